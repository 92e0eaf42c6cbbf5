"""Batches that can be resumed: what was finished before is not done again.

A folder of files is read as a stream that ends when all present files are done; the checkpoint remembers which were. The
sums of a run are kept as one increment per batch number, written whole or not at all, so a repeated batch replaces its own
increment and nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.storage import new_path


def increments(spark: SparkSession, files: str, schema, keys: list, state: str) -> None:
    """Counts rows by `keys` over the files that match and were not counted before, as increments under `state`."""
    rows = spark.readStream.schema(schema).parquet(files)

    def keep(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{state}/increments/batch={number}")

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def totals(spark: SparkSession, state: str) -> DataFrame:
    """The sums of all increments."""
    kept = spark.read.parquet(f"{state}/increments")
    return kept.groupBy(*[c for c in kept.columns if c not in ("n", "batch")]).agg(F.sum("n").alias("n"))


def segments_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of map segments by month, counted as a resumable stream over the table's files."""
    path = f"{folder}/map_segments.parquet"
    state = new_path(spark, "stream")
    increments(spark, f"{folder}/map_segments.parque[t]", spark.read.parquet(path).schema, [F.date_format("loaded_at", "yyyy-MM").alias("month")], state)
    return totals(spark, state)
