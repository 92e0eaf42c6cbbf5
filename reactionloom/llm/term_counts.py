"""Occurrences and record counts of every distinct term, kept up to date by signed deltas.

The state is a persistent table in two parts, both partitioned by a hash bucket: the elements (which term each element of
each record holds, by which delivery) and the counts per term. Each part of a bucket is a list of runs, written one after
the other. A batch of added, changed or deleted elements is compared only with the stored elements of the records it
names; that gives signed changes of occurrences and of records per term, aggregated before they move. The batch's elements
and the changes of the counts are appended as new runs of the buckets they fall into, so what is written follows the
batch. A bucket with ``MOST_RUNS`` runs is merged into one run, and where buckets have outgrown ``BUCKET_ROWS`` the state
is written anew with more of them, so the rows of a bucket, which are what a batch reads, stay bounded.

A manifest names the runs of every bucket, a number of rows bounded by buckets times runs. It is written last. Everything
before it goes to folders of the attempt, so a batch that fails changes nothing and can be applied again.

Rows are spread by ``REBALANCE`` when written, which splits a bucket that outgrows a task. No term, record or group is
ever collected: sums combine on the map side, so a term or record with a third of all rows costs one row per task.

Defined results: an element is (field, record, element); of all its deliveries, in whatever batch and order they come, the
newest by `at` counts, null being oldest; of equally new ones the greater term, and a deletion before an addition of the
same term. A deleted element stays known, so an older delivery does not bring it back. A null term is no term, but its
record counts in the field's total; a record with a null key is a record like others; repeated rows and repeated batches
count once; a deletion of an element that is not there changes nothing; empty batches and an empty state are allowed;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.storage import new_path

#: Buckets that a new state begins with, rows of a bucket before there are more, and runs of a bucket before they are merged.
BUCKETS, BUCKET_ROWS, MOST_RUNS = 8, 2_000_000, 8
_KEYS = ["field", "record", "element"]
_COUNT_KEYS = ["field", "term", "is_total"]
_SCHEMA = {
    "elements": "field string, record string, element string, at string, term string, deleted boolean",
    "counts": "field string, term string, is_total boolean, occurrences bigint, records bigint",
}
#: What a bucket of each part is the hash of.
_PLACED_BY = {"elements": ["field", "record"], "counts": ["field", "term"]}
_MANIFEST = "part string, bucket int, at int, run string, n bigint, buckets int"


def changes(rows: DataFrame, field: str, record: list[str], element: list[str], term, at, deleted=None) -> DataFrame:
    """Rows of any table as changes (field, record, element, term, at, deleted) for `TermCounts.apply`."""
    key = lambda names: F.to_json(F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names]))
    return rows.select(
        F.lit(field).alias("field"),
        key(record).alias("record"),
        key(element).alias("element"),
        term.cast("string").alias("term"),
        at.cast("string").alias("at"),
        (F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).alias("deleted"),
    )


def _newest(rows: DataFrame) -> DataFrame:
    """One row for each element: the delivery that counts."""
    best = rows.groupBy(*_KEYS).agg(F.max(F.struct("at", "term", "deleted")).alias("v"))
    return best.select(*_KEYS, "v.at", "v.term", "v.deleted")


def _summed(rows: DataFrame) -> DataFrame:
    total = [F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")]
    return rows.groupBy(*_COUNT_KEYS).agg(*total).where("occurrences <> 0 or records <> 0")


class TermCounts:
    """Counts under `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "term-counts"), buckets
        self.bucket_rows, self.most_runs = bucket_rows, most_runs
        #: Part -> bucket -> its runs as (folder of the attempt, rows).
        self.runs: dict[str, dict[int, list[tuple[str, int]]]] = {"elements": {}, "counts": {}}
        self.batch = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, batch: int, **more) -> TermCounts:
        """The state after that many batches; a batch of a higher number that failed is not seen."""
        state = cls(spark, path, **more)
        state.batch = batch
        for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{batch}").orderBy("part", "bucket", "at").collect():
            state.buckets = r["buckets"]
            if r["run"]:
                state.runs[r["part"]].setdefault(r["bucket"], []).append((r["run"], r["n"]))
        return state

    def _bucket(self, part: str):
        return F.pmod(F.xxhash64(*_PLACED_BY[part]), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, only: set[int] | None = None) -> DataFrame:
        held = [f"{self.path}/{part}/{run}/bucket={b}" for b, runs in sorted(self.runs[part].items()) if only is None or b in only for run, _ in runs]
        if not held:
            return self.spark.createDataFrame([], _SCHEMA[part])
        return self.spark.read.schema(_SCHEMA[part]).parquet(*held)

    def _write(self, part: str, rows: DataFrame, run: str) -> dict[int, int]:
        """The rows as one run of each bucket they fall into; gives the rows of each."""
        path = f"{self.path}/{part}/{run}"
        rows.withColumn("bucket", self._bucket(part)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        folder = self.spark.read.schema(f"{_SCHEMA[part]}, bucket int").parquet(path)
        return {r["bucket"]: r["n"] for r in folder.groupBy("bucket").agg(F.count("*").alias("n")).collect()}

    def _append(self, part: str, rows: DataFrame, run: str) -> None:
        for bucket, n in self._write(part, rows, run).items():
            self.runs[part].setdefault(bucket, []).append((run, n))
        full = {b for b, runs in self.runs[part].items() if len(runs) > self.most_runs}
        if full:
            self._replace(part, full, f"{run}-merged")

    def _replace(self, part: str, buckets: set[int], run: str) -> None:
        merged = {"elements": _newest, "counts": _summed}[part](self._read(part, buckets))
        sizes = self._write(part, merged, run)
        for b in buckets:
            self.runs[part].pop(b)
        self.runs[part].update({b: [(run, n)] for b, n in sizes.items()})

    def _grow(self, run: str) -> None:
        """More buckets, once those there are hold twice their rows on average: seldom, as the state has to double for it."""
        for part in ("elements", "counts"):
            n = sum(n for runs in self.runs[part].values() for _, n in runs)
            if n <= 2 * self.bucket_rows * self.buckets:
                continue
            old = {p: self._read(p) for p in ("elements", "counts")}
            self.buckets = -(-n // self.bucket_rows)
            merged = {"elements": _newest(old["elements"]), "counts": _summed(old["counts"])}
            self.runs = {p: {b: [(f"{run}-grown", k)] for b, k in self._write(p, rows, f"{run}-grown").items()} for p, rows in merged.items()}
            return

    def apply(self, batch: DataFrame) -> TermCounts:
        """The state with one batch of changes merged. `self` stays as it was, so a batch that fails can be applied again."""
        after = TermCounts(self.spark, self.path, self.buckets, self.bucket_rows, self.most_runs)
        after.runs = {part: {b: list(runs) for b, runs in held.items()} for part, held in self.runs.items()}
        after.batch = self.batch + 1
        after._merge(batch, f"{after.batch}-{uuid.uuid4().hex}")
        return after

    def _merge(self, batch: DataFrame, run: str) -> None:
        path = f"{self.path}/batches/{run}"
        _newest(batch).withColumn("bucket", self._bucket("elements")).write.parquet(path)
        new = self.spark.read.schema(f"{_SCHEMA['elements']}, bucket int").parquet(path)
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}

        old = self._read("elements", touched)
        if self.runs["elements"]:
            old = old.join(new.select("field", "record").distinct(), ["field", "record"], "left_semi")
        # Each element of the records that the batch names, before and after it: the newest of what was and of what is.
        both = old.withColumn("was", F.lit(True)).unionByName(new.drop("bucket").withColumn("was", F.lit(False)))
        held = F.struct("at", "term", "deleted")
        each = both.groupBy(*_KEYS).agg(F.max(F.when(F.col("was"), held)).alias("before"), F.max(held).alias("after"))
        there = lambda c: (F.col(c).isNotNull() & ~F.col(f"{c}.deleted"))
        side = lambda c, was: F.when(there(c), F.struct(F.col(f"{c}.term").alias("term"), F.lit(was).alias("was"), F.lit(1 - was).alias("is")))
        held = each.select("field", "record", F.explode(F.array_compact(F.array(side("before", 1), side("after", 0)))).alias("s")).select("field", "record", "s.*")

        per_record = held.groupBy("field", "record", "term").agg(F.sum("was").alias("was"), F.sum("is").alias("is"))
        sign = (F.when(F.col("is") > 0, 1).otherwise(0) - F.when(F.col("was") > 0, 1).otherwise(0)).cast("bigint")
        values = [(F.col("is") - F.col("was")).alias("occurrences"), sign.alias("records")]
        terms = per_record.where(F.col("term").isNotNull()).select("field", "term", F.lit(False).alias("is_total"), *values)
        totals = per_record.groupBy("field", "record").agg(F.sum("was").alias("was"), F.sum("is").alias("is"))
        totals = totals.select("field", F.lit("").alias("term"), F.lit(True).alias("is_total"), *values)
        self._append("counts", _summed(terms.unionByName(totals)), run)
        self._append("elements", new.drop("bucket"), run)
        self._grow(run)
        rows = [(part, b, i, name, n, self.buckets) for part, held in self.runs.items() for b, runs in held.items() for i, (name, n) in enumerate(runs)]
        manifest = self.spark.createDataFrame(rows or [("elements", 0, 0, None, 0, self.buckets)], _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{self.batch}")

    def counts(self) -> DataFrame:
        """(field, term, occurrences, records) of every term that occurs."""
        return _summed(self._read("counts")).where(~F.col("is_total")).select("field", "term", "occurrences", "records")

    def totals(self) -> DataFrame:
        """(field, n_records): all records of a field, also those without a term. One row per field."""
        return _summed(self._read("counts").where("is_total")).select("field", F.col("records").alias("n_records"))

    def marked(self, rare: int, common: float) -> DataFrame:
        """`counts` with `mark`: rare in at most `rare` records, else common in more than the share `common`, else null."""
        share = F.col("records") > F.col("n_records") * common
        mark = F.when(F.col("records") <= rare, "rare").when(share, "common")
        return self.counts().join(F.broadcast(self.totals()), "field").withColumn("mark", mark).drop("n_records")


def count_in_batches(spark: SparkSession, batches: list[DataFrame]) -> TermCounts:
    """The state after the batches, each applied to the state that is opened from what the one before has left."""

    def step(state: TermCounts, batch: DataFrame) -> TermCounts:
        done = state.apply(batch)
        return TermCounts.open(spark, done.path, done.batch)

    return reduce(step, batches, TermCounts(spark))
