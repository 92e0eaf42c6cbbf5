"""Tables in the folder that all executors share.

Long plans are cut by writing an intermediate table there and reading it back: the files outlive any executor, so a
later stage never has to recompute what an executor held that is gone.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Whether Spark drops the shuffle files of a query when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made for applications without the setting (local tests), by application id.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, an application with a local master gets one of its own."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        own = spark.sparkContext.applicationId
        folder = _OWN.get(own) or _OWN.setdefault(own, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back with the same schema; the new plan starts at those files.

    With `release`, the shuffle files of the plan that made it are dropped then. Else they stay until the driver collects its garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(RELEASE, before) if before is not None else spark.conf.unset(RELEASE)
    return spark.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession) -> None:
    """The driver lets go of the plans, broadcasts and shuffle files of steps that are over, and gives their memory back.

    For queries of very many small steps: else all that stays until the driver's heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
