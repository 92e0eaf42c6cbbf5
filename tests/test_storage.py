import glob
import time

from pyspark.sql import functions as F

from reactionloom.operators import drawing as D
from reactionloom.storage import RELEASE, written


def shuffle_files(spark) -> set[str]:
    return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))


def left(spark, before: set[str]) -> set[str]:
    """Shuffle files since `before`; they are dropped in the background."""
    until = time.time() + 10
    while (files := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return files


def test_shuffle_files_are_dropped_once_a_table_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(RELEASE, None)
    df = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table = written(df, "test", release=True)
    assert spark.conf.get(RELEASE, None) == setting and not left(spark, before)
    assert table.count() == 7 and table.agg(F.sum("n")).first()[0] == 10_000


def test_the_whole_scorecard_keeps_no_shuffle_files_of_its_steps(spark):
    n = [(1, i, "metabolite", f"m{i}_c", float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1000, 1000), (0, 1000), (1000, 0), (510, 500), (525, 500)])]
    nodes = spark.createDataFrame(n, "map_id long, node_id long, node_type string, bigg_id string, x double, y double")
    rows = [(1, 1, "a", "0", "1", None, None), (1, 2, "b", "2", "3", None, None)]
    raw = spark.createDataFrame(rows, "map_id long, seg_id long, rid string, from_node_id string, to_node_id string, b1 struct<x:double,y:double>, b2 struct<x:double,y:double>")
    before = shuffle_files(spark)
    D.whole_scorecard(nodes, D.segments(raw, nodes))
    assert not left(spark, before)


def test_a_query_of_many_steps_gives_back_the_drivers_memory(spark):
    from reactionloom.llm.value_queries import p4_matches

    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    assert p4_matches(spark, "/root/testdata/sf0.001").count() > 0
    assert whole() - before >= 4
