"""The scorecard of the tables' rows: the same by whole maps in tasks and by joins, with little shuffled."""

import datetime as dt
import random

import __spark_entry__ as entry
import numpy as np
import pytest

from reactionloom.operators import drawing as D
from reactionloom.operators import labels as L

NODES = "map_id long, node_id long, node_type string, bigg_id string, x double, y double, added_at timestamp_ntz, deleted_at timestamp_ntz"
SEGS = "map_id long, seg_id long, rid string, from_node_id string, to_node_id string, b1 struct<x:double,y:double>, b2 struct<x:double,y:double>"


def tables(spark, seed: int):
    """Copies, nodes drawn again, ties, nulls, values that are not finite, references without a node, maps without one of the two."""
    r = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, r.randint(1, 3))
    odd = lambda v: r.choice([None, float("nan"), float("inf")]) if odd_map and r.random() < 0.03 else v
    place = lambda: odd(r.choice([round(r.uniform(-500, 3_000), 1), 90.0 * r.randint(0, 20)]))
    nodes, segs = [], []
    for m, n in ((1, 300), (2, 60), (3, 12), (4, 3), (5, 1), (6, 0), (7, 20), (None, 10)):
        odd_map = m in (2, 7)
        for i in range(n):
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                kind = r.choice(["metabolite", "metabolite", "midmarker", "multimarker", None])
                name = r.choice([None, "", "x", "glc__D_c", "a_long_name_of_some_compound_c"]) if kind == "metabolite" else None
                nodes.append((m, None if r.random() < 0.01 else i, kind, name, place(), place(), None if r.random() < 0.05 else day(), day() if r.random() < 0.1 else None))
        control = lambda: {"x": place(), "y": place()} if r.random() < 0.4 else None
        spelled = lambda n: r.choice([f"{r.randint(0, n)}", f" {r.randint(0, n)}.0", f"00{r.randint(0, n)}", None if r.random() < 0.2 else "0"])
        for i in range((2 * n if m != 7 else 0) + 5):
            segs += [(m, i if r.random() < 0.99 else None, "r", spelled(n), spelled(n), control(), control())] * r.choice([1, 1, 2])
    nodes += r.sample(nodes, 40)
    r.shuffle(nodes)
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(segs, SEGS)


@pytest.mark.parametrize("most", [0, 60, 5_000])
def test_rows_are_those_of_joins(spark, most):
    raw_nodes, raw_segs = (df.localCheckpoint() for df in tables(spark, 11))
    nodes = D.standing_nodes(raw_nodes).localCheckpoint()
    joined = D.whole_scorecard(nodes, D.segments(raw_segs, nodes).localCheckpoint())
    exact = lambda df: {r["map_id"]: str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect()}
    want = exact(joined)
    assert exact(D.table_scorecard(raw_nodes, raw_segs, most)) == want
    assert set(want) == {1, 2, 3, 4, 5, 7} and " 0.0," not in want[1] and "n" not in want[1]


def test_rows_of_tables_are_shuffled_about_once(spark):
    """Bytes of shuffle and of tables written on the way, dropped or not, for each byte of the rows shuffled once."""
    folder = "/root/testdata/sf0.01"
    status = spark.sparkContext._jsc.sc().statusStore()

    def moved() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        for name in ("map_nodes", "map_segments"):
            spark.read.parquet(f"{folder}/{name}.parquet").drop("drawn_at", "loaded_at").repartition("map_id").foreach(lambda _: None)
        own, before = moved() - before, moved()
        rows = entry.queries()["scorecard_all"](spark, folder).count()
        print("moved", (moved() - before) / own)
        assert rows == 61 and moved() - before < 2 * own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)


def test_touching_is_told_as_by_the_sql():
    """A piece through a box's corner, as far as a tenth can be written: by the SQL's rounding it ends before the box."""
    one = lambda v: np.array([v])
    zero = np.array([0])
    box = L.Labels(zero, one(1), one(4293.6), one(752.8), one(4363.200000000001), 12.5, np.array([True]), 1)
    on = lambda y1, y2: int(box.on_edges(zero, one(2), one(3), one(25.5), one(y1), one(5929.5), one(y2))[0])
    assert (box.top[0], box.bottom[0]) == (740.3, 765.3)
    assert [on(2336.5, 128.5), on(2336.6, 128.6), on(2336.4, 128.4), on(750.0, 750.0)] == [0, 1, 0, 1]
