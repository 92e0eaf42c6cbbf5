"""Labels and distances counted in tasks: the same as by joins, on maps that are cut into tiles too, with little shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from reactionloom.operators import drawing as D
from reactionloom.operators import labels as L


def drawn(spark, seed: int, n: int, wide: float):
    r = random.Random(seed)
    place = lambda: (round(r.uniform(-wide / 4, wide), 1), round(r.uniform(-wide / 3, wide / 2), 1))
    kinds = ("metabolite", "metabolite", "midmarker", "multimarker", None)
    nodes, segs = [], []
    for m, some in ((1, n), (2, n // 5), (3, 3), (4, 1)):
        at = [place() for _ in range(some)]
        at[: some // 9] = at[some // 9 : 2 * (some // 9)]  # some on one spot
        nodes += [(m, i, kinds[i % 5], r.choice([None, "x", "glc__D_c", "a_long_name_of_some_compound_c"]) if i % 5 < 2 else None, *p) for i, p in enumerate(at)]
        for i in range(some):
            a, b = r.sample(range(some), 2) if some > 1 else (0, 0)
            if r.random() < 0.5:  # near ones and axis-parallel ones too
                b = min(range(some), key=lambda k: abs(at[k][0] - at[a][0]) if k != a else 1e9)
            c = lambda: {"x": r.uniform(-wide / 4, wide), "y": r.uniform(0, wide / 2)} if r.random() < 0.3 else None
            b1 = c()
            segs.append((m, 1000 * m + i, "r", str(a), f" {b}.0", b1, b1 and c()))
    nodes = spark.createDataFrame(nodes, "map_id long, node_id long, node_type string, bigg_id string, x double, y double")
    raw = spark.createDataFrame(segs * 2, "map_id long, seg_id long, rid string, from_node_id string, to_node_id string, b1 struct<x:double,y:double>, b2 struct<x:double,y:double>")
    return nodes.localCheckpoint(), D.segments(raw, nodes).localCheckpoint()


@pytest.mark.parametrize("tile,wide,n", [(10_000, 3_000, 300), (20, 6_000, 400), (5, 40_000, 400)])
def test_counts_are_those_of_joins(spark, monkeypatch, tile, wide, n):
    monkeypatch.setattr(L, "TILE_NODES", tile)
    nodes, segs = drawn(spark, 7 + tile, n, wide)
    points = nodes.where("node_type = 'metabolite'")
    boxes = D.label_boxes(points, "bigg_id")
    inner = boxes.select("map_id", "node_id", *[(F.col(k) + d).alias(k) for k, d in (("left", 3), ("top", 3), ("right", -3), ("bottom", -3))])
    off = F.when(F.col("node_type") == "metabolite", 34.0).otherwise(11.0)
    want = {"n_overlaps": D.box_overlaps(inner), "n_labels": D.labels_on_nodes(boxes, nodes, off, 34.0), "n_on_edges": D.labels_on_edges(boxes, segs), "d2": D.min_separation(points)}
    want = {k: {r[0]: r[1] for r in df.collect()} for k, df in want.items()}
    rows = {r["map_id"]: r for r in D.whole_scorecard(nodes, segs).collect()}
    for m, row in rows.items():
        assert row["min_separation_ratio"] == want["d2"][m]
        assert [row[k] for k in ("label_overlaps", "label_on_node", "label_on_edge")] == [float(want[k].get(m, 0)) for k in ("n_overlaps", "n_labels", "n_on_edges")]
    assert set(rows) == set(want["d2"]) and rows[1]["label_on_edge"] and rows[1]["label_on_node"]


def test_all_measures_together_shuffle_little(spark, tmp_path):
    """Bytes of shuffle, dropped or not, for each byte of nodes and segments shuffled once; nothing is broadcast for being small."""
    nodes, segs = drawn(spark, 3, 1_000, 6_000)
    status = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        nodes.repartition("map_id", "node_id").write.parquet(f"{tmp_path}/n")
        segs.drop("rid").repartition("map_id", "n1").write.parquet(f"{tmp_path}/s")
        own, before = shuffled() - before, shuffled()
        D.whole_scorecard(nodes, segs).count()
        print("shuffled", (shuffled() - before) / own)
        assert shuffled() - before < 4 * own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
