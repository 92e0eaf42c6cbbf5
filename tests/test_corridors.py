import numpy as np
from pyspark.sql import functions as F

from reactionloom.operators import corridors as C
from reactionloom.operators import drawing as D

NODES = "map_id long, node_id long, node_type string, x double, y double"
SEGS = "map_id long, seg_id long, rid string, n1 long, n2 long, curved boolean, x1 double, y1 double, x2 double, y2 double"


def drawing(spark, n_nodes=120, n_segs=240, seed=3):
    """A crowded map with a hub, reactions of several segments, segments of none, curved ones and nodes without a place; and a small map."""
    rng = np.random.default_rng(seed)
    kinds = ["metabolite", "midmarker", "multimarker", None]
    nodes, segs = [], []
    for m, n, k in ((1, n_nodes, n_segs), (2, 12, 20)):
        x, y = rng.integers(0, 6000, n) / 10, rng.integers(0, 4000, n) / 10
        at = [(None, None) if i % 17 == 5 else (float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        nodes += [(m, i, kinds[int(rng.integers(0, 4)) if i else 0], *at[i]) for i in range(n)]
        for s in range(k):
            a, b = (0 if s % 9 == 0 else int(rng.integers(0, n))), int(rng.integers(0, n))
            segs.append((m, 1000 * m + s, None if s % 11 == 7 else f"R{s // 3}", a, b, s % 5 == 4, *at[a], *at[b]))
    return spark.createDataFrame(segs, SEGS), spark.createDataFrame(nodes, NODES)


def test_as_with_listed_hits_and_no_hit_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_NODES", 20)
    segs, nodes = drawing(spark)
    want = D.unrelated_hits(D.edges_through_nodes(segs.where(~F.col("curved")), nodes, D.node_radius(), D.node_owners(segs)), segs, nodes)
    got = C.unrelated_edges(segs, nodes, D.node_radius(), 30.0)
    rows = lambda df: sorted(tuple(r[c] for c in ("map_id", "seg_id", "node_id")) for r in df.collect())
    found = rows(got)
    assert found == rows(want) and len({r[0] for r in found}) == 2 and len(found) > 200
    assert C._parts(nodes).first()["bounds"]


def test_the_query_shuffles_no_hit(spark, data):
    from reactionloom.plans.pieces import edge_through_unrelated

    plan = edge_through_unrelated(spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert 0 < plan.find("MapInArrow") < plan.find("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange")


def test_cells_as_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    n, s = 400, 300
    node = np.stack([rng.random(n) * 900, rng.random(n) * 900, rng.choice([30.0, 11.0, 6.0], n)], axis=1)
    ends = rng.integers(0, n, (s, 2))
    ends[:5, 1] = ends[:5, 0]
    seg = np.concatenate([node[ends[:, 0], :2], node[ends[:, 1], :2]], axis=1)
    rid = rng.integers(-1, 80, s)

    def found():
        part = C.Part(np.arange(n), np.arange(n) % 3 == 0, node, ends, rid, np.ones(s, bool), seg, np.zeros(0, int), np.zeros(0, int))
        return sorted((i, j) for nodes, counts, segs in part.hits() for i, j in zip(np.repeat(nodes, counts), segs, strict=True))

    owners = {(v, r) for (a, b), r in zip(ends, rid, strict=True) if r >= 0 for v in (a, b)}
    touch = {r: {v for v, q in owners if q == r and v % 3 == 0} for _, r in owners}
    of = {v: {r for w, r in owners if w == v} for v in range(n)}
    related = lambda v, r: any(r == q or touch[r] & touch[q] for q in of[v])
    hit = C._through(node[:, :1] - seg[:, 0], node[:, 1:2] - seg[:, 1], seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1], node[:, 2:])
    want = [(i, j) for i, j in zip(*np.nonzero(hit), strict=True) if rid[j] < 0 or not related(i, rid[j])]
    assert found() == want
    monkeypatch.setattr(C, "ONE_CELL", 0)
    assert found() == want
    monkeypatch.setattr(C, "CHUNK", 1)
    assert found() == want
