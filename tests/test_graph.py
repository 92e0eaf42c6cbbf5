"""Components, ranks and layers against brute force."""

import random

from reactionloom.operators.graph import components, connected, cycles_condensed, layer_crossings, layers
from reactionloom.operators import ranks
from reactionloom.operators.ranks import linear_percentiles, ranked


def brute(links):
    groups = []
    for u, v in links:
        near = [g for g in groups if u in g or v in g]
        groups = [g for g in groups if g not in near] + [set().union({u, v}, *near)]
    return {n: min(g) for g in groups for n in g}


def test_connected_against_union_of_sets(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (99, 99)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    got = connected(spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(links) and len(got) == len(brute(links))
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_stay_within_a_model(spark):
    edges = spark.createDataFrame([("m", "a", "b"), ("m", "c", "b"), ("n", "b", "d"), ("n", "e", "e"), ("m", "a", "b")], "model_id string, u string, v string")
    got = sorted(tuple(r) for r in components(edges).collect())
    assert got == [("m", "a", "a"), ("m", "b", "a"), ("m", "c", "a"), ("n", "b", "b"), ("n", "d", "b"), ("n", "e", "e")]


def test_ranks_of_a_split_group(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("b", 2)], "k string, i long")
    got = ranked(rows, ["k"], ["i"], per_task=7).collect()
    assert sorted(r["rank"] for r in got if r["k"] == "hot") == list(range(50))
    assert sorted((r["i"], r["rank"]) for r in got if r["k"] == "b") == [(1, 0), (2, 1)]


def graph(spark, edges):
    return spark.createDataFrame([("m", u, v) for u, v in edges], "model_id string, u string, v string")


def test_layers_over_all_edges_do_not_depend_on_names(spark):
    # z -> a -> b -> c -> a is entered from z and left to d; one more edge leads back into the cycle, one goes round it.
    edges = [("z", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("z", "e"), ("y", "y"), ("e", "f"), ("f", "e")]
    want = {"z": 0, "a": 1, "b": 1, "c": 1, "d": 2, "e": 3, "f": 3, "y": 0}
    assert {r["node"]: r["layer"] for r in layers(graph(spark, edges)).collect()} == want
    other = dict(zip("zabcdefy", "adzyxwbc", strict=True))
    renamed = layers(graph(spark, [(other[u], other[v]) for u, v in edges])).collect()
    assert {r["node"]: r["layer"] for r in renamed} == {other[n]: k for n, k in want.items()}


def test_cycles_against_reachability(spark):
    rng = random.Random(14)
    edges = {(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(34)}
    reach = {e for e in edges if e[0] != e[1]}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    want = {a: min(b for b in {x for p in reach for x in p} if b == a or (a, b) in reach and (b, a) in reach) for a, b in reach if (b, a) in reach and a != b}
    assert {r["node"]: r["component"] for r in cycles_condensed(graph(spark, edges)).collect()} == want and want


def test_crossings_against_pairs(spark):
    rng = random.Random(15)
    rows = list({("m", rng.randrange(2), str(rng.randrange(30)), str(rng.randrange(30)), False) for _ in range(120)})
    want = {}
    for i, (_, k, a, b, _) in enumerate(rows):
        for _, q, c, d, _ in rows[i + 1 :]:
            if k == q and (a < c and b > d or c < a and d > b):
                want[k] = want.get(k, 0) + 1
    got = layer_crossings(spark.createDataFrame(rows, "model_id string, from_layer int, a string, b string, flat boolean")).collect()
    assert {r["from_layer"]: r["n_crossings"] for r in got} == want


def test_percentiles_within_a_bracket(spark, monkeypatch):
    """Groups above the limit are bracketed; the percentiles stay those of all values, ties and nulls included."""
    monkeypatch.setattr(ranks, "SMALL", 100)
    rng = random.Random(16)
    rows = [("a", rng.gauss(0, 1)) for _ in range(9_000)] + [("b", float(rng.randrange(5))) for _ in range(6_000)] + [("c", float(i)) for i in range(7)] + [("a", None), ("d", None)]
    got = {r["g"]: r for r in linear_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p0": 0.0, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p0", 0.0), ("p100", 1.0)):
            at = q * (len(v) - 1)
            low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert abs(r[name] - (low + (at - int(at)) * (high - low))) < 1e-12
