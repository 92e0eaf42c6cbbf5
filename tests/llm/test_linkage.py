"""Windows, assignments and fields of the matching against brute force and hand-made cases."""

import random

from pyspark.sql import functions as F

from reactionloom.llm import entities as E
from reactionloom.llm import linkage as L


def total(edges):
    best = 0.0

    def go(i, a, b, s):
        nonlocal best
        best = max(best, s)
        for j in range(i, len(edges)):
            if edges[j][0] not in a and edges[j][1] not in b:
                go(j + 1, a | {edges[j][0]}, b | {edges[j][1]}, s + edges[j][2])

    go(0, frozenset(), frozenset(), 0.0)
    return best


def test_best_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(500):
        edges = [(i, j + 100, rng.choice([0.3, 0.5, 0.9, rng.random()])) for i in range(rng.randrange(1, 6)) for j in range(rng.randrange(1, 6)) if rng.random() < 0.6]
        flow = L.best_flow(*(list(x) for x in zip(*edges, strict=True)), [1] * len(edges), [1] * len(edges)) if edges else []
        keep = [e for e, units in zip(edges, flow, strict=True) if units]
        assert len({a for a, _, _ in keep}) == len({b for _, b, _ in keep}) == len(keep)
        assert abs(sum(c for *_, c in keep) - total(edges)) < 1e-9


def test_one_to_one_over_components(spark):
    edges = [(1, 11, 0.9), (1, 12, 0.8), (2, 11, 0.85), (3, 13, 0.7), (3, 13, 0.6), (4, 14, 0.7), (5, 14, 0.7)]
    got = sorted(tuple(r) for r in L.one_to_one(spark.createDataFrame(edges, "a long, b long, confidence double")).collect())
    assert got == [(1, 12, 0.8), (2, 11, 0.85), (3, 13, 0.7), (4, 14, 0.7)]
    assert L.one_to_one(spark.createDataFrame([], "a long, b long, confidence double")).collect() == []


def test_window_pairs_against_sorting(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice([1, 1, 1, 2]), rng.choice(["k", "k", str(rng.randrange(9)), None])) for i in range(120)]
    df = spark.createDataFrame(rows, "row long, side string, grp long, key string")
    got = {tuple(r) for r in L.window_pairs(df, [F.col("key"), F.reverse("key")], window=4, parts=3).collect()}
    want = set()
    for turn in (1, -1):
        order = sorted((x for x in rows if x[3] is not None), key=lambda x: (x[3][::turn], x[0]))
        for i, x in enumerate(order):
            for y in order[max(0, i - 4) : i + 5]:
                if x[1] == "a" and y[1] == "b" and x[2] == y[2]:
                    want.add((x[0], y[0]))
    assert want <= got and all(abs_ok(rows, p) for p in got)


def abs_ok(rows, pair):
    side = {r[0]: (r[1], r[2]) for r in rows}
    return side[pair[0]][0] == "a" and side[pair[1]][0] == "b" and side[pair[0]][1] == side[pair[1]][1]


def test_field_values(spark):
    rows = spark.createDataFrame([("Abc def (draft)", "mito. matrix", "M_glc__D_c", "P O15 C11 H39", "a")], "o string, p string, i string, f string, x string")
    r = rows.select(E.organism_key(F.col("o")).alias("o"), E.genus(F.lit("A. def")).alias("g"), E.place_key(F.col("p")).alias("p"), E.base_id(F.col("i")).alias("i"), *[E.element_count(F.col("f"), e).alias(e) for e in "CHNOP"]).first()
    assert tuple(r) == ("a def", None, "m", "glc__D", 11, 39, 0, 15, 1)


MODELS = [("m1", "Abcus defis"), ("m2", "Ghius klmis")]
REFS = [(1, "metabolite", "abcdefgh", ["Factor q"], ""), (2, "metabolite", "Water", [], ""), (3, "metabolite", "ijklmnop", [], ""), (4, "metabolite", "ATP", [], ""), (5, "metabolite", "ADP", [], "")]
METS = [(1, "m1", "abcd_c", "abcdefgh", "C6H10O5", 0, "c"), (1, "m1", "abcd_c", "abcdefgh", "C6H10O5", 0, "c"), (2, "m1", "ijkl_c", None, "C3H4", -1, "c"), (3, "m1", "abcd_m", "abcdefgh", "C6H10O5", 0, "m"), (4, "m2", "abcd_c", "abcdefgh", None, None, "c"), (5, "m2", "ijkl_c", "ijklmnop", "C3H4", None, "c"), (6, "m1", "zz_c", None, None, None, None)]
EXT = [(101, "ABCUS DEFIS", "Factor Q", None, None, None, "cytosol"), (102, "A. defis", None, "H5C3", 41.0, None, "[c]"), (103, "Abcus defis (draft)", "abcdefhg", "C6H10O5", None, 0, "Mitochondria"), (104, "Ghius klmis", "qqqqqqqqqq", "C40H2", 482.0, 3, "cytosol"), (105, None, None, None, None, None, None)]


def tables(spark):
    mets = spark.createDataFrame(METS, "met_row long, model_id string, metabolite_id string, name string, formula string, charge int, compartment string")
    refs = spark.createDataFrame(REFS, "ref_id long, kind string, name string, synonyms array<string>, form string")
    return mets, spark.createDataFrame(MODELS, "model_id string, organism string"), refs


def test_compounds(spark):
    mets, models, refs = tables(spark)
    ext = spark.createDataFrame(EXT, "ext_row long, organism string, title string, formula string, mass double, charge int, place string")
    got = E.match_compounds(mets, models, ext, refs).collect()
    assert sorted((r["model_row"], r["ext_row"]) for r in got) == [(1, 101), (2, 102), (3, 103)]
    assert all(0.6 <= r["confidence"] <= 1 for r in got)
    assert E.match_compounds(mets, models, ext.limit(0), refs).collect() == []


def test_reactions(spark):
    mets, models, refs = tables(spark)
    records = spark.createDataFrame([(1, "m1", "R1", "foo kinase"), (1, "m1", "R1", "foo kinase"), (2, "m2", "R1", None)], "rxn_row long, model_id string, rid string, name string")
    stoich = [("m1", "R1", 0, "abcd_c", -1.0), ("m1", "R1", 1, "h2o_c", -1.0), ("m1", "R1", 2, "ijkl_c", 2.0), ("m2", "R1", 0, "abcd_c", -1.0), ("m2", "R1", 1, "ijkl_c", 1.0), ("m2", "R1", 2, None, 1.0)]
    st = spark.createDataFrame(stoich, "model_id string, rid string, pos int, metabolite_id string, coefficient double")
    rows = [(201, "Abcus defis", "Kinase, foo", "4 ijklmnpo  +  Water <=> (2) Factor q [c]"), (202, "G. klmis", None, "abcdefgh = ijklmnop"), (203, "Abcus defis", None, "ATP -> ADP"), (204, "Abcus defis", None, None)]
    ext = spark.createDataFrame(rows, "ext_row long, organism string, title string, equation string")
    got = E.match_reactions(records, st, mets, models, ext, refs).collect()
    assert sorted((r["model_row"], r["ext_row"]) for r in got) == [(1, 201), (2, 202)]


def test_equal_keys_beyond_the_window(spark):
    rows = [(i, "a", "g", "same") for i in range(20)] + [(100 + i, "b", "g", "same") for i in range(20)] + [(200, "b", "h", "same")]
    df = spark.createDataFrame(rows, "row long, side string, grp string, k string")
    got = {(r["a"], r["b"]) for r in L.window_and_tied_pairs(df, [F.col("k")]).collect()}
    assert got == {(a, 100 + b) for a in range(20) for b in range(20)}


def flow_edges(rng, classes, most):
    n_a, n_b = ([rng.randrange(1, most) for _ in range(classes)] for _ in "ab")
    return [(i, j + 100, rng.choice([0.3, 0.5, 0.9, rng.random()]), n_a[i], n_b[j]) for i in range(classes) for j in range(classes) if rng.random() < 0.6]


def flow_total(edges):
    """The greatest total by single rows: each class taken apart."""
    import numpy as np

    rows = [(a, k) for a, n in {(e[0], e[3]) for e in edges} for k in range(n)]
    cols = [(b, k) for b, n in {(e[1], e[4]) for e in edges} for k in range(n)]
    value = {(e[0], e[1]): e[2] for e in edges}
    size = len(rows) + len(cols)
    w = np.zeros((size, size))
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(cols):
            w[i, j] = value.get((a, b), 0.0)
    # Hungarian method on the square matrix of costs.
    cost, u, v, p, way = 1 - w, [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sum(w[p[j] - 1][j - 1] for j in range(1, size + 1))


def test_flow_between_classes_is_optimal():
    rng = random.Random(11)
    for _ in range(150):
        edges = flow_edges(rng, rng.randrange(1, 5), 4)
        if edges:
            units = L.best_flow(*(list(x) for x in zip(*edges, strict=True)))
            for k, n in ((0, 3), (1, 4)):
                for c in {e[k] for e in edges}:
                    assert sum(x for x, e in zip(units, edges, strict=True) if e[k] == c) <= next(e[n] for e in edges if e[k] == c)
            assert abs(sum(x * e[2] for x, e in zip(units, edges, strict=True)) - flow_total(edges)) < 1e-9


def test_auction_is_near_the_optimum(spark):
    rng = random.Random(12)
    edges = flow_edges(rng, 6, 4)
    df = spark.createDataFrame([("k", *e) for e in edges], "kind string, a long, b long, confidence double, n_a long, n_b long")
    got = L.matched_classes(df, large=0, step=0.02).collect()
    for k, n in (("a", "n_a"), ("b", "n_b")):
        for c in {r[k] for r in got}:
            assert sum(r["units"] for r in got if r[k] == c) <= next(r[n] for r in got if r[k] == c)
    assert sum(r["units"] * r["confidence"] for r in got) >= flow_total(edges) - 0.02 * sum(r["units"] for r in got) - 1e-9


def test_full_key_of_500_and_500_and_copies(spark):
    """Every pair of a full key is compared, and a hot group of copies is one class that is paired row by row."""
    rows = [(i, "a", "g", "same", i) for i in range(500)] + [(1000 + i, "b", "g", "same", i) for i in range(500)]
    df = spark.createDataFrame(rows, "row long, side string, grp string, k string, field long")
    assert L.window_and_tied_pairs(df, [F.col("k")]).count() == 250_000
    copies = [(i, "a", "g", "same", 1) for i in range(3000)] + [(10_000 + i, "b", "g", "same", 2) for i in range(2000)] + [(3, "a", "g", "same", 1), (20_000, "b", "g", "same", 3)]
    alike, members = L.classes(spark.createDataFrame(copies, "row long, side string, grp string, k string, field long"))
    assert sorted((r["row"], r["n"]) for r in alike.collect()) == [(0, 3000), (10_000, 2000), (20_000, 1)]
    pairs = L.window_and_tied_pairs(alike, [F.col("k")])
    n = lambda s: alike.where(f"side = '{s}'").select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"))
    edges = pairs.join(n("a"), "a").join(n("b"), "b").withColumn("confidence", F.when(F.col("b") == 20_000, 0.9).otherwise(0.7))
    got = L.one_to_one(edges, members).collect()
    assert len(got) == len({r["a"] for r in got}) == len({r["b"] for r in got}) == 2001
    assert {r["b"] for r in got} == {20_000, *range(10_000, 12_000)}


def test_typed_differently_and_found_again(spark):
    """Recall on names with one slip of the keyboard, another order of the formula and another style of the place."""
    rng = random.Random(21)
    letters = "abcdefghiklmnoprstuvw"
    names = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(150)]
    slip = lambda s, i: s[:i] + s[i + 1] + s[i] + s[i + 2 :]
    mets = spark.createDataFrame([(i, "m1", f"x{i}_c", n, f"C{i % 40 + 1}H{i % 7 + 2}O{i % 3 + 1}", 0, "c") for i, n in enumerate(names)], "met_row long, model_id string, metabolite_id string, name string, formula string, charge int, compartment string")
    refs = spark.createDataFrame([(i, "metabolite", n, []) for i, n in enumerate(names)], "ref_id long, kind string, name string, synonyms array<string>")
    ext = spark.createDataFrame([(1000 + i, "A. DEFIS", slip(n, rng.randrange(10)), f"O{i % 3 + 1}H{i % 7 + 2}C{i % 40 + 1}", None, None, "cytosol") for i, n in enumerate(names)], "ext_row long, organism string, title string, formula string, mass double, charge int, place string")
    got = {(r["model_row"], r["ext_row"]) for r in E.match_compounds(mets, spark.createDataFrame(MODELS, "model_id string, organism string"), ext, refs).collect()}
    right = {(i, 1000 + i) for i in range(150)}
    assert len(got & right) >= 0.98 * len(right) and len(got - right) <= 0.01 * len(right)
