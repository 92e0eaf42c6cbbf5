"""Small cases of the core operators with answers known by hand or by brute force."""

import json
from itertools import combinations

from pyspark.sql import functions as F

from reactionloom.functions import text as T
from reactionloom.functions.chemistry import atoms, compartment, species
from reactionloom.operators import drawing as D
from reactionloom.operators import evaluation as E
from reactionloom.operators import graph as H
from reactionloom.operators import network as N
from reactionloom.sinks.maps import write_lines
from reactionloom.sources import models as S
from reactionloom.streaming import resumable
from reactionloom.storage import new_path


def test_ids_and_formulas(spark):
    rows = spark.createDataFrame([("M_glc__D_c", "C6H12O6"), ("atp[m]", "C10H12N5O13P3"), ("x", ""), (None, None)], "i string, f string")
    got = rows.select(species(F.col("i")), compartment(F.col("i")), *[atoms(F.col("f"), e) for e in "CHNOP"]).collect()
    assert [tuple(r) for r in got] == [("glc__D", "c", 6, 12, 0, 6, 0), ("atp", "m", 10, 12, 5, 13, 3), ("x", "", 0, 0, 0, 0, 0), (None, None, 0, 0, 0, 0, 0)]


def test_captions(spark):
    raw = [("S_Sugar : acids &amp; more", "Sugar - acids & more"), ("  a__b ", "a b"), ("12 :", ""), (None, None)]
    got = spark.createDataFrame(raw, "raw string, want string").select(T.caption(F.col("raw")).alias("got"), "want").collect()
    assert all(r["got"] == (r["want"] or "") for r in got)
    stems = spark.createDataFrame([("a/b: c",), ("x" * 80 + "1",), ("x" * 80 + "2",)], "n string").select(T.file_stem(F.col("n"))).collect()
    assert stems[0][0] == "a_b_c" and stems[1][0] != stems[2][0] and len(stems[1][0]) == 60


def test_classes_and_patterns(spark):
    rows = spark.createDataFrame([("Sugar acids",), ("Transport of sugar",), ("misc",), (None,)], "n string")
    assert [r[0] for r in rows.select(T.superclass(F.col("n"))).collect()] == ["Carbohydrates", "Transport", None, None]
    assert [r[0] for r in rows.select(T.matches(F.col("n"), "*sugar")).collect()] == [False, True, False, False]
    assert [r[0] for r in rows.select(T.matches(F.col("n"), "ACID")).collect()] == [True, False, False, False]


def test_phrases(spark):
    row = spark.createDataFrame([("Beta oxidation of the very-long chain",)], "n string").select(T.phrases(T.tokens(F.col("n")))).first()[0]
    assert "beta oxidation" in row and "very-long chain" in row and "oxidation very-long chain" in row and "the" not in row


STOICH = "model_id string, rid string, pos int, metabolite_id string, coefficient double"
METS = "model_id string, metabolite_id string, met_row long, name string, formula string, loaded_at int"


def test_main_pair_prefers_the_backbone(spark):
    entries = [("pyr_c", -1), ("coa_c", -1), ("nad_c", -1), ("accoa_c", 1), ("co2_c", 1), ("nadh_c", 1)]
    formulas = {"pyr_c": "C3H3O3", "coa_c": "C21H32N7O16P3S", "nad_c": "C21H26N7O14P2", "accoa_c": "C23H34N7O17P3S", "co2_c": "CO2", "nadh_c": "C21H27N7O14P2"}
    stoich = spark.createDataFrame([("m", "PDH", i, k, float(c)) for i, (k, c) in enumerate(entries)], STOICH)
    mets = spark.createDataFrame([("m", k, i, k, f, 0) for i, (k, f) in enumerate(formulas.items())], METS)
    flat = N.degrees(stoich).withColumn("score", F.lit(0.0))
    scores = flat.withColumn("score", F.when(species(F.col("metabolite_id")).isin("coa", "nad", "nadh", "co2"), 1.0).otherwise(0.0))
    best = N.main_pairs(N.candidate_pairs(stoich, mets, scores)).first()
    assert (best["substrate"], best["product"]) == ("pyr_c", "accoa_c")


def test_transport_without_skeleton(spark):
    stoich = spark.createDataFrame([("m", "PIt", 0, "pi_e", -1.0), ("m", "PIt", 1, "h_e", -1.0), ("m", "PIt", 2, "pi_c", 1.0), ("m", "PIt", 3, "h_c", 1.0)], STOICH)
    mets = spark.createDataFrame([("m", "pi_e", 1, "p", "HO4P", 0), ("m", "h_e", 2, "h", "H", 0), ("m", "pi_c", 3, "p", "HO4P", 0), ("m", "h_c", 4, "h", "H", 0)], METS)
    scores = N.degrees(stoich).withColumn("score", F.lit(0.0))
    best = N.main_pairs(N.candidate_pairs(stoich, mets, scores)).first()
    assert (best["substrate"], best["product"]) == ("pi_e", "pi_c")
    assert N.transport_flags(stoich).first()["moved"] == "h pi"


def square(spark, points):
    return spark.createDataFrame([(1, i, "metabolite", f"m{i}_c", float(x), float(y)) for i, (x, y) in enumerate(points)], "map_id long, node_id long, node_type string, bigg_id string, x double, y double")


def test_crossings_and_separation(spark):
    nodes = square(spark, [(0, 0), (100, 100), (0, 100), (100, 0), (500, 500), (500, 500)])
    rows = [(1, 1, "a", "0", " 01.0 ", None, None), (1, 2, "b", "2", "3", None, None), (1, 2, "b", "2", "3", None, None), (1, 3, "c", "0", "2", None, None), (1, 4, "d", "0", "99", None, None)]
    segs = D.segments(spark.createDataFrame(rows, "map_id long, seg_id long, rid string, from_node_id string, to_node_id string, b1 string, b2 string"), nodes)
    assert segs.count() == 3
    straight = segs.where(~F.col("curved"))
    assert [tuple(r) for r in D.crossings(straight).collect()] == [(1, 1)]
    assert D.min_separation(nodes).first()["min_separation_ratio"] == 100 / 180
    assert D.axis_aligned(straight).first()["n_aligned"] == 1


def test_node_overlaps_against_all_pairs(spark):
    points = [(i * 37 % 400, i * 91 % 300) for i in range(60)]
    nodes = square(spark, points)
    none = spark.createDataFrame([], "map_id long, n1 long, n2 long")
    got = sorted((r["a"], r["b"]) for r in D.node_overlaps(nodes, none).collect())
    want = [(i, j) for (i, p), (j, q) in combinations(enumerate(points), 2) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 < 1600]
    assert got == want


def test_every_node_has_its_radius(spark):
    kinds = [(0, "metabolite", 0, 0), (1, "metabolite", 1000, 0), (2, "metabolite", 300, 25), (3, "midmarker", 500, 10), (4, "midmarker", 600, 12), (5, "multimarker", 700, 5), (6, "multimarker", 800, 7), (7, "midmarker", 400, 0), (8, "metabolite", 340, 60)]
    nodes = spark.createDataFrame([(1, i, k, float(x), float(y)) for i, k, x, y in kinds], "map_id long, node_id long, node_type string, x double, y double")
    rows = [(1, 1, "a", 0, 1, False, 0.0, 0.0, 1000.0, 0.0), (1, 2, "a", 7, 8, True, 400.0, 0.0, 340.0, 60.0)]
    segs = spark.createDataFrame(rows, "map_id long, seg_id long, rid string, n1 long, n2 long, curved boolean, x1 double, y1 double, x2 double, y2 double")
    straight = segs.where(~F.col("curved"))
    hit = lambda owners: sorted(r["node_id"] for r in D.edges_through_nodes(straight, nodes, D.node_radius(), owners).collect())
    assert hit(None) == [2, 3, 5, 7] and hit(D.node_owners(segs)) == [2, 3, 5]
    assert [(r["a"], r["b"]) for r in D.node_overlaps(nodes, segs, D.node_radius()).collect()] == [(2, 8)]


def test_a_map_that_fails_on_crossings_and_labels(spark):
    nodes = square(spark, [(0, 0), (1000, 1000), (0, 1000), (1000, 0), (510, 500), (525, 500)])
    rows = [(1, 1, "a", "0", "1", None, None), (1, 2, "b", "2", "3", None, None)]
    raw = spark.createDataFrame(rows, "map_id long, seg_id long, rid string, from_node_id string, to_node_id string, b1 struct<x:double,y:double>, b2 struct<x:double,y:double>")
    card = D.whole_scorecard(nodes, D.segments(raw, nodes)).first()
    assert {c: card[c] for c in ("crossings_per_edge", "longest_run_ratio", "label_overlaps", "label_on_node", "label_on_edge")} == {"crossings_per_edge": 0.5, "longest_run_ratio": 0.0, "label_overlaps": 1.0, "label_on_node": 2.0, "label_on_edge": 1.0}
    failed = {r["metric"] for r in D.in_band(D.long_scores(D.whole_scorecard(nodes, D.segments(raw, nodes)), D.TARGETS), D.TARGETS).collect() if not r["within"]}
    assert {"crossings_per_edge", "label_overlaps", "label_on_node", "label_on_edge", "min_separation_ratio"} <= failed


def test_statistics(spark):
    pairs = spark.createDataFrame([("g", a, b) for a, b in [(5, 1), (4, 2), (3, 3), (1, 3), (9, 1), (7, 6), (2, 1)]], "g string, a int, b int")
    r = E.rank_biserial(E.signed_ranks(pairs, "g", "a", "b"), "g").first()
    assert r["n"] == 6 and r["w_pos"] == 21 - 3.5 and abs(r["effect"] - (17.5 - 3.5) / 21) < 1e-12
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert {x["k"]: x["p_holm"] and round(x["p_holm"], 6) for x in E.holm(tests, "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06, "d": None}
    assert abs(spark.range(1).select(E.two_sided(F.lit(1.959964))).first()[0] - 0.05) < 1e-6


def test_graph_loops(spark):
    edges = spark.createDataFrame([("m", str(i), str(i + 1)) for i in range(1, 7)] + [("m", "x", "y"), ("n", "1", "2")], "model_id string, u string, v string")
    comp = {(r["model_id"], r["node"]): r["component"] for r in H.components(edges).collect()}
    assert comp[("m", "7")] == "1" and comp[("m", "y")] == "x" and comp[("n", "2")] == "1"
    start = spark.createDataFrame([("m", "1")], "model_id string, node string")
    dist = {r["node"]: r["distance"] for r in H.distances(edges, start).collect()}
    assert dist == {str(i): i - 1 for i in range(1, 8)}
    assert max(r["distance"] for r in H.distances(edges, start, 2).collect()) == 2
    assert {r["node"]: r["layer"] for r in H.layers(edges.where("model_id = 'm' and u <> 'x'")).collect()}["7"] == 6


def test_layers_keep_back_edges(spark):
    edges = spark.createDataFrame([("m", "a", "c"), ("m", "c", "b"), ("m", "b", "a"), ("m", "e", "d"), ("m", "d", "c"), ("m", "f", "f")], "model_id string, u string, v string")
    layer = H.turned_layers(edges)
    assert {r["node"]: r["layer"] for r in layer.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 0}
    assert {(r["u"], r["v"]): r["reversed"] for r in H.turned(edges).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): True, ("c", "d"): True, ("d", "e"): True}
    proper = H.proper_edges(H.turned(edges), layer)
    assert sorted((r["from_layer"], r["a"], r["b"]) for r in proper.collect()) == [(0, "a", "a>c@1"), (0, "a", "b"), (1, "a>c@1", "c"), (1, "b", "c"), (2, "c", "d"), (3, "d", "e")]


def test_rings_of_every_length(spark):
    ring = [("m", f"c{i:02}", f"c{(i + 1) % 8:02}") for i in range(8)]
    long = [("n", f"c{i:02}", f"c{(i + 1) % 14:02}") for i in range(14)] + [("o", f"c{i:02}", f"c{(i + 1) % 15:02}") for i in range(15)]
    more = [("m", "c05", "c03"), ("m", "c01", "c06"), ("m", "c07", "x"), ("m", "a", "c00"), ("m", "c00", "c00"), ("m", "c01", "c00")]
    edges = spark.createDataFrame(ring + long + more, "model_id string, u string, v string")
    got = sorted((r["model_id"], r["size"], r["cycle"]) for r in N.rings(edges).collect())
    names = [f"c{i:02}" for i in range(14)]
    assert got == [("m", 3, "c03 c04 c05"), ("m", 4, "c00 c01 c06 c07"), ("m", 8, " ".join(names[:8])), ("n", 14, " ".join(names))]


def test_model_files(spark, tmp_path):
    model = {"id": "m", "reactions": [{"id": "R1", "name": "r", "metabolites": {"b_c": 1, "a_c": -1.5}, "lower_bound": 0}], "metabolites": [{"id": "a_c", "name": "a", "compartment": "c", "charge": None}]}
    (tmp_path / "m1.json").write_text(json.dumps(model, indent=1))
    (tmp_path / "bad.json").write_text("{broken")
    models = S.read_models(spark, str(tmp_path / "*.json"))
    assert {r["model_id"]: r["broken"] for r in models.collect()} == {"m1": False, "bad": True}
    assert [tuple(r) for r in S.model_stoich(models).orderBy("pos").collect()] == [("m1", "R1", 0, "a_c", -1.5), ("m1", "R1", 1, "b_c", 1.0)]
    assert S.model_reactions(models).first()["lower_bound"] == 0 and S.model_metabolites(models).count() == 1


def test_pathway_drawings_lookups_and_selections(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<pathway><reaction id="1" name="rn:R1 rn:R2" type="x"><substrate id="2" name="cpd:C2"/><product id="3" name="cpd:C1"/></reaction></pathway>')
    assert sorted(tuple(r)[1:] for r in S.drawn_pairs(spark, str(tmp_path / "p.xml")).collect()) == [("R1", "C1", "C2"), ("R2", "C1", "C2")]
    (tmp_path / "l.tsv").write_text("R1\tGlycolysis\nR1\tTCA\nR1\tGlycolysis\n1.1.1.1\tOther\n")
    lookup = S.read_lookup(spark, str(tmp_path / "l.tsv"))
    assert sorted(tuple(r) for r in lookup.where("identifier = 'R1'").collect()) == [("R1", 0, "Glycolysis"), ("R1", 1, "TCA")]
    ids = spark.createDataFrame([("a", 1, 0, "1.1.1.1"), ("a", 0, 0, "R9"), ("a", 0, 1, "R1"), ("b", 0, 0, "R9")], "rid string, priority int, pos int, identifier string")
    assert [tuple(r) for r in S.first_match(ids, lookup).collect()] == [("a", "Glycolysis")]
    (tmp_path / "s.txt").write_text("A B\n  C\nA\n")
    assert sorted(r[0] for r in S.read_selection(spark, str(tmp_path / "s.txt")).collect()) == ["A", "B", "C"]


def test_resumed_run_counts_only_what_is_new(spark, tmp_path):
    rows, state = spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), new_path(spark, "test")
    for want in ({"a": 2, "b": 1}, {"a": 4, "b": 2}, None):
        if want:
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            last = want
        resumable.increments(spark, str(tmp_path / "in"), rows.schema, ["k"], state)
        assert {r["k"]: r["n"] for r in resumable.totals(spark, state).collect()} == last


def test_lines_are_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "map_id long, id long, line string")
    write_lines(lines, str(tmp_path / "out"), ["id"])
    parts = sorted((tmp_path / "out" / "map_id=1").glob("*.txt"))
    assert "".join(p.read_text() for p in parts).split() == ["a", "b", "c"]
