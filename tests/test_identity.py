"""Compounds, boundary, captions and drawn pieces on cases worked out by hand."""

from pyspark.sql import functions as F

from reactionloom.functions import text as T
from reactionloom.operators import drawing as D
from reactionloom.operators import identity as I
from reactionloom.operators import naming as G
from reactionloom.operators import network as N
from reactionloom.sources import models as M

METS = "model_id string, metabolite_id string, name string, formula string, charge int, compartment string, other int"
CASES = [
    ("atp_c", "whatever", None, None, "c", "atp", "atp", "id"),
    ("MAM01371c", "ATP [cytosol]", None, None, "c", "MAM01371", "atp", "name"),
    ("s_0434", "ATP C10H12N5O13P3", "C10H16N5O13P3", None, "cytoplasm", "name:atp|C10H16N5O13P3", "atp", "name"),
    ("o2s_c", "superoxide", "O2", -1, "c", "o2s", None, None),
    ("M_xx[m]", "", "O2", 0, "m", "xx", "o2", "formula"),
    ("yy(e)", None, "O2", None, "e", "yy", "o2", "formula"),
    ("irona_c0", None, "Fe", 3, "c0", "irona", "fe3", "charged"),
    ("ironb_c0", None, "Fe", None, "c0", "ironb", None, None),
    ("glucose", "Glucose_e", "C6H12O6", None, "e", "name:glucose|C6H12O6", None, None),
    ("h2o_e", "Water", "HO", -1, "e", "h2o", "h2o", "id"),
    ("w1_c", "water", "HO", -1, "c", "w1", None, None),
]


def known(spark):
    rows = [("m", i, n, f, q, c, 1) for i, n, f, q, c, *_ in CASES] + [("k", "atp_c", "ATP", None, None, "c", 1), ("k", "h2o_c", "water", None, None, "c", 1)]
    return I.based(spark.createDataFrame(rows, METS))


def test_identity_and_currency(spark):
    x, fixed = known(spark), I.fixed_vocabulary(spark)
    got = {r["metabolite_id"]: (r["currency"], r["evidence"]) for r in I.currency(x, fixed.unionByName(I.learned_names(x, fixed))).where("model_id = 'm'").collect()}
    assert {r["metabolite_id"]: r["species"] for r in x.where("model_id = 'm'").collect()} == {c[0]: c[5] for c in CASES}
    assert got == {c[0]: (c[6], c[7]) for c in CASES if c[6]}


def test_references_count_unless_contradicted(spark):
    vocabulary = I.fixed_vocabulary(spark).unionByName(spark.createDataFrame([("kegg", "C00007", "o2", None), ("seed", "cpd00009", "pi", None)], "kind string, value string, key string, charge int"))
    x = I.based(spark.createDataFrame([("m", "a_c", None, "O2", -1, "c", 1), ("m", "b_c", None, "HO4P", -2, "c", 1), ("m", "d_c", None, "O2", 0, "c", 1), ("m", "cpd00009_c", None, None, None, "c", 1)], METS))
    refs = spark.createDataFrame([("m", "a_c", "kegg", 0, "C00007"), ("m", "b_c", "seed", 0, "cpd00009"), ("m", "d_c", "chebi", 0, "1")], "model_id string, metabolite_id string, kind string, pos int, value string")
    got = {r["metabolite_id"]: r["currency"] for r in I.currency(x, vocabulary, refs).collect()}
    assert got == {"b_c": "pi", "cpd00009_c": "pi"}  # a_c is contradicted, d_c is said to be something else


def test_boundary(spark):
    stoich = [("R1", "nadh_c", -1.0), ("R1", "nad_c", 1.0), ("R1", "h_c", 1.0), ("R2", "glc_c", -1.0), ("R2", "adp_c", 1.0), ("R3", "glc_c", -1.0), ("R3", "pyr_c", 1.0), ("R4", "glc_c", -1.0), ("EX_a", "glc_e", -1.0), ("EX_a", "pyr_e", 1.0), ("R5", "glc_c", -1.0), ("R5", "pyr_c", 1.0), ("R6", "glc_c", -1.0), ("R6", "pyr_c", 1.0), ("R7", "MAM1c", -1.0), ("R7", "pyr_c", 1.0)]
    s = spark.createDataFrame([("m", r, m, c) for r, m, c in stoich], "model_id string, rid string, metabolite_id string, coefficient double")
    r = spark.createDataFrame([("m", i, "SBO:0000629" if i == "R5" else None, 1 if i == "R6" else 0) for i in ("R1", "R2", "R3", "R4", "EX_a", "R5", "R6", "R7", "R8")], "model_id string, rid string, sbo string, objective int")
    flags = lambda *more: {x["rid"] for x in N.boundary_flags(r, s, *more).where("boundary").collect()}
    # Energy metabolism (R1) has currency on both sides and is no boundary; R8 has no entries.
    assert flags() == {"R2", "R4", "EX_a", "R5", "R6", "R8"}
    named = spark.createDataFrame([("m", "MAM1c", "atp")], "model_id string, metabolite_id string, canonical string")
    assert flags(named) == {"R2", "R4", "EX_a", "R5", "R6", "R7", "R8"}


def test_transport_cargo_and_top_cargo(spark):
    """Antiports and symports, which the given tables do not have."""
    stoich = [("T1", "gln_e", -1.0), ("T1", "gln_c", 1.0), ("T1", "h_e", -1.0), ("T1", "h_c", 1.0), ("T2", "glc_e", -1.0), ("T2", "glc_c", 1.0), ("T2", "h_c", -1.0), ("T2", "h_e", 1.0), ("R", "h_c", 1.0), ("R", "glc_c", -1.0)]
    s = spark.createDataFrame([("m", r, m, c) for r, m, c in stoich], "model_id string, rid string, metabolite_id string, coefficient double")
    moved = N.transport_flags(s)
    assert {r["rid"]: (r["moved"], r["n_moved"]) for r in moved.collect()} == {"T1": ("gln h", 2), "T2": ("glc h", 2)}
    degree = spark.createDataFrame([("m", "gln", 1), ("m", "glc", 2), ("m", "h", 3)], "model_id string, species string, degree long")
    cargo = G.cargo(moved, degree)
    assert {r["rid"]: r["species"] for r in cargo.collect()} == {"T1": "gln", "T2": "glc"}
    assert [(r["species"], r["rank"]) for r in G.top_cargo(cargo, 1).collect()] == [("glc", 1)]


def nodes(spark, rows):
    return spark.createDataFrame([(1, i, k, b, float(x), float(y)) for i, k, b, x, y in rows], "map_id long, node_id long, node_type string, bigg_id string, x double, y double")


def lines(spark, at, rows):
    x = [(1, s, r, a, b, False, *at[a], *at[b]) for s, r, a, b in rows]
    return spark.createDataFrame(x, "map_id long, seg_id long, rid string, n1 long, n2 long, curved boolean, x1 double, y1 double, x2 double, y2 double")


def test_overlaps_and_collinear_runs(spark):
    n = nodes(spark, [(1, "metabolite", "aa_c", 0, 0), (2, "metabolite", "bb_c", 30, 0), (3, "metabolite", "cc_c", 500, 0), (4, "metabolite", "dd_c", 520, 5), (5, "metabolite", "ee_c", 100, 300), (6, "metabolite", "ff_c", 400, 300)])
    at = {r["node_id"]: (r["x"], r["y"]) for r in n.collect()}
    s = lines(spark, at, [(1, "A", 3, 4), (2, "A", 5, 6)])
    assert [tuple(r) for r in D.node_overlaps(n, s).collect()] == [(1, 1, 2)]  # 3 and 4 are joined
    assert [tuple(r) for r in D.box_overlaps(D.label_boxes(n, "bigg_id")).collect()] == [(1, 2)]
    more = lines(spark, {**at, 7: (200.0, 301.0), 8: (395.0, 301.0), 9: (396.0, 301.0), 10: (500.0, 301.0)}, [(2, "A", 5, 6), (3, "B", 7, 8), (4, "C", 9, 10)])
    assert [tuple(r) for r in D.collinear_overlaps(more).collect()] == [(1, "h", 2, 3)]


def test_related_reactions_do_not_count(spark):
    rows = [(1, "metabolite", "a", 0, 0), (2, "midmarker", None, 200, 0), (3, "midmarker", None, 100, 5), (4, "metabolite", "b", 100, 90), (5, "midmarker", None, 150, 5), (6, "midmarker", None, 60, 4)]
    n = nodes(spark, rows)
    at = {r["node_id"]: (r["x"], r["y"]) for r in n.collect()}
    # A goes from 1 to 2. Node 3 is B's, which touches the metabolite 1 too; node 5 is C's, which does not; 6 is nobody's.
    s = lines(spark, at, [(1, "A", 1, 2), (2, "B", 1, 3), (3, "C", 4, 5)])
    hits = D.edges_through_nodes(s.where("rid = 'A'"), n, D.node_radius())
    assert sorted(r["node_id"] for r in hits.collect()) == [3, 5, 6]
    assert sorted(r["node_id"] for r in D.unrelated_hits(hits, s, n).collect()) == [5, 6]


def test_primary_and_header(spark):
    n = spark.createDataFrame([(1, 1, "a_c", True), (1, 2, "a_c", False), (1, 3, "atp_c", True), (2, 4, "atp_c", True), (2, 5, "h_c", None)], "map_id long, node_id long, bigg_id string, primary boolean")
    got = {r["node_id"]: r["primary"] for r in G.unified_primary(n, F.regexp_replace("bigg_id", "_c$", ""), N.NEVER_PRIMARY).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
    drawn = spark.createDataFrame([(1, "r2"), (1, "r1"), (1, "r2")], "map_id long, rid string")
    groups = spark.createDataFrame([("P", "east", "r1", 2), ("P", "east", "r2", 1), ("P", "east", "r3", 0), ("Q", None, "r1", 1)], "name string, region string, rid string, seq int")
    assert sorted((r["name"], r["reactions"]) for r in G.pathway_header(drawn, groups).collect()) == [("P", ["r2", "r1"]), ("Q", ["r1"])]


def test_captions_labels_and_patterns(spark):
    cases = {"Transport (2): amino acids": ("Transport", "amino acids"), "Lipids (3)": ("Lipids", ""), "a: b: c": ("a", "b: c"), "": ("", "")}
    family, qualifier = G.split_caption(F.col("s"))
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", family.alias("f"), qualifier.alias("q")).collect()
    assert {r["s"]: (r["f"], r["q"]) for r in got} == cases
    for name, structural in {"Unannotated 35": True, "Others (2)": True, "cluster_7": True, "Other glycan degradation": False, "miscellaneous": True, "Lipids": False}.items():
        assert spark.range(1).select(T.structural(F.lit(name))).first()[0] is structural
    for pattern, text, hit in (("[!x]*", "yes", True), ("[!x]*", "xes", False), ("[ab]?", "ac", True), ("PP", "apple", True), ("a[", "a[", True), ("a[", "xa[y", False), ("*.?", "q.1", True)):
        assert spark.range(1).select(T.matches(F.lit(text), pattern)).first()[0] is hit, pattern
    label = lambda c, p, many, name=None, short=None: spark.range(1).select(T.display_label(F.lit(c), F.lit(p), F.lit(many), F.lit(name).cast("string"), F.lit(short).cast("string"))).first()[0]
    assert label("mal__L", "c", False, short="Mal") == "Mal" and label("mal__L", "m", True) == "mal-L[m]"
    assert label("MAM01371", "c", False, "ATP [cytosol]") == "ATP" and label("s_0434", "c", False, "x" * 40) == "x" * 27 + "…"


def test_cluster_names_prefer_what_says_more(spark):
    rows = [("m", i, "one", n) for i, n in enumerate(["bile acid kinase", "bile acid kinase", "bile acid lyase", "kinase other"])] + [("m", 10 + i, "two", "kinase") for i in range(4)] + [("m", 20 + i, "three", f"word{chr(97 + i)}") for i in range(3)]
    rows += [("m", 30 + i, None, f"zzz{chr(97 + i)}yy") for i in range(9)]
    got = G.cluster_names(spark.createDataFrame(rows, "model_id string, rid long, subsystem string, name string")).collect()
    assert {r["subsystem"]: (r["label"], r["strict"]) for r in got} == {"one": ("Bile acid kinase", True), "two": ("Kinase", True)}


WORDS = T.Classifier(
    (("Carbohydrate metabolism", ("mannose", "inositol phosphate", "nucleotide sugar")), ("Nucleotide metabolism", ("nucleotide",)), ("Lipid metabolism", ("lipid",)), ("Glycan metabolism", ("glycan",)), ("Transport and exchange", ("exchange", "transport"))),
    (("phosphatidylinositol", "Lipid metabolism"), ("o-glycan", "Glycan metabolism")),
)


def test_classifier(spark):
    cases = {
        "Extracellular exchange: amino acids and lipids": "Transport and exchange", "Lipid metabolism (2)": "Lipid metabolism", "Mannose type O-glycan biosynthesis": "Glycan metabolism",
        "Phosphatidylinositol phosphate metabolism": "Lipid metabolism", "Nucleotide sugars": "Carbohydrate metabolism", "nucleotides_salvage": "Nucleotide metabolism", "Phospholipids": "Other metabolism",
        "Unannotated 35": "Unassigned clusters", "Other glycan degradation": "Glycan metabolism", "Other metabolism": "Other metabolism", "": "Other metabolism", None: None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r["c"]: r["l"] for r in rows.select("c", WORDS.of(F.col("c")).alias("l")).collect()} == cases
    table = [(i, label, w, False) for i, (label, words) in enumerate(WORDS.labels) for w in words] + [(-1, label, w, True) for w, label in WORDS.first]
    assert set(T.Classifier.from_table(spark.createDataFrame(table, "position int, label string, keyword string, first boolean")).first) == set(WORDS.first)


def test_clusters_by_name_else_by_votes(spark):
    votes = {"Lipids": ["Glycan metabolism"] * 4, "cluster_1": ["Lipid metabolism", "Glycan metabolism", None, None], "cluster_2": ["Glycan metabolism", None, None, None, None], "cluster_3": ["Lipid metabolism", "Other metabolism", None]}
    rows = spark.createDataFrame([("m", f"{c}{i}", c, v) for c, vs in votes.items() for i, v in enumerate(vs)], "model_id string, rid string, cluster string, vote string")
    got = {r["cluster"]: (r["label"], r["voters"]) for r in G.classified_clusters(rows, WORDS).collect()}
    assert got == {"Lipids": ("Lipid metabolism", 4), "cluster_1": ("Lipid metabolism", 2), "cluster_2": ("Unassigned clusters", 1), "cluster_3": ("Lipid metabolism", 1)}


SBML = """<sbml><model id="m"><listOfSpecies><species id="M_a_c" name="A" compartment="c" charge="-1" chemicalFormula="CH2"/></listOfSpecies><listOfReactions>
<reaction id="R_one" name="One" reversible="true"><listOfReactants><speciesReference species="M_a_c" stoichiometry="2"/></listOfReactants><listOfProducts><speciesReference species="M_b_c"/><speciesReference species="M_d_c" stoichiometry="0.5"/></listOfProducts></reaction>
<reaction id="R_ex" reversible="false"><listOfReactants><speciesReference species="M_a_c"/></listOfReactants></reaction></listOfReactions></model></sbml>"""


def test_model_files_and_sbml(spark, tmp_path):
    for name in ("m1.xml", "m1.json", "m2.xml.gz", "m3.txt", "m4.sbml"):
        (tmp_path / name).write_text(SBML)
    got = {r["model_id"]: (r["file"].rsplit("/", 1)[1], r["extension"]) for r in M.model_files(spark, str(tmp_path)).collect()}
    assert got == {"m1": ("m1.json", ".json"), "m2": ("m2.xml.gz", ".xml.gz"), "m4": ("m4.sbml", ".sbml")}
    path = str(tmp_path / "m4.sbml")
    assert sorted((r["model_id"], r["rid"], r["metabolite_id"], r["coefficient"]) for r in M.sbml_stoich(spark, path).collect()) == [("m4", "ex", "a_c", -1.0), ("m4", "one", "a_c", -2.0), ("m4", "one", "b_c", 1.0), ("m4", "one", "d_c", 0.5)]
    assert [tuple(r) for r in M.sbml_metabolites(spark, path).collect()] == [("m4", "a_c", "A", "c", -1, "CH2")]


def test_lookup_selection_and_drawn_entries(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("R1\tp2\nR1\tp1\nR1\tp2\nR2\tp9\nR2\tp1\n")
    (tmp_path / "n.tsv").write_text("p1\tFirst\np2\tSecond\n")
    plain = lambda df: sorted((r["identifier"], r["pos"], r["pathway"]) for r in df.collect())
    assert plain(M.read_lookup(spark, str(tmp_path / "l.tsv"), drop=("p9",))) == [("R1", 0, "p2"), ("R1", 1, "p1"), ("R2", 0, "p1")]
    assert plain(M.read_lookup(spark, str(tmp_path / "l.tsv"), str(tmp_path / "n.tsv"))) == [("R1", 0, "Second"), ("R1", 1, "First"), ("R2", 0, "First")]
    (tmp_path / "a.txt").write_text(" R1 R2\nR1\n")
    (tmp_path / "b.json").write_text('["R3", "R4"]')
    (tmp_path / "c.json").write_text('{"reactions": ["R5"]}')
    ids = lambda name: {r["rid"] for r in M.read_selection(spark, str(tmp_path / name)).collect()}
    assert (ids("a.txt"), ids("b.json"), ids("c.json")) == ({"R1", "R2"}, {"R3", "R4"}, {"R5"})
    for organism in ("hsa", "eco"):
        (tmp_path / f"{organism}00010.xml").write_text(f'<pathway><entry id="1" name="cpd:C1" type="compound"><graphics name="{organism}" type="circle" x="5" y="6" width="8" height="8"/></entry><entry id="2" name="{organism}:7" type="gene"/></pathway>')
    assert [(r["pathway"], r["entry"], r["x"], r["y"]) for r in M.drawn_entries(spark, str(tmp_path / "*00010.xml")).collect()] == [("00010", 1, 5.0, 6.0)]


def test_trunk_links_and_inorganic_compounds(spark):
    edges = spark.createDataFrame([("m", "a", "b", 5), ("m", "a", "c", 4), ("m", "c", "b", 9), ("m", "b", "a", 3), ("n", "x", "y", 4)], "model_id string, a string, b string, weight int")
    links = lambda *more: sorted((r["model_id"], r["a"], r["b"]) for r in N.select_links(edges, 4, *more).collect())
    assert links() == [("m", "a", "b"), ("m", "a", "c"), ("m", "c", "b"), ("n", "x", "y")]
    assert links(2) == [("m", "a", "b"), ("m", "c", "b"), ("n", "x", "y")]
    classes = spark.createDataFrame([("m", "p_c", "Lipids"), ("m", "q_c", "Lipids")], "model_id string, metabolite_id string, label string")
    mets = spark.createDataFrame([("m", "p_c", "CaCl2"), ("m", "q_c", "CH4"), ("m", "r_c", "Na"), ("m", "unused", "Na")], "model_id string, metabolite_id string, formula string")
    stoich = spark.createDataFrame([("m", i) for i in ("p_c", "q_c", "r_c", "r_c")], "model_id string, metabolite_id string")
    got = {r["metabolite_id"]: r["label"] for r in G.compound_classes_with_inorganic(classes, stoich, mets).collect()}
    assert got == {"p_c": "Inorganic ions", "q_c": "Lipids", "r_c": "Inorganic ions"}
