"""Orphan references and nested documents on small inputs with the corner cases."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from reactionloom.operators.nested import Collection, flatten, parsed
from reactionloom.operators.orphans import filter_blocks, orphan_references, orphan_report, probed_references
from reactionloom.sources.escher import map_objects, read_maps

D = dt.datetime
CHILD = "map_id long, seg_id long, a string, b string, drawn timestamp_ntz, loaded int"
PARENT = "map_id long, node_id long, since timestamp_ntz, until timestamp_ntz, seg_id int, word int"


def orphans(spark, children, parents, **more):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    found = orphan_references(c, p, group="map_id", row_id="seg_id", fields=["a", "b"], at="drawn", parent_key="node_id", since="since", until="until", **more)
    return sorted(tuple(r) for r in found.collect())


def test_reasons_spellings_copies_and_clashing_columns(spark):
    t = D(2024, 3, 5)
    parents = [(1, 7, D(2024, 1, 1), None, 0, 0), (1, 8, D(2024, 1, 1), D(2024, 2, 1), 0, 0), (1, 8, D(2024, 4, 1), None, 0, 0), (1, 9, D(2024, 4, 1), None, 0, 0), (1, 9, D(2024, 4, 1), None, 0, 0), (2, 10, D(2024, 1, 1), None, 0, 0), (1, 11, None, None, 0, 0)]
    children = [
        (1, 1, "7", "\t007.00 ", t, 1), (1, 1, "7", "\t007.00 ", t, 2), (1, 2, " 8", "8.0", t, 1), (1, 2, " 8", "8.0", t, 2),
        (1, 3, "9", None, t, 1), (1, 4, "10", "", t, 1), (1, 5, "x", "  ", t, 1), (1, 6, "7", "9", None, 1),
        (None, 7, "7", "", t, 1), (1, 8, "99999999999999999999999", "11", t, 1),
    ]
    expected = sorted(
        [(1, 2, "a", "deleted", "2024-03"), (1, 2, "b", "deleted", "2024-03"), (1, 3, "a", "late", "2024-03"), (1, 4, "a", "missing", "2024-03"), (1, 5, "a", "missing", "2024-03"), (1, 6, "a", "deleted", None), (1, 6, "b", "deleted", None), (None, 7, "a", "missing", "2024-03"), (1, 8, "a", "missing", "2024-03"), (1, 8, "b", "deleted", "2024-03")],
        key=str,
    )
    for more in ({}, {"blocks": 1}, {"blocks": 101, "broadcast_bytes": 0}, {"per_task": 1}):
        c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
        got = orphan_references(c, p, group="map_id", row_id="seg_id", fields=["a", "b"], at="drawn", parent_key="node_id", since="since", until="until", **more)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_empty_tables_and_report(spark):
    t = D(2024, 3, 5)
    assert orphans(spark, [], [(1, 7, t, None, 0, 0)]) == []
    assert orphans(spark, [(1, 1, "7", "8", t, 0)], []) == [(1, 1, "a", "missing", "2024-03"), (1, 1, "b", "missing", "2024-03")]
    rows = spark.createDataFrame([(1, 1, "a", "late", "2024-03"), (2, 2, "a", "late", "2024-03")], "group long, row long, field string, reason string, period string")
    assert [tuple(r) for r in orphan_report(rows).collect()] == [("a", "late", "2024-03", 2, 2)]


def test_against_every_parent_row(spark):
    rng = random.Random(17)
    day = lambda: None if rng.random() < 0.1 else D(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    parents = [(rng.randrange(3), rng.randrange(6), day(), day(), 0, 0) for _ in range(60)]
    children = [(rng.randrange(3), i, str(rng.randrange(8)), str(rng.choice([2, 2, 2, 3])), day(), 0) for i in range(200)]
    want = []
    for m, row, a, b, t, _ in children:
        for field, ref in (("a", int(a)), ("b", int(b))):
            own = [p for p in parents if p[0] == m and p[1] == ref]
            if not any(t and s and s <= t and (u is None or t < u) for _, _, s, u, _, _ in own):
                late = own and t and all(s and s > t for _, _, s, _, _, _ in own)
                want.append((m, row, field, "missing" if not own else "late" if late else "deleted", t and t.strftime("%Y-%m")))
    for more in ({}, {"per_task": 5}):
        assert sorted(orphans(spark, children, parents, **more), key=str) == sorted(want, key=str)


def test_the_filter_settles_as_much_at_any_size(spark):
    """Nine of ten references have no parent. The filter of 64 times the parents settles them as well as that of one time."""
    shares = []
    for load in (1, 16, 64):
        rows = spark.range(500 * load).select(F.lit(1).alias("group"), F.col("id").alias("key"))
        refs = spark.range(20_000).select(F.lit(1).alias("group"), F.when(F.col("id") % 10 == 0, F.pmod("id", F.lit(500))).otherwise(-1 - F.col("id")).alias("key"))
        probed = probed_references(refs, rows, broadcast_bytes=1 << 15)  # the two larger ones are not broadcast
        shares.append(probed.where("not may_exist").count() / 20_000)
        assert probed.where("may_exist and key >= 0").count() == 2_000
    assert min(shares[1:]) > shares[0] - 0.002 and shares[0] > 0.89 and max(shares) <= 0.9  # one in a hundred passes by chance
    assert filter_blocks(0) == 1 and filter_blocks(10**9) * 4096 >= 16 * 10**9


BODY = {"reactions": {"R1": {"bigg_id": "R1", "segments": {"s1": {"from_node_id": "1"}, "s2": {}}, "metabolites": {"a_c": -1, "b_c": 2.5}}, "R2": {"segments": None, "metabolites": []}}, "nodes": [{"node_id": "1", "x": 1.5}, {"node_id": "2", "x": 2, "tags": [{"bigg_id": "t"}]}, {"x": 1}, None]}


def objects(spark, payloads):
    texts = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, record string")
    return {tuple(r) for r in map_objects(read_maps(texts)).collect()}


def test_map_shapes(spark):
    plain = {("reaction", "", "R1"), ("reaction", "", "R2"), ("segment", "R1", "s1"), ("segment", "R1", "s2"), ("metabolite", "R1", "a_c"), ("metabolite", "R1", "b_c"), ("node", "", "1"), ("node", "", "2"), ("node", "", "")}
    text = json.dumps([{}, BODY])
    got = objects(spark, [text, json.dumps({"header": {}, "body": BODY}), json.dumps(text), text + "]}", text[:-9], "", None, "null", "[1]", '"x"', text + text])
    for i in (0, 1, 2):
        assert {r[1:] for r in got if r[0] == i} == plain
    assert {r for r in got if r[0] > 2} == {(i, "broken", "", "") for i in (3, 4, 5, 9, 10)}


def test_long_and_empty_inputs(spark):
    many = {"nodes": {str(i): {"x": i} for i in range(20_000)}}
    got = objects(spark, [json.dumps([{}, many]), json.dumps([{}, {}]), json.dumps([{}, {"nodes": {}, "reactions": None}])])
    assert len(got) == 20_000
    assert objects(spark, []) == set()


def test_merged_schema_links_and_values(spark):
    texts = spark.createDataFrame([(1, json.dumps([{}, BODY])), (2, json.dumps([{}, {"nodes": {"9": {"x": 3, "extra": "e"}}}]))], "raw_id long, payload string")
    maps = read_maps(texts)
    nodes = maps.table("nodes")
    assert {r["f_x"] for r in nodes.collect()} == {1.5, 2.0, 1.0, 3.0}
    assert "f_extra" in nodes.columns and "nodes.tags" in maps.levels
    segments = maps.table("reactions.segments")
    parents = maps.table("reactions").select(F.col("record"), F.col("path").alias("parent_path"))
    assert segments.join(parents, ["record", "parent_path"]).count() == segments.count() == 2
    values = {r["key"]: r["f__value"] for r in maps.table("reactions.metabolites").collect()}
    assert values == {"a_c": "-1", "b_c": "2.5"}


def test_twelve_levels_give_twelve_tables(spark):
    value = {"n": 12}
    for i in range(11, 0, -1):
        value = {"n": i, "below": [value, {"n": -i}]}
    texts = spark.createDataFrame([(1, json.dumps({"below": [value]}))], "k long, t string")
    flat = flatten(*parsed(texts, "k", "t"), F.col("doc"), (), array_key="n")
    names = [".".join(["below"] * i) for i in range(1, 13)]
    assert sorted(flat.levels) == sorted(["", *names])
    assert sorted(r["key"] for r in flat.table(names[11]).collect()) == ["-11", "12"]
    assert flat.table(names[5]).where("f_n = 6").first()["parent_path"] == "/below/0" + "/below/0" * 4


def test_repeated_names_count_last(spark):
    got = objects(spark, ['[{}, {"nodes": {"1": {"x": 1}, "2": {"x": 2, "x": 3}}, "reactions": {}, "reactions": {"R": {}}}]'])
    assert got == {(0, "node", "", "1"), (0, "node", "", "2"), (0, "reaction", "", "R")}


def test_more_fields_than_columns(spark):
    texts = spark.createDataFrame([(1, json.dumps({"rows": [{f"f{i}": i for i in range(9)} | {"g": [{"n": 1}, {"n": 2}], "h": [{"n": 3}]}]}))], "k long, t string")
    flat = flatten(*parsed(texts, "k", "t"), F.col("doc"), (Collection("rows", "f0"),), array_key="n", max_fields=5)
    rows = flat.table("rows").select(F.try_variant_get("f__rest", "$.f8", "int")).collect()
    assert [tuple(r) for r in rows] == [(8,)]
    assert sorted((r["collection"], r["key"], r["f_n"]) for r in flat.table("rows.*").collect()) == [("g", "1", 1), ("g", "2", 2), ("h", "3", 3)]


def test_other_trees(spark):
    texts = spark.createDataFrame([(1, '{"orders": [{"id": 5, "lines": [{"n": 1}, {"n": 2}]}]}')], "k long, t string")
    documents, broken = parsed(texts, "k", "t")
    flat = flatten(documents, broken, F.col("doc"), (Collection("orders", "id"),), array_key="n")
    assert [(r["parent_path"], r["key"]) for r in flat.table("orders.lines").orderBy("ordinal").collect()] == [("/orders/0", "1"), ("/orders/0", "2")]
