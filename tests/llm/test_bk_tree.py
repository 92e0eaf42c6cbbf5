"""The tree and the distances against brute force; spellings; shards."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reactionloom.llm import bk_tree as B


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.text("abcd", max_size=9), max_size=14)


@settings(max_examples=150, deadline=None)
@given(words, words, st.integers(0, 3))
def test_tree_returns_every_entry_within_the_radius(entries, names, radius):
    entries = [e for e in entries if e] + ["a" * 63 + "b", "a" * 64 + "bc", "a" * 90]
    names = names + ["a" * 64 + "b", "a" * 88]
    tree = B.Tree(entries)
    q, e, d = tree.near(names, np.full(len(names), radius))
    got = sorted((int(i), tree.entries[j], int(k)) for i, j, k in zip(q, e, d, strict=True))
    expected = sorted((i, x, plain(n, x)) for i, n in enumerate(names) for x in set(entries) if plain(n, x) <= radius)
    assert got == expected


def test_spelled(spark):
    cases = {"  Kinase,\tABC-ose ": "abc ose kinase", "X_6-Phosph. (reversible)": "x 6 phosphate", "α-foo 3-P [c]": "alpha foo 3 phosphate", "Foo DH?": "foo dehydrogenase", "Β-bar - putative": "beta bar"}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", B.spelled(F.col("name")).alias("s")).collect()
    assert {r["name"]: r["s"] for r in rows} == cases


LIST = [(1, "reaction", "abcdefgh kinase", ["Trivialname enzyme"], "x"), (2, "reaction", "abcdefgh mutase", None, "x"), (3, "metabolite", "D-abcdefgh 1-phosphate", [], "x"), (4, "metabolite", "L-abcdefgh 1-phosphate", [], "x"), (5, "metabolite", "ATP", ["adenos"], "x"), (6, "metabolite", "ADP", [None], "x"), (7, "metabolite", None, None, "x")]
NAMES = {("reaction", "ABCDEFGH  Kin."): 1, ("reaction", "mutase, abcdfegh"): 2, ("reaction", "Trivialnam enzyme"): 1, ("reaction", "abcdefgh lyase"): -1, ("metabolite", "D-abcdefh 1-P"): 3, ("metabolite", "L-abcdefgh 2-phosphate"): -1, ("metabolite", "atp"): 5, ("metabolite", "AXP"): -1, ("metabolite", " "): -1, ("metabolite", "q" * 3_000): -1, ("other", "atp"): -1}


def mapped(spark, shard, references=LIST, **more):
    rows = [(k, i, n, "clash") for i, (k, n) in enumerate(NAMES)] * 2 + [("reaction", 90, None, ""), ("metabolite", 91, "ATP", "")]
    names = spark.createDataFrame(rows, "kind string, row_key long, name string, form string")
    refs = spark.createDataFrame(references, "ref_id long, kind string, name string, synonyms array<string>, form string")
    return [(r["kind"], r["name"], r["ref_id"]) for r in B.map_to_list(names, refs, shard, **more).collect()]


def test_mapping_with_one_tree_and_with_shards(spark):
    expected = sorted((k, n, r) for (k, n), r in NAMES.items())
    assert sorted(mapped(spark, B.SHARD)) == expected
    assert sorted(mapped(spark, 2)) == expected


def test_spelling_is_the_callers(spark):
    without = {(k, n): r for k, n, r in mapped(spark, B.SHARD, spelling=B.PLAIN)}
    assert without[("reaction", "ABCDEFGH  Kin.")] == -1 and without[("reaction", "mutase, abcdfegh")] == 2


def test_long_entries_against_plain():
    rng = random.Random(2)
    entries = ["".join(rng.choice("ab") for _ in range(n)) for n in (65, 70, 200)]
    names = [e[:i] + e[i + 1 :] for e in entries for i in (0, 40)] + ["", "a" * 300]
    metric = B.Metric(entries)
    codes, sizes = metric.texts(names)
    q, e = (np.array(x) for x in zip(*[(i, j) for i in range(len(names)) for j in range(3)], strict=True))
    assert metric.distances(codes, sizes, names, q, e).tolist() == [plain(names[i], entries[j]) for i, j in zip(q, e, strict=True)]


def test_empty_list(spark):
    assert {r for _, _, r in mapped(spark, B.SHARD, [])} == {-1}


def test_exhaustive_against_brute_force():
    rng = random.Random(4)
    entries = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(8, 14))) for _ in range(400)]
    names = ["".join(c if rng.random() > 0.1 else rng.choice("abcdef") for c in rng.choice(entries)) for _ in range(200)]
    refs = {e: i for i, e in enumerate(sorted(set(entries)))}
    got = B.nearest(B.Tree(entries), refs, sorted(set(names))).set_index("form")["distance"].to_dict()
    for n in set(names):
        best = min(plain(n, e) for e in entries)
        limit = 2 if len(n) >= B.TWO_EDITS else 1
        assert got.get(n) == (best if best <= limit else None)
