"""Containers hold every token once, never too many, and hardly more than needed."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reactionloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=120))
def test_plan_uses_every_item(sizes):
    counts = np.bincount(sizes, minlength=17) if sizes else np.zeros(17, int)
    plan = P.plan(counts)
    used = np.zeros(17, int)
    for p in plan:
        assert sum(p.bins) <= 16 and p.repeats > 0
        np.add.at(used, list(p.bins), p.repeats)
    assert (used == counts).all()


def test_exact_patterns_against_brute_force():
    got = {tuple(sorted(int(v) for v in row if v)) for row in P.exact_patterns([2, 3, 5, 8, 10], 10, 3)}
    bins = [2, 3, 5, 8, 10]
    brute = {t for n in (1, 2, 3) for t in __import__("itertools").combinations_with_replacement(bins, n) if sum(t) == 10}
    assert got == brute


def check(spark, rows, capacity, **more):
    sizes = P.stored_sizes(spark.createDataFrame(rows, "doc_id string, n long, item int, size string"))
    packed = P.pack(sizes, "doc_id", "n", capacity, **more).collect()
    fill = {}
    for r in packed:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert all(0 < v <= capacity for v in fill.values())
    assert sum(fill.values()) == sum(n for _, n, *_ in rows if n and n > 0)
    parts = {}
    for r in packed:
        parts.setdefault(r["item"], []).append((r["start"], r["size"]))
    return fill, parts


def test_pack_long_null_tied_and_repeated(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", rng.randrange(1, 60), 0, "") for i in range(400)] + [("long", 300, 0, ""), ("none", None, 0, ""), ("zero", 0, 0, ""), ("d0", 7, 0, ""), ("d0", 7, 0, ""), ("full", 64, 0, "")]
    fill, parts = check(spark, rows, 64, bin_width=2)
    starts = sorted(parts["long"])
    assert [s for s, _ in starts] == [0, 64, 128, 192, 256] and sum(n for _, n in starts) == 300
    assert "none" not in parts and "zero" not in parts
    assert sum(fill.values()) / (64 * len(fill)) > 0.95


def test_a_bin_that_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_ROWS", 20)
    check(spark, [(f"d{i}", 20, 0, "") for i in range(300)] + [("x", 24, 0, "")], 64, bin_width=4)


def test_empty_table(spark):
    fill, _ = check(spark, [], 64, bin_width=2)
    assert fill == {}
    sizes = spark.createDataFrame([], "doc_id string, n long")
    assert P.containers(P.pack(sizes, "doc_id", "n", 64, 2), 64).collect() == []
