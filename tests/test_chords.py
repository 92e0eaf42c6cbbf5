"""Crossings counted by sorting against every pair compared."""

import itertools

import numpy as np
import pytest

from reactionloom.operators import chords as K
from reactionloom.operators import drawing as D


def compared(ends, parent):
    n = len(ends)
    i, j = np.triu_indices(n, 1)
    d = K.Drawn(np.zeros(n, int), np.arange(n), *ends.T, np.full(n, 400.0), parent or 400.0)
    cross = K._crossing(d, i, j)
    return int((cross & d.meet(i, j) if parent else cross).sum())


def drawings():
    rng = np.random.default_rng(5)
    for n, scale in itertools.product((2, 30, 240), (1, 100, 2_000, 40_000)):
        points = np.round(rng.uniform(-scale, 3 * scale, (n, 2)), 1)
        yield np.round(rng.uniform(-3 * scale, 3 * scale, (n, 4)), 1)
        yield rng.integers(0, 6, (n, 4)).astype(float) * scale  # many on one line, through one point and equal
        yield np.concatenate([points[rng.integers(0, n, n)], points[rng.integers(0, n, n)]], 1)


@pytest.mark.parametrize("parent", [None, 400.0])
@pytest.mark.parametrize("side", [400.0, 50.0])
def test_count_equals_all_pairs(parent, side):
    for ends in drawings():
        n = len(ends)
        if np.abs(ends).max() > 20_000 and side < 400:
            continue
        both = K.batch_crossings(np.repeat([3, 8], n), np.arange(2 * n), *np.concatenate([ends, ends]).T, np.full(2 * n, side), np.full(2 * n, -K._ALL), np.full(2 * n, K._ALL), parent)
        assert set(both.values()) == {compared(ends, parent)}


@pytest.mark.parametrize("exact", [True, False])
def test_parts_of_a_large_map_and_no_rows_for_pairs(spark, exact, monkeypatch):
    monkeypatch.setattr(K, "PART_ROWS", 40)
    ends = np.round(np.random.default_rng(2).uniform(-3_000, 3_000, (300, 4)), 1)
    rows = [(m, 1_000 * m + i, *map(float, e)) for m, size in ((1, 300), (2, 20), (3, 1)) for i, e in enumerate(ends[:size])]
    df = D.crossings(spark.createDataFrame([*rows, (1, 9_999, None, 0.0, 1.0, 1.0)], "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"), exact)
    assert {r["map_id"]: r["n_crossings"] for r in df.collect()} == {m: compared(ends[:size], None if exact else 400.0) for m, size in ((1, 300), (2, 20))}
    # The pairs that cross are never rows: no join of the segments with themselves.
    assert "seg_p" not in df._jdf.queryExecution().toString()


def test_labels_under_edges_with_few_and_many_first(spark):
    rng = np.random.default_rng(4)
    boxes = spark.createDataFrame([(1, i, x, y, x + 60, y + 25) for i, (x, y) in enumerate(rng.uniform(0, 2_000, (60, 2)).tolist())], "map_id long, node_id long, left double, top double, right double, bottom double")
    lines = [(1, i, int(i), int(i) + 1, *e, None, None) for i, e in enumerate(rng.uniform(0, 2_000, (40, 4)).tolist())]
    segs = spark.createDataFrame(lines, "map_id long, seg_id long, n1 long, n2 long, x1 double, y1 double, x2 double, y2 double, b1 struct<x:double,y:double>, b2 struct<x:double,y:double>")
    want = D.labels_met(boxes, D.ink(segs)).count()
    assert 0 < want < 60
    for first in (2, 15, 500):
        assert [tuple(r) for r in D.labels_on_edges(boxes, segs, first).collect()] == [(1, want)]
