"""Counts after batches of additions, changes and deletions against counting from scratch."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from reactionloom.llm.term_counts import TermCounts, changes

SCHEMA = "r string, e int, v string, t int, gone boolean, term string, bucket int"


def batch(spark, rows):
    df = spark.createDataFrame([(*x, "clash", 3) for x in rows], SCHEMA)
    return changes(df, "f", ["r"], ["e"], F.col("v"), F.lpad(F.col("t").cast("string"), 5, "0"), F.col("gone"))


def expected(state):
    occurrences, records = Counter(), defaultdict(set)
    for (r, _), v in state.items():
        if v is not None:
            occurrences[v] += 1
            records[v].add(r)
    return {v: (n, len(records[v])) for v, n in occurrences.items()}, len({r for r, _ in state})


def test_random_batches(spark):
    # Small limits: runs are merged and buckets added on the way.
    small = {"bucket_rows": 8, "most_runs": 2}
    rng, state, counts, clock = random.Random(9), {}, TermCounts(spark, buckets=2, **small), 0
    for step in range(5):
        rows = []
        for _ in range(0 if step == 2 else 120):
            clock += 1
            key = (rng.choice(["hot", "hot", *"abcdefgh"]), rng.randrange(6))
            rows.append((*key, rng.choice(["x", "y", "z", "", None]), clock, rng.random() < 0.2))
        newest = {}
        for r, e, v, t, gone in rows:
            newest[(r, e)] = (v, gone)
        for key, (v, gone) in newest.items():
            state.pop(key, None)
            if not gone:
                state[key] = v
        counts = counts.apply(batch(spark, rows + rows[:10]))
        want, n = expected(state)
        for c in (counts, TermCounts.open(spark, counts.path, counts.batch, **small)):
            got = {r["term"]: (r["occurrences"], r["records"]) for r in c.counts().collect()}
            assert got == want
            assert [r["n_records"] for r in c.totals().collect()] == ([n] if n else [])
    assert counts.buckets > 2 and max(len(runs) for part in counts.runs.values() for runs in part.values()) <= 2
    assert {r["term"]: r["mark"] for r in counts.marked(2, 0.3).collect()} == {t: "rare" if k <= 2 else "common" if k > 0.3 * n else None for t, (_, k) in want.items()}


def test_deleting_everything_and_unknown_elements(spark):
    counts = TermCounts(spark, buckets=2).apply(batch(spark, [("a", 1, "x", 1, False), (None, 1, None, 1, False)]))
    assert [tuple(r) for r in counts.totals().collect()] == [("f", 2)]
    counts = counts.apply(batch(spark, [("a", 1, "x", 2, True), ("zz", 1, "x", 2, True), (None, 1, None, 3, True)]))
    assert counts.counts().collect() == [] and counts.totals().collect() == []


def terms(counts):
    return {r["term"]: (r["occurrences"], r["records"]) for r in counts.counts().collect()}


def test_older_deliveries_do_not_win(spark):
    counts = TermCounts(spark, buckets=2).apply(batch(spark, [("a", 1, "new", 5, False), ("b", 1, "gone", 5, True)]))
    counts = counts.apply(batch(spark, [("a", 1, "old", 2, False), ("b", 1, "gone", 4, False), ("c", 1, "new", None, False)]))
    assert terms(counts) == {"new": (2, 2)}
    counts = counts.apply(batch(spark, [("b", 1, "back", 6, False), ("c", 1, "newer", 1, False)]))
    assert terms(counts) == {"new": (1, 1), "back": (1, 1), "newer": (1, 1)}


def test_a_failed_batch_is_repeated(spark, monkeypatch):
    first = TermCounts(spark, buckets=2).apply(batch(spark, [("a", 1, "x", 1, False)]))
    rows = batch(spark, [("a", 1, "y", 2, False), ("b", 1, "y", 2, False)])
    append = TermCounts._append

    def fail(self, part, *more):
        append(self, part, *more)
        if part == "elements":
            raise RuntimeError("lost")

    monkeypatch.setattr(TermCounts, "_append", fail)
    for _ in range(2):
        try:
            first.apply(rows)
        except RuntimeError:
            pass
        assert terms(first) == terms(TermCounts.open(spark, first.path, 1)) == {"x": (1, 1)}
    monkeypatch.setattr(TermCounts, "_append", append)
    again = TermCounts.open(spark, first.path, 1).apply(rows)
    assert terms(again) == {"y": (2, 2)}
    assert terms(again.apply(rows)) == {"y": (2, 2)}


def test_a_small_batch_writes_little(spark):
    many = [(str(i), k, f"t{i % 50}", 1, False) for i in range(2_000) for k in range(2)]
    counts = TermCounts(spark, buckets=16).apply(batch(spark, many))
    after = counts.apply(batch(spark, [("7", 0, "other", 2, False)]))
    new = {part: sum(n for runs in held.values() for run, n in runs if run.startswith("2-")) for part, held in after.runs.items()}
    assert new == {"elements": 1, "counts": 2}
