"""Filling containers of fixed capacity with items of varying length.

Pattern packing by non-negative least squares. Only the histogram of lengths, in bins of a few tokens, comes to the driver:
its size is bounded by the capacity, whatever the number of items. There every pattern of few items whose bins fill a
container exactly is a column, the histogram is the right-hand side, and the fitted repeat counts are rounded down. What
is left of the histogram is packed by best fit, again as patterns with repeat counts, so the plan covers every item.

Spark then carries the plan out: items are ranked within their bin (within salted parts of it, then offset by the parts
before, so a bin with a third of all items is not one task), and a range join with the small plan turns a rank into a
container. Lengths are rounded up to the bin's edge when planned, so a container can never overflow.

Defined results: an item longer than the capacity is cut into full containers and one rest, no other item is cut; items
without length (null, zero, negative) are in no container; repeated rows are separate items; equal lengths are ranked by
id; an empty table gives no containers; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.storage import written

#: Tokens per bin of the histogram.
BIN = 8
#: Items per pattern that are enumerated; patterns of more items come from the residuals.
PATTERN_ITEMS = 3
#: Items of one bin that are ranked in one task.
RANKED_ROWS = 50_000


@dataclass(frozen=True)
class Pattern:
    """Containers of one kind: `bins` are the (rounded) lengths of its items in units, `repeats` how many there are."""

    bins: tuple[int, ...]
    repeats: int


def exact_patterns(bins: list[int], units: int, most: int) -> np.ndarray:
    """Every multiset of at most `most` bins that adds up to `units`, one row each, filled with zeros."""
    present = np.zeros(units + 1, bool)
    present[bins] = True
    rows = [np.array([[units] + [0] * (most - 1)])] if present[units] else []
    small = [b for b in bins if b < units]
    for k in range(2, most + 1):
        heads = np.array(list(combinations_with_replacement(small, k - 2)), int).reshape(-1, k - 2) if k > 2 else np.zeros((1, 0), int)
        for b in small:  # b is the second largest, the largest is what is left
            base = heads[(heads <= b).all(1)]
            last = units - b - base.sum(1)
            ok = (last >= b) & (last < units)
            ok[ok] = present[last[ok]]
            if ok.any():
                found = np.column_stack([last[ok], np.full(ok.sum(), b), base[ok]])
                rows.append(np.pad(found, ((0, 0), (0, most - k))))
    return np.concatenate(rows) if rows else np.zeros((0, most), int)


def nonnegative_least_squares(patterns: np.ndarray, counts: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, A's column of a pattern counting its bins (active set method)."""
    n, m = len(patterns), len(counts)
    x = np.zeros(n)
    if not n:
        return x
    scale = max(counts.max(), 1)
    b = counts / scale
    active: list[int] = []
    columns = np.zeros((m, 0))

    def column(p: int) -> np.ndarray:
        c = np.zeros(m)
        np.add.at(c, patterns[p][patterns[p] > 0], 1)
        return c

    inside = np.zeros(n, bool)
    for _ in range(rounds * m):
        residual = b - columns @ x[active]
        padded = residual.copy()
        padded[0] = 0
        gain = padded[patterns].sum(1)
        gain[inside] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        active.append(best)
        inside[best] = True
        columns = np.column_stack([columns, column(best)])
        while True:
            z = np.linalg.solve(columns.T @ columns + 1e-9 * np.eye(len(active)), columns.T @ b)
            if (z > 1e-12).all():
                x[active] = z
                break
            now = x[active]
            bad = z <= 1e-12
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            x[active] = now + step * (z - now)
            drop = [i for i, p in enumerate(active) if x[p] <= 1e-12]
            for i in drop:
                x[active[i]] = 0
                inside[active[i]] = False
            keep = [i for i in range(len(active)) if i not in set(drop)]
            active = [active[i] for i in keep]
            columns = columns[:, keep]
            if not active:
                break
    return x * scale


def best_fit(counts: np.ndarray, units: int) -> list[Pattern]:
    """All of a histogram packed: the largest bin left, then again and again the largest that still fits."""
    left, out = counts.copy(), []
    while left.any():
        free, bins, used = units, [], np.zeros_like(left)
        while True:
            fits = np.nonzero((left - used)[: free + 1] > 0)[0]
            if not len(fits):
                break
            b = int(fits[-1])
            bins.append(b)
            used[b] += 1
            free -= b
        repeats = int((left[used > 0] // used[used > 0]).min())
        left -= repeats * used
        out.append(Pattern(tuple(bins), repeats))
    return out


def plan(counts: np.ndarray, most: int = PATTERN_ITEMS) -> list[Pattern]:
    """Patterns that use up `counts` (index: length in units, the last one a full container) exactly."""
    units = len(counts) - 1
    patterns = exact_patterns([int(b) for b in np.nonzero(counts)[0] if b], units, most)
    repeats = np.floor(nonnegative_least_squares(patterns, counts.astype(float)) + 1e-6).astype(int)
    left, out = counts.copy(), []
    for p in np.argsort(-repeats, kind="stable"):
        bins, used = tuple(int(v) for v in patterns[p] if v), np.zeros_like(left)
        np.add.at(used, list(bins), 1)
        n = min(int(repeats[p]), int((left[used > 0] // used[used > 0]).min()))
        if n > 0:
            left -= n * used
            out.append(Pattern(bins, n))
    return out + best_fit(left, units)


def plan_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, first container, items of the bin per container)."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for p in patterns:
        for b in sorted(set(p.bins)):
            each = p.bins.count(b)
            lo = taken.get(b, 0)
            taken[b] = lo + each * p.repeats
            rows.append((b, lo, taken[b], container, each))
        container += p.repeats
    return rows


def pieces(sizes: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """(item, part, start, size): items as they are put into containers, longer ones cut at the capacity."""
    n = F.col(size).cast("bigint")
    cut = sizes.where(n > 0).select(F.col(item_id).alias("item"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / capacity) - 1)).alias("part"))
    return cut.select("item", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, item_id: str, size: str, capacity: int = 2048, bin_width: int = BIN) -> DataFrame:
    """(container_id, item, part, start, size) for every piece of every item; `sizes` should be a stored table."""
    if capacity % bin_width:
        raise ValueError("the bin width must divide the capacity")
    spark, units = sizes.sparkSession, capacity // bin_width
    items = pieces(sizes, item_id, size, capacity).withColumn("bin", F.ceil(F.col("size") / bin_width).cast("int"))
    counts = np.zeros(units + 1, int)
    for r in items.groupBy("bin").count().collect():  # at most `units` rows
        counts[r["bin"]] = r["count"]
    patterns = plan(counts)
    slots = spark.createDataFrame(plan_rows(patterns), "bin int, lo bigint, hi bigint, first bigint, each bigint")

    salts = int(counts.max() // RANKED_ROWS) + 1
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item", "part"), F.lit(salts)).cast("int"))
    before = W.partitionBy("bin").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("bin", "salt").agg(F.count("*").alias("n")).select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("bin", "salt").orderBy("item", "part")) - 1
    ranked = salted.withColumn("own", own).join(offsets, ["bin", "salt"]).withColumn("rank", F.col("own") + F.col("offset"))
    placed = ranked.join(F.broadcast(slots), "bin").where("rank >= lo and rank < hi")
    return placed.select((F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("container_id"), "item", "part", "start", "size")


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per container: its pieces, and how full it is. A container holds at most `capacity` pieces."""
    piece = F.struct("item", "part", "start", "size")
    rows = packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("used"), F.array_sort(F.collect_list(piece)).alias("items"))
    return rows.withColumn("fill", F.col("used") / capacity)


def stored_sizes(counts: DataFrame) -> DataFrame:
    """Sizes written once: the histogram and the assignment must see the same ones, and they are costly to count."""
    return written(counts, "sizes")
