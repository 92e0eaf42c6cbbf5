"""Rows of two sources that describe the same thing, without a common identifier.

Rows of one side that agree in everything that is compared are one class from the start (`classes`): copies of one row,
even a third of all rows, are one thing to compare, with a number of rows.

Sorted neighbourhood over several composite keys: all classes of both sides are sorted once per key by one distributed sort
(a key is written with its pass number, so all passes are one sort), each gets its global position from its place in its
partition plus the sizes of the partitions before, and classes at most `window` positions apart are compared. The slide is
an equi-join on position blocks, so no task sees more than a few windows at once, whatever a key's frequency. Within a key
the sides are mixed; keys with more classes than are sure to be within the window are completed by a salted join.

Compared classes get a confidence from weighted field similarities over the fields that both have. Pairs above a threshold
form a graph; a pair whose both classes have no other pair is settled, the rest falls into connected components
(`operators.graph.connected`, log rounds). Components of up to ``LARGE`` pairs are solved exactly, many in one Arrow batch,
as a flow whose capacities are the numbers of rows; a larger one is solved by an auction over the cluster, whose total is
at most ``STEP`` for each matched row below the greatest. In the end the flow between two classes becomes pairs of rows.

Defined results: fields that are null on either side are left out of the weights; rows whose key of a pass is null are
not in that pass; equal confidences are decided by the smaller ids; which of several equal rows gets a partner is decided
by ranks of their ids; repeated rows count once; empty tables give no pairs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.operators.graph import connected
from reactionloom.operators.ranks import ranked
from reactionloom.storage import tidied, written

WINDOW = 12
SALTS = 16
#: Pairs of a component that one task solves; larger components go to the auction.
LARGE = 2_000
#: Least raise of a bid.
STEP = 0.01
#: Pairs that one row stands for when equal rows are paired.
CHUNK = 10_000


def positions(rows: DataFrame, keys: list[Column], parts: int, mixed: bool = False) -> DataFrame:
    """(pass, key, row, side, grp, pos): each row once for each key that is not null, with its position in the sort of all.

    Equal keys are ordered by the row, or if `mixed` by a hash of it: where ids tell the sides apart, the row would put one
    side before the other.
    """
    each = F.array(*[F.struct(F.lit(i).alias("pass"), k.alias("key")) for i, k in enumerate(keys)])
    keyed = rows.select("row", "side", "grp", F.explode(each).alias("k")).where("k.key is not null").select("row", "side", "grp", "k.pass", "k.key")
    order = ["pass", "key", *([F.xxhash64("row")] if mixed else []), "row"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ordered.select("pass", "key", "row", "side", "grp", F.monotonically_increasing_id().alias("id")), "sorted")
    part, within = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition of the sort
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("start")))
    return placed.withColumn("part", part).join(starts, "part").select("pass", "key", "row", "side", "grp", (F.col("start") + within).alias("pos"))


def window_pairs(rows: DataFrame, keys: list[Column], window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(a, b): rows of side a and side b in the same `grp` that are within the window in any pass; distinct."""
    return near_pairs(positions(rows, keys, _parts(rows, parts)), window).distinct()


def window_and_tied_pairs(rows: DataFrame, keys: list[Column], window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(a, b): as `window_pairs`, with the sides mixed within a key, and all pairs of the same `grp` with an equal key; distinct."""
    placed = positions(rows, keys, _parts(rows, parts), mixed=True)
    return near_pairs(placed, window).unionByName(tied_pairs(placed, window)).distinct()


def _parts(rows: DataFrame, parts: int | None) -> int:
    return parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_pairs(placed: DataFrame, window: int) -> DataFrame:
    """(a, b) of the same `grp` at most `window` positions apart in a pass."""
    placed = placed.withColumn("block", F.floor(F.col("pos") / window))
    left = placed.where("side = 'a'").select("block", "pass", F.col("grp").alias("grp_a"), F.col("row").alias("a"), F.col("pos").alias("pos_a"))
    right = placed.where("side = 'b'").select(F.explode(F.array([F.col("block") + d for d in (-1, 0, 1)])).alias("block"), F.col("pass").alias("pass_b"), F.col("grp").alias("grp_b"), F.col("row").alias("b"), F.col("pos").alias("pos_b"))
    near = left.join(right, "block").where(F.abs(F.col("pos_a") - F.col("pos_b")) <= window)
    return near.where("grp_a = grp_b and pass = pass_b").select("a", "b")


def tied_pairs(placed: DataFrame, window: int) -> DataFrame:
    """(a, b) with an equal key of a pass in the same `grp`, for keys with more rows than are sure to be within the window.

    Side b is salted and side a goes to every salt, so one key's pairs are spread over SALTS tasks.
    """
    long = placed.groupBy("pass", "key").agg(F.count("*").alias("n")).where(F.col("n") > window + 1).select("pass", "key")
    tied = placed.join(long, ["pass", "key"])
    left = tied.where("side = 'a'").select("pass", "key", "grp", F.col("row").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    right = tied.where("side = 'b'").select("pass", "key", "grp", F.col("row").alias("b"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    return left.join(right, ["pass", "key", "grp", "salt"]).select("a", "b")


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """The weighted mean of the similarities that are not null; null if none is."""
    total = reduce(Column.__add__, [F.when(s.isNotNull(), w).otherwise(0.0) for w, s in parts])
    value = reduce(Column.__add__, [F.coalesce(s * w, F.lit(0.0)) for w, s in parts])
    return F.when(total > 0, value / total)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alike, members) of rows (row, side, ...): `alike` has one row for all of a side that agree in every other column.

    It is named by the smallest of them and has their number `n`. `members` is (side, row, member), for classes of several.
    """
    fields = [c for c in rows.columns if c != "row"]
    marked = written(rows.distinct().withColumn("look", F.md5(F.to_json(F.struct(*fields)))), "looks")
    same = F.any_value(F.struct(*[c for c in fields if c != "side"])).alias("same")
    alike = marked.groupBy("look", "side").agg(F.min("row").alias("row"), F.count("*").alias("n"), same).select("look", "side", "row", "n", "same.*")
    alike = written(alike, "classes")
    several = alike.where("n > 1").select("look", "side", "row")
    return alike.drop("look"), marked.select("look", "side", F.col("row").alias("member")).join(several, ["look", "side"]).select("side", "row", "member")


def best_flow(a: list, b: list, confidence: list[float], n_a: list[int], n_b: list[int]) -> list[int]:
    """Rows matched by each pair of classes so that the total confidence is greatest: shortest augmenting paths with prices.

    `n_a` and `n_b` are the numbers of rows of the pair's classes. A row may stay alone, which is worth nothing.
    """
    out, held = defaultdict(list), defaultdict(set)
    for i in sorted(range(len(a)), key=lambda i: (a[i], b[i])):
        out[a[i]].append(i)
    supply, free, flow = dict(zip(a, n_a, strict=True)), dict(zip(b, n_b, strict=True)), [0] * len(a)
    top = max(confidence, default=0.0)  # a pair costs what it is below `top`, staying alone costs `top`
    price_a, price_b = defaultdict(float), defaultdict(float)
    for start in sorted(out):
        left = supply[start]
        while left:
            far_a, far_b, to_a, to_b = {start: 0.0}, {}, {}, {}
            heap, alone, end = [(0.0, 0, start)], (float("inf"), start), None
            while heap:
                d, side, node = heapq.heappop(heap)
                if d >= alone[0]:
                    break
                if side == 0 and d <= far_a[node]:
                    if d + top + price_a[node] < alone[0] - 1e-12:  # the newest stays alone where it makes no difference
                        alone = (d + top + price_a[node], node)
                    for i in out[node]:
                        step = d + max(0.0, top - confidence[i] + price_a[node] - price_b[b[i]])
                        if step < far_b.get(b[i], float("inf")):
                            far_b[b[i]], to_b[b[i]] = step, i
                            heapq.heappush(heap, (step, 1, b[i]))
                elif side == 1 and d <= far_b[node]:
                    if free[node]:
                        end = node
                        break
                    for i in held[node]:
                        step = d + max(0.0, confidence[i] - top + price_b[node] - price_a[a[i]])
                        if step < far_a.get(a[i], float("inf")):
                            far_a[a[i]], to_a[a[i]] = step, i
                            heapq.heappush(heap, (step, 0, a[i]))
            total = alone[0] if end is None else far_b[end]
            for prices, far in ((price_a, far_a), (price_b, far_b)):
                for node, d in far.items():
                    if d < total:
                        prices[node] += d - total
            path, at_a, amount = [], alone[1], left
            if end is not None:
                path, at_a, amount = [(to_b[end], 1)], a[to_b[end]], min(left, free[end])
            elif at_a == start:
                break  # what is left of the class stays alone
            while at_a != start:
                back = to_a[at_a]
                path += [(back, -1), (to_b[b[back]], 1)]
                amount, at_a = min(amount, flow[back]), a[to_b[b[back]]]
            for i, sign in path:
                flow[i] += sign * amount
                (held[b[i]].add if flow[i] else held[b[i]].discard)(i)
            if end is not None:
                free[end] -= amount
            left -= amount
    return flow


def auction(edges: DataFrame, by: list[str], step: float = STEP) -> DataFrame:
    """`edges` (by, a, b, confidence, n_a, n_b) with `units`, the rows that each pair matches, by bidding in rounds.

    Rows of a class bid together for the class that gains them most, as much as it gains them over the next best plus
    `step`; a class keeps its highest bids up to its size, and costs the lowest of them once it is full. A class bids on
    while it has rows left and gains by it. Each round is a written table; ties are spread by a hash, so that bidders with
    equal choices do not all turn to the same one.
    """
    key_a, key_b = [*by, "a"], [*by, "b"]
    edges = written(edges, "large")
    held = written(edges.limit(0).select(*by, "a", "b", "n_b", F.lit(0).cast("bigint").alias("units"), F.lit(0.0).alias("bid")), "held")
    while True:
        full = held.groupBy(*key_b).agg(F.sum("units").alias("taken"), F.min("bid").alias("price"), F.max("n_b").alias("size"))
        full = full.where("taken >= size").select(*key_b, "price")
        used = held.groupBy(*key_a).agg(F.sum("units").alias("used"))
        own = held.groupBy(*key_a, "b").agg(F.sum("units").alias("own"))
        x = edges.join(used, key_a, "left").where("n_a > coalesce(used, 0)").join(full, key_b, "left").join(own, [*key_a, "b"], "left")
        x = x.where("n_b > coalesce(own, 0)").withColumn("gain", F.col("confidence") - F.coalesce("price", F.lit(0.0))).where("gain > 0")
        order = W.partitionBy(*key_a).orderBy(F.desc("gain"), F.xxhash64("a", "b"), "b")
        best = x.withColumn("place", F.row_number().over(order)).where("place <= 2")
        best = best.withColumn("next", F.coalesce(F.lead("gain").over(order), F.lit(0.0))).where("place = 1")
        bids = best.select(*by, "a", "b", "n_b", (F.col("n_a") - F.coalesce("used", F.lit(0))).alias("units"), (F.col("confidence") - F.col("next") + step).alias("bid"), F.lit(1).alias("new"))
        offers = held.withColumn("new", F.lit(0)).unionByName(bids)
        queue = W.partitionBy(*key_b).orderBy(F.desc("bid"), "new", "a").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("units").over(queue), F.lit(0))
        kept = offers.withColumn("units", F.least("units", F.col("n_b") - before)).where("units > 0")
        seen = Observation()
        now = written(kept.observe(seen, F.coalesce(F.sum("new"), F.lit(0)).alias("n")), "held")
        held = now.drop("new")
        if not seen.get["n"]:
            break
    units = held.groupBy(*key_a, "b").agg(F.sum("units").alias("units"))
    return edges.join(units, [*key_a, "b"])


def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs in the order of their components, with the units that the best flow gives them; one component is held at a time."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, part in rows.groupby("component", sort=False):
            units = best_flow(*(part[c].tolist() for c in ("a", "b", "confidence", "n_a", "n_b")))
            parts.append(part.assign(units=units))
        return pd.concat(parts)

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch])
        last = held["component"] == held["component"].iloc[-1]
        if not last.all():
            yield solve(held[~last])
            held = held[last]
    if held is not None and len(held):
        yield solve(held)


def matched_classes(edges: DataFrame, large: int = LARGE, step: float = STEP) -> DataFrame:
    """`edges` (a, b, confidence, n_a, n_b and columns that part them, like a kind) with `units`: how many rows of a go to b."""
    by = [c for c in edges.columns if c not in ("a", "b", "confidence", "n_a", "n_b")]
    plain = [*by, "a", "b", "confidence", "n_a", "n_b"]
    edges = written(edges.groupBy(*by, "a", "b").agg(*[F.max(c).alias(c) for c in ("confidence", "n_a", "n_b")]), "edges")
    of_a, of_b = (edges.groupBy(*by, k).agg(F.count("*").alias(f"of_{k}")) for k in ("a", "b"))
    counted = written(edges.join(of_a, [*by, "a"]).join(of_b, [*by, "b"]), "edges")
    alone = counted.where("of_a = 1 and of_b = 1").select(*plain, F.least("n_a", "n_b").alias("units"))
    # Nodes are hashes: two components that one falls together for are solved together, with the same result.
    node = lambda side: F.xxhash64(F.lit(side), *by, side)
    rest = counted.where("of_a > 1 or of_b > 1").select(*plain, node("a").alias("u"), node("b").alias("v"))
    rest = rest.join(connected(rest), F.col("u") == F.col("node")).select(*plain, "component")
    sizes = rest.groupBy("component").agg(F.count("*").alias("size"))
    rest = written(rest.join(sizes, "component"), "components")
    small = rest.where(F.col("size") <= large).select(*plain, "component").repartition("component").sortWithinPartitions("component")
    done = small.mapInPandas(solved, small.withColumn("units", F.lit(0).cast("bigint")).schema).where("units > 0").select(*plain, "units")
    big = rest.where(F.col("size") > large)
    if not big.isEmpty():
        done = done.unionByName(auction(big.select(*plain), by, step).select(*plain, "units"))
    return alone.unionByName(done)


def paired_rows(flows: DataFrame, members: DataFrame) -> DataFrame:
    """(by, a, b, confidence) of rows: the k-th of the units between two classes is a pair of their rows of that rank.

    `members` (by, side, row, member) lists the classes of several rows. `flows` are read several times.
    """
    by = [c for c in flows.columns if c not in ("a", "b", "confidence", "n_a", "n_b", "units")]
    single = flows.where("n_a = 1 and n_b = 1").select(*by, "a", "b", "confidence")
    many = flows.where("n_a > 1 or n_b > 1")
    first = lambda k, other: F.coalesce(F.sum("units").over(W.partitionBy(*by, k).orderBy(other).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = many.withColumn("first_a", first("a", "b")).withColumn("first_b", first("b", "a"))
    part = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1, F.lit(CHUNK).cast("bigint"))))
    unit = part.withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("units")) - 1)))
    unit = unit.select(*by, "a", "b", "confidence", (F.col("first_a") + F.col("k")).alias("rank_a"), (F.col("first_b") + F.col("k")).alias("rank_b"))
    ranks = ranked(members, [*by, "side", "row"], ["member"])
    for k in ("a", "b"):
        own = ranks.where(F.col("side") == k).select(*by, F.col("row").alias(k), F.col("rank").alias(f"rank_{k}"), F.col("member").alias(f"member_{k}"))
        unit = unit.join(own, [*by, k, f"rank_{k}"], "left")
    each = unit.select(*by, F.coalesce("member_a", "a").alias("a"), F.coalesce("member_b", "b").alias("b"), "confidence")
    return single.unionByName(each)


def one_to_one(edges: DataFrame, members: DataFrame | None = None, large: int = LARGE, step: float = STEP) -> DataFrame:
    """The pairs of rows that give the greatest total confidence, from `edges` (a, b, confidence and columns that part them).

    With `members`, the edges are between classes and have their sizes n_a and n_b; without, between single rows.
    """
    if members is None:
        edges = edges.withColumn("n_a", F.lit(1).cast("bigint")).withColumn("n_b", F.lit(1).cast("bigint"))
        return matched_classes(edges, large, step).drop("n_a", "n_b", "units")
    flows = written(matched_classes(edges, large, step), "flows")
    tidied(flows.sparkSession)
    return paired_rows(flows, members)
