"""Ranks and exact percentiles within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one group that are ranked in one task.
RANKED_ROWS = 50_000


def ranked(rows: DataFrame, keys: list[str], order: list[str], per_task: int = RANKED_ROWS) -> DataFrame:
    """`rows` with `rank`, 0, 1, ... within each group of `keys`.

    A large group is cut into salted parts of about `per_task` rows; each part is ranked by `order` in a task of its own and
    its ranks are moved on by the sizes of the parts before. Ranks are in `order` within a part only. Keys are not null.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > per_task).select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias("_parts"))
    salted = rows.join(sizes, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(offsets, [*keys, "_salt"]).withColumn("rank", F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_salt")


def values_at(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, names of `places`): the value at each place, a function of the group's size, counted from 0 in the order of values.

    Equal values are one row from the start, so a group is sorted over its distinct values. Nulls do not count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_size", F.sum("_n").over(w))
    at = lambda place: F.min(F.when(F.col("_upto") > place(F.col("_size")), F.col(value)))
    return upto.groupBy(*keys).agg(*[at(place).alias(name) for name, place in places.items()])


#: Half the width of the bracket around a percentile, and the size of groups that need none.
BRACKET, SMALL = 0.001, 5_000


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, names of `qs`): exact percentiles with linear interpolation; nulls do not count.

    A sketch brackets each percentile, values below the bracket are only counted, and just the values within it, a few in a
    thousand, are sorted. Groups of up to ``SMALL`` values are sorted whole.
    """
    v, names = F.col(value), list(qs)
    known = rows.where(v.isNotNull()).select(*keys, value)
    ends = [p for q in qs.values() for p in (max(0.0, q - BRACKET), min(1.0, q + BRACKET))]
    stats = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, F.array(*map(F.lit, ends)), 10_000).alias("_p"))
    end = lambda i, whole: F.when(F.col("_n") <= SMALL, F.col(whole)).otherwise(F.col("_p")[i])
    each = [F.struct(F.lit(n).alias("_name"), F.lit(q).alias("_q"), end(2 * i, "_min").alias("_lo"), end(2 * i + 1, "_max").alias("_hi")) for i, (n, q) in enumerate(qs.items())]
    brackets = stats.select(*keys, "_n", F.explode(F.array(*each)).alias("_b")).select(*keys, "_n", "_b.*")
    by = [*keys, "_name"]
    x = known.join(brackets, keys) if keys else known.crossJoin(F.broadcast(brackets))  # without keys one row for each percentile
    below = x.groupBy(*by).agg(F.sum((v < F.col("_lo")).cast("int")).alias("_below"))
    inside = x.where((v >= F.col("_lo")) & (v <= F.col("_hi"))).groupBy(*by, "_q", "_n", value).agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))).join(below, by)
    place = F.col("_q") * (F.col("_n") - 1)
    at = lambda i: F.min(F.when(F.col("_below") + F.col("_upto") > i, v))
    two = inside.groupBy(*by, "_q", "_n").agg(at(F.floor(place)).alias("_a"), at(F.least(F.floor(place) + 1, F.col("_n") - 1)).alias("_b"))
    mixed = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.floor(place) + 1 - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b"))
    return two.withColumn("_v", mixed).groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names])
