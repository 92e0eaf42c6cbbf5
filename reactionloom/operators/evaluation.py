"""Agreement with a reference, pooled rates, percentiles by three conventions, and paired rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.functions.chemistry import species
from reactionloom.operators.ranks import linear_percentiles, values_at

REACTION = ["model_id", "rid"]
#: Models with fewer rows are left out of per-model rates, but counted.
FLOOR = 20


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def reference_pairs(reactions: DataFrame) -> DataFrame:
    """(model_id, rid, c1, c2): the pair that the record itself names, as compounds in no order."""
    c1, c2 = unordered(species(F.col("main_sub")), species(F.col("main_prod")))
    return reactions.where("main_sub is not null and main_prod is not null").select(*REACTION, c1.alias("c1"), c2.alias("c2"))


def judged(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Chosen or candidate pairs (substrate, product) of reactions with a reference, and whether they hit it."""
    c1, c2 = unordered(species(F.col("substrate")), species(F.col("product")))
    x = pairs.withColumn("p1", c1).withColumn("p2", c2).join(reference, REACTION)
    return x.withColumn("hit", (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")))


def agreement(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """By model: reactions with a chosen and a reference pair, and how many agree."""
    per = judged(pairs, reference).groupBy(*REACTION).agg(F.max("hit").alias("hit"))
    return per.groupBy("model_id").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("n_agree"))


def pooled(rates: DataFrame, floor: int = FLOOR) -> DataFrame:
    """One row: the pooled rate and the median, least and greatest rate of models with enough rows."""
    enough = F.col("n") >= floor
    rate = F.when(enough, F.col("n_agree") / F.col("n"))
    sums = rates.agg(F.sum("n").alias("n"), F.sum("n_agree").alias("n_agree"), F.sum(enough.cast("int")).alias("n_models"), F.sum((~enough).cast("int")).alias("n_small"), F.min(rate).alias("least"), F.max(rate).alias("greatest"))
    median = linear_percentiles(rates.select(rate.alias("rate")), [], "rate", {"median": 0.5})
    return sums.join(F.broadcast(median), how="left")  # one row each


def chance(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """By model: the mean share of a reaction's candidates that would agree, over all and over discriminating reactions."""
    per = judged(candidates, reference).groupBy(*REACTION).agg(F.count("*").alias("k"), F.sum(F.col("hit").cast("int")).alias("h"))
    share = F.col("h") / F.col("k")
    return per.groupBy("model_id").agg(F.count("*").alias("n"), F.avg(share).alias("chance"), F.sum((F.col("h") < F.col("k")).cast("int")).alias("n_discriminating"), F.avg(F.when(F.col("h") < F.col("k"), share)).alias("chance_discriminating"))


def degree_rule(stoich: DataFrame, degree: DataFrame, q: float) -> DataFrame:
    """All pairs left when compounds of a degree at or above the model's percentile are dropped, unless a side would be empty."""
    cut = values_at(degree, ["model_id"], "degree", {"cut": lambda n: F.least(n - 1, F.floor(n * q))})
    x = stoich.join(degree, ["model_id", "metabolite_id"]).join(cut, "model_id").withColumn("side", F.signum("coefficient"))
    keep = F.col("degree") < F.col("cut")
    x = x.withColumn("keep", keep).withColumn("any", F.max("keep").over(W.partitionBy(*REACTION, "side"))).where("keep or not any")
    side = lambda s, name: x.where(F.col("side") == s).select(*REACTION, F.col("metabolite_id").alias(name)).distinct()
    return side(-1, "substrate").join(side(1, "product"), REACTION).where("substrate <> product")


def precision_recall(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """By model: pairs drawn, pairs that hit, reactions, and reactions with a hit."""
    x = judged(pairs, reference)
    per = x.groupBy(*REACTION).agg(F.count("*").alias("k"), F.sum(F.col("hit").cast("int")).alias("h"))
    return per.groupBy("model_id").agg(F.sum("k").alias("n_pairs"), F.sum("h").alias("n_hits"), F.count("*").alias("n_reactions"), F.sum((F.col("h") > 0).cast("int")).alias("n_found"))


def reference_variants(reference: DataFrame, key: Column) -> DataFrame:
    """By key (a reaction's name across models): pairs named by any, by more than half and by all of the models that have it."""
    rows = reference.select(key.alias("key"), "model_id", "c1", "c2").distinct()
    files = rows.groupBy("key").agg(F.countDistinct("model_id").alias("n_models"))
    counted = rows.groupBy("key", "c1", "c2").agg(F.countDistinct("model_id").alias("n")).join(files, "key")
    flag = lambda c: F.sum(c.cast("int"))
    return counted.groupBy("key").agg(F.count("*").alias("n_union"), flag(F.col("n") * 2 > F.col("n_models")).alias("n_majority"), flag(F.col("n") == F.col("n_models")).alias("n_intersection"))


def percentiles(values: DataFrame, group: str, value: str, q: float = 0.9) -> DataFrame:
    """Three conventions of a percentile: element int(q n), linear interpolation, element int(q (n - 1))."""
    plain = values_at(values, [group], value, {"nearest": lambda n: F.least(n - 1, F.floor(n * q)), "lower": lambda n: F.floor((n - 1) * q)})
    return plain.join(linear_percentiles(values, [group], value, {"linear": q}), group).select(group, "nearest", "linear", "lower")


def ecdf(values: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Steps of the empirical distribution by group: rank over count, equal values in the order of `key`."""
    w = W.partitionBy(group)
    return values.select(group, key, value, (F.row_number().over(w.orderBy(value, key)) / F.count("*").over(w)).alias("share"))


def signed_ranks(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Non-zero differences a - b of each group with the mean rank of their size (ties share it)."""
    d = pairs.select(group, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    # Equal sizes are one row from here on, so a group is ranked over its distinct sizes, not over its rows.
    sizes = d.groupBy(group, "size").agg(F.sum((F.col("d") > 0).cast("int")).alias("n_pos"), F.sum((F.col("d") < 0).cast("int")).alias("n_neg"))
    before = F.coalesce(F.sum(F.col("n_pos") + F.col("n_neg")).over(W.partitionBy(group).orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("rank", before + (F.col("n_pos") + F.col("n_neg") + 1) / 2)


def rank_biserial(ranks: DataFrame, group: str) -> DataFrame:
    """Effect (W+ - W-) / (W+ + W-), and the signed-rank statistic with its normal deviate, by group."""
    t = F.col("n_pos") + F.col("n_neg")
    x = ranks.groupBy(group).agg(F.sum(t).alias("n"), F.sum(F.col("n_pos") * F.col("rank")).alias("w_pos"), F.sum(F.col("n_neg") * F.col("rank")).alias("w_neg"), F.sum(t * t * t - t).alias("ties"))
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = F.when((F.col("n") >= 5) & (spread > 0), (F.col("w_pos") - n * (n + 1) / 4) / spread)
    return x.select(group, "n", ((F.col("w_pos") - F.col("w_neg")) / (F.col("w_pos") + F.col("w_neg"))).alias("effect"), "w_pos", z.alias("z"))


def two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate, by the rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def holm(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Step-down adjusted p; tests without p stay without. The tests are a report: one row per group, ranked together."""
    rows = tests.where(F.col(p).isNotNull())
    m = rows.agg(F.count("*").alias("m"))
    w = W.orderBy(p, key)
    stepped = rows.withColumn("i", F.row_number().over(w)).join(F.broadcast(m)).withColumn("adjusted", F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col(p)))
    adjusted = stepped.select(key, F.max("adjusted").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("p_holm"))
    return tests.join(adjusted, key, "left")


def radial_cv(ends: DataFrame) -> DataFrame:
    """By drawn reaction: how unequal its nodes' distances from their centre are (0 for a circle); null below three nodes."""
    points = ends.select("map_id", "rid", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("map_id", "rid", "p.x", "p.y").distinct()
    centre = points.groupBy("map_id", "rid").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    r = points.join(centre, ["map_id", "rid"]).withColumn("r", F.sqrt(dx * dx + dy * dy))
    return r.groupBy("map_id", "rid").agg(F.max("n").alias("n"), F.when(F.max("n") >= 3, F.stddev_pop("r") / F.avg("r")).alias("cv"))


def size_bands(scores: DataFrame) -> DataFrame:
    """Median of a long table of scores by metric and band of map size."""
    band = F.when(F.col("n_points") < 10, "small").when(F.col("n_points") < 50, "middle").otherwise("large")
    banded = scores.withColumn("band", band)
    return linear_percentiles(banded, ["band", "metric"], "value", {"median": 0.5}).join(banded.groupBy("band", "metric").agg(F.count("*").alias("n")), ["band", "metric"])


def transformed(metric: Column, value: Column) -> Column:
    """Lower is better: distance of the log from a square for the aspect ratio, distance outside the gate for others."""
    return F.when(metric == "aspect_ratio", F.abs(F.log(value))).when(metric == "hairball_index", F.greatest(value - 3.0, F.lit(0.0))).otherwise(-value)
