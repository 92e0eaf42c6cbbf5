"""Grouping, voting and naming: what reactions are called and which function they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.functions.text import UNINFORMATIVE, Classifier, phrases, superclass, tokens

REACTION = ["model_id", "rid"]


def subsystem_groups(reactions: DataFrame) -> DataFrame:
    """Reactions of each subsystem in model order. The longest list is one model's subsystem."""
    rows = reactions.where("subsystem is not null").groupBy("model_id", "subsystem")
    return rows.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "rid"))), lambda x: x["rid"]).alias("rids"))


def mode_group(stoich: DataFrame, reactions: DataFrame) -> DataFrame:
    """The subsystem that uses a metabolite most; equally frequent ones by their first reaction."""
    x = stoich.select(*REACTION, "metabolite_id").distinct().join(reactions.where("subsystem is not null").select(*REACTION, "seq", "subsystem"), REACTION)
    counted = x.groupBy("model_id", "metabolite_id", "subsystem").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.groupBy("model_id", "metabolite_id").agg(F.max_by("subsystem", F.struct("n", -F.col("first"))).alias("subsystem"))


def phrase_frequency(reactions: DataFrame) -> DataFrame:
    """Reactions that contain each phrase of one to three words."""
    return reactions.select(F.explode(phrases(tokens(F.col("name")))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))


def tfidf_names(reactions: DataFrame, min_share: float = 0.05, min_count: int = 2, keep: int = 3) -> DataFrame:
    """The phrases that name a model's subsystem best: share times inverse frequency, longer phrases preferred."""
    rows = reactions.where("subsystem is not null and name is not null")
    said = rows.select("model_id", "subsystem", F.explode(phrases(tokens(F.col("name")))).alias("phrase"))
    counts = said.groupBy("model_id", "subsystem", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    sizes = rows.groupBy("model_id", "subsystem").agg(F.count("*").alias("size"))
    total = reactions.agg(F.count("*").alias("total"))  # one row
    x = counts.join(sizes, ["model_id", "subsystem"]).where(F.col("n") >= min_share * F.col("size")).join(phrase_frequency(reactions), "phrase").join(F.broadcast(total))
    words = F.size(F.split("phrase", " "))
    score = F.col("n") / F.col("size") * F.log((F.col("total") + 1) / (F.col("df") + 1)) * (1.0 + 0.6 * (words - 1))
    best = W.partitionBy("model_id", "subsystem").orderBy(F.desc("score"), F.desc("phrase"))
    return x.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("model_id", "subsystem", "rank", "phrase", "score")


def class_votes(reactions: DataFrame, share: float = 0.4, coverage: float = 0.25) -> DataFrame:
    """The class most reactions of a model vote for by the name of their subsystem, if enough of them vote and agree."""
    votes = reactions.select("model_id", superclass(F.col("subsystem")).alias("label"))
    counted = votes.groupBy("model_id", "label").agg(F.count("*").alias("n"))
    w = W.partitionBy("model_id")
    x = counted.withColumn("voters", F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).over(w)).withColumn("size", F.sum("n").over(w))
    top = x.where("label is not null").withColumn("_n", F.row_number().over(w.orderBy(F.desc("n"), "label"))).where("_n = 1")
    return top.select("model_id", F.when((F.col("n") >= share * F.col("voters")) & (F.col("voters") >= coverage * F.col("size")), F.col("label")).alias("label"), "n", "voters", "size")


def classified_clusters(reactions: DataFrame, classifier: Classifier, share: float = 0.4, coverage: float = 0.25) -> DataFrame:
    """(model_id, cluster, label, n, voters) of reactions (model_id, rid, cluster, vote): by the cluster's name, else by votes.

    `vote` is a class or null. A name that says nothing gives way to the class with most votes, if `share` of the voters agree
    and `coverage` of the cluster votes; of equals the one that the classifier tries first.
    """
    order = {k: i for i, (k, _) in enumerate(classifier.labels)}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("vote")), F.lit(len(order)))
    vague = (classifier.other, classifier.unassigned)
    named = reactions.withColumn("vote", F.when(~F.col("vote").isin(*vague), F.col("vote")))
    counted = named.groupBy("model_id", "cluster", "vote").agg(F.count("*").alias("k"))
    top = F.max(F.when(F.col("vote").isNotNull(), F.struct("k", (-place).alias("place"), "vote"))).alias("top")
    sums = counted.groupBy("model_id", "cluster").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("vote").isNotNull(), F.col("k"))), F.lit(0)).alias("voters"), top)
    own = classifier.of(F.col("cluster"))
    voted = (F.col("voters") >= coverage * F.col("n")) & (F.col("top.k") >= share * F.col("voters"))
    label = F.when(~own.isin(*vague), own).when(F.coalesce(voted, F.lit(False)), F.col("top.vote")).otherwise(own)
    return sums.select("model_id", "cluster", label.alias("label"), "n", "voters")


def compound_classes(stoich: DataFrame, reactions: DataFrame, transports: DataFrame) -> DataFrame:
    """Class of each metabolite of a model: at least half of the votes of its reactions that are no transports."""
    voters = reactions.select(*REACTION, superclass(F.col("subsystem")).alias("label")).where("label is not null").join(transports.select(*REACTION), REACTION, "left_anti")
    x = stoich.select(*REACTION, "metabolite_id").distinct().join(voters, REACTION).groupBy("model_id", "metabolite_id", "label").agg(F.count("*").alias("n"))
    w = W.partitionBy("model_id", "metabolite_id")
    top = x.withColumn("total", F.sum("n").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("n"), "label"))).where("_n = 1")
    return top.where(F.col("n") * 2 >= F.col("total")).select("model_id", "metabolite_id", "label", "n", "total")


def compound_classes_with_inorganic(classes: DataFrame, stoich: DataFrame, metabolites: DataFrame, inorganic: str = "Inorganic ions") -> DataFrame:
    """(model_id, metabolite_id, label): `classes`, but a compound whose formula has no carbon is inorganic whatever it takes part in."""
    key = ["model_id", "metabolite_id"]
    free = metabolites.where("formula <> ''").where(~F.col("formula").rlike("C(?![a-z])")).select(*key).join(stoich.select(*key), key, "left_semi").distinct()
    return free.withColumn("label", F.lit(inorganic)).unionByName(classes.join(free, key, "left_anti").select(*key, "label"))


def cargo(transports: DataFrame, species_degree: DataFrame) -> DataFrame:
    """The carried compound with the fewest reactions, by name where equal."""
    each = transports.select(*REACTION, F.explode(F.split("moved", " ")).alias("species"))
    x = each.join(species_degree, ["model_id", "species"])
    return x.groupBy(*REACTION).agg(F.min(F.struct("degree", "species")).alias("m")).select(*REACTION, "m.species", "m.degree")


def top_cargo(cargos: DataFrame, k: int = 2) -> DataFrame:
    """The `k` compounds most carried in each model, alphabetical where equal."""
    counted = cargos.groupBy("model_id", "species").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("n"), "species"))).where(F.col("rank") <= k)


def ordinal_names(reactions: DataFrame) -> DataFrame:
    """Names made distinct within a model: `x`, `x 2`, `x 3` in model order."""
    n = F.row_number().over(W.partitionBy("model_id", "name").orderBy("seq", "rid"))
    return reactions.where("name is not null").select(*REACTION, F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), n.cast("string"))).alias("label"))


def chunks(reactions: DataFrame, size: int = 25) -> DataFrame:
    """Each subsystem's reactions, sorted, cut into runs of `size`."""
    n = F.row_number().over(W.partitionBy("model_id", "subsystem").orderBy("seq", "rid"))
    return reactions.where("subsystem is not null").select(*REACTION, "subsystem", F.floor((n - 1) / size).alias("chunk"))


def chain_pairs(stoich: DataFrame, reactions: DataFrame) -> DataFrame:
    """Successive reactions of a metabolite in model order."""
    x = stoich.select(*REACTION, "metabolite_id").distinct().join(reactions.select(*REACTION, "seq"), REACTION)
    after = F.lead("rid").over(W.partitionBy("model_id", "metabolite_id").orderBy("seq", "rid"))
    return x.select("model_id", "metabolite_id", F.col("rid").alias("a"), after.alias("b")).where("b is not null")


def selection(reasons: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of selections (model_id, rid); the first reason in the list is kept."""
    rows = None
    for order, (why, chosen) in enumerate(reasons):
        part = chosen.select(*REACTION).distinct().withColumn("order", F.lit(order)).withColumn("why", F.lit(why))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*REACTION).agg(F.min_by("why", "order").alias("why"), F.count("*").alias("n_reasons"))


#: Fixed values of a cluster's name: least share and score of the strict and of the relaxed pass, and its greatest length.
STRICT, RELAXED, MOST_LABEL = (0.3, 0.25), (0.15, 0.12), 46


def cluster_names(reactions: DataFrame, cluster: str = "subsystem", min_count: int = 2) -> DataFrame:
    """(model_id, cluster, label, strict): a name for each cluster out of the names of its reactions; clusters that say nothing are left out.

    Phrases are scored by share, rarity in the model and length. Those of the strict pass count if the best is good enough,
    else those of the relaxed pass. A single general word gives way to the best phrase that says more, if there is one. A
    second phrase without a word of the first is added if it is not much worse and the label stays short.
    """
    key = ["model_id", cluster]
    rows = reactions.where(F.col(cluster).isNotNull())
    said = reactions.select("model_id", cluster, F.explode(phrases(tokens(F.col("name")))).alias("phrase"))
    whole = said.groupBy("model_id", "phrase").agg(F.count("*").alias("df"))
    total = reactions.groupBy("model_id").agg(F.count("*").alias("total"))
    counts = said.where(F.col(cluster).isNotNull()).groupBy(*key, "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    x = counts.join(rows.groupBy(*key).agg(F.count("*").alias("size")), key).join(total, "model_id").join(whole, ["model_id", "phrase"])
    share = F.col("n") / F.col("size")
    score = share * F.log((F.col("total") + 1) / (F.col("df") + 1)) * (1.0 + 0.6 * (F.size(F.split("phrase", " ")) - 1))
    x = x.withColumn("share", share).where(F.col("share") >= RELAXED[0])
    x = x.select(*key, "phrase", "share", F.floor(score * 1_000_000_000).alias("score"), (~F.col("phrase").isin(*UNINFORMATIVE)).alias("says"))
    tops = x.groupBy(*key).agg(F.max("score").alias("top"), F.max(F.when(F.col("share") >= STRICT[0], F.col("score"))).alias("strict_top"))
    strict = F.coalesce(F.col("strict_top") >= STRICT[1] * 1_000_000_000, F.lit(False))
    tops = tops.withColumn("strict", strict).where(F.col("strict") | (F.col("top") >= RELAXED[1] * 1_000_000_000)).select(*key, "strict")
    pool = x.join(tops, key).where(~F.col("strict") | (F.col("share") >= STRICT[0]))
    best = pool.groupBy(*key, "strict").agg(F.max(F.struct("says", "score", "phrase")).alias("b")).select(*key, "strict", F.col("b.score").alias("best_score"), F.col("b.phrase").alias("best"))
    more = pool.where("says").drop("strict").join(best, key).where(F.col("score") >= 0.55 * F.col("best_score")).where(~F.arrays_overlap(F.split("phrase", " "), F.split("best", " ")))
    second = more.groupBy(*key).agg(F.max(F.struct("score", "phrase")).alias("s")).select(*key, F.col("s.phrase").alias("second"))
    capital = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    both = F.concat_ws(" ", capital(F.col("best")), capital(F.col("second")))
    label = F.when(F.length(both) > MOST_LABEL, capital(F.col("best"))).otherwise(both)
    return best.join(second, key, "left").select(*key, F.regexp_replace(F.left(label, F.lit(MOST_LABEL)), "[ ,-]+$", "").alias("label"), "strict")


def themes(reactions: DataFrame, piece: list[str], theme: str, order: str = "seq") -> DataFrame:
    """(piece, n, theme): what the reactions of a piece are about: one theme of half of them, or two of three in five; else null."""
    counted = reactions.groupBy(*piece, theme).agg(F.count("*").alias("k"), F.min(order).alias("first"))
    w = W.partitionBy(*piece)
    ranked = counted.withColumn("n", F.sum("k").over(w)).where(F.col(theme).isNotNull() & (F.col(theme) != ""))
    ranked = ranked.withColumn("place", F.row_number().over(w.orderBy(F.desc("k"), "first"))).where("place <= 2")
    at = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    two = ranked.groupBy(*piece, "n").agg(at(1, "k").alias("k1"), at(1, theme).alias("t1"), at(2, "k").alias("k2"), at(2, theme).alias("t2"))
    text = F.when(F.col("k1") >= 0.5 * F.col("n"), F.col("t1")).when(F.col("k1") + F.col("k2") >= 0.6 * F.col("n"), F.concat_ws(" / ", "t1", "t2"))
    sizes = reactions.groupBy(*piece).agg(F.count("*").alias("n"))
    return sizes.join(two.select(*piece, text.alias("theme")), piece, "left")


def split_caption(caption: Column) -> tuple[Column, Column]:
    """(family, qualifier): the parts before and after the first `: `, the family without a number in brackets at its end."""
    at = F.instr(caption, ": ")
    family = F.when(at > 0, F.left(caption, at - 1)).otherwise(caption)
    return F.regexp_replace(family, r" \([0-9]+\)$", ""), F.when(at > 0, F.substr(caption, at + 2)).otherwise("")


def unified_primary(nodes: DataFrame, compound: Column, never: tuple[str, ...]) -> DataFrame:
    """`nodes` (map_id, bigg_id, primary, ...) with one value for each compound of a map.

    A compound that is primary somewhere on the map is so everywhere; one of `never` is not, unless nothing else is.
    """
    w = W.partitionBy("map_id", "bigg_id")
    anywhere = nodes.withColumn("primary", F.max(F.coalesce("primary", F.lit(False))).over(w)).withColumn("_never", F.coalesce(compound.isin(*never), F.lit(False)))
    left = anywhere.groupBy("map_id").agg(F.max(F.col("primary") & ~F.col("_never")).alias("_left"))
    return anywhere.join(left, "map_id").withColumn("primary", F.col("primary") & ~(F.col("_never") & F.col("_left"))).drop("_never", "_left")


def pathway_header(drawn: DataFrame, groups: DataFrame) -> DataFrame:
    """(map_id, name, region, reactions): which pathway each reaction (map_id, rid) of a map belongs to, by `groups` (name, region, rid, seq)."""
    x = drawn.select("map_id", "rid").distinct().join(groups.select("name", "region", "rid", "seq").distinct(), "rid")
    return x.groupBy("map_id", "name", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rid"))), lambda s: s["rid"]).alias("reactions"))
