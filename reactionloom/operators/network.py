"""Operators on the reaction network: stoichiometry, currency scores, boundary and transport, main pairs, linkage.

All tables carry `model_id`; nothing is ever compared across models, so every shuffle is by model and id, and windows are
by reaction or by metabolite, never by a whole model except where ranks within a model are the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.functions.chemistry import ELEMENTS, atoms, compartment, moiety_score, species
from reactionloom.operators.ranks import values_at
from reactionloom.storage import written

#: Compounds that count as currency whatever their degree, those never drawn, and those never drawn as a main compound.
CURATED = (
    "h", "h2o", "o2", "co2", "pi", "ppi", "pppi", "nh4", "nh3", "so4", "so3", "atp", "adp", "amp", "gtp", "gdp", "gmp", "utp", "udp", "ump", "ctp", "cdp", "cmp", "itp", "idp", "imp",
    "datp", "dadp", "damp", "dgtp", "dctp", "dttp", "nad", "nadh", "nadp", "nadph", "fad", "fadh2", "fmn", "fmnh2", "coa", "q8", "q8h2", "mqn8", "mql8", "q6", "q6h2", "thf", "mlthf",
    "methf", "5mthf", "10fthf", "trdox", "trdrd", "gthox", "gthrd", "na1", "k", "cl", "ca2", "mg2", "fe2", "fe3", "mn2", "zn2", "cu2", "cobalt2", "hco3", "h2o2", "no", "no2", "no3", "n2", "h2", "h2s",
)
SUPPRESSED = ("h", "h2o")
NEVER_PRIMARY = (
    "atp", "adp", "amp", "gtp", "gdp", "gmp", "utp", "udp", "ump", "ctp", "cdp", "cmp", "pi", "ppi", "pppi", "nad", "nadh", "nadp", "nadph", "fad", "fadh2", "fmn", "fmnh2", "coa", "co2", "o2",
    "h2o2", "nh4", "gthrd", "gthox", "q8", "q8h2", "mqn8", "mql8", "trdox", "trdrd", "h", "h2o",
)
#: Id prefixes and ontology terms of reactions at the boundary.
BOUNDARY_IDS = ("EX_", "DM_", "SK_", "BIOMASS", "ATPM")
BOUNDARY_TERMS = ("SBO:0000627", "SBO:0000628", "SBO:0000629", "SBO:0000630", "SBO:0000632")
CUTOFF = 0.5
DAMPING = 0.88
#: Longest ring that is looked for.
MOST_RING = 14
REACTION = ["model_id", "rid"]
METABOLITE = ["model_id", "metabolite_id"]


def clean_stoich(stoich: DataFrame) -> DataFrame:
    """Distinct entries (model_id, rid, pos, metabolite_id, coefficient) with a metabolite and a coefficient that is not zero."""
    return stoich.select(*REACTION, "pos", "metabolite_id", "coefficient").where("metabolite_id is not null and coefficient <> 0").distinct()


def clean_metabolites(metabolites: DataFrame) -> DataFrame:
    """One row per metabolite of a model, the newest delivery of its smallest met_row."""
    order = W.partitionBy(*METABOLITE).orderBy("met_row", F.desc("loaded_at"))
    return metabolites.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "loaded_at")


def clean_reactions(reactions: DataFrame) -> DataFrame:
    """One row per reaction: copies differ in `loaded_at` only."""
    return reactions.drop("loaded_at").dropDuplicates(["rxn_row"])


def stoich_with_metabolites(stoich: DataFrame, metabolites: DataFrame) -> DataFrame:
    """Every entry with its metabolite's name; `virtual` where the model has no such metabolite."""
    known = metabolites.select(*METABOLITE, "name", F.lit(True).alias("known"))
    return stoich.join(known, METABOLITE, "left").select(*REACTION, "pos", "metabolite_id", "coefficient", "name", F.col("known").isNull().alias("virtual"))


def signed_split(stoich: DataFrame) -> DataFrame:
    """Substrates and products of each reaction, sorted."""
    side = lambda cond, name: F.array_sort(F.collect_set(F.when(cond, F.col("metabolite_id")))).alias(name)
    return stoich.groupBy(*REACTION).agg(side(F.col("coefficient") < 0, "substrates"), side(F.col("coefficient") > 0, "products"))


def degrees(stoich: DataFrame) -> DataFrame:
    """Reactions per metabolite of a model."""
    return stoich.groupBy(*METABOLITE).agg(F.countDistinct("rid").alias("degree"))


def cofactor_scores(degree: DataFrame) -> DataFrame:
    """Score in [0, 1]: a ramp from the 85th to the 98th percentile of degrees (nearest rank), at least the curated prior."""
    at = lambda q: lambda n: F.least(n - 1, F.floor(n * q))
    bounds = values_at(degree, ["model_id"], "degree", {"lo": at(0.85), "hi": at(0.98)})
    x = degree.join(bounds, "model_id")
    ramp = F.when(F.col("hi") > F.col("lo"), (F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise((F.col("degree") >= F.col("hi")).cast("double"))
    prior = species(F.col("metabolite_id")).isin(*CURATED).cast("double")
    return x.select(*METABOLITE, "degree", F.greatest(F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0)), prior).alias("score"))


def backbone(stoich: DataFrame, scores: DataFrame) -> DataFrame:
    """Entries without currency; a metabolite without a score has score 0."""
    return stoich.join(scores.select(*METABOLITE, "score"), METABOLITE, "left").where(F.coalesce("score", F.lit(0.0)) < CUTOFF).drop("score")


def boundary_flags(reactions: DataFrame, stoich: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Reactions at the model's boundary.

    By id prefix, by ontology term (column `sbo`) or as objective (column `objective`) where the reactions have those, with
    one side only, or with a compound that may be a main one on exactly one side. Currency on both sides is energy
    metabolism, no boundary. `canonical` (model_id, metabolite_id, canonical) tells compounds; without it the id does.
    """
    x = stoich if canonical is None else stoich.join(canonical, METABOLITE, "left")
    compound = species(F.col("metabolite_id")) if canonical is None else F.coalesce("canonical", species(F.col("metabolite_id")))
    main = ~compound.isin(*NEVER_PRIMARY)
    neg, pos = F.col("coefficient") < 0, F.col("coefficient") > 0
    sides = x.groupBy(*REACTION).agg(F.max(neg).alias("has_sub"), F.max(pos).alias("has_prod"), F.max(neg & main).alias("sub"), F.max(pos & main).alias("prod"))
    said = F.upper("rid").rlike(f"^({'|'.join(BOUNDARY_IDS)})")
    if "sbo" in reactions.columns:
        said = said | F.coalesce(F.col("sbo").isin(*BOUNDARY_TERMS), F.lit(False))
    if "objective" in reactions.columns:
        said = said | (F.coalesce("objective", F.lit(0)) != 0)
    flag = F.col("said") | ~F.col("has_sub") | ~F.col("has_prod") | (F.col("sub") != F.col("prod"))
    return reactions.select(*REACTION, said.alias("said")).join(sides, REACTION, "left").select(*REACTION, F.coalesce(flag, F.lit(True)).alias("boundary"))


def transport_flags(stoich: DataFrame) -> DataFrame:
    """Reactions with one compound on both sides, and those compounds."""
    x = stoich.withColumn("species", species(F.col("metabolite_id")))
    moved = x.groupBy(*REACTION, "species").agg(F.min("coefficient").alias("lo"), F.max("coefficient").alias("hi")).where("lo < 0 and hi > 0")
    return moved.groupBy(*REACTION).agg(F.array_join(F.array_sort(F.collect_list("species")), " ").alias("moved"), F.count("*").alias("n_moved"))


def with_atoms(metabolites: DataFrame) -> DataFrame:
    """Metabolites with one column per element."""
    return metabolites.select(*METABOLITE, "name", "formula", *[atoms(F.col("formula"), e).alias(f"n_{e}") for e in ELEMENTS])


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the padded text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' trigrams; 0 where a text is null or empty."""
    x, y = trigrams(a), trigrams(b)
    known = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(known, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def candidate_pairs(stoich: DataFrame, metabolites: DataFrame, scores: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Substrate-product pairs of each reaction with their tier (0 best) and value; pairs of value 0 are no candidates.

    The self-join is within one reaction, whose number of participants is small; the atoms of both join it before.
    """
    entry = stoich.groupBy(*REACTION, "metabolite_id").agg(F.sum("coefficient").alias("k"))
    entry = entry.join(with_atoms(metabolites), METABOLITE, "left").join(scores, METABOLITE, "left")
    entry = entry.withColumn("sp", species(F.col("metabolite_id"))).withColumn("place", compartment(F.col("metabolite_id")))
    cols = {"metabolite_id": "id", "sp": "sp", "place": "place", "name": "name", "formula": "formula", "score": "cof", "degree": "deg", **{f"n_{e}": e for e in ELEMENTS}}
    part = lambda p, cond: entry.where(cond).select(*REACTION, *[(F.coalesce(F.col(c), F.lit(0)) if c.startswith(("n_", "degree", "score")) else F.col(c)).alias(f"{p}_{n}") for c, n in cols.items()])
    x = part("s", "k < 0").join(part("p", "k > 0"), REACTION).where("s_id <> p_id")
    moved = transport_flags(stoich).select(*REACTION, F.split("moved", " ").alias("moved"))
    x = x.join(moved, REACTION, "left")
    carried = F.coalesce(F.array_contains("moved", F.col("s_sp")) | F.array_contains("moved", F.col("p_sp")), F.lit(False))
    same = F.col("s_sp") == F.col("p_sp")
    tier = F.col("s_sp").isin(*NEVER_PRIMARY).cast("int") + F.col("p_sp").isin(*NEVER_PRIMARY).cast("int") + F.when(~same & carried, 3).otherwise(0)
    chemistry = moiety_score("s", "p")
    known = (F.coalesce("s_formula", F.lit("")) != "") & (F.coalesce("p_formula", F.lit("")) != "")
    by_name = 0.05 + 0.9 * trigram_similarity(F.lower(F.coalesce("s_name", "s_id")), F.lower(F.coalesce("p_name", "p_id")))
    value = F.when(chemistry != 0, chemistry).when(same, F.when(F.col("s_sp").isin(*SUPPRESSED), 0.1).otherwise(1.0)).when(~known, by_name).otherwise(0.0)
    value = value * (1.0 - damping * F.col("s_cof")) * (1.0 - damping * F.col("p_cof"))
    value = value * (1.0 - 0.1 * F.least(F.col("s_deg") + F.col("p_deg"), F.lit(2000)) / 2000.0)
    value = F.when(F.col("s_place") == F.col("p_place"), value * 1.02).otherwise(value)
    return x.select(*REACTION, F.col("s_id").alias("substrate"), F.col("p_id").alias("product"), tier.alias("tier"), value.alias("value")).where("value > 0")


def main_pairs(candidates: DataFrame, tiers: bool = True) -> DataFrame:
    """The pair of the best tier (any tier, without `tiers`) with the greatest value; equal values by substrate, then product."""
    order = W.partitionBy(*REACTION).orderBy(*(["tier"] if tiers else []), F.desc("value"), "substrate", "product")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def near_ties(candidates: DataFrame, tolerance: float = 0.7) -> DataFrame:
    """Candidates of the best tier within `tolerance` of its greatest value, where there are several."""
    w = W.partitionBy(*REACTION)
    best = candidates.withColumn("best_tier", F.min("tier").over(w)).where("tier = best_tier")
    near = best.withColumn("best", F.max("value").over(w)).where(F.col("value") >= tolerance * F.col("best"))
    return near.withColumn("n_near", F.count("*").over(w)).where("n_near > 1").select(*REACTION, "substrate", "product", "tier", "n_near")


def compound_edges(pairs: DataFrame) -> DataFrame:
    """The digraph of main compounds: one row per edge with the reactions that make it."""
    return pairs.groupBy("model_id", F.col("substrate").alias("u"), F.col("product").alias("v")).agg(F.array_join(F.array_sort(F.collect_set("rid")), " ").alias("rids"), F.count("*").alias("n"))


def antiparallel(edges: DataFrame) -> DataFrame:
    """Pairs of edges that run both ways, merged into the direction with more reactions, then the smaller name."""
    back = edges.select("model_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("n_back"))
    keep = (F.col("n") > F.col("n_back")) | (F.col("n") == F.col("n_back")) & (F.col("u") < F.col("v"))
    return edges.join(back, ["model_id", "u", "v"]).where(keep).select("model_id", "u", "v", (F.col("n") + F.col("n_back")).alias("n"))


def made_and_taken(stoich: DataFrame, reactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(makes, takes) of each cluster (subsystem): metabolites on either side, both for reversible reactions."""
    x = stoich.join(reactions.select(*REACTION, "reversible", F.col("subsystem").alias("cluster")).where("cluster is not null"), REACTION)
    side = lambda cond: x.where(cond).select("model_id", "cluster", "metabolite_id").distinct()
    both = F.coalesce(F.col("reversible"), F.lit(False))
    return side((F.col("coefficient") > 0) | both), side((F.col("coefficient") < 0) | both)


def meta_edges(makes: DataFrame, takes: DataFrame) -> DataFrame:
    """Cluster a makes what cluster b takes: number of metabolites and their sorted list."""
    x = makes.withColumnRenamed("cluster", "a").join(takes.withColumnRenamed("cluster", "b"), METABOLITE).where("a <> b")
    return x.groupBy("model_id", "a", "b").agg(F.count("*").alias("weight"), F.array_join(F.array_sort(F.collect_list("metabolite_id")), " ").alias("mets"))


def shared_metabolites(stoich: DataFrame, reactions: DataFrame) -> DataFrame:
    """Clusters a < b of a model with the number of metabolites they share."""
    x = stoich.join(reactions.select(*REACTION, F.col("subsystem").alias("cluster")).where("cluster is not null"), REACTION).select("model_id", "cluster", "metabolite_id").distinct()
    y = x.withColumnRenamed("cluster", "b")
    return x.withColumnRenamed("cluster", "a").join(y, METABOLITE).where("a < b").groupBy("model_id", "a", "b").agg(F.count("*").alias("n_shared"))


def select_links(edges: DataFrame, min_weight: int = 2, cap: int | None = None) -> DataFrame:
    """The strongest outgoing and the strongest incoming link of each cluster, from `min_weight` on; distinct.

    With `cap`, a drawing's limit, only so many of a model's strongest, equal ones by the names of their clusters.
    """
    strong = edges.where(F.col("weight") >= min_weight).select("model_id", "a", "b", "weight")
    first = lambda df, n, *by: df.withColumn("_n", F.row_number().over(W.partitionBy("model_id", *by).orderBy(F.desc("weight"), "a", "b"))).where(F.col("_n") <= n).drop("_n")
    kept = first(strong, 1, "a").union(first(strong, 1, "b")).distinct()
    return kept if cap is None else first(kept, cap)


def conversions(stoich: DataFrame, scores: DataFrame) -> DataFrame:
    """Backbone conversions u -> v in one compartment by some reaction, direct or through one further compound."""
    b = backbone(stoich, scores).withColumn("place", compartment(F.col("metabolite_id")))
    s = b.where("coefficient < 0").select(*REACTION, F.col("metabolite_id").alias("u"), "place")
    p = b.where("coefficient > 0").select(*REACTION, F.col("metabolite_id").alias("v"), "place")
    direct = s.join(p, [*REACTION, "place"]).where(species(F.col("u")) != species(F.col("v"))).select("model_id", "u", "v").distinct()
    second = direct.select("model_id", F.col("u").alias("via"), F.col("v").alias("w"))
    two = direct.withColumnRenamed("v", "via").join(second, ["model_id", "via"]).where("u <> w").select("model_id", "u", F.col("w").alias("v"))
    return direct.withColumn("steps", F.lit(1)).unionByName(two.withColumn("steps", F.lit(2))).groupBy("model_id", "u", "v").agg(F.min("steps").alias("steps"))


def short_cycles(edges: DataFrame) -> DataFrame:
    """Directed simple cycles of three and four compounds, each once, starting at its smallest compound.

    Paths are extended by joins on the edge table and always start at the smallest node, so none is built twice.
    """
    e = edges.select("model_id", "u", "v").where("u <> v").distinct()
    step = lambda df, last, new: df.join(e.select("model_id", F.col("u").alias(last), F.col("v").alias(new)), ["model_id", last])
    two = step(e.select("model_id", F.col("u").alias("n1"), F.col("v").alias("n2")).where("n1 < n2"), "n2", "n3").where("n3 > n1 and n3 <> n2")
    closing = lambda df, last: df.join(e.select("model_id", F.col("u").alias(last), F.col("v").alias("n1")), ["model_id", last, "n1"], "left_semi")
    three = closing(two, "n3").select("model_id", F.concat_ws(" ", "n1", "n2", "n3").alias("cycle"), F.lit(3).alias("size"))
    longer = step(two, "n3", "n4").where("n4 > n1 and n4 <> n2 and n4 <> n3")
    return three.unionByName(closing(longer, "n4").select("model_id", F.concat_ws(" ", "n1", "n2", "n3", "n4").alias("cycle"), F.lit(4).alias("size")))


def rings(edges: DataFrame, most: int = MOST_RING) -> DataFrame:
    """Directed simple cycles of three to `most` compounds, each once, starting at its smallest compound.

    First the fewest steps from each compound back to each smaller start, through compounds above the start. Then paths grow
    one edge a round, only where that leaves a way back within `most`. Each round of both is a written table.
    """
    e = written(edges.select("model_id", "u", "v").where("u <> v").distinct(), "edges")
    key = ["model_id", "start", "node"]
    frontier = back = written(e.where("u > v").select("model_id", F.col("v").alias("start"), F.col("u").alias("node"), F.lit(1).alias("steps")), "back")
    for steps in range(2, most):
        found = frontier.drop("steps").join(e.select("model_id", F.col("v").alias("node"), "u"), ["model_id", "node"]).where("u > start").select("model_id", "start", F.col("u").alias("node")).distinct()
        frontier = written(found.join(back, key, "left_anti").withColumn("steps", F.lit(steps)), "frontier")
        if frontier.isEmpty():
            break
        back = back.unionByName(frontier)
    back = written(back, "back")
    pair = e.where("u < v").select("model_id", F.col("u").alias("start"), F.col("v").alias("node"), F.array("u", "v").alias("path"))
    paths, closed = written(pair.join(back, key), "paths"), []
    for size in range(3, most + 1):
        further = paths.drop("steps").join(e.select("model_id", F.col("u").alias("node"), "v"), ["model_id", "node"]).where("v > start and not array_contains(path, v)")
        grown = further.select("model_id", "start", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path")).join(back, key)
        paths = written(grown.where(F.col("steps") <= most - size + 1), "paths")
        closed.append(paths.where("steps = 1").select("model_id", F.array_join("path", " ").alias("cycle"), F.lit(size).alias("size")))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)
