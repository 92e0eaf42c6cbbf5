"""Which compound a metabolite is: its id without compartment, its cleaned name, and whether it is currency.

Vocabularies are tables that the caller passes in: (kind, value, key, charge), where kind is `id`, `name`, `formula` or the
name of a cross-reference (`kegg`, `seed`), value what a metabolite may say, and key the currency compound that is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METABOLITE = ["model_id", "metabolite_id"]

#: Ids of currency compounds, from a table of rules in which each id stands for its own key.
CURRENCY_IDS = (
    "h", "h2o", "o2", "co2", "pi", "ppi", "pppi", "nh4", "so4", "so3", "atp", "adp", "amp", "gtp", "gdp", "gmp", "utp", "udp", "ump", "ctp", "cdp", "cmp",
    "nad", "nadh", "nadp", "nadph", "fad", "fadh2", "fmn", "fmnh2", "coa", "thf", "gthrd", "gthox", "h2o2", "hco3", "na1", "k", "cl", "ca2", "mg2", "fe2", "fe3",
    "zn2", "mn2", "cu2", "cobalt2", "itp", "idp", "imp", "datp", "dadp", "damp", "dgtp", "dctp", "dttp", "q8", "q8h2", "q6", "q6h2", "mqn8", "mql8",
    "trdox", "trdrd", "mlthf", "methf", "5mthf", "10fthf", "h2", "h2s", "n2", "no", "no2", "no3",
)
#: Formulas that name a currency compound by themselves, and the charge it has then.
CURRENCY_FORMULAS = (
    ("H2O", "h2o", 0), ("H", "h", 1), ("O2", "o2", 0), ("CO2", "co2", 0), ("H2O2", "h2o2", 0), ("Na", "na1", 1), ("K", "k", 1), ("Cl", "cl", -1),
    ("Ca", "ca2", 2), ("Mg", "mg2", 2), ("Zn", "zn2", 2), ("Mn", "mn2", 2),
)
#: Formulas whose charge decides which compound it is; it has to be known.
CHARGED_FORMULAS = (("Fe", "fe2", 2), ("Fe", "fe3", 3))


def _without(text: Column, tail: Column) -> Column:
    return F.left(text, F.length(text) - F.length(tail))


def stripped_id(metabolite_id: Column, compartment: Column) -> Column:
    """The id without its compartment, however a model spells it; null where the id does not carry it.

    `_c`, `[c]`, `(c)`, or the bare letter after a digit; without a known compartment one or two characters after the last
    underscore. The `M_` that one style puts first is dropped before.
    """
    i = F.regexp_replace(metabolite_id, "^M_", "")
    c = F.coalesce(compartment, F.lit(""))
    out = None
    for tail in (F.concat(F.lit("_"), c), F.concat(F.lit("["), c, F.lit("]")), F.concat(F.lit("("), c, F.lit(")"))):
        hit = (c != "") & i.endswith(tail) & (F.length(i) > F.length(tail))
        out = F.when(hit, _without(i, tail)) if out is None else out.when(hit, _without(i, tail))
    bare = (c != "") & i.endswith(c) & _without(i, c).rlike("[0-9]$")
    out = out.when(bare, _without(i, c))
    for n in (2, 3):
        out = out.when((F.length(i) > n) & (F.substring(i, -n, 1) == "_"), F.left(i, F.length(i) - n))
    return out


def cleaned_name(name: Column, compartment: Column, formula: Column) -> Column:
    """Lower case name without what models append: `[cytosol]`, `_c`, the formula or another one. Empty for null."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s*\[[^\]]*\]$", "")
    for sign, part in (("_", compartment), (" ", formula)):
        tail = F.concat(F.lit(sign), part)
        s = F.when((F.coalesce(part, F.lit("")) != "") & s.endswith(tail), _without(s, tail)).otherwise(s)
    return F.lower(F.trim(F.regexp_replace(s, r"\s+(?=\S*\d)(?:[A-Z][a-z]?\d*){2,}$", "")))


def based(metabolites: DataFrame) -> DataFrame:
    """`metabolites` with `base` (null where the id says nothing), `clean` and `species`: what one compound has in all compartments."""
    x = metabolites.withColumn("base", stripped_id(F.col("metabolite_id"), F.col("compartment")))
    x = x.withColumn("clean", cleaned_name(F.col("name"), F.col("compartment"), F.col("formula")))
    by_name = F.concat(F.lit("name:"), "clean", F.lit("|"), F.coalesce("formula", F.lit("")))
    return x.withColumn("species", F.coalesce("base", by_name))


def fixed_vocabulary(spark: SparkSession) -> DataFrame:
    """(kind, value, key, charge) of the fixed ids and formulas."""
    rows = [("id", i, i, None) for i in CURRENCY_IDS] + [("formula", *f) for f in CURRENCY_FORMULAS] + [("charged", *f) for f in CHARGED_FORMULAS]
    return spark.createDataFrame(rows, "kind string, value string, key string, charge int")


def learned_names(known: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Names as a vocabulary: the key that most metabolites of that name have by their ids, of equals the first."""
    ids = vocabulary.where("kind = 'id'").select(F.col("value").alias("base"), "key")
    counted = known.where("clean <> ''").join(ids, "base").groupBy("clean", "key").agg(F.count("*").alias("n"))
    best = counted.groupBy("clean").agg(F.min(F.struct(-F.col("n"), "key")).alias("m"))
    return best.select(F.lit("name").alias("kind"), F.col("clean").alias("value"), "m.key", F.lit(None).cast("int").alias("charge"))


def currency(known: DataFrame, vocabulary: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(model_id, metabolite_id, currency, evidence) of the metabolites (from `based`) that are currency.

    By id; then by cross-references (`references`: model_id, metabolite_id, kind, pos, value), by a base id that is one, and
    by name, each unless the metabolite's own formula or charge contradicts it; then by formula, only where no reference
    says what it is.
    """
    says = [F.struct(F.lit(p).alias("priority"), F.lit(0).alias("pos"), F.lit(k).alias("kind"), F.col(c).alias("value")) for p, k, c in ((0, "id", "base"), (3, "seed", "base"), (4, "name", "clean"), (5, "formula", "formula"), (5, "charged", "formula"))]
    own = known.select(*METABOLITE, "formula", "charge", F.explode(F.array(*says)).alias("s")).select(*METABOLITE, "formula", "charge", "s.*").where("value is not null and value <> ''")
    if references is not None:
        given = references.join(known.select(*METABOLITE, "formula", "charge"), METABOLITE)
        order = F.when(F.col("kind") == "kegg", 1).otherwise(2)
        own = own.unionByName(given.select(*METABOLITE, "formula", "charge", order.alias("priority"), "pos", "kind", "value"))
        named = references.select(*METABOLITE).distinct().withColumn("named", F.lit(True))
        own = own.join(named, METABOLITE, "left").where("named is null or priority < 5").drop("named")
    expected = vocabulary.where("kind = 'formula'").select("key", F.col("value").alias("exp_formula"), F.col("charge").alias("exp_charge"))
    x = own.join(vocabulary.withColumnRenamed("charge", "its"), ["kind", "value"]).join(expected, "key", "left")
    fits = (F.trim(F.coalesce("formula", F.lit(""))).isin("") | (F.col("formula") == F.col("exp_formula"))) & (F.col("charge").isNull() | (F.col("charge") == F.col("exp_charge")))
    fits = F.when(F.col("kind") == "id", True).when(F.col("kind") == "charged", F.coalesce(F.col("charge") == F.col("its"), F.lit(False))).otherwise(F.col("exp_formula").isNull() | F.coalesce(fits, F.lit(False)))
    best = x.where(fits).groupBy(*METABOLITE).agg(F.min(F.struct("priority", "pos", "key", "kind")).alias("m"))
    return best.select(*METABOLITE, F.col("m.key").alias("currency"), F.col("m.kind").alias("evidence"))


def canonical(known: DataFrame, currencies: DataFrame) -> DataFrame:
    """(model_id, metabolite_id, canonical): the currency key of a metabolite, else its species."""
    return known.select(*METABOLITE, "species").join(currencies.select(*METABOLITE, "currency"), METABOLITE, "left").select(*METABOLITE, F.coalesce("currency", "species").alias("canonical"))


def binomial(organism: Column) -> Column:
    """Genus and species without the strain; the first word where no species follows; empty for null."""
    words = F.filter(F.split(F.coalesce(organism, F.lit("")), r"\s+"), lambda w: w != "")
    second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    return F.when(second.rlike(r"^\p{Ll}"), F.concat_ws(" ", first, second)).otherwise(first)


def organisms(models: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(model_id, organism, binomial, common, search): unknown names are empty; `common` has (binomial, common)."""
    x = models.select("model_id", F.coalesce("organism", F.lit("")).alias("organism"), binomial(F.col("organism")).alias("binomial"))
    x = x.withColumn("common", F.lit("")) if common is None else x.join(common, "binomial", "left").withColumn("common", F.coalesce("common", F.lit("")))
    filled = F.filter(F.array("model_id", "organism", "binomial", "common"), lambda w: w != "")
    return x.select("model_id", "organism", "binomial", "common", F.lower(F.array_join(filled, " ")).alias("search"))
