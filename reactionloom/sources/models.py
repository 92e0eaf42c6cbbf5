"""Scans of model files (JSON, SBML), pathway drawings (KGML) and lookups, as declared by their formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MODEL = """id string,
reactions array<struct<id string, name string, metabolites map<string, double>, lower_bound double, upper_bound double, gene_reaction_rule string, subsystem string>>,
metabolites array<struct<id string, name string, compartment string, charge int, formula string>>, _corrupt string"""
ENTRY = "_id string, _name string, _type string"
REACTION = "_id string, _name string, _type string, substrate array<struct<_id string, _name string>>, product array<struct<_id string, _name string>>"


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, id, reactions, metabolites, broken): one row per model file; the stem of the file is the model's id.

    Of files with one stem the first by name counts. A file that is no JSON is kept as `broken` and does not stop the scan.
    """
    rows = spark.read.schema(MODEL).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    named = rows.select("*", file.alias("file"), F.regexp_replace(file, r"\.json(\.gz)?$", "").alias("model_id"), F.col("_corrupt").isNotNull().alias("broken"))
    first = W.partitionBy("model_id").orderBy("file")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("model_id", "id", "reactions", "metabolites", "broken")


def model_reactions(models: DataFrame) -> DataFrame:
    """(model_id, rid, seq, name, lower_bound, upper_bound, subsystem, genes)."""
    each = models.select("model_id", F.posexplode("reactions").alias("seq", "r"))
    return each.select("model_id", F.col("r.id").alias("rid"), "seq", "r.name", "r.lower_bound", "r.upper_bound", "r.subsystem", F.col("r.gene_reaction_rule").alias("genes"))


def model_stoich(models: DataFrame) -> DataFrame:
    """(model_id, rid, pos, metabolite_id, coefficient): metabolites of each reaction in the order of their ids."""
    each = models.select("model_id", F.explode("reactions").alias("r"))
    entries = F.array_sort(F.map_entries("r.metabolites"))
    x = each.select("model_id", F.col("r.id").alias("rid"), F.posexplode(entries).alias("pos", "e"))
    return x.select("model_id", "rid", "pos", F.col("e.key").alias("metabolite_id"), F.col("e.value").alias("coefficient"))


def model_metabolites(models: DataFrame) -> DataFrame:
    """(model_id, metabolite_id, name, compartment, charge, formula)."""
    each = models.select("model_id", F.explode("metabolites").alias("m"))
    return each.select("model_id", F.col("m.id").alias("metabolite_id"), "m.name", "m.compartment", "m.charge", "m.formula")


def drawn_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c1, c2): substrate-product pairs of each reaction number in pathway drawings (KGML), in no order, distinct."""
    rows = spark.read.format("xml").option("rowTag", "reaction").schema(REACTION).load(path)
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:", "")
    x = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(F.split(F.regexp_replace("_name", "rn:", ""), r"\s+")).alias("r"), F.explode("substrate").alias("s"), "product")
    x = x.select("file", "r", plain(F.col("s._name")).alias("a"), F.explode("product").alias("p")).withColumn("b", plain(F.col("p._name")))
    return x.where("r <> ''").select("file", "r", F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()


#: Model files by their extension, the first of one stem counts.
EXTENSIONS = (".json", ".xml.gz", ".xml", ".sbml", ".mat", ".yml", ".yaml")
_SPECIES = "_id string, _name string, _compartment string, _charge int, _chemicalFormula string"
_REFERENCE = "struct<speciesReference array<struct<_species string, _stoichiometry double>>>"
_SBML = f"_id string, _name string, _reversible boolean, listOfReactants {_REFERENCE}, listOfProducts {_REFERENCE}"
_GRAPHICS = "_id int, _name string, _type string, graphics array<struct<_name string, _type string, _x double, _y double, _width double, _height double>>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?:" + "|".join(e.replace(".", r"\.") for e in sorted(EXTENSIONS, key=len, reverse=True)) + ")$", "")


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, file, extension): of all files that match, the one to read for each stem, by the order of EXTENSIONS, then by name."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    rank = F.lit(None).cast("int")
    for i, e in reversed([*enumerate(EXTENSIONS)]):
        rank = F.when(F.col("file").endswith(e), i).otherwise(rank)
    known = files.select(_stem(F.col("file")).alias("model_id"), "file", rank.alias("rank")).where("rank is not null")
    first = known.groupBy("model_id").agg(F.min(F.struct("rank", "file")).alias("m"))
    return first.select("model_id", "m.file", F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("m.rank") + 1).alias("extension"))


def sbml_stoich(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, rid, name, reversible, metabolite_id, coefficient) of SBML files, reactants negative; one missing number is 1."""
    rows = spark.read.format("xml").option("rowTag", "reaction").schema(_SBML).load(path).withColumn("model_id", _stem(F.col("_metadata.file_path")))
    side = lambda c, sign: F.transform(F.coalesce(F.col(f"{c}.speciesReference"), F.array()), lambda r: F.struct(r["_species"].alias("metabolite_id"), (sign * F.coalesce(r["_stoichiometry"], F.lit(1.0))).alias("coefficient")))
    each = rows.select("model_id", F.col("_id").alias("rid"), F.col("_name").alias("name"), F.col("_reversible").alias("reversible"), F.explode(F.concat(side("listOfReactants", -1.0), side("listOfProducts", 1.0))).alias("e"))
    return each.select("model_id", F.regexp_replace("rid", "^R_", "").alias("rid"), "name", "reversible", F.regexp_replace("e.metabolite_id", "^M_", "").alias("metabolite_id"), "e.coefficient")


def sbml_metabolites(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, metabolite_id, name, compartment, charge, formula) of SBML files."""
    rows = spark.read.format("xml").option("rowTag", "species").schema(_SPECIES).load(path)
    return rows.select(_stem(F.col("_metadata.file_path")).alias("model_id"), F.regexp_replace("_id", "^M_", "").alias("metabolite_id"), F.col("_name").alias("name"), F.col("_compartment").alias("compartment"), F.col("_charge").alias("charge"), F.col("_chemicalFormula").alias("formula"))


def drawn_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, entry, kind, name, x, y, width, height): what pathway drawings (KGML) place where.

    Of drawings of one pathway number (of several organisms) the first file by name counts.
    """
    rows = spark.read.format("xml").option("rowTag", "entry").schema(_GRAPHICS).load(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[a-z]+$", "")
    x = rows.select(stem.alias("stem"), F.regexp_extract(stem, "([0-9]+)$", 1).alias("pathway"), F.col("_id").alias("entry"), F.col("_type").alias("kind"), F.col("_name").alias("name"), F.explode("graphics").alias("g"))
    first = x.groupBy("pathway").agg(F.min("stem").alias("stem"))
    return x.join(first, ["pathway", "stem"], "left_semi").select("pathway", "entry", "kind", "name", F.col("g._x").alias("x"), F.col("g._y").alias("y"), F.col("g._width").alias("width"), F.col("g._height").alias("height"))


def read_lookup(spark: SparkSession, path: str, names: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """(identifier, pos, pathway) from a tab-separated file of identifier and pathway, in order, repeated pairs once.

    The order is that of the files by name and of the lines within one. Pathways in `drop` are left out; `names`, a file of
    pathway and name, replaces pathways by their names and leaves out those without one.
    """
    rows = spark.read.schema("identifier string, pathway string").option("sep", "\t").csv(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.withColumn("at", at).where("identifier is not null and pathway is not null").where(~F.col("pathway").isin(*drop) if drop else F.lit(True))
    first = rows.groupBy("identifier", "pathway").agg(F.min("at").alias("at"))
    if names is not None:
        known = spark.read.schema("pathway string, name string").option("sep", "\t").csv(names).where("name is not null").dropDuplicates(["pathway"])
        first = first.join(known, "pathway").groupBy("identifier", F.col("name").alias("pathway")).agg(F.min("at").alias("at"))
    return first.select("identifier", (F.row_number().over(W.partitionBy("identifier").orderBy("at")) - 1).alias("pos"), "pathway")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids from text files of ids with white space between, or from JSON files: a list of ids, or an object with `reactions`."""
    files = spark.read.option("wholetext", True).text(path).select("value")
    json = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<reactions array<string>>")["reactions"])
    ids = F.when(F.col("value").rlike(r"^\s*[\[{]"), json).otherwise(F.split("value", r"\s+"))
    return files.select(F.explode(ids).alias("rid")).where("rid <> ''").distinct()


def first_match(ids: DataFrame, lookup: DataFrame) -> DataFrame:
    """(rid, pathway): the first pathway of the first identifier that the lookup knows; `ids` has (rid, priority, pos, identifier)."""
    heads = lookup.where("pos = 0").select("identifier", "pathway")
    return ids.join(heads, "identifier").groupBy("rid").agg(F.min_by("pathway", F.struct("priority", "pos")).alias("pathway"))
