"""Compounds and reactions of two sources, prepared for `linkage`: what their fields say, brought to comparable values.

Compounds are labelled: a name that is near an entry of the name list takes that entry, any other keeps its spelling, and
the label most used for an id across all models is the label of that id. The other source's names are looked up among all
labels. Labels are numbers from here on, so names typed differently compare as equal or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.llm.bk_tree import SPELLING, Spelling, entries_of, map_forms, spelled
from reactionloom.llm.linkage import classes, one_to_one, weighted, window_and_tied_pairs
from reactionloom.storage import tidied, written

#: Other ways to write the compounds that take part everywhere.
SHORT_NAMES = {"h2o": "water", "h": "proton", "h+": "proton", "nad": "nad+", "coa": "coenzyme a", "co2": "carbon dioxide", "nh4": "ammonium", "nh4+": "ammonium", "pi": "phosphate"}
#: Left out of a reaction's participants.
IGNORED = ("water", "proton")
#: Rounded standard atomic masses.
MASSES = {"C": 12.011, "H": 1.008, "N": 14.007, "O": 15.999, "P": 30.974, "S": 32.06}
#: A pair below this confidence is no match.
CONFIDENT = 0.6


@dataclass(frozen=True)
class Vocabulary:
    """What the caller knows of the field's words: other names of compounds, those that every reaction may have, spelling."""

    short_names: dict[str, str] = field(default_factory=lambda: dict(SHORT_NAMES))
    ignored: tuple[str, ...] = IGNORED
    spelling: Spelling = SPELLING


WORDS = Vocabulary()


def newest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One delivery for each key, the newest by `loaded_at` where there is one; equally new ones by their greatest values."""
    at = ["loaded_at"] if "loaded_at" in rows.columns else []
    return rows.groupBy(*key).agg(F.max(F.struct(*at, *columns)).alias("v")).select(*key, *[f"v.{c}" for c in columns])


def organism_key(name: Column) -> Column:
    """Genus initial and the rest: `A. bcd`, `ABC BCD` and `Abc bcd (draft)` have one key."""
    s = F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"[\s\p{Z}]+", " ")), r"\s*\([^)]*\)\s*$", ""))
    return F.regexp_replace(s, r"^(\S)\S*\s+", "$1 ")


def genus(name: Column) -> Column:
    """The full first word, null where it is abbreviated."""
    word = F.regexp_extract(F.lower(name), r"^\s*(\S+)", 1)
    return F.when(~word.endswith(".") & (F.length(word) > 1), word)


def place_key(place: Column) -> Column:
    """Compartment letter of a place written in words or brackets."""
    s = F.lower(F.trim(place))
    letter = F.regexp_extract(s, r"^\[?([a-z])\d?\]?$", 1)
    named = F.when(s.rlike("mito"), "m").when(s.rlike("extra|outside"), "e").when(s.rlike("cyto"), "c")
    return F.when(letter != "", letter).otherwise(named)


def base_id(metabolite_id: Column) -> Column:
    """The compound of an id: without style prefix and compartment."""
    return F.regexp_replace(F.regexp_replace(F.trim(metabolite_id), "^M_", ""), r"(_[a-z]\d?|\[[a-z]\d?\]|\([a-z]\d?\))$", "")


def name_form(name: Column, words: Vocabulary = WORDS) -> Column:
    """`spelled`, with the short names written out."""
    s = spelled(name, words.spelling)
    if not words.short_names:
        return s
    table = F.create_map(*[F.lit(x) for pair in words.short_names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, s), s)


def element_count(formula: Column, element: str) -> Column:
    """Atoms of one element, written in any order; a symbol without a number is one atom. Null for a blank formula."""
    found = F.regexp_extract_all(formula, F.lit(rf"{element}(?![a-z])\s*(\d*)"), F.lit(1))
    total = F.aggregate(found, F.lit(0), lambda t, d: t + F.coalesce(F.when(d == "", 1).otherwise(d.try_cast("int")), F.lit(0)))
    return F.when(F.trim(formula) != "", total)


def compound_labels(metabolites: DataFrame, references: DataFrame, words: Vocabulary = WORDS) -> tuple[DataFrame, DataFrame]:
    """(ids, entries): `ids` has (base, label) of every compound id; `entries` (kind, ref_id, form) of every label."""
    forms = metabolites.where("name is not null").select(base_id(F.col("metabolite_id")).alias("base"), F.lit("metabolite").alias("kind"), name_form(F.col("name"), words).alias("form")).where("form <> ''")
    listed = entries_of(references, spelling=words.spelling).where("kind = 'metabolite'")
    main = references.where("kind = 'metabolite' and name is not null").select("ref_id", name_form(F.col("name"), words).alias("label"))
    near = map_forms(forms.select("kind", "form"), listed).join(main, "ref_id").select("kind", "form", "label")
    used = forms.join(near, ["kind", "form"], "left").select("base", F.coalesce("label", "form").alias("label"))
    counted = used.groupBy("base", "label").agg(F.count("*").alias("n"))
    ids = written(counted.groupBy("base").agg(F.max_by("label", F.struct("n", "label")).alias("label")), "labels")
    own = ids.select("label", F.col("label").alias("form")).union(listed.join(main, "ref_id").select("label", "form")).union(main.select("label", F.col("label").alias("form")))
    entries = own.distinct().select(F.lit("metabolite").alias("kind"), F.xxhash64("label").alias("ref_id"), "form")
    return ids.select("base", F.xxhash64("label").alias("label")), written(entries, "entries")


def near_labels(forms: list[DataFrame], entries: DataFrame, references: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    """(kind, form, ref_id) of all spellings (kind, form) that are near a compound's label or a listed reaction, looked up once."""
    listed = entries_of(references, spelling=words.spelling).where("kind = 'reaction'").select("kind", "ref_id", "form")
    return written(map_forms(reduce(DataFrame.unionByName, forms), entries.unionByName(listed)).select("kind", "form", "ref_id"), "near")


def with_label(rows: DataFrame, form: str, near: DataFrame, label: str) -> DataFrame:
    """`rows` with the column `label`: the label that the spelling in column `form` is near, else one of its own (`unknown`)."""
    found = near.where("kind = 'metabolite'").select(F.col("form").alias(form), F.col("ref_id").alias("_near"))
    own = F.when(F.col(form) != "", F.xxhash64(form))
    return rows.join(found, form, "left").withColumn(label, F.coalesce("_near", own)).withColumn("unknown", F.col("_near").isNull()).drop("_near")


def compound_forms(external: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    return external.where("title is not null").select(F.lit("metabolite").alias("kind"), name_form(F.col("title"), words).alias("form"))


def reaction_forms(records: DataFrame, external: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    titles = records.select("name").union(external.select("title")).where("name is not null").select(F.lit("reaction").alias("kind"), spelled(F.col("name"), words.spelling).alias("form"))
    return titles.unionByName(equation_terms(external.select("ext_row", "equation"), words).select(F.lit("metabolite").alias("kind"), "form"))


def _compound_fields(rows: DataFrame) -> DataFrame:
    for e in MASSES:
        rows = rows.withColumn(f"n_{e}", element_count(F.col("formula"), e))
    heavy = F.concat_ws(".", *[F.lpad(F.col(f"n_{e}").cast("string"), 4, "0") for e in "CNOPS"])
    by_formula = sum((F.col(f"n_{e}") * w for e, w in MASSES.items()), F.lit(0.0))
    return rows.withColumn("heavy", F.when(F.col("n_C").isNotNull(), heavy)).withColumn("weight", F.when(~F.coalesce(F.col("formula").rlike("[RX](?![a-z])"), F.lit(False)), by_formula))


def compound_pairs(metabolites: DataFrame, models: DataFrame, external: DataFrame, ids: DataFrame, near: DataFrame, words: Vocabulary = WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes (a, b, confidence, n_a, n_b) of compounds that may be the same in the same place of the same organism, and the rows of classes."""
    mine = newest(metabolites, ["met_row"], ["model_id", "metabolite_id", "formula", "charge", "compartment"])
    mine = mine.join(models.select("model_id", "organism").distinct(), "model_id").withColumn("base", base_id(F.col("metabolite_id"))).join(ids, "base", "left")
    mine = mine.select(F.col("met_row").alias("row"), "organism", F.lower("compartment").alias("place"), "label", "formula", "charge", F.lit(None).cast("double").alias("mass"))
    theirs = with_label(external.withColumn("form", name_form(F.col("title"), words)), "form", near, "label")
    theirs = theirs.select(F.col("ext_row").alias("row"), "organism", place_key(F.col("place")).alias("place"), "label", "formula", "charge", "mass").distinct()

    # Each side is a table of its own: the plans stay small.
    both = written(mine.withColumn("side", F.lit("a")), "mine").unionByName(written(theirs.withColumn("side", F.lit("b")), "theirs"))
    both = _compound_fields(both).withColumn("org", organism_key(F.col("organism"))).withColumn("genus", genus(F.col("organism")))
    both = both.withColumn("grp", F.xxhash64("org", "place")).withColumn("open", F.col("formula").rlike("[RX](?![a-z])")).where("org is not null and place is not null")
    fields = ["genus", "label", "heavy", "n_H", "charge", "mass", "weight", "open"]
    alike, members = classes(both.select("row", "side", "grp", "org", "place", *fields))
    weight = F.coalesce("weight", "mass")
    keys = [
        F.when(F.col("label").isNotNull(), F.concat_ws("|", "org", "place", F.lpad(F.hex("label"), 16, "0"), "heavy")),
        F.when(F.col("heavy").isNotNull(), F.concat_ws("|", "org", "place", "heavy", F.lpad(F.col("n_H").cast("string"), 4, "0"))),
        F.when(weight.isNotNull(), F.concat_ws("|", "org", "place", F.lpad(F.round(weight, 1).cast("string"), 9, "0"))),
    ]
    pairs = window_and_tied_pairs(alike, keys)
    side = lambda s, p: alike.where(f"side = '{s}'").select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{p}_{c}") for c in fields])
    x = pairs.join(side("a", "m"), "a").join(side("b", "e"), "b")
    c = F.col
    name = (c("m_label") == c("e_label")).cast("double")
    hydrogens = F.abs(c("m_n_H") - c("e_n_H"))
    formula = F.when(c("m_heavy") != c("e_heavy"), 0.0).when(hydrogens <= 1, 1.0).when(hydrogens <= 3, 0.7).when(c("m_open"), 0.7).otherwise(0.3)
    formula = F.when(c("m_heavy").isNotNull() & c("e_heavy").isNotNull(), formula)
    mass = F.when(F.abs(c("m_weight") - c("e_mass")) <= 1.6, 1.0).otherwise(0.0)
    mass = F.when(c("m_weight").isNotNull() & c("e_mass").isNotNull(), mass)
    charge = F.greatest(F.lit(0.0), 1 - F.abs(c("m_charge") - c("e_charge")) / 2)
    scored = x.withColumn("confidence", weighted([(0.55, name), (0.3, formula), (0.1, mass), (0.05, charge)]))
    evidence = F.coalesce(name == 1, formula >= 0.7, mass == 1)
    same_genus = F.coalesce(c("m_genus") == c("e_genus"), F.lit(True))
    return scored.where(evidence & same_genus & (c("confidence") >= CONFIDENT)).select("a", "b", "confidence", "n_a", "n_b"), members


def equation_terms(external: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    """(ext_row, coefficient, form): the terms of equations in words, the left side negative."""
    sides = F.split(F.col("equation"), r"\s+(?:<=>|<->|⇌|->|→|=)\s+")
    side = external.select("ext_row", F.posexplode(sides).alias("at", "text"))
    term = side.select("ext_row", "at", F.explode(F.split("text", r"\s\+\s")).alias("term"))
    number = F.regexp_extract(F.trim("term"), r"^\(?(\d+(?:\.\d+)?)\)?\s+\S", 1)
    rest = F.regexp_replace(F.trim("term"), r"^\(?\d+(?:\.\d+)?\)?\s+", "")
    form, whole = name_form(rest, words), name_form(F.col("term"), words)
    # A bare `2 oxo-...` is the beginning of a name, not a number of molecules.
    part_of_name = F.coalesce(form.startswith("oxo ") & ~F.trim("term").startswith("("), F.lit(False))
    amount = F.when(part_of_name | (number == ""), 1.0).otherwise(number.try_cast("double"))
    out = term.select("ext_row", (F.when(F.col("at") == 0, -1).otherwise(1) * amount).alias("coefficient"), F.when(part_of_name, whole).otherwise(form).alias("form"))
    return out.where("form <> ''")


def participants(terms: DataFrame, row: str, words: Vocabulary = WORDS) -> DataFrame:
    """(row, labels, amounts, unknown): sorted participants of each reaction, its amounts up to a factor and the direction,
    and how many of its terms name no known compound. A term without label counts there only."""
    ignored = [F.xxhash64(F.lit(x)) for x in words.ignored]
    unknown = terms.groupBy(row).agg(F.sum(F.col("unknown").cast("int")).alias("unknown"))
    summed = terms.where(F.col("label").isNotNull() & ~F.col("label").isin(*ignored)).groupBy(row, "label").agg(F.sum("coefficient").alias("k"))
    top = F.max(F.abs("k")).over(W.partitionBy(row))
    lists = summed.withColumn("k", F.round(F.col("k") / top * 1_000).cast("int")).groupBy(row).agg(F.array_sort(F.collect_list(F.struct("label", "k"))).alias("terms"))
    amounts, turned = F.transform("terms", lambda t: t["k"]), F.transform("terms", lambda t: -t["k"])
    lists = lists.join(unknown, row)
    return lists.select(F.col(row).alias("row"), F.transform("terms", lambda t: t["label"]).alias("labels"), F.least(F.to_json(amounts), F.to_json(turned)).alias("amounts"), "unknown")


def reaction_pairs(records: DataFrame, stoich: DataFrame, models: DataFrame, external: DataFrame, ids: DataFrame, near: DataFrame, words: Vocabulary = WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes (a, b, confidence, n_a, n_b) of reactions that may be the same of the same organism, and the rows of classes."""
    rows = newest(records, ["rxn_row"], ["model_id", "rid", "name"])
    terms = newest(stoich, ["model_id", "rid", "pos"], ["metabolite_id", "coefficient"])
    terms = terms.withColumn("base", base_id(F.col("metabolite_id"))).join(ids, "base", "left")
    terms = terms.withColumn("unknown", F.col("base").isNull()).withColumn("label", F.coalesce("label", F.when(~F.col("unknown"), F.xxhash64(name_form(F.col("base"), words)))))
    mine = rows.join(participants(rows.select("rxn_row", "model_id", "rid").join(terms, ["model_id", "rid"]), "rxn_row", words), F.col("rxn_row") == F.col("row"))
    mine = mine.join(models.select("model_id", "organism").distinct(), "model_id").select("row", "organism", "name", "labels", "amounts", "unknown")
    said = with_label(equation_terms(external.select("ext_row", "equation").distinct(), words), "form", near, "label")
    theirs = external.select("ext_row", "organism", F.col("title").alias("name")).distinct().join(participants(said, "ext_row", words), F.col("ext_row") == F.col("row"))
    theirs = theirs.select("row", "organism", "name", "labels", "amounts", "unknown")

    # Each side is a table of its own: the plans stay small.
    both = written(mine.withColumn("side", F.lit("a")), "mine").unionByName(written(theirs.withColumn("side", F.lit("b")), "theirs"))
    near = near.where("kind = 'reaction'").select(F.col("form").alias("title"), F.col("ref_id").cast("string").alias("title_ref"))
    both = both.withColumn("title", spelled(F.col("name"), words.spelling)).join(near, "title", "left").withColumn("title", F.coalesce("title_ref", "title")).drop("title_ref")
    both = both.withColumn("org", organism_key(F.col("organism"))).withColumn("genus", genus(F.col("organism"))).where("org is not null").withColumn("grp", F.xxhash64("org"))
    fields = ["genus", "labels", "amounts", "title", "unknown"]
    alike, members = classes(both.select("row", "side", "grp", "org", *fields))
    listed = lambda labels: F.array_join(F.transform(labels, lambda v: F.lpad(F.hex(v), 16, "0")), ".")
    keys = [
        F.concat_ws("|", "org", listed(F.col("labels")), "amounts"),
        F.concat_ws("|", "org", listed(F.reverse("labels")), "amounts"),
        F.when(F.col("title").isNotNull(), F.concat_ws("|", "org", "title", "amounts")),
    ]
    pairs = window_and_tied_pairs(alike, keys)
    side = lambda s, p: alike.where(f"side = '{s}'").select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{p}_{c}") for c in fields])
    x = pairs.join(side("a", "m"), "a").join(side("b", "e"), "b")
    c = F.col
    shared = F.size(F.array_intersect("m_labels", "e_labels")) / F.size(F.array_union("m_labels", "e_labels"))
    amounts = (c("m_amounts") == c("e_amounts")).cast("double")
    title = F.greatest((c("m_title") == c("e_title")).cast("double"), (F.levenshtein("m_title", "e_title") <= 2).cast("double") * 0.9)
    scored = x.withColumn("confidence", weighted([(0.6, shared), (0.2, F.when(shared == 1, amounts)), (0.2, title)]))
    # A participant of one side may only be missing on the other where a term of that other side is unknown.
    lacking_m, lacking_e = F.size(F.array_except("e_labels", "m_labels")), F.size(F.array_except("m_labels", "e_labels"))
    evidence = (shared == 1) & (amounts == 1) | (shared >= 0.5) & (lacking_m + lacking_e > 0) & (lacking_m <= c("m_unknown") + c("e_unknown")) & (lacking_e <= c("e_unknown"))
    same_genus = F.coalesce(c("m_genus") == c("e_genus"), F.lit(True))
    return scored.where(evidence & same_genus & (c("confidence") >= CONFIDENT)).select("a", "b", "confidence", "n_a", "n_b"), members


def _named(pairs: tuple[DataFrame, DataFrame], kind: str) -> tuple[DataFrame, DataFrame]:
    return tuple(x.withColumn("kind", F.lit(kind)) for x in pairs)


def match_compounds(metabolites: DataFrame, models: DataFrame, external: DataFrame, references: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    """(model_row, ext_row, confidence) of compounds in the same place of the same organism."""
    ids, entries = compound_labels(metabolites, references, words)
    near = near_labels([compound_forms(external, words)], entries, references, words)
    return one_to_one(*compound_pairs(metabolites, models, external, ids, near, words)).withColumnsRenamed({"a": "model_row", "b": "ext_row"})


def match_reactions(records: DataFrame, stoich: DataFrame, metabolites: DataFrame, models: DataFrame, external: DataFrame, references: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    """(model_row, ext_row, confidence) of reactions of the same organism."""
    ids, entries = compound_labels(metabolites, references, words)
    near = near_labels([reaction_forms(records, external, words)], entries, references, words)
    return one_to_one(*reaction_pairs(records, stoich, models, external, ids, near, words)).withColumnsRenamed({"a": "model_row", "b": "ext_row"})


def match_both(metabolites: DataFrame, records: DataFrame, stoich: DataFrame, models: DataFrame, compounds: DataFrame, reactions: DataFrame, references: DataFrame, words: Vocabulary = WORDS) -> DataFrame:
    """(kind, model_row, ext_row, confidence) of both kinds: labels, spellings and assignment in one go."""
    ids, entries = compound_labels(metabolites, references, words)
    near = near_labels([compound_forms(compounds, words), reaction_forms(records, reactions, words)], entries, references, words)
    tidied(metabolites.sparkSession)
    of_compounds = _named(compound_pairs(metabolites, models, compounds, ids, near, words), "metabolite")
    tidied(metabolites.sparkSession)
    of_reactions = _named(reaction_pairs(records, stoich, models, reactions, ids, near, words), "reaction")
    tidied(metabolites.sparkSession)
    matched = one_to_one(*[x.unionByName(y) for x, y in zip(of_compounds, of_reactions, strict=True)])
    return matched.select("kind", F.col("a").alias("model_row"), F.col("b").alias("ext_row"), "confidence")
