"""Queries on values: term frequencies (problem 1), names mapped to the canonical list (2), entities of two sources (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.llm.bk_tree import map_to_list
from reactionloom.llm.entities import match_both
from reactionloom.llm.term_counts import TermCounts, changes, count_in_batches
from reactionloom.sources.tables import table

#: A term in at most so many records is rare; in more than this share of all records it is common.
RARE, COMMON = 2, 0.02


def _term_state(spark: SparkSession, folder: str) -> TermCounts:
    """First all rows loaded before the last month, then the late and repeated rows of that month as signed deltas."""
    stoich = table(spark, folder, "stoich", "model_id", "rid", "pos", "metabolite_id", "loaded_at")
    compounds = table(spark, folder, "metabolites", "met_row", "cofactor_score", "loaded_at")
    score = F.when(~F.isnan("cofactor_score"), F.round(F.col("cofactor_score") * 10_000).cast("bigint"))
    rows = changes(stoich, "stoichiometry", ["model_id", "rid"], ["pos"], F.col("metabolite_id"), F.col("loaded_at")).unionByName(
        changes(compounds, "cofactor_score", ["met_row"], ["met_row"], score, F.col("loaded_at"))
    )
    last = rows.agg(F.substring(F.max("at"), 1, 7)).first()[0]  # yyyy-MM
    late = F.coalesce(F.col("at") >= F.lit(last), F.lit(False))
    return count_in_batches(spark, [rows.where(~late), rows.where(late)])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_state(spark, folder).marked(RARE, COMMON).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_state(spark, folder).counts()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = typed_names(spark, folder)
    mapped = map_to_list(names, table(spark, folder, "name_list"))
    return mapped.select(F.col("kind").alias("field"), "row_key", "ref_id").distinct()


def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, row_key, name) of both tables with names typed by hand."""
    reactions = table(spark, folder, "reaction_records", "rxn_row", "name").select(F.lit("reaction").alias("kind"), F.col("rxn_row").alias("row_key"), "name")
    compounds = table(spark, folder, "metabolites", "met_row", "name").select(F.lit("metabolite").alias("kind"), F.col("met_row").alias("row_key"), "name")
    return reactions.unionByName(compounds)


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows have a name without an entry, by kind and name."""
    mapped = map_to_list(typed_names(spark, folder), table(spark, folder, "name_list"))
    return mapped.where("ref_id = -1").groupBy("kind", "name").agg(F.count("*").alias("n_rows"))


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, model_row, ext_row, confidence)."""
    t = lambda name, *columns: table(spark, folder, name, *columns)
    compounds = t("metabolites", "met_row", "model_id", "metabolite_id", "name", "formula", "charge", "compartment", "loaded_at")
    models, references = t("model_list", "model_id", "organism"), t("name_list")
    records, stoich = t("reaction_records", "rxn_row", "model_id", "rid", "name", "loaded_at"), t("stoich", "model_id", "rid", "pos", "metabolite_id", "coefficient", "loaded_at")
    return match_both(compounds, records, stoich, models, t("ext_compounds"), t("ext_reactions"), references)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_matches(spark, folder).select("kind", "model_row", "ext_row").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_unmatched, p4_found, p4_matches)}

_P1 = """
WITH e AS (
  SELECT DISTINCT 'stoichiometry' AS field, model_id || '/' || rid AS record, pos AS element, metabolite_id AS term FROM stoich
  UNION ALL SELECT DISTINCT 'cofactor_score', met_row::VARCHAR, 0, round(cofactor_score * 10000)::BIGINT::VARCHAR FROM metabolites),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM e WHERE term IS NOT NULL GROUP BY ALL),
n AS (SELECT field, count(DISTINCT record) AS n FROM e GROUP BY ALL)
"""

ORACLE = {
    "p1_counts": _P1 + "SELECT field, term, occurrences, records FROM c",
    "p1_found": _P1 + """
SELECT field, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark
FROM c JOIN n USING (field) WHERE records <= 2 OR records > 0.02 * n""",
}
