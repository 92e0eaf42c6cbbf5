"""Queries on document texts: token ids (problem 6), containers of tokens (7) and visually identical texts (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.llm.lookalike import canonical_forms, lookalike_pairs
from reactionloom.llm.packing import containers, pack, stored_sizes
from reactionloom.llm.tokenizer import encode, round_trip, token_counts
from reactionloom.sources.tables import table

#: Tokens that a container holds.
CAPACITY = 2_048


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(_documents(spark, folder))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, same): whether the ids decode to the text again, a null text to the empty one."""
    return round_trip(_documents(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per container with its pieces (document, part, first token, tokens) and its fill."""
    return containers(p7_pieces(spark, folder).withColumnsRenamed({"doc_id": "item", "start_token": "start", "n_tokens": "size"}), CAPACITY)


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    sizes = stored_sizes(token_counts(_documents(spark, folder)))
    packed = pack(sizes, "doc_id", "n_tokens", CAPACITY)
    return packed.withColumnsRenamed({"item": "doc_id", "start": "start_token", "size": "n_tokens"})


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, tokens in them, the fewest containers that could hold them, and the unused space in tokens."""
    used = p7_pieces(spark, folder).agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / CAPACITY)
    return used.select("n_containers", "n_tokens", least.alias("lower_bound"), (F.col("n_containers") * CAPACITY - F.col("n_tokens")).alias("unused"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(_documents(spark, folder))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_forms(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip, p7_containers, p7_pieces, p7_fill, p8_found, p8_forms)}
ORACLE: dict[str, str] = {}
