"""Scan of drawn maps delivered as Escher JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reactionloom.operators.nested import Collection, Flattened, flatten, parsed

#: The collections of a map's body that are stored by key or as arrays.
MAP_COLLECTIONS = (
    Collection("reactions", "bigg_id", (Collection("segments", "id"), Collection("metabolites", "bigg_id"))),
    Collection("nodes", "node_id"),
    Collection("text_labels", "id"),
)


def read_maps(texts: DataFrame, record_id: str = "raw_id", text: str = "payload") -> Flattened:
    """The tables inside whole maps: ``[header, body]`` or an object with both, perhaps encoded once more as a string.

    In an object-of-numbers collection (metabolites by coefficient) the number stands in ``f__value``.
    """
    documents, broken = parsed(texts, record_id, text)
    body = F.coalesce(F.try_variant_get("doc", "$[1]", "variant"), F.try_variant_get("doc", "$.body", "variant"))
    return flatten(documents, broken, body, MAP_COLLECTIONS)


def map_objects(maps: Flattened) -> DataFrame:
    """One row (record, kind, parent_key, child_key) for each reaction, segment, metabolite and node; distinct."""
    kinds = {"reaction": "reactions", "segment": "reactions.segments", "metabolite": "reactions.metabolites", "node": "nodes"}
    rows = maps.broken.select("record", F.lit("broken").alias("kind"), F.lit("").alias("parent_key"), F.lit("").alias("child_key"))
    for kind, level in kinds.items():
        parent = F.coalesce("parent_key", F.lit("")) if "." in level else F.lit("")
        rows = rows.unionByName(maps.levels[level].select("record", F.lit(kind).alias("kind"), parent.alias("parent_key"), F.coalesce("key", F.lit("")).alias("child_key")))
    return rows.distinct()
