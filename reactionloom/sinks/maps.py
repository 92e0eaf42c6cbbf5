"""Drawn maps as text: Escher-like JSON objects and SVG primitives, one line each.

A map is never collected: every object is its own line, ordered within its map by (layer, id), and files are partitioned
by map, so a map with a third of all objects is many rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(map_id, kind, id, line): a JSON object for every standing node and every segment."""
    node = F.to_json(F.struct(F.col("node_id").cast("string").alias("node_id"), "node_type", "bigg_id", "x", "y"))
    seg = F.to_json(F.struct(F.col("seg_id").cast("string").alias("id"), "rid", F.col("n1").cast("string").alias("from_node_id"), F.col("n2").cast("string").alias("to_node_id")))
    lines = nodes.select("map_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), node.alias("line"))
    return lines.unionByName(segments.select("map_id", F.lit("segment").alias("kind"), F.col("seg_id").alias("id"), seg.alias("line")))


def svg_lines(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(map_id, layer, id, line): edges below nodes below labels, coordinates with one decimal."""
    edge = F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', "x1", "y1", "x2", "y2")
    dot = F.format_string('<circle cx="%.1f" cy="%.1f" r="%d"/>', "x", "y", F.when(F.col("node_type") == "metabolite", 20).otherwise(5))
    label = F.format_string('<text x="%.1f" y="%.1f">%s</text>', "x", "y", F.replace(F.replace("bigg_id", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    placed = nodes.where("x is not null and y is not null")
    rows = segments.select("map_id", F.lit(0).alias("layer"), F.col("seg_id").alias("id"), edge.alias("line"))
    rows = rows.unionByName(placed.select("map_id", F.lit(1).alias("layer"), F.col("node_id").alias("id"), dot.alias("line")))
    return rows.unionByName(placed.where("bigg_id is not null").select("map_id", F.lit(2).alias("layer"), F.col("node_id").alias("id"), label.alias("line")))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """The lines as text files, one folder per map; a large map becomes several files in order."""
    lines.repartitionByRange("map_id", *order).sortWithinPartitions("map_id", *order).select("map_id", "line").write.partitionBy("map_id").text(path)
