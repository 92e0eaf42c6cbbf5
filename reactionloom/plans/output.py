"""Queries on sinks and resumable runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reactionloom.plans.drawing import BASE as MAPS
from reactionloom.plans.drawing import _nodes, _segments
from reactionloom.sinks.maps import json_lines, svg_lines
from reactionloom.streaming.resumable import segments_by_month


def map_json(spark, folder):
    return json_lines(_nodes(spark, folder), _segments(spark, folder)).select("map_id", "kind", "id", F.get_json_object("line", "$.bigg_id").alias("bigg_id"), F.get_json_object("line", "$.from_node_id").alias("from_node_id"))


def map_svg(spark, folder):
    return svg_lines(_nodes(spark, folder), _segments(spark, folder)).groupBy("map_id", "layer").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (map_json, map_svg, segments_by_month)}
ORACLE = {
    "map_json": MAPS + "SELECT map_id, 'node' AS kind, node_id AS id, bigg_id, NULL::VARCHAR AS from_node_id FROM n UNION ALL SELECT map_id, 'segment', seg_id, NULL, n1::VARCHAR FROM s",
    "segments_by_month": "SELECT strftime(loaded_at, '%Y-%m') AS month, count(*) AS n FROM map_segments GROUP BY 1",
}
