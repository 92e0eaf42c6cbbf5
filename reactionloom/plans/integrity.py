"""Queries on references without a target (problem 3) and on nested map documents (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.operators.orphans import orphan_references, orphan_report
from reactionloom.sources.escher import map_objects, read_maps
from reactionloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(
        table(spark, folder, "map_segments"),
        table(spark, folder, "map_nodes"),
        group="map_id",
        row_id="seg_id",
        fields=["from_node_id", "to_node_id"],
        at="drawn_at",
        parent_key="node_id",
        since="added_at",
        until="deleted_at",
    )
    return found.select(F.col("group").alias("map_id"), F.col("row").alias("seg_id"), "field", "reason", "period")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    found = p3_found(spark, folder).withColumnRenamed("map_id", "group")
    return orphan_report(found).withColumnRenamed("n_groups", "n_maps")


def _maps(spark: SparkSession, folder: str):
    return read_maps(table(spark, folder, "raw_maps", "raw_id", "payload"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_objects(_maps(spark, folder)).withColumnRenamed("record", "raw_id")


def p5_reactions(spark: SparkSession, folder: str) -> DataFrame:
    t = _maps(spark, folder).table("reactions")
    return t.select(F.col("record").alias("raw_id"), "path", "ordinal", "key", F.col("f_name").alias("name"), F.col("f_reversibility").alias("reversibility"))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    t = _maps(spark, folder).table("reactions.segments")
    return t.select(F.col("record").alias("raw_id"), "parent_path", "parent_key", "path", "ordinal", "key", F.col("f_from_node_id").alias("from_node_id"), F.col("f_to_node_id").alias("to_node_id"), F.col("f_b1.x").alias("b1_x"), F.col("f_b1.y").alias("b1_y"))


def p5_metabolites(spark: SparkSession, folder: str) -> DataFrame:
    t = _maps(spark, folder).table("reactions.metabolites")
    coefficient = F.coalesce("f_coefficient", F.col("f__value").try_cast("double"))
    return t.select(F.col("record").alias("raw_id"), "parent_path", "parent_key", "path", "ordinal", "key", coefficient.alias("coefficient"))


def p5_nodes(spark: SparkSession, folder: str) -> DataFrame:
    t = _maps(spark, folder).table("nodes")
    return t.select(F.col("record").alias("raw_id"), "path", "ordinal", "key", F.col("f_node_type").alias("node_type"), F.col("f_x").alias("x"), F.col("f_y").alias("y"), F.col("f_bigg_id").alias("bigg_id"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_reactions, p5_segments, p5_metabolites, p5_nodes)}

_P3 = """
WITH refs AS (
  SELECT map_id, seg_id, drawn_at, 'from_node_id' AS field, from_node_id AS ref FROM map_segments
  UNION ALL SELECT map_id, seg_id, drawn_at, 'to_node_id', to_node_id FROM map_segments),
r AS (
  SELECT map_id, seg_id, drawn_at, field, TRY_CAST(regexp_extract(ref, '^\\s*([+-]?\\d+)(?:\\.0*)?\\s*$', 1) AS BIGINT) AS node_id
  FROM refs WHERE ref IS NOT NULL AND regexp_matches(ref, '\\S')),
joined AS (
  SELECT r.map_id, r.seg_id, r.drawn_at, r.field, count(n.node_id) AS n_rows,
    bool_or(coalesce(n.added_at <= r.drawn_at AND (n.deleted_at IS NULL OR r.drawn_at < n.deleted_at), false)) AS stood,
    bool_and(coalesce(n.added_at > r.drawn_at, false)) AS late
  FROM r LEFT JOIN map_nodes n ON n.map_id = r.map_id AND n.node_id = r.node_id
  GROUP BY r.map_id, r.seg_id, r.drawn_at, r.field, r.node_id),
found AS (
  SELECT DISTINCT map_id, seg_id, field,
    CASE WHEN n_rows = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason,
    strftime(drawn_at, '%Y-%m') AS period
  FROM joined WHERE NOT stood)
"""

_P5 = """
WITH p AS (
  SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_maps WHERE payload IS NOT NULL),
q AS (
  SELECT raw_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS doc FROM p),
b AS (
  SELECT raw_id, CASE WHEN json_type(doc) = 'ARRAY' THEN doc->'$[1]' ELSE doc->'$.body' END AS body FROM q WHERE doc IS NOT NULL),
r AS (
  SELECT raw_id, k AS rk, body->'reactions'->('$."' || k || '"') AS v
  FROM (SELECT raw_id, body, unnest(json_keys(body->'reactions')) AS k FROM b WHERE json_type(body->'reactions') = 'OBJECT')
  UNION ALL
  SELECT raw_id, coalesce(v->>'bigg_id', '') AS rk, v
  FROM (SELECT raw_id, unnest(json_extract(body, '$.reactions[*]')) AS v FROM b WHERE json_type(body->'reactions') = 'ARRAY')),
rr AS (SELECT * FROM r WHERE json_type(v) <> 'NULL'),
c AS (
  SELECT raw_id, rk, 'segment' AS kind, v->'segments' AS held, 'id' AS kf FROM rr
  UNION ALL SELECT raw_id, rk, 'metabolite', v->'metabolites', 'bigg_id' FROM rr
  UNION ALL SELECT raw_id, '', 'node', body->'nodes', 'node_id' FROM b),
m AS (
  SELECT raw_id, kind, rk, k AS ck, held->('$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(held)) AS k FROM c WHERE json_type(held) = 'OBJECT')
  UNION ALL
  SELECT raw_id, kind, rk, coalesce(v->>kf, '') AS ck, v
  FROM (SELECT *, unnest(json_extract(held, '$[*]')) AS v FROM c WHERE json_type(held) = 'ARRAY'))
SELECT DISTINCT raw_id, 'reaction' AS kind, '' AS parent_key, rk AS child_key FROM rr
UNION SELECT raw_id, kind, rk, ck FROM m WHERE json_type(v) <> 'NULL'
UNION SELECT raw_id, 'broken', '', '' FROM q WHERE doc IS NULL
"""

#: The four tables. The ordinal of a member of an object by key is its rank among the sorted keys.
_P5_TABLES = _P5[: _P5.index("r AS (")] + """
r0 AS (
  SELECT raw_id, k AS key, row_number() OVER (PARTITION BY raw_id ORDER BY k) - 1 AS ordinal, body->'reactions'->('$."' || k || '"') AS v
  FROM (SELECT raw_id, body, unnest(json_keys(body->'reactions')) AS k FROM b WHERE json_type(body->'reactions') = 'OBJECT')
  UNION ALL
  SELECT raw_id, v->>'bigg_id', i, v
  FROM (SELECT raw_id, unnest(json_extract(body, '$.reactions[*]')) AS v, unnest(range(json_array_length(body->'reactions')::BIGINT)) AS i FROM b WHERE json_type(body->'reactions') = 'ARRAY')),
rx AS (SELECT raw_id, '/reactions/' || ordinal AS path, ordinal::INT AS ordinal, key, v FROM r0 WHERE json_type(v) <> 'NULL'),
c AS (
  SELECT raw_id, path AS parent_path, key AS parent_key, 'segments' AS name, v->'segments' AS held, 'id' AS kf FROM rx
  UNION ALL SELECT raw_id, path, key, 'metabolites', v->'metabolites', 'bigg_id' FROM rx
  UNION ALL SELECT raw_id, '', '', 'nodes', body->'nodes', 'node_id' FROM b),
m0 AS (
  SELECT * EXCLUDE (held, kf, k), k AS key, row_number() OVER (PARTITION BY raw_id, parent_path, name ORDER BY k) - 1 AS ordinal, held->('$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(held)) AS k FROM c WHERE json_type(held) = 'OBJECT')
  UNION ALL
  SELECT * EXCLUDE (held, kf, v, i), v->>kf, i, v
  FROM (SELECT *, unnest(json_extract(held, '$[*]')) AS v, unnest(range(json_array_length(held)::BIGINT)) AS i FROM c WHERE json_type(held) = 'ARRAY')),
mx AS (SELECT raw_id, name, parent_path, parent_key, parent_path || '/' || name || '/' || ordinal AS path, ordinal::INT AS ordinal, key, v FROM m0 WHERE json_type(v) <> 'NULL')
"""

ORACLE = {
    "p5_reactions": _P5_TABLES + "SELECT raw_id, path, ordinal, key, v->>'name' AS name, (v->>'reversibility')::BOOLEAN AS reversibility FROM rx",
    "p5_segments": _P5_TABLES + """SELECT raw_id, parent_path, parent_key, path, ordinal, key, v->>'from_node_id' AS from_node_id, v->>'to_node_id' AS to_node_id,
(v->>'$.b1.x')::DOUBLE AS b1_x, (v->>'$.b1.y')::DOUBLE AS b1_y FROM mx WHERE name = 'segments'""",
    "p5_metabolites": _P5_TABLES + """SELECT raw_id, parent_path, parent_key, path, ordinal, key, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'coefficient' ELSE v->>'$' END::DOUBLE AS coefficient
FROM mx WHERE name = 'metabolites'""",
    "p5_nodes": _P5_TABLES + "SELECT raw_id, path, ordinal, key, v->>'node_type' AS node_type, (v->>'x')::DOUBLE AS x, (v->>'y')::DOUBLE AS y, v->>'bigg_id' AS bigg_id FROM mx WHERE name = 'nodes'",
    "p3_found": _P3 + "SELECT map_id, seg_id, field, reason, period FROM found",
    "p3_report": _P3 + "SELECT field, reason, period, count(*) AS n_references, count(DISTINCT map_id) AS n_maps FROM found GROUP BY ALL",
    "p5_found": _P5,
}
