"""Queries on drawn maps: crossings, overlaps, density and the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from reactionloom.functions.chemistry import compartment, millionths
from reactionloom.operators import drawing as D
from reactionloom.sources.tables import table


def _nodes(spark, folder):
    return D.standing_nodes(table(spark, folder, "map_nodes"))


def _points(spark, folder):
    return _nodes(spark, folder).where("node_type = 'metabolite'")


def _segments(spark, folder):
    return D.segments(table(spark, folder, "map_segments"), _nodes(spark, folder))


def _straight(spark, folder):
    return _segments(spark, folder).where(~F.col("curved"))


def standing_nodes(spark, folder):
    return _nodes(spark, folder)


def segment_ends(spark, folder):
    return _segments(spark, folder).select("map_id", "seg_id", "n1", "n2", "curved", millionths(D.length()).alias("length"))


def axis_aligned(spark, folder):
    return D.axis_aligned(_straight(spark, folder))


def segment_crossings(spark, folder):
    return D.crossings(_straight(spark, folder))


def segment_crossings_exact(spark, folder):
    return D.crossings(_straight(spark, folder), exact=True)


def longest_run(spark, folder):
    return D.longest_run(_straight(spark, folder)).withColumn("longest_run", millionths(F.col("longest_run")))


def bbox(spark, folder):
    return D.extents(_points(spark, folder)).withColumn("aspect_ratio", millionths(F.col("aspect_ratio")))


def hairball(spark, folder):
    return D.hairball(_points(spark, folder)).withColumn("hairball_index", millionths(F.col("hairball_index")))


def min_separation(spark, folder):
    return D.min_separation(_points(spark, folder)).withColumn("min_separation_ratio", millionths(F.col("min_separation_ratio")))


def box_overlaps(spark, folder):
    return D.box_overlaps(D.label_boxes(_points(spark, folder), "bigg_id"))


def label_hits(spark, folder):
    return D.labels_on_nodes(D.label_boxes(_points(spark, folder), "bigg_id"), _nodes(spark, folder))


def node_overlaps(spark, folder):
    return D.node_overlaps(_nodes(spark, folder), _segments(spark, folder))


def edge_through_node(spark, folder):
    return D.edges_through_nodes(_straight(spark, folder), _points(spark, folder))


def node_overlaps_all(spark, folder):
    return D.node_overlaps(_nodes(spark, folder), _segments(spark, folder), D.node_radius())


def edge_through_node_all(spark, folder):
    s = _segments(spark, folder)
    return D.edges_through_nodes(s.where(~F.col("curved")), _nodes(spark, folder), D.node_radius(), D.node_owners(s))


def collinear_overlap(spark, folder):
    return D.collinear_overlaps(_straight(spark, folder))


def nearest_other(spark, folder):
    return D.nearest_other(_points(spark, folder), "bigg_id").withColumn("d2", millionths(F.col("d2")))


def cell_clash(spark, folder):
    return D.cell_clashes(_points(spark, folder), compartment(F.col("bigg_id")))


def gap_remap(spark, folder):
    return D.gap_remap(_points(spark, folder)).withColumn("shift", F.bround(F.col("shift") * 10).cast("bigint"))


def _scores(spark, folder):
    return D.scorecard(_nodes(spark, folder), _segments(spark, folder))


def scorecard(spark, folder):
    return _scores(spark, folder).select("map_id", "n_points", *[millionths(F.col(c)).alias(c) for c in D.GATES])


def gate_bands(spark, folder):
    return D.in_band(D.long_scores(_scores(spark, folder))).select("map_id", "metric", "within")


def pooled_summary(spark, folder):
    s = D.summary(D.in_band(D.long_scores(_scores(spark, folder))))
    return s.select("metric", "n", *[F.floor(F.col(c) * 1000).cast("bigint").alias(c) for c in ("median", "p10", "p90", "share_within")])


def worst_maps(spark, folder):
    return D.worst(D.in_band(D.long_scores(_scores(spark, folder))))


def _whole(spark, folder):
    return D.table_scorecard(table(spark, folder, "map_nodes"), table(spark, folder, "map_segments"))


def _whole_bands(spark, folder):
    return D.in_band(D.long_scores(_whole(spark, folder), D.TARGETS), D.TARGETS)


def scorecard_all(spark, folder):
    return _whole(spark, folder).select("map_id", "n_points", *[millionths(F.col(c)).alias(c) for c in D.TARGETS])


def gate_bands_all(spark, folder):
    return _whole_bands(spark, folder).select("map_id", "metric", "within")


def pooled_summary_all(spark, folder):
    s = D.summary(_whole_bands(spark, folder))
    return s.select("metric", "n", *[F.floor(F.col(c) * 1000).cast("bigint").alias(c) for c in ("median", "p10", "p90", "share_within")])


def worst_maps_all(spark, folder):
    return D.worst(_whole_bands(spark, folder))


_NAMES = "standing_nodes segment_ends axis_aligned segment_crossings segment_crossings_exact longest_run bbox hairball min_separation box_overlaps label_hits node_overlaps edge_through_node node_overlaps_all edge_through_node_all collinear_overlap nearest_other cell_clash gap_remap scorecard gate_bands pooled_summary worst_maps scorecard_all gate_bands_all pooled_summary_all worst_maps_all"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_NUMBER = "TRY_CAST(regexp_extract({0}, '^\\s*([+-]?\\d+)(?:\\.0*)?\\s*$', 1) AS BIGINT)"
BASE = f"""
WITH n AS (SELECT map_id, node_id, node_type, bigg_id, x, y FROM map_nodes WHERE deleted_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY map_id, node_id ORDER BY added_at DESC, x, y) = 1),
p AS (SELECT * FROM n WHERE node_type = 'metabolite'),
s0 AS (SELECT DISTINCT map_id, seg_id, rid, {_NUMBER.format('from_node_id')} AS n1, {_NUMBER.format('to_node_id')} AS n2, b1 IS NOT NULL OR b2 IS NOT NULL AS curved FROM map_segments),
s AS (SELECT s0.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM s0 JOIN n a ON a.map_id = s0.map_id AND a.node_id = n1 JOIN n b ON b.map_id = s0.map_id AND b.node_id = n2),
t AS (SELECT * FROM s WHERE NOT curved),
ax AS (SELECT map_id, count(*) AS n_segments, sum((abs(x1 - x2) < 1 OR abs(y1 - y2) < 1)::INT)::BIGINT AS n_aligned FROM t GROUP BY ALL),
box AS (SELECT map_id, count(*) AS n_points, min(x) AS x_min, min(y) AS y_min, max(x) - min(x) AS x_range, max(y) - min(y) AS y_range,
  greatest(max(x) - min(x), 160e0) / greatest(max(y) - min(y), 160e0) AS aspect_ratio FROM p GROUP BY ALL),
bins AS (SELECT map_id, n_points, least(19, floor((x - x_min) / greatest(x_range, 1e-6) * 20)) AS bx, least(19, floor((y - y_min) / greatest(y_range, 1e-6) * 20)) AS by_, count(*) AS c FROM p JOIN box USING (map_id) GROUP BY ALL),
hb AS (SELECT map_id, CASE WHEN n_points < 4 THEN 1e0 ELSE max(c) / avg(c) END AS hairball_index FROM bins GROUP BY map_id, n_points),
sep0 AS (SELECT a.map_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM p a JOIN p b ON a.map_id = b.map_id AND abs(floor(a.x / 180e0) - floor(b.x / 180e0)) <= 1 AND abs(floor(a.y / 180e0) - floor(b.y / 180e0)) <= 1 WHERE a.x <> b.x OR a.y <> b.y GROUP BY ALL),
sep AS (SELECT map_id, sqrt(coalesce(d2, 32400e0)) / 180e0 AS min_separation_ratio FROM box LEFT JOIN sep0 USING (map_id)),
card AS (SELECT map_id, n_points, aspect_ratio, hairball_index, min_separation_ratio, coalesce(n_aligned / n_segments::DOUBLE, 1e0) AS axis_aligned FROM box JOIN hb USING (map_id) JOIN sep USING (map_id) LEFT JOIN ax USING (map_id)),
long_ AS (SELECT map_id, 'aspect_ratio' AS metric, aspect_ratio AS value FROM card UNION ALL SELECT map_id, 'hairball_index', hairball_index FROM card
  UNION ALL SELECT map_id, 'min_separation_ratio', min_separation_ratio FROM card UNION ALL SELECT map_id, 'axis_aligned', axis_aligned FROM card),
band AS (SELECT map_id, metric, value, CASE metric WHEN 'aspect_ratio' THEN value >= 0.5 AND value <= 2 WHEN 'hairball_index' THEN value <= 3 WHEN 'min_separation_ratio' THEN value >= 0.5 ELSE value >= 0.9 END AS within_ FROM long_),
lb AS (SELECT map_id, node_id, x AS l, y - 12.5e0 AS t, x + greatest(length(bigg_id), 1) * 20e0 * 0.58e0 AS r, y + 12.5e0 AS b FROM p),
axis_ AS (SELECT *, CASE WHEN abs(x1 - x2) < 1 THEN 'v' WHEN abs(y1 - y2) < 1 THEN 'h' END AS axis, CASE WHEN abs(x1 - x2) < 1 THEN x1 ELSE y1 END AS pos,
  CASE WHEN abs(x1 - x2) < 1 THEN least(y1, y2) ELSE least(x1, x2) END AS lo, CASE WHEN abs(x1 - x2) < 1 THEN greatest(y1, y2) ELSE greatest(x1, x2) END AS hi FROM t)
"""


def _turn(a, b, c):
    v = f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"
    return f"(CASE WHEN abs({v}) < 1e-9 THEN 0 WHEN {v} > 0 THEN 1 ELSE -1 END)"


_P1, _P2, _Q1, _Q2 = ((f"{t}.x{i}", f"{t}.y{i}") for t in ("a", "b") for i in (1, 2))
_TOUCH = " OR ".join(f"(abs({u[0]} - {v[0]}) < 1e-6 AND abs({u[1]} - {v[1]}) < 1e-6)" for u in (_P1, _P2) for v in (_Q1, _Q2))
_CELLS = """, k AS (SELECT *, unnest(range(0, greatest(1, floor(len / {0}) + 1)::BIGINT + 1)) AS i, greatest(1, floor(len / {0}) + 1) AS steps FROM t),
cells AS (SELECT DISTINCT map_id, seg_id, n1, n2, x1, y1, x2, y2, floor((x1 + (x2 - x1) * (i / steps)) / {0}) AS cx, floor((y1 + (y2 - y1) * (i / steps)) / {0}) AS cy FROM k)
"""
_RADII = """, nr AS (SELECT *, CASE node_type WHEN 'metabolite' THEN 30e0 WHEN 'midmarker' THEN 11e0 ELSE 6e0 END AS r FROM n), ow AS (SELECT map_id, n1 AS node_id, rid FROM s UNION SELECT map_id, n2, rid FROM s)
"""
#: The whole scorecard, every pair of a map compared; a box and a segment by clipping.
WHOLE = BASE + _CELLS.format("400e0") + f""", cr AS (SELECT map_id, count(*) AS n_crossings FROM (SELECT DISTINCT a.map_id, a.seg_id, b.seg_id AS other FROM cells a JOIN cells b ON a.map_id = b.map_id AND a.cx = b.cx AND a.cy = b.cy AND a.seg_id < b.seg_id
WHERE NOT ({_TOUCH}) AND {_turn(_P1, _P2, _Q1)} <> {_turn(_P1, _P2, _Q2)} AND {_turn(_Q1, _Q2, _P1)} <> {_turn(_Q1, _Q2, _P2)}) GROUP BY ALL),
sp AS (SELECT map_id, axis || round_even(pos, 0)::BIGINT AS line, lo, hi FROM axis_ WHERE axis IS NOT NULL),
rc AS (SELECT *, max(hi) OVER (PARTITION BY map_id, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
ru AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY map_id, line ORDER BY lo, hi) AS run FROM rc),
lr AS (SELECT map_id, max(l) AS longest FROM (SELECT map_id, max(hi) - min(lo) AS l FROM ru GROUP BY map_id, line, run) GROUP BY map_id),
tl AS (SELECT map_id, count(*) AS n_segments, sum(len) AS total FROM t GROUP BY map_id),
lo AS (SELECT a.map_id, count(*) AS n FROM lb a JOIN lb b ON a.map_id = b.map_id AND a.node_id < b.node_id AND a.r - 3e0 > b.l + 3e0 AND a.l + 3e0 < b.r - 3e0 AND a.b - 3e0 > b.t + 3e0 AND a.t + 3e0 < b.b - 3e0 GROUP BY ALL),
nr34 AS (SELECT *, CASE WHEN node_type = 'metabolite' THEN 34e0 ELSE 11e0 END AS q FROM n),
ln_ AS (SELECT map_id, count(*) AS n FROM (SELECT DISTINCT a.map_id, a.node_id FROM lb a JOIN nr34 o ON a.map_id = o.map_id AND a.node_id <> o.node_id AND o.x > a.l - q AND o.x < a.r + q AND o.y > a.t - q AND o.y < a.b + q) GROUP BY ALL),
bz AS (SELECT DISTINCT s.*, m.b1, m.b2 FROM s JOIN map_segments m ON m.map_id = s.map_id AND m.seg_id = s.seg_id),
pk AS (SELECT *, unnest(range(0, 10)) AS i FROM bz WHERE b1 IS NOT NULL AND b2 IS NOT NULL),
pc AS (SELECT map_id, n1, n2, x1, y1, x2, y2 FROM bz WHERE b1 IS NULL OR b2 IS NULL
  UNION ALL SELECT map_id, n1, n2, {', '.join(f"pow(1 - (i + {d}) / 10e0, 3) * {a}1 + 3 * pow(1 - (i + {d}) / 10e0, 2) * ((i + {d}) / 10e0) * b1.{a} + 3 * (1 - (i + {d}) / 10e0) * pow((i + {d}) / 10e0, 2) * b2.{a} + pow((i + {d}) / 10e0, 3) * {a}2" for d in (0, 1) for a in 'xy')} FROM pk),
cl AS (SELECT a.map_id, a.node_id, l, r, t, b, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM lb a JOIN pc ON a.map_id = pc.map_id AND node_id <> n1 AND node_id <> n2 AND greatest(x1, x2) >= l AND least(x1, x2) <= r AND greatest(y1, y2) >= t AND least(y1, y2) <= b),
le AS (SELECT map_id, count(DISTINCT node_id) AS n FROM cl WHERE greatest(0e0, CASE WHEN dx = 0 THEN 0e0 ELSE least((l - x1) / dx, (r - x1) / dx) END, CASE WHEN dy = 0 THEN 0e0 ELSE least((t - y1) / dy, (b - y1) / dy) END)
  <= least(1e0, CASE WHEN dx = 0 THEN 1e0 ELSE greatest((l - x1) / dx, (r - x1) / dx) END, CASE WHEN dy = 0 THEN 1e0 ELSE greatest((t - y1) / dy, (b - y1) / dy) END) GROUP BY map_id),
whole AS (SELECT card.*, coalesce(n_crossings / n_segments::DOUBLE, 0e0) AS crossings_per_edge, coalesce(CASE WHEN total > 0 THEN longest / total END, 0e0) AS longest_run_ratio,
  coalesce(lo.n, 0)::DOUBLE AS label_overlaps, coalesce(ln_.n, 0)::DOUBLE AS label_on_node, coalesce(le.n, 0)::DOUBLE AS label_on_edge
  FROM card LEFT JOIN tl USING (map_id) LEFT JOIN cr USING (map_id) LEFT JOIN lr USING (map_id) LEFT JOIN lo USING (map_id) LEFT JOIN ln_ USING (map_id) LEFT JOIN le USING (map_id)),
wl AS ({' UNION ALL '.join(f"SELECT map_id, n_points, '{c}' AS metric, {c} AS value FROM whole" for c in D.TARGETS)}),
wb AS (SELECT *, CASE metric WHEN 'axis_aligned' THEN value >= 0.9 WHEN 'crossings_per_edge' THEN value <= 0.05 WHEN 'longest_run_ratio' THEN value >= 0.15 WHEN 'min_separation_ratio' THEN value >= 1
  WHEN 'hairball_index' THEN value <= 3 WHEN 'aspect_ratio' THEN value >= 0.35 AND value <= 3 ELSE value <= 0 END AS within_ FROM wl)
"""

ORACLE = {
    "standing_nodes": BASE + "SELECT * FROM n",
    "segment_ends": BASE + "SELECT map_id, seg_id, n1, n2, curved, floor(len * 1000000)::BIGINT AS length FROM s",
    "axis_aligned": BASE + "SELECT * FROM ax",
    "segment_crossings": BASE + _CELLS.format("400e0") + f"""SELECT map_id, count(*) AS n_crossings FROM (SELECT DISTINCT a.map_id, a.seg_id, b.seg_id AS other FROM cells a JOIN cells b ON a.map_id = b.map_id AND a.cx = b.cx AND a.cy = b.cy AND a.seg_id < b.seg_id
WHERE NOT ({_TOUCH}) AND {_turn(_P1, _P2, _Q1)} <> {_turn(_P1, _P2, _Q2)} AND {_turn(_Q1, _Q2, _P1)} <> {_turn(_Q1, _Q2, _P2)}) GROUP BY ALL""",
    "segment_crossings_exact": BASE + f"""SELECT map_id, count(*) AS n_crossings FROM (SELECT a.map_id FROM t a JOIN t b ON a.map_id = b.map_id AND a.seg_id < b.seg_id
AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)
WHERE NOT ({_TOUCH}) AND {_turn(_P1, _P2, _Q1)} <> {_turn(_P1, _P2, _Q2)} AND {_turn(_Q1, _Q2, _P1)} <> {_turn(_Q1, _Q2, _P2)}) GROUP BY ALL""",
    "longest_run": BASE + """, sp AS (SELECT map_id, axis || round_even(pos, 0)::BIGINT AS line, lo, hi FROM axis_ WHERE axis IS NOT NULL),
rc AS (SELECT *, max(hi) OVER (PARTITION BY map_id, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
ru AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY map_id, line ORDER BY lo, hi) AS run FROM rc),
ea AS (SELECT map_id, line, run, max(hi) - min(lo) AS len FROM ru GROUP BY ALL)
SELECT map_id, floor(max(len) * 1000000)::BIGINT AS longest_run, count(*) AS n_runs FROM ea GROUP BY ALL""",
    "bbox": BASE + "SELECT * REPLACE (floor(aspect_ratio * 1000000)::BIGINT AS aspect_ratio) FROM box",
    "hairball": BASE + "SELECT map_id, floor(hairball_index * 1000000)::BIGINT AS hairball_index FROM hb",
    "min_separation": BASE + "SELECT map_id, floor(min_separation_ratio * 1000000)::BIGINT AS min_separation_ratio FROM sep",
    "box_overlaps": BASE + "SELECT a.map_id, count(*) AS n_overlaps FROM lb a JOIN lb b ON a.map_id = b.map_id AND a.node_id < b.node_id AND a.r > b.l AND a.l < b.r AND a.b > b.t AND a.t < b.b GROUP BY ALL",
    "label_hits": BASE + "SELECT map_id, count(*) AS n_labels FROM (SELECT DISTINCT a.map_id, a.node_id FROM lb a JOIN n o ON a.map_id = o.map_id AND a.node_id <> o.node_id AND o.x > a.l - 20e0 AND o.x < a.r + 20e0 AND o.y > a.t - 20e0 AND o.y < a.b + 20e0) GROUP BY ALL",
    "node_overlaps": BASE + "SELECT a.map_id, a.node_id AS a, b.node_id AS b FROM n a JOIN n b ON a.map_id = b.map_id AND a.node_id < b.node_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1600 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.map_id = a.map_id AND least(n1, n2) = a.node_id AND greatest(n1, n2) = b.node_id)",
    "edge_through_node": BASE + """, h AS (SELECT t.map_id, seg_id, node_id, x2 - x1 AS dx, y2 - y1 AS dy, x - x1 AS px, y - y1 AS py FROM t JOIN p ON t.map_id = p.map_id AND node_id <> n1 AND node_id <> n2
  AND x > least(x1, x2) - 20 AND x < greatest(x1, x2) + 20 AND y > least(y1, y2) - 20 AND y < greatest(y1, y2) + 20)
SELECT map_id, seg_id, node_id FROM h WHERE dx * dx + dy * dy > 0 AND px * dx + py * dy > 0 AND px * dx + py * dy < dx * dx + dy * dy AND (px * dy - py * dx) * (px * dy - py * dx) < 400e0 * (dx * dx + dy * dy)""",
    "node_overlaps_all": BASE + _RADII + "SELECT a.map_id, a.node_id AS a, b.node_id AS b FROM nr a JOIN nr b ON a.map_id = b.map_id AND a.node_id < b.node_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < (a.r + b.r) * (a.r + b.r) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.map_id = a.map_id AND least(n1, n2) = a.node_id AND greatest(n1, n2) = b.node_id)",
    "edge_through_node_all": BASE + _RADII + """, h AS (SELECT t.map_id, seg_id, rid, node_id, r, x2 - x1 AS dx, y2 - y1 AS dy, x - x1 AS px, y - y1 AS py FROM t JOIN nr ON t.map_id = nr.map_id AND node_id <> n1 AND node_id <> n2
  AND x > least(x1, x2) - 30 AND x < greatest(x1, x2) + 30 AND y > least(y1, y2) - 30 AND y < greatest(y1, y2) + 30)
SELECT map_id, seg_id, node_id FROM h WHERE dx * dx + dy * dy > 0 AND px * dx + py * dy > 0 AND px * dx + py * dy < dx * dx + dy * dy AND (px * dy - py * dx) * (px * dy - py * dx) < r * r * (dx * dx + dy * dy)
AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.map_id = h.map_id AND ow.node_id = h.node_id AND ow.rid = h.rid)""",
    "collinear_overlap": BASE + "SELECT a.map_id, a.axis, a.seg_id AS seg_p, b.seg_id AS seg_q FROM axis_ a JOIN axis_ b ON a.map_id = b.map_id AND a.axis = b.axis AND round_even(a.pos / 4e0, 0) = round_even(b.pos / 4e0, 0) AND a.seg_id < b.seg_id WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 12",
    "nearest_other": BASE + """, q AS (SELECT a.map_id, a.node_id, b.node_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.map_id = b.map_id AND a.bigg_id <> b.bigg_id)
SELECT map_id, node_id, other, floor(d2 * 1000000)::BIGINT AS d2 FROM q WHERE d2 <= 32400 QUALIFY row_number() OVER (PARTITION BY map_id, node_id ORDER BY d2, other) = 1""",
    "cell_clash": BASE + "SELECT map_id, sum(n_)::BIGINT AS n_clashes, count(*) AS n_cells FROM (SELECT map_id, floor(x / 100e0) AS cx, floor(y / 100e0) AS cy, greatest(count(DISTINCT regexp_extract(bigg_id, '(?:_|\\[)([a-z])\\]?$', 1)) - 1, 0) AS n_ FROM p GROUP BY ALL) GROUP BY ALL",
    "gap_remap": BASE + """, d AS (SELECT DISTINCT map_id, x FROM p WHERE x IS NOT NULL), g AS (SELECT *, greatest(coalesce(x - lag(x) OVER (PARTITION BY map_id ORDER BY x), 0e0) - 50e0, 0e0) AS e FROM d)
SELECT map_id, x, round_even(sum(e) OVER (PARTITION BY map_id ORDER BY x ROWS UNBOUNDED PRECEDING) * 10, 0)::BIGINT AS shift FROM g""",
    "scorecard": BASE + "SELECT map_id, n_points, " + ", ".join(f"floor({c} * 1000000)::BIGINT AS {c}" for c in D.GATES) + " FROM card",
    "gate_bands": BASE + 'SELECT map_id, metric, within_ AS "within" FROM band',
    "pooled_summary": BASE + "SELECT metric, count(*) AS n, floor(quantile_cont(value, 0.5) * 1000)::BIGINT AS median, floor(quantile_cont(value, 0.1) * 1000)::BIGINT AS p10, floor(quantile_cont(value, 0.9) * 1000)::BIGINT AS p90, floor(avg(within_::INT) * 1000)::BIGINT AS share_within FROM band GROUP BY metric",
    "worst_maps": BASE + "SELECT map_id, sum((NOT within_)::INT)::BIGINT AS n_failed FROM band GROUP BY map_id ORDER BY n_failed DESC, map_id LIMIT 20",
    "scorecard_all": WHOLE + "SELECT map_id, n_points, " + ", ".join(f"floor({c} * 1000000)::BIGINT AS {c}" for c in D.TARGETS) + " FROM whole",
    "gate_bands_all": WHOLE + 'SELECT map_id, metric, within_ AS "within" FROM wb',
    "pooled_summary_all": WHOLE + "SELECT metric, count(*) AS n, floor(quantile_cont(value, 0.5) * 1000)::BIGINT AS median, floor(quantile_cont(value, 0.1) * 1000)::BIGINT AS p10, floor(quantile_cont(value, 0.9) * 1000)::BIGINT AS p90, floor(avg(within_::INT) * 1000)::BIGINT AS share_within FROM wb GROUP BY metric",
    "worst_maps_all": WHOLE + "SELECT map_id, sum((NOT within_)::INT)::BIGINT AS n_failed FROM wb GROUP BY map_id ORDER BY n_failed DESC, map_id LIMIT 20",
}
