"""Queries on agreement, statistics and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reactionloom.functions.chemistry import millionths
from reactionloom.operators import drawing as D
from reactionloom.operators import evaluation as E
from reactionloom.operators import graph as H
from reactionloom.operators import network as N
from reactionloom.plans.drawing import BASE as MAPS
from reactionloom.plans.drawing import WHOLE
from reactionloom.plans.drawing import _nodes, _points, _scores, _segments, _whole
from reactionloom.plans.network import PAIRS, Model, _species


def _reference(m: Model):
    return E.reference_pairs(m.reactions)


def agreement(spark, folder):
    m = Model(spark, folder)
    return E.agreement(m.main_pairs, _reference(m))


def pooled_rates(spark, folder):
    return E.pooled(agreement(spark, folder)).select("n", "n_agree", "n_models", "n_small", *[millionths(F.col(c)).alias(c) for c in ("median", "least", "greatest")])


def chance(spark, folder):
    m = Model(spark, folder)
    c = E.chance(m.candidates, _reference(m))
    return c.select("model_id", "n", "n_discriminating", F.floor(F.col("chance") * 1000).cast("bigint").alias("chance"), F.floor(F.col("chance_discriminating") * 1000).cast("bigint").alias("chance_discriminating"))


def precision_recall(spark, folder):
    m = Model(spark, folder)
    return E.precision_recall(E.degree_rule(m.stoich, N.degrees(m.stoich), 0.9), _reference(m))


def reference_variants(spark, folder):
    return E.reference_variants(_reference(Model(spark, folder)), F.regexp_replace("rid", r"_\d+$", ""))


def percentiles3(spark, folder):
    p = E.percentiles(N.degrees(Model(spark, folder).stoich), "model_id", "degree")
    return p.withColumn("linear", F.floor(F.col("linear") * 1000).cast("bigint"))


def ecdf(spark, folder):
    return E.ecdf(N.degrees(Model(spark, folder).stoich), "model_id", "degree", "metabolite_id").withColumn("share", millionths(F.col("share")))


def _tests(spark, folder):
    r = Model(spark, folder).reactions.where("subsystem is not null").select("subsystem", F.size("produced").alias("a"), F.size("consumed").alias("b"))
    return E.rank_biserial(E.signed_ranks(r, "subsystem", "a", "b"), "subsystem")


def rank_biserial(spark, folder):
    t = _tests(spark, folder)
    return t.select("subsystem", "n", millionths(F.col("effect")).alias("effect"), (F.col("w_pos") * 2).cast("bigint").alias("w2"), F.floor(F.col("z") * 1000).cast("bigint").alias("z"))


def holm(spark, folder):
    tests = _tests(spark, folder).select("subsystem", E.two_sided(F.col("z")).alias("p"))
    return E.holm(tests, "subsystem").select("subsystem", F.floor(F.col("p") * 10_000).cast("bigint").alias("p"), F.floor(F.col("p_holm") * 10_000).cast("bigint").alias("p_holm"))


def ring_cv(spark, folder):
    return E.radial_cv(_segments(spark, folder)).withColumn("cv", F.floor(F.col("cv") * 1000).cast("bigint"))


def size_bands(spark, folder):
    s = _scores(spark, folder)
    long = D.long_scores(s).join(s.select("map_id", "n_points"), "map_id")
    return E.size_bands(long).withColumn("median", F.floor(F.col("median") * 1000).cast("bigint"))


def metric_transform(spark, folder):
    s = D.long_scores(_scores(spark, folder))
    return s.select("map_id", "metric", F.floor(E.transformed(F.col("metric"), F.col("value")) * 1000).cast("bigint").alias("cost"))


def _whole_long(spark, folder):
    return D.long_scores(_whole(spark, folder), D.TARGETS)


def size_bands_all(spark, folder):
    s = _whole(spark, folder)
    long = D.long_scores(s, D.TARGETS).join(s.select("map_id", "n_points"), "map_id")
    return E.size_bands(long).withColumn("median", F.floor(F.col("median") * 1000).cast("bigint"))


def metric_transform_all(spark, folder):
    # Of the measures added to these, only longest_run_ratio has a gate from below; the others are costs as they are.
    cost = F.when(F.col("metric").isin("crossings_per_edge", "label_overlaps", "label_on_node", "label_on_edge"), F.col("value")).otherwise(E.transformed(F.col("metric"), F.col("value")))
    return _whole_long(spark, folder).select("map_id", "metric", F.floor(cost * 1000).cast("bigint").alias("cost"))


def _edges(spark, folder):
    return Model(spark, folder).edges


def components(spark, folder):
    return H.components(_edges(spark, folder))


def bfs_distance(spark, folder):
    """Steps from each model's three best connected compounds to every compound that they reach."""
    e = _edges(spark, folder)
    return H.distances(e, H.hubs(e))


def hubs(spark, folder):
    return H.hubs(_edges(spark, folder))


def k_hop(spark, folder):
    m = Model(spark, folder)
    b = N.backbone(m.stoich, m.scores)
    return H.neighbourhood(b, m.reactions.where("seq < 3"), 2)


def layers(spark, folder):
    return H.layers(_edges(spark, folder))


def proper_layering(spark, folder):
    e = _edges(spark, folder)
    return H.proper_edges(e, H.layers(e))


def layer_crossings(spark, folder):
    return H.layer_crossings(proper_layering(spark, folder))


def layers_all(spark, folder):
    return H.turned_layers(_edges(spark, folder))


def proper_layering_all(spark, folder):
    e = _edges(spark, folder)
    return H.proper_edges(H.turned(e), H.turned_layers(e)).drop("flat")


def layer_crossings_all(spark, folder):
    e = _edges(spark, folder)
    return H.layer_crossings(H.proper_edges(H.turned(e), H.turned_layers(e)))


def node_places(spark, folder):
    """How many metabolite nodes of each compound stand on each map, with their weighted centre."""
    p = _points(spark, folder).where("x is not null and y is not null")
    return p.groupBy("map_id", "bigg_id").agg(F.count("*").alias("n"), F.floor(F.avg("x") * 100).cast("bigint").alias("cx"), F.floor(F.avg("y") * 100).cast("bigint").alias("cy"))


def node_lives(spark, folder):
    """Nodes by type: rows, distinct nodes and nodes standing now."""
    from reactionloom.sources.tables import table

    all_rows = table(spark, folder, "map_nodes").groupBy("node_type").agg(F.count("*").alias("n_rows"), F.countDistinct("map_id", "node_id").alias("n_nodes"))
    return all_rows.join(_nodes(spark, folder).groupBy("node_type").agg(F.count("*").alias("n_standing")), "node_type", "left")


_NAMES = "agreement pooled_rates chance precision_recall reference_variants percentiles3 ecdf rank_biserial holm ring_cv size_bands metric_transform size_bands_all metric_transform_all components bfs_distance hubs k_hop layers proper_layering layer_crossings layers_all proper_layering_all layer_crossings_all node_places node_lives"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_SP, _PP = _species("main_sub"), _species("main_prod")
REF = PAIRS + f"""
ref AS (SELECT model_id, rid, least({_SP}, {_PP}) AS c1, greatest({_SP}, {_PP}) AS c2 FROM r WHERE main_sub IS NOT NULL AND main_prod IS NOT NULL),
jb AS (SELECT model_id, rid, least({_species('substrate')}, {_species('product')}) = c1 AND greatest({_species('substrate')}, {_species('product')}) = c2 AS hit FROM best JOIN ref USING (model_id, rid)),
ag AS (SELECT model_id, count(*) AS n, sum(hit::INT)::BIGINT AS n_agree FROM jb GROUP BY ALL),
jc AS (SELECT model_id, rid, count(*) AS k, sum((least({_species('substrate')}, {_species('product')}) = c1 AND greatest({_species('substrate')}, {_species('product')}) = c2)::INT) AS h FROM cand JOIN ref USING (model_id, rid) GROUP BY ALL),
cut AS (SELECT model_id, degree AS cut FROM ranked WHERE rn - 1 = least(n - 1, floor(n * 0.9e0))),
sx AS (SELECT *, degree < cut AS keep FROM s JOIN deg USING (model_id, metabolite_id) JOIN cut USING (model_id)),
sy AS (SELECT *, bool_or(keep) OVER (PARTITION BY model_id, rid, sign(coefficient)) AS some_ FROM sx),
sz AS (SELECT DISTINCT model_id, rid, metabolite_id, sign(coefficient) AS side FROM sy WHERE keep OR NOT some_),
dp AS (SELECT model_id, rid, a.metabolite_id AS substrate, b.metabolite_id AS product FROM sz a JOIN sz b USING (model_id, rid) WHERE a.side < 0 AND b.side > 0 AND a.metabolite_id <> b.metabolite_id),
jd AS (SELECT model_id, rid, count(*) AS k, sum((least({_species('substrate')}, {_species('product')}) = c1 AND greatest({_species('substrate')}, {_species('product')}) = c2)::INT) AS h FROM dp JOIN ref USING (model_id, rid) GROUP BY ALL),
rr AS (SELECT DISTINCT regexp_replace(rid, '_\\d+$', '') AS key, model_id, c1, c2 FROM ref),
rn_ AS (SELECT key, count(DISTINCT model_id) AS n_models FROM rr GROUP BY ALL),
rp AS (SELECT key, c1, c2, count(DISTINCT model_id) AS n FROM rr GROUP BY ALL),
td AS (SELECT subsystem, len(produced) - len(consumed) AS d FROM r WHERE subsystem IS NOT NULL AND len(produced) <> len(consumed)),
tr AS (SELECT subsystem, d, rank() OVER (PARTITION BY subsystem ORDER BY abs(d)) + (count(*) OVER (PARTITION BY subsystem, abs(d)) - 1) / 2e0 AS rank FROM td),
ti AS (SELECT subsystem, sum(c * c * c - c) AS ties FROM (SELECT subsystem, abs(d), count(*) AS c FROM td GROUP BY ALL) GROUP BY ALL),
tw AS (SELECT subsystem, count(*)::DOUBLE AS n, coalesce(sum(rank) FILTER (d > 0), 0e0) AS wp, coalesce(sum(rank) FILTER (d < 0), 0e0) AS wn FROM tr GROUP BY ALL),
tz AS (SELECT subsystem, n, wp, wn, CASE WHEN n >= 5 AND n * (n + 1) * (2 * n + 1) / 24 - ties / 48e0 > 0 THEN (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48e0) END AS z FROM tw JOIN ti USING (subsystem)),
"""
_T = "(1e0 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0)))"
HOLM = REF + f"""
tp AS (SELECT subsystem, ((((1.061405429e0 * {_T} - 1.453152027e0) * {_T} + 1.421413741e0) * {_T} - 0.284496736e0) * {_T} + 0.254829592e0) * {_T} * exp(-(z * z) / 2) AS p FROM tz),
th AS (SELECT subsystem, p, CASE WHEN p IS NOT NULL THEN max(least(1e0, (m - i + 1) * p)) OVER (ORDER BY p, subsystem ROWS UNBOUNDED PRECEDING) END AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, subsystem) AS i, count(p) OVER () AS m FROM tp WHERE p IS NOT NULL)),
"""
GRAPH = PAIRS.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """
un AS (SELECT model_id, u, v FROM ce UNION SELECT model_id, v, u FROM ce),
hb AS (SELECT model_id, u AS node, count(*) AS n, row_number() OVER (PARTITION BY model_id ORDER BY count(*) DESC, u) AS rank FROM un GROUP BY model_id, u),
dg AS (SELECT model_id, u, v FROM ce WHERE u < v),
"""
TURNED = GRAPH + """
pt AS (SELECT model_id, u AS node, 0 AS d FROM dg UNION SELECT model_id, v, 0 FROM dg UNION SELECT dg.model_id, dg.v, pt.d + 1 FROM pt JOIN dg ON dg.model_id = pt.model_id AND dg.u = pt.node),
ly AS (SELECT model_id, node, max(d) AS layer FROM pt GROUP BY ALL),
pe AS (SELECT dg.model_id, dg.u, dg.v, a.layer AS lu, b.layer AS lv, unnest(range(a.layer, b.layer))::INT AS from_layer FROM dg JOIN ly a ON a.model_id = dg.model_id AND a.node = dg.u JOIN ly b ON b.model_id = dg.model_id AND b.node = dg.v),
pr AS (SELECT model_id, from_layer, CASE WHEN from_layer = lu THEN u ELSE u || '>' || v || '@' || from_layer END AS a, CASE WHEN from_layer + 1 = lv THEN v ELSE u || '>' || v || '@' || (from_layer + 1) END AS b FROM pe),
"""
#: Over all edges, back edges turned round.
LAYERS_ALL = TURNED.replace("dg AS (SELECT model_id, u, v FROM ce WHERE u < v)", "dg AS (SELECT DISTINCT model_id, least(u, v) AS u, greatest(u, v) AS v FROM ce WHERE u <> v)")
#: Over all edges, nodes that reach one another counted as one.
LAYERS = GRAPH + """
rc AS (SELECT model_id, u, v FROM ce WHERE u <> v UNION SELECT rc.model_id, rc.u, ce.v FROM rc JOIN ce ON ce.model_id = rc.model_id AND ce.u = rc.v),
nd AS (SELECT model_id, u AS node FROM ce UNION SELECT model_id, v FROM ce),
sc AS (SELECT nd.model_id, node, least(node, coalesce(min(x.v), node)) AS c FROM nd LEFT JOIN (SELECT p.model_id, p.u, p.v FROM rc p JOIN rc q ON p.model_id = q.model_id AND p.u = q.v AND p.v = q.u) x ON x.model_id = nd.model_id AND x.u = node GROUP BY nd.model_id, node),
dc AS (SELECT DISTINCT ce.model_id, a.c AS u, b.c AS v FROM ce JOIN sc a ON a.model_id = ce.model_id AND a.node = ce.u JOIN sc b ON b.model_id = ce.model_id AND b.node = ce.v WHERE a.c <> b.c),
pt AS (SELECT DISTINCT model_id, c AS node, 0 AS d FROM sc UNION SELECT dc.model_id, dc.v, pt.d + 1 FROM pt JOIN dc ON dc.model_id = pt.model_id AND dc.u = pt.node),
lc AS (SELECT model_id, node, max(d) AS layer FROM pt GROUP BY ALL),
ly AS (SELECT sc.model_id, sc.node, layer FROM sc JOIN lc ON lc.model_id = sc.model_id AND lc.node = sc.c),
pe AS (SELECT ce.model_id, ce.u, ce.v, a.layer AS lu, b.layer AS lv, unnest(range(a.layer, greatest(b.layer, a.layer + 1)))::INT AS from_layer FROM ce JOIN ly a ON a.model_id = ce.model_id AND a.node = ce.u JOIN ly b ON b.model_id = ce.model_id AND b.node = ce.v WHERE ce.u <> ce.v),
pr AS (SELECT model_id, from_layer, CASE WHEN from_layer = lu THEN u ELSE u || '>' || v || '@' || from_layer END AS a, CASE WHEN lu = lv OR from_layer + 1 = lv THEN v ELSE u || '>' || v || '@' || (from_layer + 1) END AS b, lu = lv AS flat FROM pe),
"""
_END = "done AS (SELECT 1) "
ORACLE = {
    "agreement": REF + _END + "SELECT * FROM ag",
    "pooled_rates": REF + _END + "SELECT sum(n)::BIGINT AS n, sum(n_agree)::BIGINT AS n_agree, sum((n >= 20)::INT)::BIGINT AS n_models, sum((n < 20)::INT)::BIGINT AS n_small, floor(quantile_cont(n_agree / n::DOUBLE, 0.5) FILTER (n >= 20) * 1000000)::BIGINT AS median, floor(min(n_agree / n::DOUBLE) FILTER (n >= 20) * 1000000)::BIGINT AS least, floor(max(n_agree / n::DOUBLE) FILTER (n >= 20) * 1000000)::BIGINT AS greatest FROM ag",
    "chance": REF + _END + "SELECT model_id, count(*) AS n, sum((h < k)::INT)::BIGINT AS n_discriminating, floor(avg(h / k::DOUBLE) * 1000)::BIGINT AS chance, floor(avg(h / k::DOUBLE) FILTER (h < k) * 1000)::BIGINT AS chance_discriminating FROM jc GROUP BY model_id",
    "precision_recall": REF + _END + "SELECT model_id, sum(k)::BIGINT AS n_pairs, sum(h)::BIGINT AS n_hits, count(*) AS n_reactions, sum((h > 0)::INT)::BIGINT AS n_found FROM jd GROUP BY model_id",
    "reference_variants": REF + _END + "SELECT key, count(*) AS n_union, sum((n * 2 > n_models)::INT)::BIGINT AS n_majority, sum((n = n_models)::INT)::BIGINT AS n_intersection FROM rp JOIN rn_ USING (key) GROUP BY key",
    "percentiles3": REF + _END + "SELECT model_id, max(degree) FILTER (rn - 1 = least(n - 1, floor(n * 0.9e0))) AS nearest, floor(quantile_cont(degree, 0.9) * 1000)::BIGINT AS linear, max(degree) FILTER (rn - 1 = floor((n - 1) * 0.9e0)) AS lower FROM ranked GROUP BY model_id",
    "ecdf": REF + _END + "SELECT model_id, metabolite_id, degree, floor(rn / n::DOUBLE * 1000000)::BIGINT AS share FROM ranked",
    "rank_biserial": REF + _END + "SELECT subsystem, n::BIGINT AS n, floor((wp - wn) / (wp + wn) * 1000000)::BIGINT AS effect, (wp * 2)::BIGINT AS w2, floor(z * 1000)::BIGINT AS z FROM tz",
    "holm": HOLM + _END + "SELECT subsystem, floor(tp.p * 10000)::BIGINT AS p, floor(p_holm * 10000)::BIGINT AS p_holm FROM tp LEFT JOIN th USING (subsystem)",
    "ring_cv": MAPS + """, pt AS (SELECT map_id, rid, x1 AS x, y1 AS y FROM s UNION SELECT map_id, rid, x2, y2 FROM s),
ct AS (SELECT map_id, rid, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM pt GROUP BY ALL),
rd AS (SELECT map_id, rid, n, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM pt JOIN ct USING (map_id, rid))
SELECT map_id, rid, max(n) AS n, CASE WHEN max(n) >= 3 THEN floor(stddev_pop(r) / avg(r) * 1000)::BIGINT END AS cv FROM rd GROUP BY map_id, rid""",
    "size_bands": MAPS + "SELECT CASE WHEN n_points < 10 THEN 'small' WHEN n_points < 50 THEN 'middle' ELSE 'large' END AS band, metric, floor(quantile_cont(value, 0.5) * 1000)::BIGINT AS median, count(*) AS n FROM long_ JOIN (SELECT map_id, n_points FROM card) USING (map_id) GROUP BY 1, 2",
    "metric_transform": MAPS + "SELECT map_id, metric, floor(CASE metric WHEN 'aspect_ratio' THEN abs(ln(value)) WHEN 'hairball_index' THEN greatest(value - 3e0, 0e0) ELSE -value END * 1000)::BIGINT AS cost FROM long_",
    "components": GRAPH + "cc AS (SELECT model_id, u AS node, u AS c FROM un UNION SELECT un.model_id, un.v, cc.c FROM cc JOIN un ON un.model_id = cc.model_id AND un.u = cc.node) SELECT model_id, node, min(c) AS component FROM cc GROUP BY model_id, node",
    "bfs_distance": GRAPH + "bf AS (SELECT model_id, node, 0 AS d FROM hb WHERE rank <= 3 UNION SELECT un.model_id, un.v, d + 1 FROM bf JOIN un ON un.model_id = bf.model_id AND un.u = bf.node WHERE d < 40) SELECT model_id, node, min(d) AS distance FROM bf GROUP BY model_id, node",
    "hubs": GRAPH + _END + "SELECT * FROM hb WHERE rank <= 3",
    "k_hop": PAIRS + """h0 AS (SELECT model_id, rid FROM r WHERE seq < 3),
h1 AS (SELECT DISTINCT b.model_id, b.rid FROM h0 JOIN bb a USING (model_id, rid) JOIN bb b ON b.model_id = a.model_id AND b.metabolite_id = a.metabolite_id),
h2 AS (SELECT DISTINCT b.model_id, b.rid FROM h1 JOIN bb a USING (model_id, rid) JOIN bb b ON b.model_id = a.model_id AND b.metabolite_id = a.metabolite_id)
SELECT model_id, rid, min(h)::INT AS hops FROM (SELECT *, 0 AS h FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY model_id, rid""",
    "size_bands_all": WHOLE + "SELECT CASE WHEN n_points < 10 THEN 'small' WHEN n_points < 50 THEN 'middle' ELSE 'large' END AS band, metric, floor(quantile_cont(value, 0.5) * 1000)::BIGINT AS median, count(*) AS n FROM wl GROUP BY ALL",
    "metric_transform_all": WHOLE + "SELECT map_id, metric, floor(CASE WHEN metric = 'aspect_ratio' THEN abs(ln(value)) WHEN metric = 'hairball_index' THEN greatest(value - 3e0, 0e0) WHEN metric LIKE 'label%' OR metric = 'crossings_per_edge' THEN value ELSE -value END * 1000)::BIGINT AS cost FROM wl",
    "layers": LAYERS + _END + "SELECT * FROM ly",
    "proper_layering": LAYERS + _END + "SELECT * FROM pr",
    "layer_crossings": LAYERS + _END + "SELECT model_id, from_layer, count(*) AS n_crossings FROM pr x JOIN pr y USING (model_id, from_layer) WHERE x.a < y.a AND x.b > y.b AND NOT x.flat AND NOT y.flat GROUP BY ALL",
    "layers_all": LAYERS_ALL + _END + "SELECT * FROM ly",
    "proper_layering_all": LAYERS_ALL + _END + "SELECT * FROM pr",
    "layer_crossings_all": LAYERS_ALL + _END + "SELECT model_id, from_layer, count(*) AS n_crossings FROM pr x JOIN pr y USING (model_id, from_layer) WHERE x.a < y.a AND x.b > y.b GROUP BY ALL",
    "node_places": MAPS + "SELECT map_id, bigg_id, count(*) AS n, floor(avg(x) * 100)::BIGINT AS cx, floor(avg(y) * 100)::BIGINT AS cy FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL",
    "node_lives": MAPS + "SELECT node_type, n_rows, n_nodes, n_standing FROM (SELECT node_type, count(*) AS n_rows, count(DISTINCT (map_id, node_id)) AS n_nodes FROM map_nodes GROUP BY ALL) LEFT JOIN (SELECT node_type, count(*) AS n_standing FROM n GROUP BY ALL) USING (node_type)",
}
