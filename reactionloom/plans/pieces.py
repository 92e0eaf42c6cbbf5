"""Queries on captions, on variants of the main pair, and on the geometry of drawn pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reactionloom.functions import text as T
from reactionloom.functions.chemistry import compartment, species
from reactionloom.operators import drawing as D
from reactionloom.operators import evaluation as E
from reactionloom.operators import naming as G
from reactionloom.operators import network as N
from reactionloom.operators.corridors import unrelated_edges
from reactionloom.plans.drawing import _RADII
from reactionloom.plans.drawing import BASE as MAPS
from reactionloom.plans.drawing import _nodes, _points, _segments

from reactionloom.plans.naming import _PHRASES, _label
from reactionloom.plans.network import BASE as MODEL
from reactionloom.plans.network import META, PAIRS, Model, _place, _species

#: Reactions of one piece.
PIECE = 25


def cluster_names(spark, folder):
    return G.cluster_names(Model(spark, folder).reactions)


def compound_classes_all(spark, folder):
    m = Model(spark, folder)
    return G.compound_classes_with_inorganic(G.compound_classes(m.stoich, m.reactions, N.transport_flags(m.stoich)), m.stoich, m.metabolites)


def trunk_links(spark, folder):
    """Links of clusters that are worth drawing: of weight 4 and more, at most 400 in a model."""
    m = Model(spark, folder)
    return N.select_links(N.meta_edges(*N.made_and_taken(N.backbone(m.stoich, m.scores), m.reactions)), 4, 400)


def themes(spark, folder):
    r = Model(spark, folder).reactions.select("model_id", F.floor(F.col("seq") / PIECE).alias("piece"), "seq", T.superclass(F.col("subsystem")).alias("label"))
    return G.themes(r, ["model_id", "piece"], "label")


def split_captions(spark, folder):
    family, qualifier = G.split_caption(F.col("name"))
    return Model(spark, folder).reactions.where("name is not null").select("rxn_row", family.alias("family"), qualifier.alias("qualifier"))


def display_labels(spark, folder):
    p = _points(spark, folder).where("bigg_id is not null").select("map_id", "node_id", species(F.col("bigg_id")).alias("compound"), compartment(F.col("bigg_id")).alias("place"))
    several = p.groupBy("map_id", "compound").agg((F.countDistinct("place") > 1).alias("several"))
    none = F.lit(None).cast("string")
    return p.join(several, ["map_id", "compound"]).select("map_id", "node_id", T.display_label(F.col("compound"), F.col("place"), F.col("several"), none, none).alias("label"))


def ablation_pairs(spark, folder):
    """By model: reactions whose main pair agrees with the record's own, in full, without tiers and without damping."""
    m = Model(spark, folder)
    plain = N.candidate_pairs(*m.base, damping=0.0)
    chosen = {"full": m.main_pairs, "no_tiers": N.main_pairs(m.candidates, tiers=False), "no_damping": N.main_pairs(plain)}
    rates = [E.agreement(pairs, E.reference_pairs(m.reactions)).withColumn("variant", F.lit(name)) for name, pairs in chosen.items()]
    full = rates[0].select("model_id", F.col("n_agree").alias("n_full"))
    return reduce(DataFrame.unionByName, rates).join(full, "model_id").select("model_id", "variant", "n", "n_agree", (F.col("n_agree") - F.col("n_full")).alias("gain"))


def bezier_lengths(spark, folder):
    return D.bezier_pieces(_segments(spark, folder)).withColumn("length", F.floor(F.col("length") * 1000).cast("bigint"))


def arc_controls(spark, folder):
    thousandths = lambda c: F.bround(F.col(c) * 100, 0).cast("bigint").alias(c)
    return D.arc_controls(_segments(spark, folder)).select("map_id", "seg_id", *[thousandths(c) for c in ("bend", "c1x", "c1y", "c2x", "c2y", "sagitta")])


def ring_radii(spark, folder):
    """By drawn reaction: nodes, and the radius of a ring that they would stand on."""
    owners = D.node_owners(_segments(spark, folder)).groupBy("map_id", "rid").agg(F.count("*").alias("n"))
    return owners.select("map_id", "rid", "n", F.floor(D.ring_radius(F.col("n")) * 1000).cast("bigint").alias("radius"))


def edge_through_unrelated(spark, folder):
    s, n = _segments(spark, folder), _nodes(spark, folder)
    return unrelated_edges(s, n, D.node_radius(), max(D.NODE_RADIUS.values()))


def merged_maps(spark, folder):
    nodes, lines = D.merged_maps(_nodes(spark, folder), _segments(spark, folder))
    return nodes.select(F.lit("node").alias("kind"), "id", F.col("bigg_id").alias("what")).unionByName(lines.select(F.lit("segment").alias("kind"), "id", F.col("rid").alias("what")))


QUERIES = {f.__name__: f for f in (cluster_names, compound_classes_all, trunk_links, themes, split_captions, display_labels, ablation_pairs, bezier_lengths, arc_controls, ring_radii, edge_through_unrelated, merged_maps)}

_END = "done AS (SELECT 1) "
_GENERAL = "acid acids transport exchange dehydrogenase reductase kinase oxidase synthase synthetase ligase hydrolase transferase isomerase phosphatase ester esters beta alpha gamma delta chain long short medium protein complex subunit family group class"
_CURVE = ", ".join(f"pow(1 - (i + {d}) / 10e0, 3) * {a}1 + 3 * pow(1 - (i + {d}) / 10e0, 2) * ((i + {d}) / 10e0) * b1.{a} + 3 * (1 - (i + {d}) / 10e0) * pow((i + {d}) / 10e0, 2) * b2.{a} + pow((i + {d}) / 10e0, 3) * {a}2 AS {a}{d}" for d in (0, 1) for a in "xy")


def _variant(name: str, base: str, order: str) -> str:
    """Agreement by model of the pairs that `order` puts first, over the candidates of `base`."""
    s, p = _species("substrate"), _species("product")
    tail = base + f"""bv AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY model_id, rid ORDER BY {order}) = 1),
rv AS (SELECT model_id, rid, least({_species('main_sub')}, {_species('main_prod')}) AS c1, greatest({_species('main_sub')}, {_species('main_prod')}) AS c2 FROM r WHERE main_sub IS NOT NULL AND main_prod IS NOT NULL)
SELECT model_id, '{name}' AS variant, count(*) AS n, sum((least({s}, {p}) = c1 AND greatest({s}, {p}) = c2)::INT)::BIGINT AS n_agree FROM bv JOIN rv USING (model_id, rid) GROUP BY model_id"""
    return f"SELECT * FROM ({tail})"


_RANKED = "tier, value DESC, substrate, product"
ORACLE = {
    "compound_classes_all": MODEL + f"""v AS (SELECT model_id, rid, {_label('subsystem')} AS label FROM r WHERE (model_id, rid) NOT IN (SELECT (model_id, rid) FROM moved)),
c AS (SELECT model_id, metabolite_id, label, count(*) AS n FROM (SELECT DISTINCT model_id, rid, metabolite_id FROM s) JOIN v USING (model_id, rid) WHERE label IS NOT NULL GROUP BY ALL),
x AS (SELECT *, sum(n) OVER (PARTITION BY model_id, metabolite_id) AS total, row_number() OVER (PARTITION BY model_id, metabolite_id ORDER BY n DESC, label) AS k FROM c),
ino AS (SELECT model_id, metabolite_id FROM m WHERE formula <> '' AND NOT regexp_matches(formula, 'C([^a-z]|$)') AND EXISTS (SELECT 1 FROM s WHERE s.model_id = m.model_id AND s.metabolite_id = m.metabolite_id))
SELECT model_id, metabolite_id, 'Inorganic ions' AS label FROM ino UNION ALL SELECT model_id, metabolite_id, label FROM x WHERE k = 1 AND n * 2 >= total AND (model_id, metabolite_id) NOT IN (SELECT (model_id, metabolite_id) FROM ino)""",
    "trunk_links": META.replace("weight >= 2", "weight >= 4") + """lk AS (SELECT * FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY model_id, a ORDER BY weight DESC, a, b) = 1)
UNION SELECT * FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY model_id, b ORDER BY weight DESC, a, b) = 1))
SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY weight DESC, a, b) <= 400""",
    "cluster_names": _PHRASES + f"""sz AS (SELECT model_id, subsystem, count(*) AS size FROM r WHERE subsystem IS NOT NULL GROUP BY ALL),
tt AS (SELECT model_id, count(*) AS total FROM r GROUP BY ALL), dm AS (SELECT model_id, phrase, count(*) AS d FROM ph GROUP BY ALL),
sc AS (SELECT model_id, subsystem, phrase, n / size::DOUBLE AS share, floor(n / size::DOUBLE * ln((total + 1) / (d + 1)::DOUBLE) * (1e0 + 0.6e0 * (len(string_split(phrase, ' ')) - 1)) * 1e9)::BIGINT AS score, phrase NOT IN ({', '.join(repr(w) for w in _GENERAL.split())}) AS says
  FROM (SELECT model_id, subsystem, phrase, count(*) AS n FROM ph WHERE subsystem IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) JOIN sz USING (model_id, subsystem) JOIN tt USING (model_id) JOIN dm USING (model_id, phrase) WHERE n / size::DOUBLE >= 0.15e0),
tp AS (SELECT model_id, subsystem, coalesce(max(score) FILTER (share >= 0.3e0) >= 250000000, false) AS strict, max(score) AS top FROM sc GROUP BY ALL),
po AS (SELECT sc.*, strict FROM sc JOIN tp USING (model_id, subsystem) WHERE (strict OR top >= 120000000) AND (NOT strict OR share >= 0.3e0)),
be AS (SELECT model_id, subsystem, strict, phrase AS best, score AS bs FROM po QUALIFY row_number() OVER (PARTITION BY model_id, subsystem ORDER BY says DESC, score DESC, phrase DESC) = 1),
se AS (SELECT po.model_id, po.subsystem, phrase AS second FROM po JOIN be USING (model_id, subsystem) WHERE says AND score >= 0.55e0 * bs AND len(list_intersect(string_split(phrase, ' '), string_split(best, ' '))) = 0 QUALIFY row_number() OVER (PARTITION BY po.model_id, po.subsystem ORDER BY score DESC, phrase DESC) = 1),
lb AS (SELECT model_id, subsystem, strict, upper(best[1]) || best[2:] AS one, upper(best[1]) || best[2:] || coalesce(' ' || upper(second[1]) || second[2:], '') AS two FROM be LEFT JOIN se USING (model_id, subsystem))
SELECT model_id, subsystem, regexp_replace(left(CASE WHEN length(two) > 46 THEN one ELSE two END, 46), '[ ,-]+$', '') AS label, strict FROM lb""",
    "themes": MODEL + f"""tr AS (SELECT model_id, seq // 25 AS piece, seq, {_label('subsystem')} AS label FROM r),
tc AS (SELECT model_id, piece, label, count(*) AS k, min(seq) AS f FROM tr WHERE label IS NOT NULL GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (PARTITION BY model_id, piece ORDER BY k DESC, f) AS place FROM tc),
tn AS (SELECT model_id, piece, count(*) AS n FROM tr GROUP BY ALL)
SELECT tn.model_id, tn.piece, n, CASE WHEN a.k >= 0.5 * n THEN a.label WHEN a.k + b.k >= 0.6 * n THEN a.label || ' / ' || b.label END AS theme FROM tn
LEFT JOIN tk a ON a.model_id = tn.model_id AND a.piece = tn.piece AND a.place = 1 LEFT JOIN tk b ON b.model_id = tn.model_id AND b.piece = tn.piece AND b.place = 2""",
    "split_captions": MODEL + _END + "SELECT rxn_row, regexp_replace(CASE WHEN contains(name, ': ') THEN string_split(name, ': ')[1] ELSE name END, ' \\([0-9]+\\)$', '') AS family, CASE WHEN contains(name, ': ') THEN substr(name, strpos(name, ': ') + 2) ELSE '' END AS qualifier FROM r WHERE name IS NOT NULL",
    "display_labels": MAPS + f""", dl AS (SELECT map_id, node_id, {_species('bigg_id')} AS c, {_place('bigg_id')} AS pl FROM p WHERE bigg_id IS NOT NULL),
ds AS (SELECT map_id, c, count(DISTINCT pl) > 1 AS several FROM dl GROUP BY ALL),
dt AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]{{1,4}}_?[0-9]{{4,}}') THEN CASE WHEN length(c) > 28 THEN rtrim(left(c, 27)) || '…' ELSE c END ELSE replace(replace(c, '__', '-'), '_', '-') END AS t FROM dl JOIN ds USING (map_id, c))
SELECT map_id, node_id, CASE WHEN several AND pl <> '' THEN t || '[' || pl || ']' ELSE t END AS label FROM dt""",
    "ablation_pairs": f"""WITH av AS ({_variant('full', PAIRS, _RANKED)} UNION ALL {_variant('no_tiers', PAIRS, _RANKED.replace('tier, ', ''))} UNION ALL {_variant('no_damping', PAIRS.replace('0.88e0', '0e0'), _RANKED)})
SELECT model_id, av.variant, av.n, av.n_agree, av.n_agree - f.n_agree AS gain FROM av JOIN (SELECT model_id, n_agree FROM av WHERE variant = 'full') f USING (model_id)""",
    "bezier_lengths": MAPS + f""", bz AS (SELECT DISTINCT s.map_id, s.seg_id, x1, y1, x2, y2, m.b1, m.b2 FROM s JOIN map_segments m ON m.map_id = s.map_id AND m.seg_id = s.seg_id WHERE m.b1 IS NOT NULL AND m.b2 IS NOT NULL),
pk AS (SELECT *, unnest(range(0, 10)) AS i FROM bz), pc AS (SELECT map_id, seg_id, {_CURVE} FROM pk)
SELECT map_id, seg_id, count(*) AS n_pieces, floor(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) * 1000)::BIGINT AS length FROM pc WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL GROUP BY ALL""",
    "arc_controls": MAPS + """, pt AS (SELECT map_id, rid, x1 AS x, y1 AS y FROM s UNION SELECT map_id, rid, x2, y2 FROM s), ct AS (SELECT map_id, rid, avg(x) AS cx, avg(y) AS cy FROM pt GROUP BY ALL),
ar AS (SELECT * REPLACE (CASE WHEN abs(bend) > pi() - 1e-6 THEN pi() ELSE bend END AS bend) FROM (SELECT s.*, cx, cy, x1 - cx AS ax, y1 - cy AS ay, x2 - cx AS bx, y2 - cy AS by_, atan2((x1 - cx) * (y2 - cy) - (y1 - cy) * (x2 - cx), (x1 - cx) * (x2 - cx) + (y1 - cy) * (y2 - cy)) AS bend,
  (sqrt((x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy)) + sqrt((x2 - cx) * (x2 - cx) + (y2 - cy) * (y2 - cy))) / 2 AS radius FROM s JOIN ct USING (map_id, rid))),
ak AS (SELECT *, tan(bend / 4) * 4 / 3 AS k, ((ax + bx) / 2 * -(y2 - y1) + (ay + by_) / 2 * (x2 - x1)) / len AS tw FROM ar WHERE ax * ax + ay * ay >= 1e-6 AND bx * bx + by_ * by_ >= 1e-6 AND abs(bend) >= 1e-6 AND len > 0)
SELECT map_id, seg_id, round_even(bend * 100, 0)::BIGINT AS bend, round_even((x1 - k * ay) * 100, 0)::BIGINT AS c1x, round_even((y1 + k * ax) * 100, 0)::BIGINT AS c1y, round_even((x2 + k * by_) * 100, 0)::BIGINT AS c2x, round_even((y2 - k * bx) * 100, 0)::BIGINT AS c2y,
round_even(CASE WHEN abs(tw) < 1e-6 THEN radius ELSE sign(tw) * (radius - abs(tw)) END * 100, 0)::BIGINT AS sagitta FROM ak""",
    "ring_radii": MAPS + ", ow AS (SELECT map_id, n1 AS node_id, rid FROM s WHERE rid IS NOT NULL UNION SELECT map_id, n2, rid FROM s WHERE rid IS NOT NULL) SELECT map_id, rid, count(*) AS n, floor(greatest(180e0, count(*) * 180e0 / (2 * pi())) * 1000)::BIGINT AS radius FROM ow GROUP BY ALL",
    "edge_through_unrelated": MAPS + _RADII + """, h AS (SELECT t.map_id, seg_id, rid, node_id, r, x2 - x1 AS dx, y2 - y1 AS dy, x - x1 AS px, y - y1 AS py FROM t JOIN nr ON t.map_id = nr.map_id AND node_id <> n1 AND node_id <> n2
  AND x > least(x1, x2) - 30 AND x < greatest(x1, x2) + 30 AND y > least(y1, y2) - 30 AND y < greatest(y1, y2) + 30),
hh AS (SELECT map_id, seg_id, rid, node_id FROM h WHERE dx * dx + dy * dy > 0 AND px * dx + py * dy > 0 AND px * dx + py * dy < dx * dx + dy * dy AND (px * dy - py * dx) * (px * dy - py * dx) < r * r * (dx * dx + dy * dy)),
tm AS (SELECT map_id, rid, node_id FROM ow JOIN p USING (map_id, node_id) WHERE rid IS NOT NULL),
rl AS (SELECT DISTINCT a.map_id, a.rid, b.rid AS other FROM tm a JOIN tm b ON a.map_id = b.map_id AND a.node_id = b.node_id)
SELECT map_id, seg_id, node_id FROM hh WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.map_id = hh.map_id AND ow.node_id = hh.node_id AND (ow.rid = hh.rid OR EXISTS (SELECT 1 FROM rl WHERE rl.map_id = hh.map_id AND rl.rid = hh.rid AND rl.other = ow.rid)))""",
    "merged_maps": MAPS + ", cf AS (SELECT rid, count(DISTINCT map_id) > 1 AS clash FROM s GROUP BY rid) SELECT 'node' AS kind, map_id || '_' || node_id AS id, bigg_id AS what FROM n UNION ALL SELECT 'segment', map_id || '_' || seg_id, CASE WHEN clash THEN rid || '~' || map_id ELSE rid END FROM s LEFT JOIN cf USING (rid)",
}
