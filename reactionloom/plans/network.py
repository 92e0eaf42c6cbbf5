"""Queries on the reaction network: main pairs (the flagship), scores, predicates and linkage of functions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.functions.chemistry import ELEMENTS, HEAVY, SKELETON, millionths, species
from reactionloom.operators import network as N
from reactionloom.sources.tables import table
from reactionloom.storage import written


class Model:
    """The cleaned model tables of a data folder, built as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @property
    def stoich(self) -> DataFrame:
        return N.clean_stoich(table(self.spark, self.folder, "stoich"))

    @property
    def metabolites(self) -> DataFrame:
        return N.clean_metabolites(table(self.spark, self.folder, "metabolites"))

    @property
    def reactions(self) -> DataFrame:
        return N.clean_reactions(table(self.spark, self.folder, "reaction_records"))

    @property
    def scores(self) -> DataFrame:
        return N.cofactor_scores(N.degrees(self.stoich))

    @cached_property
    def base(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entries, metabolites and scores, each written once: the pairs read them several times."""
        stoich = written(self.stoich, "stoich")
        return stoich, written(self.metabolites, "metabolites"), written(N.cofactor_scores(N.degrees(stoich)), "scores")

    @property
    def candidates(self) -> DataFrame:
        return N.candidate_pairs(*self.base)

    @property
    def edges(self) -> DataFrame:
        """The graph of main compounds, written once: what works on it reads it several times."""
        return written(N.compound_edges(self.main_pairs), "edges")

    @property
    def main_pairs(self) -> DataFrame:
        return N.main_pairs(self.candidates)


def main_pair(spark, folder):
    return Model(spark, folder).main_pairs.withColumn("value", millionths(F.col("value")))


def moiety_pairs(spark, folder):
    return Model(spark, folder).candidates.withColumn("value", millionths(F.col("value")))


def near_tie_alternates(spark, folder):
    return N.near_ties(Model(spark, folder).candidates)


def stoich_long(spark, folder):
    m = Model(spark, folder)
    return N.stoich_with_metabolites(m.stoich, m.metabolites)


def signed_split(spark, folder):
    x = N.signed_split(Model(spark, folder).stoich)
    return x.select(*N.REACTION, F.array_join("substrates", " ").alias("substrates"), F.array_join("products", " ").alias("products"))


def degree(spark, folder):
    return N.degrees(Model(spark, folder).stoich)


def cofactor_score(spark, folder):
    return Model(spark, folder).scores.withColumn("score", millionths(F.col("score")))


def currency_filter(spark, folder):
    m = Model(spark, folder)
    return N.backbone(m.stoich, m.scores).select(*N.REACTION, "pos", "metabolite_id")


def boundary_flag(spark, folder):
    m = Model(spark, folder)
    return N.boundary_flags(m.reactions, m.stoich)


def transport_flag(spark, folder):
    return N.transport_flags(Model(spark, folder).stoich)


def reversible_flag(spark, folder):
    lb, ub = F.coalesce("lower_bound", F.lit(0.0)), F.coalesce("upper_bound", F.lit(0.0))
    return Model(spark, folder).reactions.select(*N.REACTION, ((lb < 0) & (ub > 0)).alias("by_bounds"), ((lb < 0) & (ub > 0) == F.col("reversible")).alias("agrees"))


def formula_counts(spark, folder):
    return N.with_atoms(Model(spark, folder).metabolites).drop("name", "formula")


def compound_graph(spark, folder):
    return N.compound_edges(Model(spark, folder).main_pairs)


def antiparallel_edges(spark, folder):
    return N.antiparallel(Model(spark, folder).edges)


def meta_edges(spark, folder):
    m = Model(spark, folder)
    return N.meta_edges(*N.made_and_taken(N.backbone(m.stoich, m.scores), m.reactions))


def shared_metabolites(spark, folder):
    m = Model(spark, folder)
    return N.shared_metabolites(N.backbone(m.stoich, m.scores), m.reactions)


def select_links(spark, folder):
    return N.select_links(meta_edges(spark, folder))


def conversions(spark, folder):
    m = Model(spark, folder)
    return N.conversions(m.stoich, m.scores)


def short_cycles(spark, folder):
    return N.short_cycles(Model(spark, folder).edges)


def short_cycles_all(spark, folder):
    return N.rings(Model(spark, folder).edges)


def species_copies(spark, folder):
    x = Model(spark, folder).metabolites.withColumn("species", species(F.col("metabolite_id")))
    return x.groupBy("species").agg(F.countDistinct("model_id").alias("n_models"), F.countDistinct("compartment").alias("n_places"), F.count("*").alias("n_rows"))


def orphan_metabolites(spark, folder):
    """Anti join: metabolites of a model that no reaction uses."""
    m = Model(spark, folder)
    return m.metabolites.select(*N.METABOLITE).join(m.stoich, N.METABOLITE, "left_anti")


def used_models(spark, folder):
    """Semi join: models with at least one reaction."""
    return table(spark, folder, "model_list", "model_id", "grade").join(table(spark, folder, "reaction_records", "model_id"), "model_id", "left_semi")


_NAMES = "main_pair moiety_pairs near_tie_alternates stoich_long signed_split degree cofactor_score currency_filter boundary_flag transport_flag reversible_flag formula_counts compound_graph antiparallel_edges meta_edges shared_metabolites select_links conversions short_cycles short_cycles_all species_copies orphan_metabolites used_models"
QUERIES = {name: globals()[name] for name in _NAMES.split()}


def _species(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^M_', ''), '(_[a-z]|\\[[a-z]\\])$', '')"


def _place(col: str) -> str:
    return f"regexp_extract({col}, '(?:_|\\[)([a-z])\\]?$', 1)"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _atoms(e: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(formula, '{e}([0-9]*)(?:[^a-z0-9]|$)', 1), lambda d: CASE WHEN d = '' THEN 1 ELSE d::INT END)), 0)::INT"


def _moiety() -> str:
    heavy = [e for e in ELEMENTS if e != "H"]
    least = lambda e: f"least(s_{e}, p_{e})"
    weigh = lambda f: "(" + " + ".join(f"{w}e0 * {f(e)}" for e, w in SKELETON.items()) + ")"
    plain = lambda f: f"({HEAVY}e0 * (" + " + ".join(f(e) for e in heavy) + "))"
    size = lambda p: f"(CASE WHEN {weigh(lambda e: f'{p}_{e}')} = 0 THEN {plain(lambda e: f'{p}_{e}')} ELSE {weigh(lambda e: f'{p}_{e}')} END)"
    overlap = f"(CASE WHEN {weigh(least)} = 0 THEN {plain(least)} ELSE {weigh(least)} END)"
    return f"(CASE WHEN {overlap} = 0 THEN 0e0 ELSE {overlap} * (0.4e0 + 0.6e0 * least({overlap} / greatest({size('s')}, {size('p')}, 1e-9), 1e0)) END)"


def _trigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, length({t}) + 1), lambda i: substr(' ' || {t} || ' ', i::INT, 3)))"


BASE = f"""
WITH s AS (SELECT DISTINCT model_id, rid, pos, metabolite_id, coefficient FROM stoich WHERE metabolite_id IS NOT NULL AND coefficient <> 0),
m AS (SELECT * EXCLUDE (degree) FROM metabolites QUALIFY row_number() OVER (PARTITION BY model_id, metabolite_id ORDER BY met_row, loaded_at DESC) = 1),
r AS (SELECT DISTINCT ON (rxn_row) * FROM reaction_records),
deg AS (SELECT model_id, metabolite_id, count(DISTINCT rid) AS degree FROM s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY degree, metabolite_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM deg),
bounds AS (SELECT model_id, max(degree) FILTER (rn = least(n - 1, floor(n * 0.85e0)) + 1) AS lo, max(degree) FILTER (rn = least(n - 1, floor(n * 0.98e0)) + 1) AS hi FROM ranked GROUP BY ALL),
cof AS (SELECT model_id, metabolite_id, degree, greatest(least(greatest(CASE WHEN hi > lo THEN (degree - lo) / (hi - lo)::DOUBLE ELSE (degree >= hi)::INT::DOUBLE END, 0e0), 1e0),
  CASE WHEN {_species('metabolite_id')} IN ({_list(N.CURATED)}) THEN 1e0 ELSE 0e0 END) AS score FROM deg JOIN bounds USING (model_id)),
bb AS (SELECT s.* FROM s LEFT JOIN cof USING (model_id, metabolite_id) WHERE coalesce(score, 0) < 0.5),
moved AS (SELECT model_id, rid, {_species('metabolite_id')} AS sp FROM s GROUP BY ALL HAVING min(coefficient) < 0 AND max(coefficient) > 0),
"""

PAIRS = BASE + f"""
e AS (SELECT model_id, rid, metabolite_id AS id, {_species('metabolite_id')} AS sp, {_place('metabolite_id')} AS place, k, m.name, m.formula, coalesce(score, 0e0) AS cof, coalesce(degree, 0) AS deg,
  {', '.join(f"{_atoms(x).replace('formula', 'm.formula')} AS {x}" for x in ELEMENTS)}
  FROM (SELECT model_id, rid, metabolite_id, sum(coefficient) AS k FROM s GROUP BY ALL) LEFT JOIN m USING (model_id, metabolite_id) LEFT JOIN cof USING (model_id, metabolite_id)),
x AS (SELECT model_id, rid, {', '.join(f'a.{c} AS s_{c}, b.{c} AS p_{c}' for c in ('id', 'sp', 'place', 'name', 'formula', 'cof', 'deg', *ELEMENTS))}
  FROM e a JOIN e b USING (model_id, rid) WHERE a.k < 0 AND b.k > 0 AND a.id <> b.id),
y AS (SELECT *, {_moiety()} AS chem, lower(coalesce(s_name, s_id)) AS sn, lower(coalesce(p_name, p_id)) AS pn,
  (s_sp IN ({_list(N.NEVER_PRIMARY)}))::INT + (p_sp IN ({_list(N.NEVER_PRIMARY)}))::INT + CASE WHEN s_sp <> p_sp AND ((model_id, rid, s_sp) IN (SELECT (model_id, rid, sp) FROM moved) OR (model_id, rid, p_sp) IN (SELECT (model_id, rid, sp) FROM moved)) THEN 3 ELSE 0 END AS tier FROM x),
z AS (SELECT *, CASE WHEN chem <> 0 THEN chem WHEN s_sp = p_sp THEN CASE WHEN s_sp IN ({_list(N.SUPPRESSED)}) THEN 0.1e0 ELSE 1e0 END
  WHEN coalesce(s_formula, '') = '' OR coalesce(p_formula, '') = '' THEN 0.05e0 + 0.9e0 * (CASE WHEN length(sn) > 0 AND length(pn) > 0 THEN len(list_intersect({_trigrams('sn')}, {_trigrams('pn')}))::DOUBLE / len(list_distinct(list_concat({_trigrams('sn')}, {_trigrams('pn')}))) ELSE 0e0 END) ELSE 0e0 END
  * 1e0 AS v0 FROM y),
c AS (SELECT model_id, rid, s_id AS substrate, p_id AS product, tier, CASE WHEN s_place = p_place THEN v1 * 1.02e0 ELSE v1 END AS value
  FROM (SELECT *, v0 * (1e0 - 0.88e0 * s_cof) * (1e0 - 0.88e0 * p_cof) * (1e0 - 0.1e0 * least(s_deg + p_deg, 2000) / 2000e0) AS v1 FROM z)),
cand AS (SELECT * FROM c WHERE value > 0),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY model_id, rid ORDER BY tier, value DESC, substrate, product) = 1),
ce AS (SELECT model_id, substrate AS u, product AS v, array_to_string(list_sort(list(DISTINCT rid)), ' ') AS rids, count(*) AS n FROM best GROUP BY ALL),
"""

META = BASE + """
rc AS (SELECT model_id, rid, coalesce(reversible, false) AS rev, subsystem AS cluster FROM r WHERE subsystem IS NOT NULL),
mk AS (SELECT DISTINCT model_id, cluster, metabolite_id FROM bb JOIN rc USING (model_id, rid) WHERE coefficient > 0 OR rev),
tk AS (SELECT DISTINCT model_id, cluster, metabolite_id FROM bb JOIN rc USING (model_id, rid) WHERE coefficient < 0 OR rev),
me AS (SELECT model_id, mk.cluster AS a, tk.cluster AS b, count(*) AS weight, array_to_string(list_sort(list(metabolite_id)), ' ') AS mets FROM mk JOIN tk USING (model_id, metabolite_id) WHERE mk.cluster <> tk.cluster GROUP BY ALL),
st AS (SELECT model_id, a, b, weight FROM me WHERE weight >= 2),
"""

_END = "done AS (SELECT 1) "
ORACLE = {
    "main_pair": PAIRS + _END + "SELECT model_id, rid, substrate, product, tier, floor(value * 1000000)::BIGINT AS value FROM best",
    "moiety_pairs": PAIRS + _END + "SELECT model_id, rid, substrate, product, tier, floor(value * 1000000)::BIGINT AS value FROM cand",
    "near_tie_alternates": PAIRS + """b1 AS (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY model_id, rid)),
b2 AS (SELECT * FROM b1 QUALIFY value >= 0.7e0 * max(value) OVER (PARTITION BY model_id, rid))
SELECT * EXCLUDE (value) FROM (SELECT *, count(*) OVER (PARTITION BY model_id, rid) AS n_near FROM b2) WHERE n_near > 1""",
    "stoich_long": BASE + _END + "SELECT model_id, rid, pos, metabolite_id, coefficient, m.name, m.met_row IS NULL AS virtual FROM s LEFT JOIN m USING (model_id, metabolite_id)",
    "signed_split": BASE + _END + """SELECT model_id, rid, coalesce(array_to_string(list_sort(list(DISTINCT metabolite_id) FILTER (coefficient < 0)), ' '), '') AS substrates,
coalesce(array_to_string(list_sort(list(DISTINCT metabolite_id) FILTER (coefficient > 0)), ' '), '') AS products FROM s GROUP BY ALL""",
    "degree": BASE + _END + "SELECT * FROM deg",
    "cofactor_score": BASE + _END + "SELECT model_id, metabolite_id, degree, floor(score * 1000000)::BIGINT AS score FROM cof",
    "currency_filter": BASE + _END + "SELECT model_id, rid, pos, metabolite_id FROM bb",
    "boundary_flag": BASE + f"""sides AS (SELECT model_id, rid, bool_or(coefficient < 0) AS hs, bool_or(coefficient > 0) AS hp, bool_or(coefficient < 0 AND main) AS bs, bool_or(coefficient > 0 AND main) AS bp
FROM (SELECT *, {_species('metabolite_id')} NOT IN ({_list('atp adp amp gtp gdp gmp utp udp ump ctp cdp cmp pi ppi pppi nad nadh nadp nadph fad fadh2 fmn fmnh2 coa co2 o2 h2o2 nh4 gthrd gthox q8 q8h2 mqn8 mql8 trdox trdrd h h2o'.split())}) AS main FROM s) GROUP BY ALL)
SELECT model_id, rid, coalesce(regexp_matches(upper(rid), '^(EX_|DM_|SK_|BIOMASS|ATPM)') OR NOT hs OR NOT hp OR bs <> bp, true) AS boundary FROM r LEFT JOIN sides USING (model_id, rid)""",
    "transport_flag": BASE + _END + "SELECT model_id, rid, array_to_string(list_sort(list(sp)), ' ') AS moved, count(*) AS n_moved FROM moved GROUP BY model_id, rid",
    "reversible_flag": BASE + _END + "SELECT model_id, rid, coalesce(lower_bound, 0) < 0 AND coalesce(upper_bound, 0) > 0 AS by_bounds, (coalesce(lower_bound, 0) < 0 AND coalesce(upper_bound, 0) > 0) = reversible AS agrees FROM r",
    "formula_counts": BASE + _END + f"SELECT model_id, metabolite_id, {', '.join(f'{_atoms(x)} AS n_{x}' for x in ELEMENTS)} FROM m",
    "compound_graph": PAIRS + _END + "SELECT model_id, u, v, rids, n FROM ce",
    "antiparallel_edges": PAIRS + _END + "SELECT model_id, x.u, x.v, x.n + y.n AS n FROM ce x JOIN ce y USING (model_id) WHERE x.u = y.v AND x.v = y.u AND (x.n > y.n OR x.n = y.n AND x.u < x.v)",
    "meta_edges": META + _END + "SELECT * FROM me",
    "shared_metabolites": META + """u AS (SELECT DISTINCT model_id, cluster, metabolite_id FROM bb JOIN rc USING (model_id, rid))
SELECT model_id, x.cluster AS a, y.cluster AS b, count(*) AS n_shared FROM u x JOIN u y USING (model_id, metabolite_id) WHERE x.cluster < y.cluster GROUP BY ALL""",
    "select_links": META + _END + """SELECT * FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY model_id, a ORDER BY weight DESC, a, b) = 1)
UNION SELECT * FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY model_id, b ORDER BY weight DESC, a, b) = 1)""",
    "conversions": BASE + f"""d AS (SELECT DISTINCT x.model_id, x.metabolite_id AS u, y.metabolite_id AS v FROM bb x JOIN bb y USING (model_id, rid)
WHERE x.coefficient < 0 AND y.coefficient > 0 AND {_place('x.metabolite_id')} = {_place('y.metabolite_id')} AND {_species('x.metabolite_id')} <> {_species('y.metabolite_id')}),
both_ AS (SELECT *, 1 AS steps FROM d UNION ALL SELECT a.model_id, a.u, b.v, 2 FROM d a JOIN d b ON a.model_id = b.model_id AND a.v = b.u WHERE a.u <> b.v)
SELECT model_id, u, v, min(steps) AS steps FROM both_ GROUP BY ALL""",
    "short_cycles": PAIRS + """g AS (SELECT model_id, u, v FROM ce WHERE u <> v),
t AS (SELECT a.model_id, a.u AS n1, a.v AS n2, b.v AS n3 FROM g a JOIN g b ON a.model_id = b.model_id AND a.v = b.u WHERE a.u < a.v AND b.v > a.u AND b.v <> a.v)
SELECT t.model_id, concat_ws(' ', n1, n2, n3) AS cycle, 3 AS size FROM t JOIN g ON g.model_id = t.model_id AND g.u = n3 AND g.v = n1
UNION ALL SELECT t.model_id, concat_ws(' ', n1, n2, n3, h.v), 4 FROM t JOIN g h ON h.model_id = t.model_id AND h.u = n3 JOIN g k ON k.model_id = t.model_id AND k.u = h.v AND k.v = n1 WHERE h.v > n1 AND h.v <> n2 AND h.v <> n3""",
    "short_cycles_all": PAIRS.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """g AS (SELECT model_id, u, v FROM ce WHERE u <> v),
w AS (SELECT model_id, [u, v] AS p FROM g WHERE u < v UNION ALL SELECT w.model_id, list_append(p, g.v) FROM w JOIN g ON g.model_id = w.model_id AND g.u = p[-1] WHERE len(p) < 14 AND g.v > p[1] AND NOT list_contains(p, g.v))
SELECT w.model_id, array_to_string(p, ' ') AS cycle, len(p)::INT AS size FROM w JOIN g ON g.model_id = w.model_id AND g.u = p[-1] AND g.v = p[1] WHERE len(p) >= 3""",
    "species_copies": BASE + _END + f"SELECT {_species('metabolite_id')} AS species, count(DISTINCT model_id) AS n_models, count(DISTINCT compartment) AS n_places, count(*) AS n_rows FROM m GROUP BY 1",
    "orphan_metabolites": BASE + _END + "SELECT model_id, metabolite_id FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.model_id = m.model_id AND s.metabolite_id = m.metabolite_id)",
    "used_models": "SELECT model_id, grade FROM model_list WHERE model_id IN (SELECT model_id FROM reaction_records)",
}
