"""Queries on who is who: compounds without compartment, currency, organisms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reactionloom.operators import identity as I
from reactionloom.plans.network import BASE, Model
from reactionloom.sources.tables import table


def _known(spark, folder):
    return I.based(Model(spark, folder).metabolites)


def _currency(spark, folder):
    known = _known(spark, folder)
    fixed = I.fixed_vocabulary(spark)
    return known, I.currency(known, fixed.unionByName(I.learned_names(known, fixed)))


def identity(spark, folder):
    return _known(spark, folder).select("model_id", "metabolite_id", "base", "clean", "species")


def currency(spark, folder):
    return _currency(spark, folder)[1]


def canonical_ids(spark, folder):
    return I.canonical(*_currency(spark, folder))


def organism_names(spark, folder):
    return I.organisms(table(spark, folder, "model_list"))


QUERIES = {f.__name__: f for f in (identity, currency, canonical_ids, organism_names)}

_IDS = "h h2o o2 co2 pi ppi pppi nh4 so4 so3 atp adp amp gtp gdp gmp utp udp ump ctp cdp cmp nad nadh nadp nadph fad fadh2 fmn fmnh2 coa thf gthrd gthox h2o2 hco3 na1 k cl ca2 mg2 fe2 fe3 zn2 mn2 cu2 cobalt2 itp idp imp datp dadp damp dgtp dctp dttp q8 q8h2 q6 q6h2 mqn8 mql8 trdox trdrd mlthf methf 5mthf 10fthf h2 h2s n2 no no2 no3"
_IDENTITY = BASE + f"""
i0 AS (SELECT *, regexp_replace(metabolite_id, '^M_', '') AS i, coalesce(compartment, '') AS c FROM m),
i1 AS (SELECT *, CASE WHEN c <> '' AND length(i) > length(c) + 1 AND right(i, length(c) + 1) = '_' || c THEN left(i, length(i) - length(c) - 1)
  WHEN c <> '' AND length(i) > length(c) + 2 AND right(i, length(c) + 2) IN ('[' || c || ']', '(' || c || ')') THEN left(i, length(i) - length(c) - 2)
  WHEN c <> '' AND right(i, length(c)) = c AND regexp_matches(left(i, length(i) - length(c)), '[0-9]$') THEN left(i, length(i) - length(c))
  WHEN length(i) > 2 AND substr(i, length(i) - 1, 1) = '_' THEN left(i, length(i) - 2) WHEN length(i) > 3 AND substr(i, length(i) - 2, 1) = '_' THEN left(i, length(i) - 3) END AS base,
  regexp_replace(trim(coalesce(name, '')), '\\s*\\[[^\\]]*\\]$', '') AS n0 FROM i0),
i2 AS (SELECT *, CASE WHEN c <> '' AND right(n0, length(c) + 1) = '_' || c THEN left(n0, length(n0) - length(c) - 1) ELSE n0 END AS n1 FROM i1),
i3 AS (SELECT *, CASE WHEN coalesce(formula, '') <> '' AND right(n1, length(formula) + 1) = ' ' || formula THEN left(n1, length(n1) - length(formula) - 1) ELSE n1 END AS n2 FROM i2),
i4 AS (SELECT *, regexp_extract(n2, '\\s+((?:[A-Z][a-z]?\\d*){{2,}})$', 1) AS tail FROM i3),
i5 AS (SELECT *, lower(trim(CASE WHEN regexp_matches(tail, '\\d') THEN regexp_replace(n2, '\\s+(?:[A-Z][a-z]?\\d*){{2,}}$', '') ELSE n2 END)) AS clean FROM i4),
idn AS (SELECT *, coalesce(base, 'name:' || clean || '|' || coalesce(formula, '')) AS species FROM i5),
ids AS (SELECT unnest(string_split('{_IDS}', ' ')) AS key),
ef AS (SELECT unnest(['H2O', 'H', 'O2', 'CO2', 'H2O2', 'Na', 'K', 'Cl', 'Ca', 'Mg', 'Zn', 'Mn']) AS f, unnest(['h2o', 'h', 'o2', 'co2', 'h2o2', 'na1', 'k', 'cl', 'ca2', 'mg2', 'zn2', 'mn2']) AS key, unnest([0, 1, 0, 0, 0, 1, 1, -1, 2, 2, 2, 2]) AS q),
nm AS (SELECT clean, base AS key FROM (SELECT clean, base, count(*) AS k FROM idn WHERE clean <> '' AND base IN (SELECT key FROM ids) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clean ORDER BY k DESC, base) = 1),
cu0 AS (SELECT model_id, metabolite_id, 0 AS p, base AS key, 'id' AS evidence FROM idn WHERE base IN (SELECT key FROM ids)
  UNION ALL SELECT model_id, metabolite_id, 4, nm.key, 'name' FROM idn JOIN nm USING (clean) LEFT JOIN ef ON ef.key = nm.key WHERE f IS NULL OR (trim(coalesce(formula, '')) = '' OR formula = f) AND (charge IS NULL OR charge = q)
  UNION ALL SELECT model_id, metabolite_id, 5, key, 'formula' FROM idn JOIN ef ON formula = f WHERE charge IS NULL OR charge = q
  UNION ALL SELECT model_id, metabolite_id, 5, 'fe' || charge, 'charged' FROM idn WHERE formula = 'Fe' AND charge IN (2, 3)),
cu AS (SELECT model_id, metabolite_id, key AS currency, evidence FROM cu0 QUALIFY row_number() OVER (PARTITION BY model_id, metabolite_id ORDER BY p, key, evidence) = 1)
"""
ORACLE = {
    "identity": _IDENTITY + "SELECT model_id, metabolite_id, base, clean, species FROM idn",
    "currency": _IDENTITY + "SELECT * FROM cu",
    "canonical_ids": _IDENTITY + "SELECT model_id, metabolite_id, coalesce(currency, species) AS canonical FROM idn LEFT JOIN cu USING (model_id, metabolite_id)",
    "organism_names": """WITH o AS (SELECT model_id, coalesce(organism, '') AS organism, list_filter(regexp_split_to_array(coalesce(organism, ''), '\\s+'), lambda w: w <> '') AS w FROM model_list),
b AS (SELECT *, CASE WHEN len(w) >= 2 AND regexp_matches(w[2], '^\\p{Ll}') THEN w[1] || ' ' || w[2] ELSE coalesce(w[1], '') END AS "binomial" FROM o)
SELECT model_id, organism, "binomial", '' AS common, lower(array_to_string(list_filter([model_id, organism, "binomial"], lambda x: x <> ''), ' ')) AS search FROM b""",
}
