"""Queries on names, classes and selections of reactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reactionloom.functions import text as T
from reactionloom.functions.chemistry import millionths, species
from reactionloom.operators import naming as G
from reactionloom.operators import network as N
from reactionloom.plans.network import BASE as MODEL
from reactionloom.plans.network import Model, _species
from reactionloom.sources.tables import table


def subsystem_groups(spark, folder):
    return G.subsystem_groups(Model(spark, folder).reactions).withColumn("rids", F.array_join("rids", " "))


def metabolite_mode_group(spark, folder):
    m = Model(spark, folder)
    return G.mode_group(m.stoich, m.reactions)


def phrase_df(spark, folder):
    return G.phrase_frequency(Model(spark, folder).reactions)


def tfidf_names(spark, folder):
    return G.tfidf_names(Model(spark, folder).reactions).withColumn("score", F.floor(F.col("score") * 1000).cast("bigint"))


def keyword_superclass(spark, folder):
    return Model(spark, folder).reactions.select("rxn_row", T.superclass(F.col("subsystem")).alias("label"), T.structural(F.col("subsystem")).alias("structural"))


def class_votes(spark, folder):
    return G.class_votes(Model(spark, folder).reactions)


def compound_classes(spark, folder):
    m = Model(spark, folder)
    return G.compound_classes(m.stoich, m.reactions, N.transport_flags(m.stoich))


def _cargo(spark, folder):
    m = Model(spark, folder)
    degree = m.stoich.groupBy("model_id", species(F.col("metabolite_id")).alias("species")).agg(F.countDistinct("rid").alias("degree"))
    return G.cargo(N.transport_flags(m.stoich), degree)


def cargo(spark, folder):
    return _cargo(spark, folder)


def top_cargo(spark, folder):
    return G.top_cargo(_cargo(spark, folder))


def name_ordinals(spark, folder):
    return G.ordinal_names(Model(spark, folder).reactions)


def chunks(spark, folder):
    return G.chunks(Model(spark, folder).reactions)


def chain_pairs(spark, folder):
    m = Model(spark, folder)
    return G.chain_pairs(m.stoich, m.reactions)


def caption_clean(spark, folder):
    return Model(spark, folder).reactions.select("rxn_row", T.caption(F.col("name")).alias("caption"), T.file_stem(F.col("name")).alias("stem"))


def clean_names(spark, folder):
    m = Model(spark, folder).metabolites
    return m.select("met_row", T.clean_name(F.col("name")).alias("clean"), T.short_compound(F.col("name")).alias("short"), F.coalesce(species(F.col("metabolite_id")), F.concat_ws("|", F.lit("name:"), "name", "formula")).alias("species_key"), T.opaque(F.col("metabolite_id")).alias("opaque"))


def trigram_similarity(spark, folder):
    m = Model(spark, folder)
    names = m.metabolites.select("model_id", "metabolite_id", F.lower("name").alias("name"))
    name = lambda key, out: names.select("model_id", F.col("metabolite_id").alias(key), F.col("name").alias(out))
    x = m.main_pairs.join(name("substrate", "a"), ["model_id", "substrate"]).join(name("product", "b"), ["model_id", "product"])
    return x.select("model_id", "rid", millionths(N.trigram_similarity(F.col("a"), F.col("b"))).alias("similarity"))


def select_union(spark, folder):
    """Reactions chosen by subsystem, by name pattern and by a metabolite they use, less the ones at the boundary."""
    m = Model(spark, folder)
    r = m.reactions
    parts = [
        ("pathway", r.where("subsystem = 'Sugar acids'")),
        ("name", r.where(T.matches(F.col("name"), "*kinase*"))),
        ("metabolite", m.stoich.where(species(F.col("metabolite_id")) == "coa")),
    ]
    drop = r.where(F.col("is_boundary") | T.matches(F.col("rid"), "EX_*")).select(*N.REACTION)
    return G.selection(parts).join(drop, N.REACTION, "left_anti")


def title_uniqueness(spark, folder):
    """Whether names are distinct within a model, and how many repeat."""
    r = Model(spark, folder).reactions.where("name is not null")
    return r.groupBy("model_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_distinct")).withColumn("unique", F.col("n") == F.col("n_distinct"))


def moved_species(spark, folder):
    """Set operations: compounds both consumed and produced in a model, and those only consumed."""
    s = Model(spark, folder).stoich.withColumn("species", species(F.col("metabolite_id")))
    used, made = (s.where(c).select("model_id", "species").distinct() for c in ("coefficient < 0", "coefficient > 0"))
    return used.intersect(made).withColumn("side", F.lit("both")).unionByName(used.exceptAll(made).withColumn("side", F.lit("consumed")))


def sampled_reactions(spark, folder):
    """A sample of 100 reactions that depends on the ids only: the smallest keyed digests."""
    r = Model(spark, folder).reactions.select("model_id", "rid").withColumn("key", F.md5(F.concat_ws("/", "model_id", "rid", F.lit("7"))))
    return r.orderBy("key", "model_id", "rid").limit(100)


def model_index(spark, folder):
    """Index of models: reactions, subsystems and metabolites of each."""
    m = Model(spark, folder)
    r = m.reactions.groupBy("model_id").agg(F.count("*").alias("n_reactions"), F.countDistinct("subsystem").alias("n_subsystems"))
    c = m.metabolites.groupBy("model_id").agg(F.count("*").alias("n_metabolites"))
    return table(spark, folder, "model_list").join(r, "model_id", "left").join(c, "model_id", "left").select("model_id", "organism", F.coalesce("n_reactions", F.lit(0)).alias("n_reactions"), F.coalesce("n_subsystems", F.lit(0)).alias("n_subsystems"), F.coalesce("n_metabolites", F.lit(0)).alias("n_metabolites"))


_NAMES = "subsystem_groups metabolite_mode_group phrase_df tfidf_names keyword_superclass class_votes compound_classes cargo top_cargo name_ordinals chunks chain_pairs caption_clean clean_names trigram_similarity select_union title_uniqueness moved_species sampled_reactions model_index"
QUERIES = {name: globals()[name] for name in _NAMES.split()}


def _label(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '(^|[^a-z0-9])({'|'.join(words)})') THEN '{name}'" for name, words in T.SUPERCLASSES) + " END"


_WORDS = f"list_filter(list_transform(regexp_extract_all(name, '[A-Za-z][A-Za-z\\-]{{2,}}'), lambda w: regexp_replace(lower(w), '^-+|-+$', '', 'g')), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}))"
_PHRASES = MODEL + f"""
w AS (SELECT rxn_row, model_id, subsystem, {_WORDS} AS ws FROM r WHERE name IS NOT NULL),
ph AS (SELECT DISTINCT rxn_row, model_id, subsystem, phrase FROM (
  SELECT rxn_row, model_id, subsystem, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')))) AS phrase FROM w)),
df AS (SELECT phrase, count(*) AS df FROM ph GROUP BY ALL),
"""
_CARGO = MODEL + f"""
sd AS (SELECT model_id, {_species('metabolite_id')} AS species, count(DISTINCT rid) AS degree FROM s GROUP BY ALL),
cg AS (SELECT mv.model_id, mv.rid, species, degree FROM moved mv JOIN sd ON sd.model_id = mv.model_id AND sd.species = mv.sp QUALIFY row_number() OVER (PARTITION BY mv.model_id, mv.rid ORDER BY degree, species) = 1),
"""
_END = "done AS (SELECT 1) "
ORACLE = {
    "subsystem_groups": MODEL + _END + "SELECT model_id, subsystem, count(*) AS n, string_agg(rid, ' ' ORDER BY seq, rid) AS rids FROM r WHERE subsystem IS NOT NULL GROUP BY model_id, subsystem",
    "metabolite_mode_group": MODEL + """c AS (SELECT model_id, metabolite_id, subsystem, count(*) AS n, min(seq) AS f FROM (SELECT DISTINCT model_id, rid, metabolite_id FROM s) JOIN r USING (model_id, rid) WHERE subsystem IS NOT NULL GROUP BY ALL)
SELECT model_id, metabolite_id, subsystem FROM c QUALIFY row_number() OVER (PARTITION BY model_id, metabolite_id ORDER BY n DESC, f, subsystem DESC) = 1""",
    "phrase_df": _PHRASES + _END + "SELECT * FROM df",
    "tfidf_names": _PHRASES + """sz AS (SELECT model_id, subsystem, count(*) AS size FROM r WHERE subsystem IS NOT NULL AND name IS NOT NULL GROUP BY ALL),
c AS (SELECT model_id, subsystem, phrase, count(*) AS n FROM ph WHERE subsystem IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT model_id, subsystem, phrase, n / size::DOUBLE * ln((SELECT count(*) + 1 FROM r) / (df + 1)::DOUBLE) * (1e0 + 0.6e0 * (len(string_split(phrase, ' ')) - 1)) AS score FROM c JOIN sz USING (model_id, subsystem) JOIN df USING (phrase) WHERE n >= 0.05 * size)
SELECT model_id, subsystem, rank, phrase, floor(score * 1000)::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY model_id, subsystem ORDER BY score DESC, phrase DESC) AS rank FROM x) WHERE rank <= 3""",
    "keyword_superclass": MODEL + _END + f"SELECT rxn_row, {_label('subsystem')} AS label, regexp_matches(trim(subsystem), '(?i)^(?:unannotated|others?|uncategorized|unassigned|miscellaneous)(?: [0-9]+)?(?: \\([0-9]+\\))?$|^cluster_') AS structural FROM r",
    "class_votes": MODEL + f"""v AS (SELECT model_id, {_label('subsystem')} AS label, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT *, sum(n) FILTER (label IS NOT NULL) OVER (PARTITION BY model_id) AS voters, sum(n) OVER (PARTITION BY model_id) AS size FROM v)
SELECT model_id, CASE WHEN n >= 0.4 * voters AND voters >= 0.25 * size THEN label END AS label, n, voters::BIGINT AS voters, size::BIGINT AS size FROM x WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY n DESC, label) = 1""",
    "compound_classes": MODEL + f"""v AS (SELECT model_id, rid, {_label('subsystem')} AS label FROM r WHERE (model_id, rid) NOT IN (SELECT (model_id, rid) FROM moved)),
c AS (SELECT model_id, metabolite_id, label, count(*) AS n FROM (SELECT DISTINCT model_id, rid, metabolite_id FROM s) JOIN v USING (model_id, rid) WHERE label IS NOT NULL GROUP BY ALL),
x AS (SELECT *, (sum(n) OVER (PARTITION BY model_id, metabolite_id))::BIGINT AS total, row_number() OVER (PARTITION BY model_id, metabolite_id ORDER BY n DESC, label) AS k FROM c)
SELECT model_id, metabolite_id, label, n, total FROM x WHERE k = 1 AND n * 2 >= total""",
    "cargo": _CARGO + _END + "SELECT * FROM cg",
    "top_cargo": _CARGO + _END + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, species) AS rank FROM (SELECT model_id, species, count(*) AS n FROM cg GROUP BY ALL)) WHERE rank <= 2",
    "name_ordinals": MODEL + _END + "SELECT model_id, rid, CASE WHEN k = 1 THEN name ELSE name || ' ' || k END AS label FROM (SELECT *, row_number() OVER (PARTITION BY model_id, name ORDER BY seq, rid) AS k FROM r WHERE name IS NOT NULL)",
    "chunks": MODEL + _END + "SELECT model_id, rid, subsystem, ((row_number() OVER (PARTITION BY model_id, subsystem ORDER BY seq, rid) - 1) // 25)::BIGINT AS chunk FROM r WHERE subsystem IS NOT NULL",
    "chain_pairs": MODEL + _END + "SELECT * FROM (SELECT model_id, metabolite_id, rid AS a, lead(rid) OVER (PARTITION BY model_id, metabolite_id ORDER BY seq, rid) AS b FROM (SELECT DISTINCT model_id, rid, metabolite_id FROM s) JOIN r USING (model_id, rid)) WHERE b IS NOT NULL",
    "caption_clean": MODEL + """c AS (SELECT rxn_row, name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(name, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^S_', ''), '\\s*:\\s*', ' - ', 'g'), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS c,
regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS st FROM r)
SELECT rxn_row, CASE WHEN regexp_matches(c, '[A-Za-z]') THEN c ELSE '' END AS caption, CASE WHEN length(st) <= 60 THEN st ELSE substr(st, 1, 53) || '_' || substr(sha1(name), 1, 6) END AS stem FROM c""",
    "clean_names": MODEL + _END + f"""SELECT met_row, lower(trim(regexp_replace(name, '\\s*\\[[^\\]]*\\]\\s*$', ''))) AS clean, CASE WHEN length(h) <= 28 AND regexp_matches(h, '[A-Za-z]{{3}}') THEN h END AS short, {_species('metabolite_id')} AS species_key, regexp_matches(metabolite_id, '^[A-Za-z]{{1,4}}_?\\d{{4,}}$') AS opaque
FROM (SELECT *, trim(regexp_extract(name, '^[^(\\[/:]*', 0)) AS h FROM m)""",
    "select_union": MODEL + f"""parts AS (SELECT model_id, rid, 0 AS o, 'pathway' AS why FROM r WHERE subsystem = 'Sugar acids' UNION SELECT model_id, rid, 1, 'name' FROM r WHERE lower(name) LIKE '%kinase%'
UNION SELECT model_id, rid, 2, 'metabolite' FROM s WHERE {_species('metabolite_id')} = 'coa'),
x AS (SELECT model_id, rid, arg_min(why, o) AS why, count(*) AS n_reasons FROM parts GROUP BY ALL)
SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model_id = x.model_id AND r.rid = x.rid AND (is_boundary OR rid ILIKE 'EX\\_%' ESCAPE '\\'))""",
    "title_uniqueness": MODEL + _END + 'SELECT model_id, count(*) AS n, count(DISTINCT name) AS n_distinct, count(*) = count(DISTINCT name) AS "unique" FROM r WHERE name IS NOT NULL GROUP BY model_id',
    "moved_species": MODEL + f"""u AS (SELECT DISTINCT model_id, {_species('metabolite_id')} AS species FROM s WHERE coefficient < 0), d AS (SELECT DISTINCT model_id, {_species('metabolite_id')} AS species FROM s WHERE coefficient > 0)
SELECT *, 'both' AS side FROM (SELECT * FROM u INTERSECT SELECT * FROM d) UNION ALL SELECT *, 'consumed' FROM (SELECT * FROM u EXCEPT SELECT * FROM d)""",
    "sampled_reactions": MODEL + _END + "SELECT model_id, rid, md5(model_id || '/' || rid || '/7') AS key FROM r ORDER BY 3, 1, 2 LIMIT 100",
    "model_index": MODEL + _END + """SELECT l.model_id, organism, coalesce(n_reactions, 0) AS n_reactions, coalesce(n_subsystems, 0) AS n_subsystems, coalesce(n_metabolites, 0) AS n_metabolites FROM model_list l
LEFT JOIN (SELECT model_id, count(*) AS n_reactions, count(DISTINCT subsystem) AS n_subsystems FROM r GROUP BY ALL) USING (model_id) LEFT JOIN (SELECT model_id, count(*) AS n_metabolites FROM m GROUP BY ALL) USING (model_id)""",
}


def _similarity_sql() -> str:
    from reactionloom.plans.network import PAIRS, _trigrams

    a, b = _trigrams("a"), _trigrams("b")
    return PAIRS + f"""ab AS (SELECT best.model_id, rid, lower(x.name) AS a, lower(y.name) AS b FROM best JOIN m x ON x.model_id = best.model_id AND x.metabolite_id = substrate JOIN m y ON y.model_id = best.model_id AND y.metabolite_id = product)
SELECT model_id, rid, floor(CASE WHEN length(a) > 0 AND length(b) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0e0 END * 1000000)::BIGINT AS similarity FROM ab"""


ORACLE["trigram_similarity"] = _similarity_sql()
