"""Names typed by hand, mapped to the entry of a reference list that is meant.

Names and entries (canonical names and synonyms) are first brought to one spelling with Spark's string functions: case,
white space, word order, and the notes and abbreviations of a ``Spelling`` that the caller may choose. Then a BK-tree over the entries under the Levenshtein distance, a
true metric, gives every entry within the allowed distance of a name: subtrees are skipped by the triangle inequality. A
batch of names walks the tree level by level, and the distances of all (name, node) pairs of a level are computed at once
by a bit-parallel algorithm over numpy arrays. Each distinct spelling is looked up once, whatever the number of rows.

A list of up to ``SHARD`` entries is one tree for each kind, broadcast. A longer one is cut into shards of at most about
that size, by kind, length and hash. The tree of a shard is built once and stored; a name goes only to the shards whose
entries can be within its radius by their length, in slices of ``SLICE`` names, and the winners of the shards are merged.

A name may be away from an entry by one edit from ``ONE_EDIT`` characters on and by two (a swap of neighbours is two) from
``TWO_EDITS``; numbers and single letters in it (positions, D and L) must be the entry's. The nearest entry is meant, among
equally near ones that with a swap of neighbours or else the smallest id.

Defined results: a null name gives no row; a blank name, or one that is near no entry, gives ref -1; a name that is an
entry's name character for character is no case; an empty list makes every name -1; entries with null name and null
synonyms are ignored; repeated rows count once; names of any length are allowed; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.storage import written

SHARD = 20_000
SLICE = 20_000
ONE_EDIT, TWO_EDITS = 5, 8

#: How the words of enzyme and compound names are abbreviated.
ABBREVIATIONS = {
    "transam": "transaminase", "ta": "transaminase", "perm": "permease", "mut": "mutase", "isom": "isomerase", "iso": "isomerase",
    "carbox": "carboxylase", "cbx": "carboxylase", "hydrat": "hydratase", "hyd": "hydratase", "synth": "synthase", "syn": "synthase",
    "ald": "aldolase", "aldol": "aldolase", "dehydrog": "dehydrogenase", "dh": "dehydrogenase", "dhase": "dehydrogenase",
    "kin": "kinase", "p": "phosphate", "phosph": "phosphate", "α": "alpha", "β": "beta",
}
#: Remarks that people add to a name.
NOTES = r"\((?:reversible|irreversible|cytosol|mitochondria|extracellular)\)|\[[a-z]\d?\]|\s-\s*putative\b|[*?]+"


@dataclass(frozen=True)
class Spelling:
    """How names are brought to one spelling: words written out, and a pattern of remarks that are left out (None: none)."""

    abbreviations: dict[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))
    notes: str | None = NOTES


SPELLING = Spelling()
#: Case, separators and word order only.
PLAIN = Spelling({}, None)


def spelled(name: Column, spelling: Spelling = SPELLING) -> Column:
    """One spelling of a name: lower case, single spaces for separators, no notes, `kind, stem` turned round, words in full."""
    s = F.translate(F.lower(name), " _\t", "   ")
    if spelling.notes:
        s = F.regexp_replace(s, spelling.notes, " ")
    s = F.regexp_replace(F.regexp_replace(s, "α", "alpha "), "β", "beta ")
    s = F.regexp_replace(s, r"^\s*([^,]+?)\s*,\s*(\D.*)$", "$2 $1")
    words = F.filter(F.split(s, r"[\s\-.,]+"), lambda w: w != "")
    if spelling.abbreviations:
        table = F.create_map(*[F.lit(x) for pair in spelling.abbreviations.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(words, " ")


class Metric:
    """Levenshtein distances of (name, entry) pairs, many at once. Entries of up to 64 characters are bit vectors."""

    def __init__(self, entries: list[str]) -> None:
        self.entries = entries
        self.codes = {c: i + 1 for i, c in enumerate(sorted(set("".join(entries))))}
        self.size = np.array([len(e) for e in entries], "int64")
        self.masks = np.zeros((len(entries), len(self.codes) + 1), "uint64")
        for i, e in enumerate(entries):
            for k, c in enumerate(e[:64]):
                self.masks[i, self.codes[c]] |= np.uint64(1 << k)

    def texts(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Names as a padded matrix of codes, and their lengths."""
        width = max((len(n) for n in names), default=0)
        out = np.zeros((len(names), width), "int64")
        for i, n in enumerate(names):
            out[i, : len(n)] = [self.codes.get(c, 0) for c in n]
        return out, np.array([len(n) for n in names], "int64")

    def distances(self, codes: np.ndarray, sizes: np.ndarray, names: list[str], q: np.ndarray, e: np.ndarray, step: int = 200_000) -> np.ndarray:
        """Distance of name q[i] and entry e[i] for each i."""
        out = np.empty(len(q), "int64")
        for at in range(0, len(q), step):
            out[at : at + step] = self._block(codes, sizes, q[at : at + step], e[at : at + step])
        long = np.nonzero(self.size[e] > 64)[0]
        for i in np.unique(e[long]):  # one entry and all names that meet it
            at = long[e[long] == i]
            width = max(1, 4_000_000 // int(self.size[i]))
            for k in range(0, len(at), width):
                out[at[k : k + width]] = self._rows(codes, sizes, q[at[k : k + width]], int(i))
        return out

    def _rows(self, codes: np.ndarray, sizes: np.ndarray, q: np.ndarray, entry: int) -> np.ndarray:
        """Distances of many names to one entry of any length, the rows of all their tables computed together."""
        text = np.array([self.codes[c] for c in self.entries[entry]], "int64")
        at = np.arange(len(text) + 1)
        row, out = np.tile(at, (len(q), 1)), np.full(len(q), len(text), "int64")
        for j in range(int(sizes[q].max(initial=0))):
            best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (text != codes[q, j][:, None]))
            row = np.minimum.accumulate(np.column_stack([np.full(len(q), j + 1), best]) - at, axis=1) + at
            ends = sizes[q] == j + 1
            out[ends] = row[ends, -1]
        return out

    def _block(self, codes: np.ndarray, sizes: np.ndarray, q: np.ndarray, e: np.ndarray) -> np.ndarray:
        order = np.argsort(-sizes[q], kind="stable")
        q, e = q[order], e[order]
        length, m = sizes[q], self.size[e]
        one = np.uint64(1)
        last = one << np.minimum(np.maximum(m, 1) - 1, 63).astype("uint64")
        vp, vn, score = np.full(len(q), np.uint64(2**64 - 1)), np.zeros(len(q), "uint64"), m.copy()
        for j in range(int(length[0]) if len(q) else 0):
            n = int(np.searchsorted(-length, -j, "left"))  # pairs whose name has a character here
            eq = self.masks[e[:n], codes[q[:n], j]]
            p, v = vp[:n], vn[:n]
            d0 = (((eq & p) + p) ^ p) | eq | v
            hn, hp = p & d0, v | ~(p | d0)
            score[:n] += (hp & last[:n]) != 0
            score[:n] -= (hn & last[:n]) != 0
            x = (hp << one) | one
            vn[:n] = x & d0
            vp[:n] = (hn << one) | ~(x | d0)
        score = np.where(m == 0, length, score)
        out = np.empty_like(score)
        out[order] = score
        return out


def _distance(a: str, b: str, swaps: bool = False) -> int:
    """Levenshtein distance, with `swaps` a swap of neighbours counting one."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if swaps and before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


class Tree:
    """A BK-tree over distinct entries. `near` finds all entries within each name's radius."""

    def __init__(self, entries: list[str]) -> None:
        self.entries = sorted(set(entries))
        self.metric = Metric(self.entries)
        n = len(self.entries)
        self.first, self.children, self.edges = np.zeros(n + 1, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")
        kids: dict[int, list[tuple[int, int]]] = {}
        codes, sizes = self.metric.texts(self.entries)
        todo = [(0, np.arange(1, n))] if n else []
        while todo:  # a node and the entries below it: they are parted by their distance to the node
            node, rest = todo.pop()
            if not len(rest):
                continue
            d = self.metric.distances(codes, sizes, self.entries, rest, np.full(len(rest), node))
            for k in np.unique(d):
                part = rest[d == k]
                kids.setdefault(node, []).append((int(part[0]), int(k)))
                todo.append((int(part[0]), part[1:]))
        flat = [(c, k) for node in range(n) for c, k in kids.get(node, [])]
        self.first[1:] = np.cumsum([len(kids.get(node, [])) for node in range(n)])
        if flat:
            self.children, self.edges = (np.array(x, "int64") for x in zip(*flat, strict=True))

    def near(self, names: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name index, entry index, distance) of every entry within the radius of a name."""
        found = [(np.zeros(0, "int64"),) * 3]
        codes, sizes = self.metric.texts(names)
        q, e = np.arange(len(names)), np.zeros(len(names), "int64")
        while len(q) and self.entries:
            d = self.metric.distances(codes, sizes, names, q, e)
            hit = d <= radius[q]
            found.append((q[hit], e[hit], d[hit]))
            count = self.first[e + 1] - self.first[e]
            at = np.repeat(self.first[e] - np.cumsum(count) + count, count) + np.arange(count.sum())
            q, d, e, edge = np.repeat(q, count), np.repeat(d, count), self.children[at], self.edges[at]
            keep = np.abs(edge - d) <= radius[q]  # triangle inequality
            q, e = q[keep], e[keep]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _marks(name: str) -> list[str]:
    """The words in which one letter or digit makes another compound."""
    return sorted(w for w in name.split() if len(w) == 1 or w.isdigit())


def nearest(tree: Tree, refs: dict[str, int], names: list[str], block: int = 2_000) -> pd.DataFrame:
    """(form, ref_id, distance, swaps) for each name: the entry that is meant; names near none are left out."""
    rows = []
    for at in range(0, len(names), block):
        part = names[at : at + block]
        size = np.array([len(n) for n in part])
        radius = np.where(size >= TWO_EDITS, 2, np.where(size >= ONE_EDIT, 1, 0))
        best: dict[str, tuple[int, int, int]] = {}
        for q, e, d in zip(*tree.near(part, radius), strict=True):
            name, entry = part[q], tree.entries[e]
            if d and _marks(name) != _marks(entry):
                continue
            found = (int(d), _distance(name, entry, swaps=True) if d > 1 else int(d), refs[entry])
            best[name] = min(best.get(name, found), found)
        rows += [(name, ref, d, s) for name, (d, s, ref) in best.items()]
    return pd.DataFrame(rows, columns=["form", "ref_id", "distance", "swaps"])


_FOUND = "kind string, form string, ref_id bigint, distance bigint, swaps bigint"


def _by_kind(entries: pd.DataFrame) -> dict[str, tuple[Tree, dict[str, int]]]:
    out = {}
    for kind, part in entries.groupby("kind"):
        refs = part.groupby("form")["ref_id"].min().to_dict()
        out[kind] = (Tree(list(refs)), refs)
    return out


def _looked_up(trees: dict, names: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for kind, part in names.groupby("kind"):
        if kind in trees:
            found = nearest(*trees[kind], part["form"].tolist())
            yield found.assign(kind=kind)[["kind", "form", "ref_id", "distance", "swaps"]]


def map_forms(forms: DataFrame, entries: DataFrame, shard: int = SHARD) -> DataFrame:
    """(kind, form, ref_id, distance) of the distinct `forms` (kind, form) that are near an entry (kind, ref_id, form)."""
    entries = entries.where("form <> ''").groupBy("kind", "form").agg(F.min("ref_id").alias("ref_id"))
    names = forms.where("form <> ''").select("kind", "form").distinct()
    head = entries.limit(shard + 1).toPandas()  # the whole list, if it has at most `shard` entries
    if len(head) <= shard:
        trees = forms.sparkSession.sparkContext.broadcast(_by_kind(head))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _looked_up(trees.value, batch)

        parts = max(forms.sparkSession.sparkContext.defaultParallelism, int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return names.repartition(parts, "form").mapInPandas(run, _FOUND).drop("swaps")
    return _map_sharded(names, entries, shard)


def _map_sharded(names: DataFrame, entries: DataFrame, shard: int) -> DataFrame:
    key = ["kind", "size", "part"]
    entries = entries.withColumn("size", F.length("form"))
    sizes = entries.groupBy("kind", "size").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    sizes = written(sizes, "shards")  # one row per kind and length

    def build(own: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps(_by_kind(own))
        return own[key].iloc[:1].assign(blob=[blob])

    placed = entries.join(sizes, ["kind", "size"]).withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
    trees = written(placed.select(*key, "form", "ref_id").groupBy(*key).applyInPandas(build, "kind string, size int, part int, blob binary"), "trees")

    length = F.length("form")
    radius = F.when(length >= TWO_EDITS, 2).when(length >= ONE_EDIT, 1).otherwise(0)
    near = names.withColumn("size", F.explode(F.sequence(length - radius, length + radius))).join(sizes, ["kind", "size"])
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "form")
    slices = near.groupBy(*key).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sliced = near.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("form"), F.col("slices")).cast("int"))
    copies = trees.join(slices, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def one(names: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        found = [*_looked_up(pickle.loads(tree["blob"].iloc[0]), names)] if len(tree) and len(names) else []
        return pd.concat(found) if found else pd.DataFrame(columns=["kind", "form", "ref_id", "distance", "swaps"])

    by = [*key, "slice"]
    winners = sliced.select(*by, "form").groupBy(*by).cogroup(copies.select(*by, "blob").groupBy(*by)).applyInPandas(one, _FOUND)
    best = F.min(F.struct("distance", "swaps", "ref_id")).alias("w")
    return winners.groupBy("kind", "form").agg(best).select("kind", "form", "w.ref_id", "w.distance")


def entries_of(references: DataFrame, ref_id: str = "ref_id", kind: str = "kind", name: str = "name", synonyms: str = "synonyms", spelling: Spelling = SPELLING) -> DataFrame:
    """(kind, ref_id, form) of every name and synonym."""
    named = F.concat(F.array(F.col(name)), F.coalesce(F.col(synonyms), F.array().cast("array<string>")))
    each = references.select(F.col(kind).alias("kind"), F.col(ref_id).cast("bigint").alias("ref_id"), F.explode(named).alias("name"))
    return each.where(F.col("name").isNotNull()).select("kind", "ref_id", spelled(F.col("name"), spelling).alias("form"))


def map_to_list(rows: DataFrame, references: DataFrame, shard: int = SHARD, spelling: Spelling = SPELLING) -> DataFrame:
    """(kind, row_key, name, ref_id) for rows (kind, row_key, name): the entry of `references` (kind, ref_id, name, synonyms) that is meant, or -1."""
    cases = rows.where(F.col("name").isNotNull()).select("kind", "row_key", "name").distinct()
    cases = cases.join(references.select("kind", "name").where("name is not null"), ["kind", "name"], "left_anti")
    cases = cases.withColumn("form", spelled(F.col("name"), spelling))
    found = map_forms(cases.select("kind", "form"), entries_of(references, spelling=spelling), shard)
    return cases.join(found, ["kind", "form"], "left").select("kind", "row_key", "name", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"))


def unmatched(mapped: DataFrame) -> DataFrame:
    """Report of names without an entry: (kind, name, n_rows), most frequent first by `rank`."""
    counts = mapped.where("ref_id = -1").groupBy("kind", "name").agg(F.count("*").alias("n_rows"))
    return counts.withColumn("rank", F.rank().over(W.partitionBy("kind").orderBy(F.desc("n_rows"))))
