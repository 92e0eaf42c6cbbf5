"""The measures of whole maps in tasks, from one shuffle of the tables' own rows.

All rows of a map go to one task. What is found elsewhere by joins is found there in arrays: the newest drawing of each node,
copies of segments, the ends of segments; then labels and distances (`labels`) and crossings (`chords`) are counted. Points
and straight segments come out as rows, for measures that are plain aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactionloom.operators.chords import _ALL, SPLIT, batch_crossings
from reactionloom.operators.labels import measures, whole_groups
from reactionloom.operators.orphans import whole_number
from reactionloom.storage import written

#: Rows: other nodes, points (nodes with a label), segments without, with one and with both control points; rows of counts come out.
NODE, POINT, STRAIGHT, HALF, BENT, COUNTS = 0, 1, 2, 3, 4, 5
INTS, REALS = ("a", "b", "seg_id"), ("x1", "y1", "x2", "y2")
FOUND = ("n_overlaps", "n_labels", "n_on_edges", "n_crossings")


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _measured(t: pa.Table, half: float, tolerance: float, pitch: float, size: float) -> pa.RecordBatch:
    """Counts, points and straight segments of a table of whole maps."""
    t = t.combine_chunks()
    array = lambda c: t.column(c).chunk(0)
    null = lambda c: array(c).is_null().to_numpy(zero_copy_only=False)
    owner, kind = array("map_id").dictionary_encode().indices.to_numpy().astype(np.int64), array("kind").to_numpy()
    new = _first(owner)
    group, n = np.cumsum(new) - 1, int(new.sum())
    a, b, seg = (array(c).fill_null(-1).to_numpy() for c in INTS)
    x1, y1, x2, y2 = (array(c).fill_null(float("nan")).to_numpy() for c in REALS)
    at, nameless, unnumbered = array("added_at").cast(pa.int64()).fill_null(0).to_numpy(), null("a"), null("seg_id")

    # The newest drawing of each node; equally new ones by the smaller place, nulls last.
    node = np.flatnonzero(kind <= POINT)
    node = node[np.lexsort([k[node] for k in (y1, null("y1"), x1, null("x1"), ~at, null("added_at"), a, nameless, group)])]
    node = node[_first(group[node], a[node], nameless[node])]
    line = np.flatnonzero(kind >= STRAIGHT)
    line = line[np.lexsort([k[line] for k in (seg, unnumbered, a, group)])]
    line = line[_first(group[line], a[line], seg[line], unnumbered[line])]
    named = node[~nameless[node]]
    ids, code = np.unique(np.concatenate([a[named], a[line], b[line]]), return_inverse=True)
    place = np.append(group[named], np.tile(group[line], 2)) * len(ids) + code
    known, ends = place[: len(named)], place[len(named) :].reshape(2, -1)
    if len(named):
        ends_at = np.minimum(np.searchsorted(known, ends), len(named) - 1)
        both = (known[ends_at] == ends).all(0)
        line, (start, end) = line[both], named[ends_at[:, both]]
    else:
        line = start = end = line[:0]

    finite = lambda rows, *values: np.isfinite([v[rows] for v in values]).all(0)
    drawn = finite(start, x1, y1) & finite(end, x1, y1)
    bent = kind[line] == BENT
    curved = bent & drawn & finite(line, x1, y1, x2, y2)
    lines = lambda some: [v[some] for v in (group[line], a[line], b[line], x1[start], y1[start], x1[end], y1[end])]
    controls = [v[line[curved]] for v in (x1, y1, x2, y2)]
    spot = node[finite(node, x1, y1)]
    spots = (group[spot], a[spot], x1[spot], y1[spot], np.where(kind[spot] == POINT, x1[spot] + x2[spot], np.nan), y2[spot], np.ones(len(spot), bool))
    found = measures(n, spots, lines(drawn & ~bent), [*lines(curved), *controls], half, tolerance, pitch)

    straight = kind[line] == STRAIGHT
    crossings, some = np.zeros(n, np.int64), straight & drawn & ~unnumbered[line]
    if some.any():
        g, _, _, *places = lines(some)
        sides = size / np.clip(np.floor(np.sqrt(np.bincount(g, minlength=n) / SPLIT)), 1.0, 16.0)
        all_columns = np.full(len(g), _ALL)
        by_map = batch_crossings(g, seg[line[some]], *places, sides[g], -all_columns, all_columns, size)
        crossings[list(by_map)] = list(by_map.values())

    points = node[kind[node] == POINT]
    rows = [np.flatnonzero(new), points, line[straight]]
    take = lambda c, i: array(c).take(pa.array(i))
    nothing = lambda i, kind: pa.nulls(len(i), kind)
    real = {
        "x1": [pa.array(found[0]), take("x1", points), take("x1", start[straight])], "y1": [nothing(rows[0], pa.float64()), take("y1", points), take("y1", start[straight])],
        "x2": [*[nothing(r, pa.float64()) for r in rows[:2]], take("x1", end[straight])], "y2": [*[nothing(r, pa.float64()) for r in rows[:2]], take("y1", end[straight])],
    }
    counts = {c: [pa.array(v.astype(np.int64)), *[nothing(r, pa.int64()) for r in rows[1:]]] for c, v in zip(FOUND, (*found[1:], crossings), strict=True)}
    kinds = [pa.array(np.full(len(r), k, np.int32)) for r, k in zip(rows, (COUNTS, POINT, STRAIGHT), strict=True)]
    columns = {"map_id": [take("map_id", r) for r in rows], "kind": kinds, **real, **counts}
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns.values()], list(columns))


def whole_maps(nodes: DataFrame, segs: DataFrame, width: Column, height: float, keep_off: Column, tolerance: float, pitch: float, size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(map_id, x, y) of points, (map_id, x1, y1, x2, y2) of straight segments, and (map_id, d2 and FOUND) of each map.

    `nodes` and `segs` are rows of the tables, of maps that fit into a task. `width`: that of the label, null for nodes without.
    `size`: of the cells in which segments are sampled. The rest as for `labels.label_measures`.
    """
    kinds = {**dict.fromkeys(INTS, "bigint"), **dict.fromkeys(REALS, "double")}
    rows = lambda df, kind, at, **cols: df.select("map_id", kind.cast("int").alias("kind"), at.alias("added_at"), *[cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    c = F.col
    spots = rows(nodes.where("deleted_at is null"), F.when(width.isNotNull(), POINT).otherwise(NODE), c("added_at"), a=c("node_id"), x1=c("x"), y1=c("y"), x2=width, y2=keep_off)
    kind = F.when(c("b1").isNull() & c("b2").isNull(), STRAIGHT).when(c("b1").isNotNull() & c("b2").isNotNull(), BENT).otherwise(HALF)
    lines = rows(segs, kind, F.lit(None).cast(dict(nodes.dtypes)["added_at"]), a=whole_number(c("from_node_id")), b=whole_number(c("to_node_id")), seg_id=c("seg_id"), x1=c("b1.x"), y1=c("b1.y"), x2=c("b2.x"), y2=c("b2.y"))

    def run(batches):
        for table in whole_groups(batches, ("map_id",)):
            yield _measured(table, height / 2, tolerance, pitch, size)

    each = spots.unionByName(lines.where("a is not null and b is not null")).where("map_id is not null").repartition("map_id").sortWithinPartitions("map_id")
    schema = f"map_id {dict(nodes.dtypes)['map_id']}, kind int, {', '.join(f'{k} double' for k in REALS)}, {', '.join(f'{k} bigint' for k in FOUND)}"
    found = written(each.mapInArrow(run, schema), "maps", release=True)
    of = lambda kind: found.where(c("kind") == kind)
    return of(POINT).select("map_id", c("x1").alias("x"), c("y1").alias("y")), of(STRAIGHT).select("map_id", *REALS), of(COUNTS).select("map_id", c("x1").alias("d2"), *FOUND)
