"""Labels against labels, nodes and edges, and the least distance of two points, counted in tasks.

The nodes and edges of a map go to one task, those of a large map to square tiles. A point and its label belong to the tile
that the point is in, and a tile has all that comes near its own: nothing that is found has to be made distinct or shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactionloom.operators.chords import _expand, _slices
from reactionloom.storage import written

#: Nodes of a tile as planned, and how many tiles a large map is wide at most.
TILE_NODES, TILES = 10_000, 64
#: Rows of small maps that are gone through together.
BATCH = 20_000
#: Cells: of nodes, of boxes (width, height) and of pieces of edges. No cell is smaller than this share of a map.
NODE_CELL, BOX_CELL, PIECE_CELL, LEAST = 64.0, (50.0, 20.0), 200.0, 2.0**-20
#: Straight pieces of a curved edge.
STEPS = 10
NEAR, OWN, STRAIGHT, BENT = 0, 1, 2, 3


def _by_group(group: np.ndarray, n: int, values: np.ndarray, least: bool) -> np.ndarray:
    out = np.full(n, np.inf if least else -np.inf)
    (np.minimum if least else np.maximum).at(out, group, values)
    return out


class Grid:
    """Rows in cells of their group: those of neighbouring cells of one column stand side by side."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, size: tuple[np.ndarray, np.ndarray], rows: np.ndarray | None = None):
        self.size = size
        cx, cy = np.floor(x / size[0][group]).astype(np.int64), np.floor(y / size[1][group]).astype(np.int64)
        self._place(group, cx, cy, np.arange(len(group)) if rows is None else rows)

    def _place(self, group, cx, cy, rows):
        self.x0, self.y0 = (int(cx.min()), int(cy.min())) if len(cx) else (0, 0)
        self.nx, self.ny = (int(cx.max()) - self.x0 + 1, int(cy.max()) - self.y0 + 1) if len(cx) else (1, 1)
        key = self._key(group, cx, cy)
        order = np.argsort(key, kind="stable")
        self.key, self.rows = key[order], rows[order]

    def _key(self, group, cx, cy):
        return (group * self.nx + cx - self.x0) * self.ny + cy - self.y0

    def around(self, group: np.ndarray, lo_x, hi_x, lo_y, hi_y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, first, end): for each query and column of its cells, the places in `rows`."""
        sx, sy = self.size[0][group], self.size[1][group]
        cell = lambda v, s, least, n: np.clip(np.floor(v / s) - least, -1, n).astype(np.int64) + least
        x0, x1 = np.maximum(cell(lo_x, sx, self.x0, self.nx), self.x0), np.minimum(cell(hi_x, sx, self.x0, self.nx), self.x0 + self.nx - 1)
        y0, y1 = np.maximum(cell(lo_y, sy, self.y0, self.ny), self.y0), np.minimum(cell(hi_y, sy, self.y0, self.ny), self.y0 + self.ny - 1)
        q, k = _expand(np.where(y1 >= y0, np.maximum(0, x1 - x0 + 1), 0))
        first = np.searchsorted(self.key, self._key(group[q], x0[q] + k, y0[q]), "left")
        end = np.searchsorted(self.key, self._key(group[q], x0[q] + k, y1[q]), "right")
        some = end > first
        return q[some], first[some], end[some]


def _sizes(group: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    far = np.maximum(_by_group(group, n, np.abs(x), False), _by_group(group, n, np.abs(y), False))
    return np.maximum(width, far * LEAST), np.maximum(height, far * LEAST)


def _any(n: int, q: np.ndarray, first: np.ndarray, end: np.ndarray, test: Callable, take: int = 8) -> np.ndarray:
    """Which of `n` queries have a candidate that passes `test`. Those that have one meet no more of them."""
    hit = np.zeros(n, bool)
    while len(q):
        counts = np.minimum(end - first, take)
        for part in _slices(counts):
            row, k = _expand(counts[part])
            i, j = q[part][row], first[part][row] + k
            hit[i[test(i, j)]] = True
        first = first + counts
        more = (first < end) & ~hit[q]
        q, first, end, take = q[more], first[more], end[more], take * 2
    return hit


class Labels:
    """Boxes of labels: group, node, (left, top, right, bottom), and whether they belong to the tile."""

    def __init__(self, group, node, left, y, right, half: float, own, n_groups: int):
        self.group, self.node, self.own, self.n = group, node, own, n_groups
        self.left, self.top, self.right, self.bottom, self.y = left, y - half, right, y + half, y
        self.mine = np.flatnonzero(own)

    def count(self, hit: np.ndarray) -> np.ndarray:
        return np.bincount(self.group[self.mine[hit]], minlength=self.n)

    def overlaps(self, tolerance: float) -> np.ndarray:
        """By group, pairs of boxes that overlap by more than the tolerance; a pair belongs to the tile of the one further right."""
        left, right, top, bottom = self.left + tolerance, self.right - tolerance, self.top + tolerance, self.bottom - tolerance
        grid = Grid(self.group, self.left, self.y, _sizes(self.group, self.n, self.left, self.y, *BOX_CELL))
        widest, high = _by_group(self.group, self.n, self.right - self.left, False), self.bottom - self.top
        m = self.mine
        g = self.group[m]
        q, first, end = grid.around(g, self.left[m] - widest[g], self.left[m], self.y[m] - high[m], self.y[m] + high[m])
        out, counts = np.zeros(self.n, np.int64), end - first
        for part in _slices(counts):
            row, k = _expand(counts[part])
            i, j = m[q[part][row]], grid.rows[first[part][row] + k]
            before = (self.left[j] < self.left[i]) | ((self.left[j] == self.left[i]) & (self.node[j] < self.node[i]))
            i, j = i[before], j[before]
            hit = (right[i] > left[j]) & (left[i] < right[j]) & (bottom[i] > top[j]) & (top[i] < bottom[j])
            out += np.bincount(self.group[i[hit]], minlength=self.n)
        return out

    def on_nodes(self, group, node, x, y, r) -> np.ndarray:
        """By group, labels that cover another node with its radius."""
        grid = Grid(group, x, y, _sizes(group, self.n, x, y, NODE_CELL, NODE_CELL))
        most = float(r.max()) if len(r) else 0.0
        m = self.mine
        left, top, right, bottom, own = (v[m] for v in (self.left, self.top, self.right, self.bottom, self.node))
        q, first, end = grid.around(self.group[m], left - most, right + most, top - most, bottom + most)

        def covers(i, place):
            j = grid.rows[place]
            return (node[j] != own[i]) & (x[j] > left[i] - r[j]) & (x[j] < right[i] + r[j]) & (y[j] > top[i] - r[j]) & (y[j] < bottom[i] + r[j])

        return self.count(_any(len(m), q, first, end, covers))

    def on_edges(self, group, n1, n2, x1, y1, x2, y2) -> np.ndarray:
        """By group, labels that a piece of an edge at another node runs through or touches."""
        m = self.mine
        g = self.group[m]
        left, top, right, bottom, own = (v[m] for v in (self.left, self.top, self.right, self.bottom, self.node))
        box = [_by_group(g, self.n, v, least) for v, least in ((left, True), (top, True), (right, False), (bottom, False))]
        sizes = _sizes(self.group, self.n, self.left, self.y, PIECE_CELL, PIECE_CELL)
        low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        # Only cells where the labels are; the margin is for rounding: a cell too many is harmless.
        near = np.flatnonzero((high_x >= box[0][group]) & (low_x <= box[2][group]) & (high_y >= box[1][group]) & (low_y <= box[3][group]))
        s = sizes[0][group[near]]
        c0 = np.floor((np.maximum(low_x[near], box[0][group[near]]) - 1e-6) / s).astype(np.int64)
        c1 = np.floor((np.minimum(high_x[near], box[2][group[near]]) + 1e-6) / s).astype(np.int64)
        row, k = _expand(c1 - c0 + 1)
        p, cx, s = near[row], c0[row] + k, s[row]
        with np.errstate(all="ignore"):
            at = lambda x: np.clip(y1[p] + (y2 - y1)[p] * ((x - x1[p]) / (x2 - x1)[p]), low_y[p], high_y[p])
            a, b = at(np.maximum(low_x[p], cx * s)), at(np.minimum(high_x[p], (cx + 1) * s))
        upright = x1[p] == x2[p]
        lo, hi = np.where(upright, low_y[p], np.fmin(a, b)) - 1e-6, np.where(upright, high_y[p], np.fmax(a, b)) + 1e-6
        r0 = np.floor(np.maximum(lo, box[1][group[p]]) / s).astype(np.int64)
        r1 = np.floor(np.minimum(hi, box[3][group[p]]) / s).astype(np.int64)
        row, k = _expand(np.maximum(0, r1 - r0 + 1))
        grid = Grid(group[:0], x1[:0], y1[:0], sizes)
        grid._place(group[p[row]], cx[row], r0[row] + k, p[row])
        q, first, end = grid.around(g, left, right, top, bottom)

        def meets(i, place):
            j = grid.rows[place]
            hit = (high_x[j] >= left[i]) & (low_x[j] <= right[i]) & (high_y[j] >= top[i]) & (low_y[j] <= bottom[i])
            k = np.flatnonzero(hit)
            i, j = i[k], j[k]
            other = (own[i] != n1[j]) & (own[i] != n2[j])
            # A piece meets a box if some of it is within both of the box's ranges: rounded as in the SQL, for pieces that just touch.
            enter, leave = np.zeros(len(i)), np.ones(len(i))
            for start, stop, low, high in ((x1[j], x2[j], left[i], right[i]), (y1[j], y2[j], top[i], bottom[i])):
                d = stop - start
                with np.errstate(all="ignore"):
                    at = np.stack([(low - start) / d, (high - start) / d])
                enter, leave = np.maximum(enter, np.where(d == 0, 0, at.min(0))), np.minimum(leave, np.where(d == 0, 1, at.max(0)))
            hit[k] = other & (enter <= leave)
            return hit

        return self.count(_any(len(m), q, first, end, meets))


def least_distance(group: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, n_groups: int, pitch: float) -> np.ndarray:
    """By group, the least squared distance of an own point and another one elsewhere, in the same or neighbouring cells of size `pitch`.

    Cells are small at first: a distance within the size of a cell is the least.
    """
    order = np.lexsort((y, x, group))
    group, x, y, own = group[order], x[order], y[order], own[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
    group, x, y, own = group[new], x[new], y[new], own[new]
    n = np.maximum(1, np.bincount(group, minlength=n_groups))
    with np.errstate(all="ignore"):
        spread = [_by_group(group, n_groups, v, False) - _by_group(group, n_groups, v, True) for v in (x, y)]
        size = np.clip(np.sqrt(spread[0] * spread[1] / n), pitch / 1024, pitch)
    size, out = np.where(np.isfinite(size), size, pitch), np.full(n_groups, np.inf)
    left = np.ones(n_groups, bool)
    while left.any():
        at = np.flatnonzero(left[group])
        g, px, py = group[at], x[at], y[at]

        def close(v: np.ndarray) -> np.ndarray:
            """Numbers of cells, gaps of more than two shortened to two."""
            values, where = np.unique(v, return_inverse=True)
            return np.append(0, np.cumsum(np.minimum(np.diff(values), 2))).astype(np.int64)[where]

        cx, cy = close(np.floor(px / size[g])), close(np.floor(py / size[g]))
        ones = np.ones(n_groups)
        grid = Grid(g, cx.astype(float), cy.astype(float), (ones, ones))
        mine = np.flatnonzero(own[at])
        q, first, end = grid.around(g[mine], cx[mine] - 1, cx[mine] + 1, cy[mine] - 1, cy[mine] + 1)
        counts, found = end - first, np.full(n_groups, np.inf)
        for part in _slices(counts):
            row, k = _expand(counts[part])
            i, j = mine[q[part][row]], grid.rows[first[part][row] + k]
            dx, dy = px[i] - px[j], py[i] - py[j]
            np.minimum.at(found, g[i], np.where(i == j, np.inf, dx * dx + dy * dy))
        out[left] = found[left]
        left &= (found > size * size) & (size < pitch)
        size = np.minimum(pitch, size * 4)
    return out


def _bent(c: tuple, i: int) -> np.ndarray:
    """Points of curves (start, end and the two between) at step `i`."""
    t = i / STEPS
    return np.power(1 - t, 3.0) * c[0] + 3 * (1 - t) * (1 - t) * t * c[2] + 3 * (1 - t) * t * t * c[3] + np.power(t, 3.0) * c[1]


def measures(n: int, nodes: tuple, lines: tuple, curves: tuple, half: float, tolerance: float, pitch: float) -> list[np.ndarray]:
    """By group, the least squared distance and how many labels overlap, cover a node and lie on an edge.

    `nodes`: group, id, x, y, right end of the label (NaN without one), what labels keep off, whether it belongs to the tile.
    `lines`: group, ids and places of both ends; `curves`: the same and the places of both control points.
    """
    group, node, x, y, right, off, own = nodes
    point = np.flatnonzero(~np.isnan(right))
    labels = Labels(group[point], node[point], x[point], y[point], right[point], half, own[point], n)
    bent = [np.stack([_bent(curves[3 + v :: 2], i) for v in (0, 1)]) for i in range(STEPS + 1)]
    straight, many = lines[:3], [np.repeat(c, STEPS) for c in curves[:3]]
    join = lambda place, v, by: np.append(place, np.stack([e[v] for e in bent[by : STEPS + by]], axis=1).ravel())
    ends = [join(place, v, by) for place, v, by in zip(lines[3:], (0, 1, 0, 1), (0, 0, 1, 1), strict=True)]
    good = np.isfinite(ends).all(0)
    pieces = [np.append(a, b)[good] for a, b in zip(straight, many, strict=True)]
    return [
        least_distance(group[point], x[point], y[point], own[point], n, pitch),
        labels.overlaps(tolerance),
        labels.on_nodes(group, node, x, y, off),
        labels.on_edges(*pieces, *[e[good] for e in ends]),
    ]


def measured(t: pa.Table, half: float, tolerance: float, pitch: float) -> pa.RecordBatch:
    """The counts and the least distance for each map and tile of a table of whole tiles, a row for each."""
    t = t.combine_chunks()
    array = lambda c: t.column(c).chunk(0)
    owner, tile, kind = array("map_id").dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64), array("tile").to_numpy(), array("kind").to_numpy()
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(tile) != 0))
    group, n = np.cumsum(new) - 1, int(new.sum())
    whole = lambda c: array(c).fill_null(-1).to_numpy()
    real = lambda c: array(c).fill_null(float("nan")).to_numpy()
    node, seg, bent = np.flatnonzero(kind <= OWN), np.flatnonzero(kind == STRAIGHT), np.flatnonzero(kind == BENT)
    columns = [group, whole("a"), whole("b"), *[real(c) for c in ("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2")]]
    spots = [columns[k][node] for k in (0, 1, 3, 4, 5, 6)]
    found = measures(n, (*spots, kind[node] == OWN), [c[seg] for c in columns[:7]], [c[bent] for c in columns], half, tolerance, pitch)
    return pa.RecordBatch.from_arrays([array("map_id").take(pa.array(np.flatnonzero(new))), *map(pa.array, found)], ["map_id", "d2", "n_overlaps", "n_labels", "n_on_edges"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of about BATCH rows or more, cut where the sorted `keys` change."""
    kept: list[pa.RecordBatch] = []
    rows_kept = 0
    for batch in batches:
        kept.append(batch)
        rows_kept += batch.num_rows
        if rows_kept < BATCH or not batch.num_rows:
            continue
        last, first = ([b[k][at].as_py() for k in keys] for b, at in ((kept[-1], -1), (kept[0], 0)))
        if last == first:
            continue
        # Up to the last change; what follows may go on in the next batch.
        table = pa.Table.from_batches(kept).combine_chunks()
        differs = functools.reduce(pc.or_, [pc.not_equal(table[k], table[k][-1]) for k in keys]).to_numpy()
        end = int(np.flatnonzero(differs)[-1]) + 1
        yield table.slice(0, end)
        kept = table.slice(end).to_batches()
        rows_kept = table.num_rows - end
    if rows_kept:
        yield pa.Table.from_batches(kept)


def label_measures(nodes: DataFrame, segs: DataFrame, width: Column, height: float, keep_off: Column, largest: float, tolerance: float, pitch: float) -> DataFrame:
    """(map_id, d2, n_overlaps, n_labels, n_on_edges): the least squared distance of two points (infinite without any), and
    labels that overlap, cover another node and lie on an edge.

    Points are the nodes with a `width`, that of their label. `keep_off`: what labels keep off a node, `largest` at most.
    Segments at the label's own node are left out: the box starts at the node, so they would always touch it.
    """
    finite = lambda *cols: F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in cols))
    half, c = height / 2, F.col
    n = nodes.where(finite("x", "y")).select("map_id", "node_id", "x", "y", (c("x") + width).alias("right"), keep_off.alias("r"))
    extent = [F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.coalesce(F.max(c("right") - c("x")), F.lit(0.0)).alias("widest")]
    side = F.greatest(F.lit(4 * pitch), F.greatest("w", "h") / TILES, F.sqrt(c("w") * c("h") * TILE_NODES / c("n")))
    large = n.groupBy("map_id").agg(*extent).where(c("n") >= 2 * TILE_NODES).select("map_id", "x0", "y0", "widest", side.alias("side"))
    tiles = F.broadcast(written(large, "tiles", release=True))  # a row for each map of many nodes
    span = lambda lo, hi: F.explode(F.coalesce(F.sequence(*[F.greatest(F.lit(0), F.floor(v / c("side"))).cast("int") for v in (lo, hi)]), F.array(F.lit(0))))
    tile = (c("tx") * 1_000 + c("ty")).alias("tile")

    def rows(df: DataFrame, kind: Column, **cols: Column) -> DataFrame:
        columns = {"a": "bigint", "b": "bigint", **dict.fromkeys(("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2"), "double")}
        return df.select("map_id", tile, kind.alias("kind"), *[cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in columns.items()])

    x, y, point = c("x") - c("x0"), c("y") - c("y0"), c("right").isNotNull()
    wide = c("widest") + largest
    far_x, far_y = F.when(point, F.greatest(F.lit(2 * pitch), wide)).otherwise(wide) + 1, F.when(point, F.lit(max(2 * pitch, height))).otherwise(half + largest) + 1
    placed = n.join(tiles, "map_id", "left").withColumn("tx", span(x - far_x, x + far_x)).withColumn("ty", span(y - far_y, y + far_y))
    own = F.coalesce((F.floor(x / c("side")) == c("tx")) & (F.floor(y / c("side")) == c("ty")), F.lit(True))
    spots = rows(placed, F.when(own, OWN).otherwise(NEAR), a=c("node_id"), x1=c("x"), y1=c("y"), x2=c("right"), y2=c("r"))

    s = segs.where(finite("x1", "y1", "x2", "y2")).join(tiles, "map_id", "left")
    bent = c("b1").isNotNull() & c("b2").isNotNull()
    cut = lambda df, xs, ys: df.withColumn("tx", span(F.least(*xs) - c("x0") - c("widest") - 1, F.greatest(*xs) - c("x0") + 1)).withColumn("ty", span(F.least(*ys) - c("y0") - half - 1, F.greatest(*ys) - c("y0") + half + 1))
    # The part of a straight edge that labels of a column of tiles may reach.
    left, start = F.least("x1", "x2"), c("x0") + c("tx") * c("side")
    on = lambda at: F.least(F.greatest("y1", "y2"), F.greatest(F.least("y1", "y2"), c("y1") + (c("y2") - c("y1")) * ((at - c("x1")) / F.nullif(c("x2") - c("x1"), F.lit(0.0)))))
    reached = [on(F.greatest(left, start)), on(F.least(F.greatest("x1", "x2"), start + c("side") + c("widest")))]
    reached = [F.when(c("x1") == c("x2"), v).otherwise(r) for v, r in zip((c("y1"), c("y2")), reached, strict=True)]
    straight = rows(cut(s.where(~bent), [c("x1"), c("x2")], reached), F.lit(STRAIGHT), a=c("n1"), b=c("n2"), **{k: c(k) for k in ("x1", "y1", "x2", "y2")})
    curved = cut(s.where(bent & finite("b1.x", "b1.y", "b2.x", "b2.y")), *[[c(f"{v}1"), c(f"{v}2"), c(f"b1.{v}"), c(f"b2.{v}")] for v in "xy"])
    curved = rows(curved, F.lit(BENT), a=c("n1"), b=c("n2"), **{k: c(k) for k in ("x1", "y1", "x2", "y2")}, bx1=c("b1.x"), by1=c("b1.y"), bx2=c("b2.x"), by2=c("b2.y"))

    def run(batches):
        for table in whole_groups(batches, ("map_id", "tile")):
            yield measured(table, half, tolerance, pitch)

    key = dict(nodes.dtypes)["map_id"]
    each = spots.unionByName(straight).unionByName(curved).where("map_id is not null").repartition("map_id", "tile").sortWithinPartitions("map_id", "tile")
    found = each.mapInArrow(run, f"map_id {key}, d2 double, n_overlaps bigint, n_labels bigint, n_on_edges bigint")
    return found.groupBy("map_id").agg(F.min("d2").alias("d2"), *[F.sum(k).alias(k) for k in ("n_overlaps", "n_labels", "n_on_edges")])
