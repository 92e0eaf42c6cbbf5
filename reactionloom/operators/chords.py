"""Crossings of straight segments counted without listing the pairs that cross.

A map is cut by walls into square cells. A segment that passes a cell is a chord of it, and two chords cross if their ends
alternate along the cell's border: these pairs are counted by sorting. Only segments that end within a cell are compared one
by one with the others there. Each crossing lies in one cell, so nothing has to be made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Walls stand at whole multiples of the cell's size plus these, so that neither drawn points nor diagonals meet a wall or a corner.
OFFSET_X, OFFSET_Y = 0.0271828182845905, 0.0141421356237310
#: Border positions per cell side as a power of two; positions closer than TIED (about 1e-9 at a side of 50) are put in order by segment.
FINE, TIED = 42, 100
#: Pairs that are compared at once.
CHUNK = 1 << 20
#: Sine of an angle below which two segments are parallel.
PARALLEL = 1e-10
#: Pieces in a cell from which pairs are told apart by distances first, and what two distances multiply to at least where that is safe.
DENSE, CLEAR = 64, 1e-6


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) for rows that are repeated `counts` times."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose `counts` sum to about CHUNK."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield slice(at, end)
        at = end


def inversions(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """By group, how many pairs of `values` (a permutation of 0, 1, ...) stand in falling order; no such pair is of two groups."""
    out, order = np.zeros(n_groups), values.astype(np.int64)
    owner = group[np.argsort(values, kind="stable")] if n_groups > 1 else None
    for k in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        high, bit = order >> (k + 1), (order >> k) & 1
        ones = np.cumsum(bit)
        start = high << (k + 1)  # blocks of equal high bits stand where their values begin
        before = ones - bit - np.where(start > 0, ones[start - 1], 0)
        low = bit == 0
        if owner is None:
            out[0] += before[low].sum()
        else:
            out += np.bincount(owner[order[low]], before[low], n_groups)
        moved = np.empty_like(order)
        moved[np.where(low, np.arange(len(order)) - before, start + (1 << k) + before)] = order
        order = moved
    return out.astype(np.int64)


def _turn(ax, ay, bx, by, cx, cy):
    v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return np.where(np.abs(v) < 1e-9, 0, np.where(v > 0, 1, -1))


class Drawn:
    """Segments of some maps: `owner` numbers the map, `size` is the side of its cells."""

    def __init__(self, owner, ids, x1, y1, x2, y2, size, parent: float | None):
        self.owner, self.ids, self.size = owner, ids, size
        self.given = np.stack([x1, y1, x2, y2], axis=1)
        swap = (x2 < x1) | ((x2 == x1) & (y2 < y1))
        self.a, self.b = np.where(swap[:, None], self.given[:, 2:], self.given[:, :2]), np.where(swap[:, None], self.given[:, :2], self.given[:, 2:])
        self.n_maps = int(owner.max()) + 1
        self.parent = parent
        if parent:
            self._sample()

    def _sample(self) -> None:
        """Cells of the sampled points of each segment, as bits of the map's own cells."""
        x1, y1, x2, y2 = self.given.T
        dx, dy = x2 - x1, y2 - y1
        steps = np.maximum(1, np.floor(np.sqrt(dx * dx + dy * dy) / self.parent) + 1)
        row, k = _expand(steps.astype(np.int64) + 1)
        t = k / steps[row]
        cx, cy = (np.floor((p[row] + (q - p)[row] * t) / self.parent).astype(np.int64) for p, q in ((x1, x2), (y1, y2)))
        low = lambda v: np.minimum.reduceat(v[by], first)
        high = lambda v: np.maximum.reduceat(v[by], first)
        by = np.argsort(self.owner[row], kind="stable")
        first = np.searchsorted(self.owner[row][by], np.arange(self.n_maps))
        self.x0, self.y0 = low(cx), low(cy)
        self.nx, self.ny = high(cx) - self.x0 + 1, high(cy) - self.y0 + 1
        m = self.owner[row]
        at = (cx - self.x0[m]) * self.ny[m] + cy - self.y0[m]
        self.words = int((self.nx * self.ny).max() + 63) // 64
        self.bits = None
        if self.words <= 16:
            self.bits = np.zeros((self.words, len(x1)), np.uint64)
            np.bitwise_or.at(self.bits, (at >> 6, row), np.uint64(1) << (at & 63).astype(np.uint64))
        else:
            self.span = int((self.nx * self.ny).max())
            self.keys = np.unique(row * self.span + at)
            self.start = np.searchsorted(self.keys, np.arange(len(x1) + 1) * self.span)

    def has(self, seg: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """Whether each segment has a sampled point in the cell (cx, cy)."""
        m = self.owner[seg]
        x, y = cx - self.x0[m], cy - self.y0[m]
        inside = (x >= 0) & (x < self.nx[m]) & (y >= 0) & (y < self.ny[m])
        at = np.where(inside, x * self.ny[m] + y, 0)
        if self.bits is not None:
            return inside & ((self.bits[at >> 6, seg] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        key = seg * self.span + at
        return inside & (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)

    def meet(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the two segments have sampled points in one cell."""
        if self.bits is not None:
            out = (self.bits[0][p] & self.bits[0][q]) != 0
            for w in self.bits[1:]:
                out |= (w[p] & w[q]) != 0
            return out
        out, counts = np.zeros(len(p), bool), (self.start[1:] - self.start[:-1])[p]
        for part in _slices(counts):
            row, k = _expand(counts[part])
            key = q[part][row] * self.span + self.keys[self.start[p[part][row]] + k] % self.span
            found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            out[part] = np.bincount(row, found, part.stop - part.start) > 0
        return out


def _pieces(d: Drawn, seg: np.ndarray, ix: np.ndarray):
    """Pieces of segments `seg` in columns `ix`: (seg, ix, iy, border position of either end, whether either end is a segment's end)."""
    h = d.size[seg]
    (ax, ay), (bx, by) = d.a[seg].T, d.b[seg].T
    left, right = ix * h + OFFSET_X, (ix + 1) * h + OFFSET_X
    starts, ends = np.floor((ax - OFFSET_X) / h) == ix, np.floor((bx - OFFSET_X) / h) == ix
    with np.errstate(all="ignore"):
        at = lambda x: np.clip(ay + (by - ay) * ((x - ax) / (bx - ax)), np.minimum(ay, by), np.maximum(ay, by))
        yl, yr = np.where(starts, ay, at(left)), np.where(ends, by, at(right))
    r0, r1 = np.floor((yl - OFFSET_Y) / h).astype(np.int64), np.floor((yr - OFFSET_Y) / h).astype(np.int64)
    n, up = np.abs(r1 - r0), np.where(r1 >= r0, 1, -1)
    row, k = _expand(n + 1)
    iy = r0[row] + up[row] * k
    rise, side = up[row] > 0, h[row]

    def across(wall):
        """Border position on the horizontal wall, from the left."""
        y = wall * side + OFFSET_Y
        with np.errstate(all="ignore"):
            x = ax[row] + (bx - ax)[row] * ((y - ay[row]) / (by - ay)[row])
        lo, hi = np.where(starts, ax, left)[row], np.where(ends, bx, right)[row]
        return (np.clip(x, lo, hi) - left[row]) / side

    first, last = k == 0, k == n[row]
    low = iy * side + OFFSET_Y
    enter = np.where(first, 4 - (yl[row] - low) / side, np.where(rise, across(iy), 3 - across(iy + 1)))
    leave = np.where(last, 1 + (yr[row] - low) / side, np.where(rise, 3 - across(iy + 1), across(iy)))
    return seg[row], ix[row], iy, enter, leave, first & starts[row], last & ends[row]


def _border_point(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Points from the cell's lower left corner at border positions."""
    side = np.clip(np.floor(at), 0, 3)
    f = at - side
    return np.stack([np.choose(side.astype(int), [f, 1, 1 - f, 0]) * size, np.choose(side.astype(int), [0, f, 1, 1 - f]) * size], axis=1)


def _fine(cell: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (cell << (FINE + 2)) | np.clip((at * (1 << FINE)).astype(np.int64), 0, (1 << (FINE + 2)) - 1)


def _border_order(key: np.ndarray, ids: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Places along the borders. Of tied places on one side the larger id is the upper one, so that segments on one line keep their order on all walls."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    tied = (np.diff(k) <= TIED) & ((k[1:] >> FINE) == (k[:-1] >> FINE))
    if tied.any():
        group = np.concatenate([[0], np.cumsum(~tied)])
        within = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
        at = order[within]
        side = (k[within] >> FINE) & 3  # from below round to the left; what is upper on a rising line is to its left
        own = np.where((side % 2 == 0) & rising[at], -ids[at], ids[at])
        order[within] = at[np.lexsort((np.where(side >= 2, -own, own), group[within]))]
    return order


def _crossing(d: Drawn, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each two segments cross; those that share an end do not."""
    ax, ay, bx, by = d.given[p].T
    cx, cy, ex, ey = d.given[q].T
    cross = (_turn(ax, ay, bx, by, cx, cy) != _turn(ax, ay, bx, by, ex, ey)) & (_turn(cx, cy, ex, ey, ax, ay) != _turn(cx, cy, ex, ey, bx, by))
    near = lambda x, y, u, v: (np.abs(x - u) < 1e-6) & (np.abs(y - v) < 1e-6)
    return cross & ~(near(ax, ay, cx, cy) | near(ax, ay, ex, ey) | near(bx, by, cx, cy) | near(bx, by, ex, ey))


def _place(d: Drawn, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the point where each two segments cross; of parallel ones, where the later of the two begins."""
    h, r, s, w = d.size[p], d.b[p] - d.a[p], d.b[q] - d.a[q], d.a[q] - d.a[p]
    den = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    with np.errstate(all="ignore"):
        u = np.clip((w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / den, 0.0, 1.0)
    later = (d.a[q, 0] > d.a[p, 0]) | ((d.a[q, 0] == d.a[p, 0]) & (d.a[q, 1] > d.a[p, 1]))
    parallel = den * den <= PARALLEL * PARALLEL * (r * r).sum(1) * (s * s).sum(1)
    at = np.where(parallel[:, None], np.where(later[:, None], d.a[q], d.a[p]), d.a[p] + r * u[:, None])
    return np.floor((at[:, 0] - OFFSET_X) / h), np.floor((at[:, 1] - OFFSET_Y) / h)


def count_crossings(d: Drawn, seg: np.ndarray, ix: np.ndarray) -> np.ndarray:
    """By map, the crossings within the columns `ix` of cells; `seg` and `ix` list the segments in each column.

    With `d.parent`, pairs without a sampled point in one cell of that size are left out.
    """
    out, parent = np.zeros(d.n_maps, np.int64), d.parent
    seg, ix, iy, enter, leave, starts, ends = _pieces(d, seg, ix)
    owner = d.owner[seg]
    order = np.lexsort((iy, ix, owner))
    seg, ix, iy, enter, leave, starts, ends, owner = (v[order] for v in (seg, ix, iy, enter, leave, starts, ends, owner))
    inner = starts | ends
    new = np.ones(len(seg), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(ix) != 0) | (np.diff(iy) != 0)
    cell = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(seg))
    if parent:
        middle = lambda i: np.floor((i + 0.5) * d.size[seg] / d.parent).astype(np.int64)
        clipped = ~d.has(seg, middle(ix), middle(iy))

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By map, how many of the pieces `i` and `j` are of segments that cross in their cell."""
        hit = _crossing(d, seg[i], seg[j])
        i, j = i[hit], j[hit]
        # The two in the order of ids, so that the point is the same in every cell.
        swap = d.ids[seg[i]] > d.ids[seg[j]]
        px, py = _place(d, np.where(swap, seg[j], seg[i]), np.where(swap, seg[i], seg[j]))
        here = (px == ix[i]) & (py == iy[i])
        if parent:
            apart = here & (clipped[i] | clipped[j])
            here[apart] = d.meet(seg[i[apart]], seg[j[apart]])
        return np.bincount(owner[i[here]], minlength=d.n_maps)

    # Segments that end in the cell, each with all others there; two such segments once.
    own = np.flatnonzero(inner)
    counts = (begin[1:] - begin[:-1])[cell[own]]
    small = counts < DENSE
    for part in _slices(counts[small]):
        row, k = _expand(counts[small][part])
        i = own[small][part][row]
        j = begin[cell[i]] + k
        take = (~inner[j]) | (i < j)
        out += compared(i[take], j[take])
    own = own[~small]
    if len(own):
        corner = np.stack([ix * d.size[seg] + OFFSET_X, iy * d.size[seg] + OFFSET_Y], axis=1)
        e = np.where(starts[own][:, None], d.a[seg[own]] - corner[own], _border_point(enter[own], d.size[seg[own]]))
        w = np.where(ends[own][:, None], d.b[seg[own]] - corner[own], _border_point(leave[own], d.size[seg[own]]))
        bounds = np.append(np.flatnonzero(np.append(True, np.diff(cell[own]) != 0)), len(own))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            left, right = begin[cell[own[lo]]], begin[cell[own[lo]] + 1]
            there = np.arange(left, right)
            r = d.b[seg[there]] - d.a[seg[there]]
            normal = np.stack([-r[:, 1], r[:, 0]]) / np.maximum(np.hypot(r[:, 0], r[:, 1]), 1e-300)
            base = (normal * (d.a[seg[there]] - corner[left]).T).sum(0)
            for at in range(lo, hi, step := max(1, CHUNK // len(there))):
                some = slice(at, min(at + step, hi))
                sides = (e[some] @ normal - base) * (w[some] @ normal - base)
                # A chord between the two ends of the piece, well off both, crosses it here. Other pairs are compared if they may meet.
                sure = (sides < -CLEAR) & ~inner[there]
                unsure = (sides <= CLEAR) & ~sure
                if parent:
                    doubtful = sure & (clipped[there] | clipped[own[some]][:, None])
                    sure &= ~doubtful
                    i, j = np.nonzero(doubtful)
                    out[owner[left]] += np.count_nonzero(d.meet(seg[own[some]][i], seg[there][j]))
                out[owner[left]] += np.count_nonzero(sure)
                i, j = np.nonzero(unsure)
                i, j = own[some][i], there[j]
                take = (~inner[j]) | (i < j)
                out += compared(i[take], j[take])

    # Chords: pairs whose ends alternate are those that begin within one another, less those that also end within.
    chord = np.flatnonzero(~inner)
    m = len(chord)
    if not m:
        return out
    cells, place = np.unique(cell[chord], return_inverse=True)
    key = np.concatenate([_fine(place, enter[chord]), _fine(place, leave[chord])])
    order = _border_order(key, np.tile(d.ids[seg[chord]], 2), np.tile(d.b[seg[chord], 1] > d.a[seg[chord], 1], 2))
    rank = np.empty(2 * m, np.int64)
    rank[order] = np.arange(2 * m)
    a, b = np.minimum(rank[:m], rank[m:]), np.maximum(rank[:m], rank[m:])
    opens = np.zeros(2 * m, np.int64)
    opens[a] = 1
    opened = np.cumsum(opens)
    chord_owner = owner[chord]
    within = opened[b] - opened[a]
    by_a = np.argsort(a)
    nested = inversions((b - opened[b])[by_a], chord_owner[by_a], d.n_maps)
    out += np.bincount(chord_owner, within, d.n_maps).astype(np.int64) - nested
    if parent:
        ends_at = 2 * np.searchsorted(place, np.arange(len(cells) + 1))
        out -= _apart(d, seg[chord], chord_owner, clipped[chord], a, b, order % m, ends_at[place], ends_at[place + 1] - 1)
    return out


def _apart(d: Drawn, seg, owner, clipped, a, b, at, first, last) -> np.ndarray:
    """By map, pairs of chords that cross but have no sampled point in one cell: one of the two has none in this cell.

    `at` has the chord at each place of the borders; the places of a chord's cell are `first` to `last`. The places on the
    shorter way between its ends are gone through.
    """
    out = np.zeros(d.n_maps, np.int64)
    mine = np.flatnonzero(clipped)
    inside, around = (b - a - 1)[mine], (last - first - b + a)[mine]
    short = inside <= around
    counts = np.where(short, inside, around)
    for part in _slices(counts):
        row, k = _expand(counts[part])
        i = mine[part][row]
        place = np.where(short[part][row], a[i], b[i]) + 1 + k
        place = np.where(place > last[i], place - last[i] - 1 + first[i], place)
        j = at[place]
        within = lambda v: (v > a[i]) & (v < b[i])  # noqa: B023, E731
        take = (within(a[j]) != within(b[j])) & ((~clipped[j]) | (i < j))
        i, j = i[take], j[take]
        apart = ~d.meet(seg[i], seg[j])
        out += np.bincount(owner[i[apart]], minlength=d.n_maps)
    return out


def batch_crossings(maps, ids, x1, y1, x2, y2, size, first, last, parent: float | None) -> dict[int, int]:
    """Crossings by map of the segments of a batch, each within its columns of cells `first` to `last`."""
    names, owner = np.unique(maps, return_inverse=True)
    d = Drawn(owner, ids, x1, y1, x2, y2, size, parent)
    lo = np.maximum(first, np.floor((d.a[:, 0] - OFFSET_X) / size)).astype(np.int64)
    hi = np.minimum(last, np.floor((d.b[:, 0] - OFFSET_X) / size)).astype(np.int64)
    total = np.zeros(len(names), np.int64)
    if len(names) == 1:  # one large map: column by column
        for x in range(int(lo.min()), int(hi.max()) + 1):
            if len(seg := np.flatnonzero((lo <= x) & (hi >= x))):
                total += count_crossings(d, seg, np.full(len(seg), x))
    else:
        row, k = _expand(np.maximum(0, hi - lo + 1))
        if len(row):
            total += count_crossings(d, row, lo[row] + k)
    return dict(zip(names.tolist(), total.tolist(), strict=True))


#: Straight segments of a map for one more part of it, the most parts, and segments from which a map's cells are made smaller.
PART_ROWS, PARTS, SPLIT = 2_500, 48, 400
#: Segments of small maps that are counted together.
BATCH = 20_000
_ALL = 1 << 40


def crossings_by_map(straight: DataFrame, size: float, exact: bool) -> DataFrame:
    """(map_id, n_crossings) of the maps that have crossings; not `exact`: of segments with sampled points in one cell of `size`.

    A large map is cut into upright parts, each of which gets the segments that pass it.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    finite = F.col("seg_id").isNotNull()
    for c in ends:
        finite &= F.abs(c) < float("inf")
    rows = straight.where(finite).select("map_id", "seg_id", *ends)
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    cols = F.least(F.lit(PARTS), F.ceil(F.col("n") / PART_ROWS))
    side = size / F.least(F.lit(16.0), F.greatest(F.lit(1.0), F.floor(F.sqrt(F.col("n") / SPLIT))))
    maps = rows.groupBy("map_id").agg(F.count("*").alias("n"), F.min(left).alias("lo"), F.max(right).alias("hi")).select("map_id", side.alias("side"), F.when(cols > 1, F.ceil((F.col("hi") - F.col("lo")) / side / cols) + 1).alias("per"))
    part = lambda x: F.floor(F.floor((x - OFFSET_X) / F.col("side")) / F.col("per"))
    placed = rows.join(maps, "map_id").withColumn("part", F.explode(F.coalesce(F.sequence(part(left), part(right)), F.array(F.lit(0).cast("bigint")))))

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def counted(table: pa.Table) -> pa.RecordBatch:
            c = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("per", "map_id")}
            per = table.column("per").fill_null(0).to_numpy()
            maps = np.asarray(table.column("map_id").to_pylist()) if not pa.types.is_integer(table.schema.field("map_id").type) else table.column("map_id").to_numpy()
            first = np.where(per > 0, c["part"] * per, -_ALL)
            last = np.where(per > 0, first + per - 1, _ALL)
            found: list[tuple] = []
            new = np.flatnonzero(np.append(True, (maps[1:] != maps[:-1]) | (c["part"][1:] != c["part"][:-1])))
            large = np.zeros(len(per), bool)
            for a, b in zip(new, np.append(new[1:], len(per)), strict=True):
                if per[a]:
                    large[a:b] = True
                    s = slice(a, b)
                    found += batch_crossings(maps[s], *[c[n][s] for n in ("seg_id", "x1", "y1", "x2", "y2", "side")], first[s], last[s], None if exact else size).items()
            if not large.all():
                s = ~large
                found += batch_crossings(maps[s], *[c[n][s] for n in ("seg_id", "x1", "y1", "x2", "y2", "side")], first[s], last[s], None if exact else size).items()
            return pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], table.schema.field("map_id").type), pa.array([n for _, n in found], pa.int64())], ["map_id", "n"])

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= BATCH:
                # Up to the last change of map or part; what follows may go on in the next batch.
                table = pa.Table.from_batches(kept).combine_chunks()
                end = table.slice(table.num_rows - 1)
                differs = pc.or_(pc.not_equal(table["map_id"], end["map_id"][0]), pc.not_equal(table["part"], end["part"][0])).to_numpy()
                cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                if cut:
                    yield counted(table.slice(0, cut))
                kept = table.slice(cut).to_batches()
        if kept:
            yield counted(pa.Table.from_batches(kept).combine_chunks())

    kind = dict(straight.dtypes)["map_id"]
    each = placed.repartition("map_id", "part").sortWithinPartitions("map_id", "part").mapInArrow(run, f"map_id {kind}, n bigint")
    return each.groupBy("map_id").agg(F.sum("n").alias("n_crossings")).where("n_crossings > 0")
