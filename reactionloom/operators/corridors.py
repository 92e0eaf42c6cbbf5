"""Edges through nodes of unrelated reactions, found and told apart in tasks: no hit is shuffled.

A node is in one part of its map and in one cell of it, so each hit is found once. Segments come to every part that they may
hit something in. Whether two reactions are related is looked up among the nodes and segments that share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reactionloom.operators.chords import CHUNK, _expand, _slices
from reactionloom.storage import written

#: Kinds of rows that go to a part of a map.
NODE, STRAIGHT, CURVED, TOUCHED = range(4)
#: Nodes of a map for one more part of it, and the most parts.
PART_NODES, PARTS = 2_500, 32
#: Pairs of a part below which it is one cell; nodes of a cell and its least side beyond that.
ONE_CELL, CELL_NODES, LEAST_SIDE = 4_000_000, 40, 48.0
#: Distances this close to a limit, as a share of the largest coordinate, are decided by the measure itself.
CLOSE = 1e-9
#: Rows of small maps that are read together, and hits that are passed on together.
BATCH, PASSED = 20_000, 500_000


def _runs(of: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of 0, 1, ..., n - 1 begin in the sorted `of`, and where the last ends."""
    return np.searchsorted(of, np.arange(n + 1))


def _through(px, py, dx, dy, r) -> np.ndarray:
    """Whether a segment passes within `r` of a node between its ends."""
    size, along, across = dx * dx + dy * dy, px * dx + py * dy, px * dy - py * dx
    return (size > 0) & (along > 0) & (along < size) & (across * across < r * r * size)


class Part:
    """Nodes and segments of one part of a map. `node` and `seg` have the columns a to d: x, y, radius, and the ends."""

    def __init__(self, ids, main, node, ends, rid, straight, seg, touched, touched_rid):
        self.node, self.seg = node, seg
        self.drawn = np.flatnonzero(np.isfinite(node[:, :2]).all(1))
        self.largest = float(node[:, 2].max())
        self.eps = CLOSE * max(1.0, float(np.abs(node[self.drawn, :2]).max(initial=0.0)), float(np.abs(seg).max(initial=0.0)))
        self.delta = seg[:, 2:] - seg[:, :2]
        with np.errstate(all="ignore"):
            self.length = np.sqrt((self.delta * self.delta).sum(1))
            self.unit = self.delta / self.length[:, None]
        self._relate(ids, main, ends, rid, touched, touched_rid)
        self.rid = rid[straight]

    def _relate(self, ids, main, ends, rid, touched, touched_rid) -> None:
        """Marks of reactions and, by node, of those drawn at it: each reaction itself, and the metabolites it shares with others."""
        by_id = np.argsort(ids, kind="stable")
        at = np.minimum(np.searchsorted(ids[by_id], ends.T.ravel()), len(ids) - 1)
        drawn = np.tile(rid, 2)
        here = (ids[by_id][at] == ends.T.ravel()) & (drawn >= 0)
        owned = np.unique(np.stack([by_id[at[here]], drawn[here]], axis=1), axis=0)
        n = int(max(rid.max(initial=-1), touched_rid.max(initial=-1))) + 1
        met = main[owned[:, 0]]
        touch = np.concatenate([np.stack([ids[owned[met, 0]], owned[met, 1]], axis=1), np.stack([touched, touched_rid], axis=1)])
        touch = np.unique(touch, axis=0)
        _, mark, times = np.unique(touch[:, 0], return_inverse=True, return_counts=True)
        several = times[mark] > 1
        marks = np.concatenate([np.arange(n), n + mark[several]])
        of = np.concatenate([np.arange(n), touch[several, 1]])
        order = np.argsort(of, kind="stable")
        self.marks, self.begin = marks[order], _runs(of[order], n)
        self.known = np.zeros(n + len(times), bool)
        self.owner, self.owner_begin = owned[:, 1], _runs(owned[:, 0], len(ids))

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, segments) that may meet, each node once."""
        x, y = self.node[self.drawn, 0], self.node[self.drawn, 1]
        live = np.flatnonzero(self.length > 0)
        if len(x) * len(live) <= ONE_CELL:
            yield self.drawn, live
            return
        with np.errstate(all="ignore"):
            side = max(LEAST_SIDE, float(np.sqrt((x.max() - x.min()) * (y.max() - y.min()) * CELL_NODES / len(x))))
        if not np.isfinite(side):
            yield self.drawn, live
            return
        reach = self.largest + 2 * self.eps
        (x1, y1, x2, y2), (dx, dy) = self.seg.T, self.delta.T
        left, right, low, high = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        col, row = np.floor(x / side), np.floor(y / side)
        order = np.lexsort((row, col))
        bounds = np.append(np.flatnonzero(np.append(True, np.diff(col[order]) != 0)), len(order))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            nodes = order[a:b]
            lo, hi = x[nodes].min() - reach, x[nodes].max() + reach
            seg = live[(left[live] <= hi) & (right[live] >= lo)]
            with np.errstate(all="ignore"):
                ys = [y1[seg] + dy[seg] * ((np.clip(v, left[seg], right[seg]) - x1[seg]) / dx[seg]) for v in (lo, hi)]
            steep = ~(np.abs(dx[seg]) > self.eps)
            bottom = np.where(steep, low[seg], np.clip(np.minimum(*ys), low[seg], high[seg])) - reach
            top = np.where(steep, high[seg], np.clip(np.maximum(*ys), low[seg], high[seg])) + reach
            rows = row[nodes]
            new = np.flatnonzero(np.append(True, np.diff(rows) != 0))
            ends = np.append(new, len(nodes))
            first = np.searchsorted(np.maximum.reduceat(y[nodes], new), bottom, "left")
            last = np.searchsorted(np.minimum.reduceat(y[nodes], new), top, "right")
            which, k = _expand(np.maximum(0, last - first))
            at = first[which] + k
            by = np.argsort(at, kind="stable")
            begin = _runs(at[by], len(new))
            for i in range(len(new)):
                yield self.drawn[nodes[ends[i] : ends[i + 1]]], seg[which[by[begin[i] : begin[i + 1]]]]

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, how many segments each has, those segments) of unrelated reactions."""
        for nodes, seg in self.cells():
            if not len(nodes) or not len(seg):
                continue
            x, y = self.node[nodes, 0], self.node[nodes, 1]
            ox, oy = x.min(), y.min()
            w, h = x.max() - ox, y.max() - oy
            ux, uy = self.unit[seg].T
            px, py = ox - self.seg[seg, 0], oy - self.seg[seg, 1]
            along, across = px * ux + py * uy, px * uy - py * ux
            start, end = along + np.minimum(0, ux) * w + np.minimum(0, uy) * h, along + np.maximum(0, ux) * w + np.maximum(0, uy) * h
            reach = self.largest + self.eps
            off = (end < -self.eps) | (start > self.length[seg] + self.eps) | (across + np.maximum(0, uy) * w + np.maximum(0, -ux) * h < -reach) | (across + np.minimum(0, uy) * w + np.minimum(0, -ux) * h > reach)
            within = (start > self.eps) & (end < self.length[seg] - self.eps)
            # Those that pass all nodes first, then those with an end among them.
            order = np.concatenate([np.flatnonzero(within & ~off), np.flatnonzero(~within & ~off)])
            if not len(order):
                continue
            passing = int((within & ~off).sum())
            seg, ux, uy, along, across = seg[order], ux[order], uy[order], along[order], across[order]
            step = max(1, CHUNK // len(seg))
            for at in range(0, len(nodes), step):
                some = nodes[at : at + step]
                spot = np.stack([x[at : at + step] - ox, y[at : at + step] - oy, np.ones(len(some))], axis=1)
                hit = self._hit(some, seg, spot, np.stack([uy, -ux, across]), np.stack([ux, uy, along])[:, passing:], passing)
                self._unrelated(hit, some, seg)
                i, j = np.nonzero(hit)
                if len(i):
                    yield some, np.bincount(i, minlength=len(some)), seg[j]

    def _hit(self, nodes, seg, spot, across, along, passing) -> np.ndarray:
        """Whether each node is hit by each segment; pairs close to a limit by the measure itself."""
        with np.errstate(all="ignore"):
            off = spot @ across
            np.abs(off, out=off)
            off -= self.node[nodes, 2][:, None]
            hit, may = off < -self.eps, ~(off > self.eps)
            if passing < len(seg):
                at, length = spot @ along, self.length[seg[passing:]]
                hit[:, passing:] &= (at > self.eps) & (at < length - self.eps)
                may[:, passing:] &= ~((at < -self.eps) | (at > length + self.eps))
            if np.count_nonzero(may) != np.count_nonzero(hit):
                i, j = np.nonzero(may & ~hit)
                n, s = nodes[i], seg[j]
                hit[i, j] = _through(self.node[n, 0] - self.seg[s, 0], self.node[n, 1] - self.seg[s, 1], *self.delta[s].T, self.node[n, 2])
        return hit

    def _unrelated(self, hit, nodes, seg) -> None:
        """Takes from `hit` the pairs of a node and a segment of related reactions."""
        begin, counts = self.owner_begin[nodes], self.owner_begin[nodes + 1] - self.owner_begin[nodes]
        i, k = _expand(counts)
        reaction = self.owner[begin[i] + k]
        row, k = _expand(self.begin[reaction + 1] - self.begin[reaction])
        pair = np.unique(self.marks[self.begin[reaction[row]] + k] * len(nodes) + i[row])
        mark, i = pair // len(nodes), pair % len(nodes)
        self.known[mark] = True
        has = np.flatnonzero(self.rid[seg] >= 0)
        reaction = self.rid[seg[has]]
        row, k = _expand(self.begin[reaction + 1] - self.begin[reaction])
        marks = self.marks[self.begin[reaction[row]] + k]
        found = self.known[marks]
        self.known[mark] = False
        j, marks = has[row[found]], marks[found]
        first = np.searchsorted(mark, marks, "left")
        counts = np.searchsorted(mark, marks, "right") - first
        for part in _slices(counts):
            row, k = _expand(counts[part])
            hit[i[first[part][row] + k], j[part][row]] = False


def _parts(nodes: DataFrame) -> DataFrame:
    """(map_id, bounds): for large maps, the x at which their parts end; each part has about as many nodes."""
    step = F.expr(f"cast({PARTS} / pow(2, floor(log2(least(n, {PARTS * PART_NODES}) / {PART_NODES}))) as int)")
    large = nodes.groupBy("map_id").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * PART_NODES)
    # The places are found over all nodes of a large map, combined on the map side.
    places = nodes.join(large.select("map_id"), "map_id", "left_semi").groupBy("map_id").agg(F.percentile_approx("x", [i / PARTS for i in range(1, PARTS)], 2_000).alias("q"))
    return places.join(large.withColumn("step", step), "map_id").select("map_id", F.expr("array_distinct(filter(q, (v, i) -> (i + 1) % step = 0))").alias("bounds"))


def unrelated_edges(segs: DataFrame, nodes: DataFrame, radius, largest: float) -> DataFrame:
    """(map_id, seg_id, node_id): straight segments through nodes of unrelated reactions. `largest`: the largest radius.

    Reactions are related if they are the same or both touch one metabolite node, which need not have a place. Ends of segments stand
    where their nodes do, so no segment runs through its own.
    """
    finite = lambda *cols: F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in cols))
    n = written(nodes.where(F.col("map_id").isNotNull() & F.col("node_id").isNotNull()).select("map_id", "node_id", "x", "y", F.lit(radius).alias("r"), F.coalesce(F.col("node_type") == "metabolite", F.lit(False)).alias("main")), "nodes")
    s = written(segs.select("map_id", "seg_id", "rid", "n1", "n2", "curved", "x1", "y1", "x2", "y2"), "segments")
    bounds = written(_parts(n), "parts")
    ids, keys = dict(segs.dtypes)["seg_id"], dict(segs.dtypes)["map_id"]

    def rows(df: DataFrame, kind: int, parts, **cols) -> DataFrame:
        columns = {"seg_id": ids, "node_id": "bigint", "rid": "string", "n1": "bigint", "n2": "bigint", "a": "double", "b": "double", "c": "double", "d": "double", "main": "boolean", "touch": "array<bigint>"}
        return df.join(bounds, "map_id", "left").select("map_id", F.explode(parts).alias("part"), F.lit(kind).alias("kind"), *[F.col(cols[c]).cast(t).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

    def part(x: str, by: float = 0.0):
        return F.expr(f"case when bounds is null then 0 else size(filter(bounds, v -> v <= {x} + {by})) end")

    def span(x1: str, x2: str):
        # A little more than the radius, for rounding.
        return F.sequence(part(f"least({x1}, {x2})", -largest - 1.0), part(f"greatest({x1}, {x2})", largest + 1.0))

    drawn = {"seg_id": "seg_id", "rid": "rid", "n1": "n1", "n2": "n2", "a": "x1", "b": "y1", "c": "x2", "d": "y2"}
    straight = ~F.col("curved") & finite("x1", "y1", "x2", "y2")
    ends = s.where("rid is not null").join(bounds.select("map_id"), "map_id", "left_semi").select("map_id", "rid", F.explode(F.expr("array(struct(n1 as node_id, x1 as x), struct(n2 as node_id, x2 as x))")).alias("e")).select("map_id", "rid", "e.*")
    touch = ends.join(n.where("main").select("map_id", "node_id", F.lit(True).alias("main")), ["map_id", "node_id"], "left").groupBy("map_id", "rid").agg(F.collect_set(F.when(F.col("main"), F.col("node_id"))).alias("touch"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    all_rows = [
        rows(n, NODE, F.array(part("x")), node_id="node_id", a="x", b="y", c="r", main="main"),
        rows(s.where(straight), STRAIGHT, span("x1", "x2"), **drawn),
        rows(s.where(~F.coalesce(straight, F.lit(False)) & F.col("rid").isNotNull()), CURVED, F.array_distinct(F.array(part("x1"), part("x2"))), rid="rid", n1="n1", n2="n2"),
        rows(touch.where("size(touch) > 0"), TOUCHED, span("lo", "hi"), rid="rid", touch="touch"),
    ]

    def run(batches):
        kept: list[pa.RecordBatch] = []
        ready: list[tuple] = []

        def passed(schema: pa.Schema) -> pa.RecordBatch:
            """The hits so far, a row for each node."""
            counts = np.concatenate([c for _, _, c, _ in ready])
            segs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.concat_arrays([s for _, _, _, s in ready]))
            out = [pa.concat_arrays([m for m, _, _, _ in ready]), pa.concat_arrays([n for _, n, _, _ in ready]), segs]
            ready.clear()
            return pa.RecordBatch.from_arrays(out, ["map_id", "node_id", "segs"])

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            array = lambda c: table.column(c).chunk(0) if table.num_rows else table.column(c).combine_chunks()
            kind, part_of = array("kind").to_numpy(), array("part").to_numpy()
            number = lambda c: array(c).fill_null(0).to_numpy()
            node_ids, n1, n2, main = number("node_id"), number("n1"), number("n2"), array("main").fill_null(False).to_numpy(zero_copy_only=False)
            at = np.stack([array(c).fill_null(float("nan")).to_numpy() for c in "abcd"], axis=1)
            rid = array("rid").dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
            owner = array("map_id").dictionary_encode().indices.to_numpy()
            lists = array("touch")
            sizes, values = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64), pc.list_flatten(lists).to_numpy()
            list_begin = np.append(0, np.cumsum(sizes))
            map_ids, seg_ids, names = array("map_id"), array("seg_id"), array("node_id")
            new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(part_of) != 0)))
            for lo, hi in zip(new, np.append(new[1:], len(kind)), strict=True):
                of = lambda *kinds: lo + np.flatnonzero(np.isin(kind[lo:hi], kinds))  # noqa: B023, E731
                node, straight_at, seg, touched = of(NODE), of(STRAIGHT), of(STRAIGHT, CURVED), of(TOUCHED)
                if not len(node) or not len(straight_at):
                    continue
                local = np.unique(np.concatenate([rid[seg], rid[touched], [-1]]))
                code = lambda rows: np.searchsorted(local, rid[rows]) - 1  # noqa: B023, E731
                row, k = _expand(sizes[touched])
                part = Part(node_ids[node], main[node], at[node, :3], np.stack([n1[seg], n2[seg]], axis=1), code(seg), kind[seg] == STRAIGHT, at[straight_at], values[list_begin[touched][row] + k], code(touched)[row])
                for some, counts, hit in part.hits():
                    some, counts = some[counts > 0], counts[counts > 0]
                    ready.append((map_ids.take(pa.array(node[some])), names.take(pa.array(node[some])), counts, seg_ids.take(pa.array(straight_at[hit]))))
                    if sum(len(s) for _, _, _, s in ready[-1:]) >= PASSED or len(ready) % 64 == 0 and sum(len(s) for _, _, _, s in ready) >= PASSED:
                        yield passed(table.schema)
            if ready:
                yield passed(table.schema)

        rows_kept = 0
        for batch in batches:
            kept.append(batch)
            rows_kept += batch.num_rows
            if rows_kept >= BATCH:
                # Up to the last change of map or part; what follows may go on in the next batch.
                ends_at = (kept[-1]["map_id"][-1].as_py(), kept[-1]["part"][-1].as_py())
                begins_at = (kept[0]["map_id"][0].as_py(), kept[0]["part"][0].as_py())
                if ends_at == begins_at:
                    continue
                table = pa.Table.from_batches(kept).combine_chunks()
                differs = pc.or_(pc.not_equal(table["map_id"], table["map_id"][-1]), pc.not_equal(table["part"], table["part"][-1])).to_numpy()
                cut = int(np.flatnonzero(differs)[-1]) + 1
                yield from found(table.slice(0, cut))
                kept = table.slice(cut).to_batches()
                rows_kept = table.num_rows - cut
        if kept and rows_kept:
            yield from found(pa.Table.from_batches(kept))

    placed = all_rows[0]
    for more in all_rows[1:]:
        placed = placed.unionByName(more)
    found = placed.repartition("map_id", "part").sortWithinPartitions("map_id", "part").mapInArrow(run, f"map_id {keys}, node_id bigint, segs array<{ids}>")
    return found.select("map_id", F.explode("segs").alias("seg_id"), "node_id")
