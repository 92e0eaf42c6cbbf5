"""Measures of drawn maps as spatial joins.

Nothing is compared with everything: points, boxes and segments are put into square cells, and only what shares a cell of
the same map is compared, each pair once. Extents and histograms are plain aggregations by map.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.operators.chords import crossings_by_map
from reactionloom.operators.labels import label_measures
from reactionloom.operators.orphans import whole_number
from reactionloom.operators.ranks import linear_percentiles
from reactionloom.operators.whole_maps import whole_maps
from reactionloom.storage import written

#: Cell sizes, node radius, label metrics and gates of the measures.
CELL, NEAR_CELL, PITCH = 400.0, 120.0, 180.0
RADIUS = 20.0
#: Radius of a drawn node by its type, and of any other. No table says which metabolites are secondary: all count as main ones.
NODE_RADIUS, OTHER_RADIUS = {"metabolite": 30.0, "midmarker": 11.0, "multimarker": 6.0}, 6.0
FONT, CHAR_WIDTH, LINE_HEIGHT = 20.0, 0.58, 1.25
EXTENT = 160.0
BINS = 20
GATES = {"axis_aligned": (0.9, None), "hairball_index": (None, 3.0), "aspect_ratio": (0.5, 2.0), "min_separation_ratio": (0.5, None)}
#: Gates of the whole scorecard. Occupancy is not among them: no table has the size of a canvas.
TARGETS = {
    "axis_aligned": (0.9, None), "crossings_per_edge": (None, 0.05), "longest_run_ratio": (0.15, None), "min_separation_ratio": (1.0, None), "label_overlaps": (None, 0.0),
    "label_on_node": (None, 0.0), "label_on_edge": (None, 0.0), "hairball_index": (None, 3.0), "aspect_ratio": (0.35, 3.0),
}
#: What two labels may overlap by, and how far a label has to keep from a metabolite and from a marker.
TOLERANCE, LABEL_RADIUS, MARKER_RADIUS = 3.0, 34.0, 11.0
#: Rows of nodes or of segments up to which a map is gone through in one task.
MAP_ROWS = 5_000


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def standing_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that were not deleted, each with its newest drawing; equally new ones by the smaller place."""
    newest = W.partitionBy("map_id", "node_id").orderBy(F.desc("added_at"), F.asc_nulls_last("x"), F.asc_nulls_last("y"))
    return nodes.where("deleted_at is null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "added_at", "deleted_at")


def segments(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments between two standing nodes with their end points; `curved` where a control point is set."""
    rows = segs.select("map_id", "seg_id", "rid", whole_number(F.col("from_node_id")).alias("n1"), whole_number(F.col("to_node_id")).alias("n2"), (F.col("b1").isNotNull() | F.col("b2").isNotNull()).alias("curved"), "b1", "b2")
    # Copies are dropped where the segments of a node are, so they need no shuffle of their own.
    rows = rows.where("n1 is not null and n2 is not null").repartition("map_id", "n1").dropDuplicates(["map_id", "n1", "seg_id"])
    end = lambda i: nodes.select("map_id", F.col("node_id").alias(f"n{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return rows.join(end(1), ["map_id", "n1"]).join(end(2), ["map_id", "n2"])


def length() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def axis_aligned(straight: DataFrame) -> DataFrame:
    """Share of straight segments that run along an axis."""
    aligned = (F.abs(F.col("x1") - F.col("x2")) < 1) | (F.abs(F.col("y1") - F.col("y2")) < 1)
    return straight.groupBy("map_id").agg(F.count("*").alias("n_segments"), F.sum(aligned.cast("int")).alias("n_aligned"))


def sampled_cells(straight: DataFrame, size: float = CELL) -> DataFrame:
    """(map_id, seg_id, ends, cx, cy): the cells of points sampled along each segment, at most a cell apart."""
    steps = F.greatest(F.lit(1), F.floor(length() / size) + 1)
    k = straight.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("steps"))))
    t = F.col("k") / F.col("steps")
    at = lambda a, b: cell(F.col(a) + (F.col(b) - F.col(a)) * t, size)
    return k.select("map_id", "seg_id", "n1", "n2", "x1", "y1", "x2", "y2", at("x1", "x2").alias("cx"), at("y1", "y2").alias("cy")).distinct()


def passed_cells(straight: DataFrame, size: float = CELL) -> DataFrame:
    """`straight` with (cx, cy): every cell that a segment passes, by the rows it covers in each column of cells."""
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    k = straight.withColumn("cx", F.explode(F.sequence(cell(left, size), cell(right, size))))
    y = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * ((x - F.col("x1")) / (F.col("x2") - F.col("x1"))))
    a, b = y(F.greatest(left, F.col("cx") * size)), y(F.least(right, (F.col("cx") + 1) * size))
    # The margin is for rounding: a cell too many is harmless.
    lo, hi = F.coalesce(F.least(a, b), F.least("y1", "y2")) - 1e-6, F.coalesce(F.greatest(a, b), F.greatest("y1", "y2")) + 1e-6
    return k.withColumn("cy", F.explode(F.sequence(cell(lo, size), cell(hi, size))))


def crossings(straight: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs of straight segments of a map that cross, counted by map. Segments that share an end point do not cross.

    Segments meet in the cells of points sampled along them, which leaves out a crossing in a cell that one of them only
    clips; with `exact` they meet wherever they cross. Pairs are counted by sorting, not listed (`chords`).
    """
    return crossings_by_map(straight, CELL, exact)


def longest_run(straight: DataFrame) -> DataFrame:
    """Longest chain of touching segments on one axis-parallel line, by map (gaps and islands)."""
    vertical, horizontal = F.abs(F.col("x1") - F.col("x2")) < 1, F.abs(F.col("y1") - F.col("y2")) < 1
    line = F.when(vertical, F.concat(F.lit("v"), F.bround("x1").cast("bigint"))).when(horizontal, F.concat(F.lit("h"), F.bround("y1").cast("bigint")))
    lo = F.when(vertical, F.least("y1", "y2")).otherwise(F.least("x1", "x2"))
    hi = F.when(vertical, F.greatest("y1", "y2")).otherwise(F.greatest("x1", "x2"))
    spans = straight.select("map_id", line.alias("line"), lo.alias("lo"), hi.alias("hi")).where("line is not null")
    w = W.partitionBy("map_id", "line").orderBy("lo", "hi")
    reach = spans.withColumn("reach", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    runs = reach.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    each = runs.groupBy("map_id", "line", "run").agg((F.max("hi") - F.min("lo")).alias("length"))
    return each.groupBy("map_id").agg(F.max("length").alias("longest_run"), F.count("*").alias("n_runs"))


def extents(points: DataFrame) -> DataFrame:
    """Width, height and aspect ratio of each map's points, not below one node's footprint."""
    w, h = F.greatest(F.max("x") - F.min("x"), F.lit(EXTENT)), F.greatest(F.max("y") - F.min("y"), F.lit(EXTENT))
    return points.groupBy("map_id").agg(F.count("*").alias("n_points"), F.min("x").alias("x_min"), F.min("y").alias("y_min"), (F.max("x") - F.min("x")).alias("x_range"), (F.max("y") - F.min("y")).alias("y_range"), (w / h).alias("aspect_ratio"))


def hairball(points: DataFrame) -> DataFrame:
    """Peak over mean of the occupied bins of a 20 by 20 grid; 1 for fewer than four points."""
    box = extents(points).select("map_id", "n_points", "x_min", "y_min", F.greatest("x_range", F.lit(1e-6)).alias("w"), F.greatest("y_range", F.lit(1e-6)).alias("h"))
    at = lambda v, lo, size: F.least(F.lit(BINS - 1), F.floor((F.col(v) - F.col(lo)) / F.col(size) * BINS))
    # Bounds are one row per map: the join is on the map, and the histogram combines on the map side.
    bins = points.join(box, "map_id").groupBy("map_id", "n_points", at("x", "x_min", "w").alias("bx"), at("y", "y_min", "h").alias("by")).agg(F.count("*").alias("n"))
    peak = F.when(F.col("n_points") < 4, 1.0).otherwise(F.max("n") / F.avg("n"))
    return bins.groupBy("map_id", "n_points").agg(peak.alias("hairball_index")).select("map_id", "hairball_index")


def near_pairs(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Pairs of points of a map in the same or neighbouring cells; columns of `others` end in `_o`."""
    grid = lambda df: df.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    around = F.array([F.lit(d) for d in (-1, 0, 1)])
    spread = grid(others).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    spread = spread.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")
    spread = spread.select("map_id", "cx", "cy", *[F.col(c).alias(f"{c}_o") for c in others.columns if c != "map_id"])
    return grid(points).join(spread, ["map_id", "cx", "cy"]).drop("cx", "cy")


def distance2() -> Column:
    dx, dy = F.col("x") - F.col("x_o"), F.col("y") - F.col("y_o")
    return dx * dx + dy * dy


def min_separation(points: DataFrame, pitch: float = PITCH) -> DataFrame:
    """Smallest distance of two points that do not coincide, in pitches; 1 where no two are in neighbouring cells."""
    p = points.select("map_id", "x", "y")
    least = near_pairs(p, p, pitch).where("x <> x_o or y <> y_o").groupBy("map_id").agg(F.min(distance2()).alias("d2"))
    return p.select("map_id").distinct().join(least, "map_id", "left").select("map_id", (F.sqrt(F.coalesce("d2", F.lit(pitch * pitch))) / pitch).alias("min_separation_ratio"))


def label_width(text: str) -> Column:
    return F.greatest(F.length(text), F.lit(1)) * FONT * CHAR_WIDTH


def label_boxes(points: DataFrame, text: str) -> DataFrame:
    """The box of the label right of each point."""
    w, h = label_width(text), FONT * LINE_HEIGHT
    return points.select("map_id", "node_id", F.col("x").alias("left"), (F.col("y") - h / 2).alias("top"), (F.col("x") + w).alias("right"), (F.col("y") + h / 2).alias("bottom"))


def box_overlaps(boxes: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of boxes of a map that overlap (touching is no overlap), counted by map."""
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))
    placed = boxes.withColumn("cx", span("left", "right")).withColumn("cy", span("top", "bottom"))
    half = lambda p: placed.select("map_id", "cx", "cy", *[F.col(c).alias(f"{c}_{p}") for c in ("node_id", "left", "top", "right", "bottom")])
    pairs = half("p").join(half("q"), ["map_id", "cx", "cy"]).where("node_id_p < node_id_q and right_p > left_q and left_p < right_q and bottom_p > top_q and top_p < bottom_q")
    # Each pair counts in one cell, that of the corner where the overlap begins.
    once = (F.col("cx") == cell(F.greatest("left_p", "left_q"), size)) & (F.col("cy") == cell(F.greatest("top_p", "top_q"), size))
    return pairs.where(once).groupBy("map_id").agg(F.count("*").alias("n_overlaps"))


def labels_on_nodes(boxes: DataFrame, nodes: DataFrame, radius: float | Column = RADIUS, most: float = RADIUS, size: float = CELL) -> DataFrame:
    """Labels that cover another node; each label counts once. `most`: the largest radius."""
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a) - most, size), cell(F.col(b) + most, size)))
    placed = boxes.withColumn("cx", span("left", "right")).withColumn("cy", span("top", "bottom"))
    spots = nodes.select("map_id", F.col("node_id").alias("other"), "x", "y", F.lit(radius).alias("r"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    hit = placed.join(spots, ["map_id", "cx", "cy"]).where("other <> node_id and x > left - r and x < right + r and y > top - r and y < bottom + r")
    return hit.select("map_id", "node_id").distinct().groupBy("map_id").agg(F.count("*").alias("n_labels"))


def ink(segs: DataFrame, steps: int = 10) -> DataFrame:
    """(map_id, n1, n2, x1, y1, x2, y2): segments as straight pieces; those with both control points in `steps` pieces."""
    t = lambda i: i / F.lit(float(steps))
    on = lambda a, i: F.pow(1 - t(i), F.lit(3.0)) * F.col(f"{a}1") + 3 * (1 - t(i)) * (1 - t(i)) * t(i) * F.col(f"b1.{a}") + 3 * (1 - t(i)) * t(i) * t(i) * F.col(f"b2.{a}") + F.pow(t(i), F.lit(3.0)) * F.col(f"{a}2")
    piece = lambda i: F.struct(on("x", i).alias("x1"), on("y", i).alias("y1"), on("x", i + 1).alias("x2"), on("y", i + 1).alias("y2"))
    bent = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), piece)
    line = F.array(F.struct("x1", "y1", "x2", "y2"))
    pieces = segs.select("map_id", "n1", "n2", F.explode(F.when(F.col("b1").isNotNull() & F.col("b2").isNotNull(), bent).otherwise(line)).alias("p"))
    return pieces.select("map_id", "n1", "n2", "p.*").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def labels_met(boxes: DataFrame, pieces: DataFrame, by_cell: bool = True) -> DataFrame:
    """(map_id, node_id): labels that a piece of a segment runs through or touches; met in cells, or all of a map.

    Segments at the label's own node are left out: the box starts at the node, so they would always touch it.
    """
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), CELL), cell(F.col(b), CELL)))
    placed = boxes.withColumn("cx", span("left", "right")).withColumn("cy", span("top", "bottom"))
    x = placed.join(passed_cells(pieces), ["map_id", "cx", "cy"]) if by_cell else boxes.join(pieces, "map_id")
    x = x.where("node_id <> n1 and node_id <> n2")
    # A segment meets a box if their extents meet and the corners are not all on one side of the line.
    side = lambda a, b: (F.col("x2") - F.col("x1")) * (F.col(b) - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col(a) - F.col("x1"))
    corners = [side(a, b) for a in ("left", "right") for b in ("top", "bottom")]
    meets = "greatest(x1, x2) >= left and least(x1, x2) <= right and greatest(y1, y2) >= top and least(y1, y2) <= bottom"
    hit = x.where(meets).where((F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))
    return hit.select("map_id", "node_id").distinct()


def labels_on_edges(boxes: DataFrame, segs: DataFrame, first: int = 500) -> DataFrame:
    """Labels that an edge runs through or touches, counted by map; each label counts once.

    On a map of many edges, labels meet about `first` of the edges to begin with; only labels that none of these touches meet
    all of them, in cells. The first edges go to the tasks by map and are cut into pieces there, so no cells are shuffled for them.
    """
    many = segs.groupBy("map_id").agg(F.ceil(F.count("*") / first).alias("_share"))
    shared = segs.join(many, "map_id")
    some = shared.where(F.pmod(F.xxhash64("seg_id"), F.col("_share")) == 0).repartition("map_id")
    hit = written(labels_met(boxes, ink(some), by_cell=False), "labels", release=True)
    left = boxes.join(many.where("_share > 1").select("map_id"), "map_id", "left_semi").join(hit, ["map_id", "node_id"], "left_anti")
    left = written(left, "labels", release=True)
    rest = segs.join(left.select("map_id").distinct(), "map_id", "left_semi")
    return hit.unionByName(labels_met(left, ink(rest))).groupBy("map_id").agg(F.count("*").alias("n_on_edges"))


def node_radius() -> Column:
    kind = F.col("node_type")
    return F.coalesce(*[F.when(kind == k, r) for k, r in NODE_RADIUS.items()], F.lit(OTHER_RADIUS))


def node_overlaps(nodes: DataFrame, segs: DataFrame, radius: float | Column = RADIUS) -> DataFrame:
    """Pairs of nodes closer than the sum of their radii that no segment joins. Two radii are at most NEAR_CELL."""
    p = nodes.select("map_id", "node_id", "x", "y", F.lit(radius).alias("r"))
    reach = F.col("r") + F.col("r_o")
    close = near_pairs(p, p, NEAR_CELL).where(F.col("node_id") < F.col("node_id_o")).where(distance2() < reach * reach)
    joined = segs.select("map_id", F.least("n1", "n2").alias("node_id"), F.greatest("n1", "n2").alias("node_id_o")).distinct()
    return close.join(joined, ["map_id", "node_id", "node_id_o"], "left_anti").select("map_id", F.col("node_id").alias("a"), F.col("node_id_o").alias("b"))


def node_owners(segs: DataFrame) -> DataFrame:
    """(map_id, node_id, rid): the reactions that have a segment, curved or not, at each node."""
    ends = segs.where("rid is not null").select("map_id", "rid", F.explode(F.array("n1", "n2")).alias("node_id"))
    return ends.select("map_id", "node_id", "rid").distinct()


def edges_through_nodes(straight: DataFrame, nodes: DataFrame, radius: float | Column = RADIUS, owners: DataFrame | None = None) -> DataFrame:
    """Segments that run through a node they do not end at; given `owners`, nodes of the segment's own reaction are left out."""
    cells = sampled_cells(straight, NEAR_CELL).select("map_id", "seg_id", "n1", "n2", "x1", "y1", "x2", "y2", "cx", "cy")
    around = F.array([F.lit(d) for d in (-1, 0, 1)])
    spots = nodes.select("map_id", "node_id", "x", "y", F.lit(radius).alias("r"), F.explode(around).alias("dx")).withColumn("dy", F.explode(around))
    spots = spots.select("map_id", "node_id", "x", "y", "r", (cell(F.col("x"), NEAR_CELL) + F.col("dx")).alias("cx"), (cell(F.col("y"), NEAR_CELL) + F.col("dy")).alias("cy"))
    x = cells.join(spots, ["map_id", "cx", "cy"]).where("node_id <> n1 and node_id <> n2")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    size, r = dx * dx + dy * dy, F.col("r")
    along, across = px * dx + py * dy, px * dy - py * dx
    hit = x.where((size > 0) & (along > 0) & (along < size) & (across * across < r * r * size)).select("map_id", "seg_id", "node_id").distinct()
    if owners is None:
        return hit
    own = straight.select("map_id", "seg_id", "rid").join(owners, ["map_id", "rid"]).select("map_id", "seg_id", "node_id")
    return hit.join(own, ["map_id", "seg_id", "node_id"], "left_anti")


def collinear_overlaps(straight: DataFrame, tolerance: float = 4.0, shared: float = 12.0) -> DataFrame:
    """Pairs of axis-parallel segments on the same line that overlap by more than `shared`."""
    vertical, horizontal = F.abs(F.col("x1") - F.col("x2")) < 1, F.abs(F.col("y1") - F.col("y2")) < 1
    axis = F.when(vertical, "v").when(horizontal, "h")
    at = F.bround(F.when(vertical, F.col("x1")).otherwise(F.col("y1")) / tolerance).cast("bigint")
    lo = F.when(vertical, F.least("y1", "y2")).otherwise(F.least("x1", "x2"))
    hi = F.when(vertical, F.greatest("y1", "y2")).otherwise(F.greatest("x1", "x2"))
    spans = straight.select("map_id", "seg_id", axis.alias("axis"), at.alias("at"), lo.alias("lo"), hi.alias("hi")).where("axis is not null")
    half = lambda p: spans.select("map_id", "axis", "at", F.col("seg_id").alias(f"seg_{p}"), F.col("lo").alias(f"lo_{p}"), F.col("hi").alias(f"hi_{p}"))
    x = half("p").join(half("q"), ["map_id", "axis", "at"]).where("seg_p < seg_q")
    return x.where(F.least("hi_p", "hi_q") - F.greatest("lo_p", "lo_q") > shared).select("map_id", "axis", "seg_p", "seg_q")


def nearest_other(points: DataFrame, key: str, reach: float = PITCH) -> DataFrame:
    """For each point the nearest point of the map with another `key` within reach; equally near ones by id."""
    p = points.select("map_id", "node_id", "x", "y", key)
    x = near_pairs(p, p, reach).where(F.col(key) != F.col(f"{key}_o")).where(distance2() <= reach * reach)
    best = F.min(F.struct(distance2().alias("d2"), F.col("node_id_o").alias("other"))).alias("b")
    return x.groupBy("map_id", "node_id").agg(best).select("map_id", "node_id", "b.other", "b.d2")


def cell_clashes(points: DataFrame, tile: Column, size: float = 100.0) -> DataFrame:
    """Cells of a map that more than one tile draws into."""
    cells = points.groupBy("map_id", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy")).agg((F.countDistinct(tile) - 1).alias("n"))
    return cells.groupBy("map_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("n_clashes"), F.count("*").alias("n_cells"))


def gap_remap(points: DataFrame, max_gap: float = 50.0, block: float = 1_000.0) -> DataFrame:
    """Distinct x values of each map with what gaps above `max_gap` shift them by.

    A map is cut into blocks of x. Gaps and their sums are found within each block; only the blocks, one row each, are put
    in order over the map, which gives the value before a block and the sum of all gaps before it.
    """
    values = points.where("x is not null").select("map_id", "x").distinct().withColumn("block", cell(F.col("x"), block))
    blocks = values.groupBy("map_id", "block").agg(F.max("x").alias("last"))
    over = W.partitionBy("map_id").orderBy("block")
    x = values.join(blocks.select("map_id", "block", F.lag("last").over(over).alias("before")), ["map_id", "block"])
    own = W.partitionBy("map_id", "block").orderBy("x")
    gap = F.coalesce(F.col("x") - F.coalesce(F.lag("x").over(own), F.col("before")), F.lit(0.0))
    x = x.withColumn("excess", F.greatest(gap - max_gap, F.lit(0.0)))
    sums = x.groupBy("map_id", "block").agg(F.sum("excess").alias("all"))
    starts = sums.select("map_id", "block", F.coalesce(F.sum("all").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("start"))
    upto = F.sum("excess").over(own.rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("upto", upto).join(starts, ["map_id", "block"]).select("map_id", "x", (F.col("start") + F.col("upto")).alias("shift"))


def scorecard(nodes: DataFrame, segs: DataFrame, separation: DataFrame | None = None) -> DataFrame:
    """The measures of each map that has metabolites, in one row; `separation` (map_id, d2) where that is known."""
    points, straight = nodes.where("node_type = 'metabolite'"), segs.where(~F.col("curved"))
    share = F.when(F.col("n_segments") > 0, F.col("n_aligned") / F.col("n_segments")).otherwise(1.0)
    out = extents(points).select("map_id", "n_points", "aspect_ratio").join(hairball(points), "map_id")
    if separation is None:
        out = out.join(min_separation(points), "map_id")
    else:
        known = separation.where("d2 < double('infinity')").select("map_id", (F.sqrt("d2") / PITCH).alias("min_separation_ratio"))
        out = out.join(known, "map_id", "left").withColumn("min_separation_ratio", F.coalesce("min_separation_ratio", F.lit(1.0)))
    return out.join(axis_aligned(straight), "map_id", "left").select("map_id", "n_points", "aspect_ratio", "hairball_index", "min_separation_ratio", F.coalesce(share, F.lit(1.0)).alias("axis_aligned"))


def _label_rules() -> tuple[Column, Column]:
    """Width of a node's label, null for nodes without, and what labels keep off the node."""
    metabolite = F.coalesce(F.col("node_type") == "metabolite", F.lit(False))
    return F.when(metabolite, label_width("bigg_id")), F.when(metabolite, LABEL_RADIUS).otherwise(MARKER_RADIUS)


def _counts(nodes: DataFrame, segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is counted of labels and crossings; `nodes` and `segs` are written tables."""
    width, keep_off = _label_rules()
    labels = written(label_measures(nodes, segs, width, FONT * LINE_HEIGHT, keep_off, LABEL_RADIUS, TOLERANCE, PITCH), "measures", release=True)
    return labels, written(crossings(segs.where(~F.col("curved"))), "measures", release=True)


def _gathered(nodes: DataFrame, segs: DataFrame, labels: DataFrame, crossed: DataFrame) -> DataFrame:
    """The measures in one row for each map that has metabolites."""
    straight = segs.where(~F.col("curved"))
    lengths = straight.groupBy("map_id").agg(F.count("*").alias("n_segments"), F.sum(length()).alias("total"))
    out = written(scorecard(nodes, segs, labels).join(labels.drop("d2"), "map_id", "left"), "scores", release=True).join(crossed, "map_id", "left")
    for part in (lengths, longest_run(straight)):
        out = out.join(written(part, "measures", release=True), "map_id", "left")
    over = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    added = {"crossings_per_edge": over("n_crossings", "n_segments"), "longest_run_ratio": over("longest_run", "total"), "label_overlaps": count("n_overlaps"), "label_on_node": count("n_labels"), "label_on_edge": count("n_on_edges")}
    return out.withColumns(added).select("map_id", "n_points", *TARGETS)


def whole_scorecard(nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """`scorecard` with crossings, runs and labels: all of TARGETS; 0 for maps without any.

    `nodes` are read several times. Each step is written by itself, a row for each map, so that the shuffle files of only
    one of them are there at a time; all that looks at labels or at distances is one step (`labels`).
    """
    segs = written(segs.drop("rid"), "segments", release=True)
    return _gathered(nodes, segs, *_counts(nodes, segs))


def table_scorecard(nodes: DataFrame, segs: DataFrame, most: int = MAP_ROWS) -> DataFrame:
    """`whole_scorecard` of the rows of the tables.

    Maps of at most `most` rows of either table are shuffled once, as they are, and gone through in tasks (`whole_maps`); only
    larger ones go through joins and are cut into tiles and parts.
    """
    ids = nodes.select("map_id", F.lit(0).alias("t")).unionByName(segs.select("map_id", F.lit(1).alias("t")))
    sizes = ids.groupBy("map_id", "t").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = written(sizes.select("map_id").distinct(), "large", release=True)
    width, keep_off = _label_rules()
    rest = [df.join(F.broadcast(large), "map_id", "left_anti") for df in (nodes, segs)]  # a row for each map of many rows
    points, straight, found = whole_maps(*rest, width, FONT * LINE_HEIGHT, keep_off, TOLERANCE, PITCH, CELL)
    labels, crossed = found.drop("n_crossings"), found.select("map_id", "n_crossings")
    if not large.isEmpty():
        nodes, segs = (df.join(F.broadcast(large), "map_id", "left_semi") for df in (nodes, segs))
        nodes = written(standing_nodes(nodes), "nodes", release=True)
        segs = written(segments(segs, nodes).drop("rid"), "segments", release=True)
        more_labels, more_crossed = _counts(nodes, segs)
        points = points.unionByName(nodes.where("node_type = 'metabolite'").select(*points.columns))
        straight = straight.unionByName(segs.where(~F.col("curved")).select(*straight.columns))
        labels, crossed = labels.unionByName(more_labels), crossed.unionByName(more_crossed)
    return _gathered(points.withColumn("node_type", F.lit("metabolite")), straight.withColumn("curved", F.lit(False)), labels, crossed)


def long_scores(scores: DataFrame, metrics: Iterable[str] = GATES) -> DataFrame:
    """(map_id, metric, value) of a scorecard."""
    return scores.unpivot(["map_id"], list(metrics), "metric", "value")


def in_band(scores: DataFrame, gates: dict[str, tuple[float | None, float | None]] = GATES) -> DataFrame:
    """Long scores with whether they are within their gate; an open side always passes."""
    bands = scores.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in gates.items()], "metric string, lo double, hi double")
    within = (F.col("lo").isNull() | (F.col("value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    return scores.join(F.broadcast(bands), "metric").select("map_id", "metric", "value", within.alias("within"))


def summary(banded: DataFrame) -> DataFrame:
    """Median, tenth and ninetieth percentile (linear) and the share within the gate, by metric."""
    places = linear_percentiles(banded, ["metric"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return places.join(banded.groupBy("metric").agg(F.avg(F.col("within").cast("int")).alias("share_within"), F.count("*").alias("n")), "metric")


def worst(banded: DataFrame, n: int = 20) -> DataFrame:
    """The maps that fail most gates, most failures first."""
    failed = banded.groupBy("map_id").agg(F.sum((~F.col("within")).cast("int")).alias("n_failed"))
    return failed.orderBy(F.desc("n_failed"), "map_id").limit(n)


def bezier_pieces(segs: DataFrame, steps: int = 10) -> DataFrame:
    """(map_id, seg_id, n_pieces, length): segments with both control points, measured over `steps` straight pieces."""
    bent = segs.where("b1 is not null and b2 is not null")
    pieces = ink(bent.withColumn("n1", F.col("seg_id")), steps).withColumnRenamed("n1", "seg_id")
    return pieces.groupBy("map_id", "seg_id").agg(F.count("*").alias("n_pieces"), F.sum(length()).alias("length"))


def arc_controls(segs: DataFrame) -> DataFrame:
    """(map_id, seg_id, bend, c1x, c1y, c2x, c2y, sagitta): the arc of each segment about the centre of its drawn reaction.

    The arc goes the short way, half a turn to the left; its control points stand on the tangents, 4/3 tan(angle/4) radii from the ends. Segments
    with an end at the centre, or whose ends are in one direction from it, have no arc. `sagitta` is how far the arc is from the
    chord, to the left of start to end.
    """
    points = segs.select("map_id", "rid", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("map_id", "rid", "p.x", "p.y").distinct()
    centre = points.groupBy("map_id", "rid").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    x = segs.join(centre, ["map_id", "rid"]).select("map_id", "seg_id", "x1", "y1", "x2", "y2", "cx", "cy", (F.col("x1") - F.col("cx")).alias("ax"), (F.col("y1") - F.col("cy")).alias("ay"), (F.col("x2") - F.col("cx")).alias("bx"), (F.col("y2") - F.col("cy")).alias("by"))
    c = F.col
    bend = F.atan2(c("ax") * c("by") - c("ay") * c("bx"), c("ax") * c("bx") + c("ay") * c("by"))
    bend = F.when(F.abs(bend) > math.pi - 1e-6, math.pi).otherwise(bend)  # half a turn goes to the left
    x = x.withColumn("bend", bend).withColumn("radius", (F.sqrt(c("ax") * c("ax") + c("ay") * c("ay")) + F.sqrt(c("bx") * c("bx") + c("by") * c("by"))) / 2)
    x = x.where((c("ax") * c("ax") + c("ay") * c("ay") >= 1e-6) & (c("bx") * c("bx") + c("by") * c("by") >= 1e-6) & (F.abs("bend") >= 1e-6)).withColumn("k", F.tan(c("bend") / 4) * 4 / 3).withColumn("chord", length())
    # The chord's middle from the centre, along the left normal of start to end.
    towards = ((c("ax") + c("bx")) / 2 * -(c("y2") - c("y1")) + (c("ay") + c("by")) / 2 * (c("x2") - c("x1"))) / c("chord")
    x = x.where("chord > 0").withColumn("towards", towards)
    sagitta = F.when(F.abs("towards") < 1e-6, c("radius")).otherwise(F.signum("towards") * (c("radius") - F.abs("towards")))
    return x.select("map_id", "seg_id", "bend", (c("x1") - c("k") * c("ay")).alias("c1x"), (c("y1") + c("k") * c("ax")).alias("c1y"), (c("x2") + c("k") * c("by")).alias("c2x"), (c("y2") - c("k") * c("bx")).alias("c2y"), sagitta.alias("sagitta"))


def ring_radius(n: Column, pitch: float = PITCH) -> Column:
    """Radius on which `n` nodes stand about one pitch apart, at least one pitch."""
    return F.greatest(F.lit(pitch), n * pitch / (2 * math.pi))


def unrelated_hits(hits: DataFrame, segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`hits` (map_id, seg_id, node_id) of edges through nodes between unrelated reactions only.

    The segment's reaction and one of the node's are related if they are the same or both touch one metabolite node.
    """
    drawn = segs.where("rid is not null").select("map_id", "seg_id", "rid")
    owners = node_owners(segs)
    x = hits.join(drawn, ["map_id", "seg_id"]).join(owners.withColumnRenamed("rid", "other"), ["map_id", "node_id"])
    touch = owners.join(nodes.where("node_type = 'metabolite'").select("map_id", "node_id"), ["map_id", "node_id"], "left_semi")
    pairs = x.select("map_id", "rid", "other").distinct()
    both = pairs.join(touch.withColumnRenamed("node_id", "shared"), ["map_id", "rid"]).join(touch.select("map_id", F.col("rid").alias("other"), F.col("node_id").alias("shared")), ["map_id", "other", "shared"], "left_semi")
    related = pairs.where("rid = other").union(both.select("map_id", "rid", "other")).distinct()
    near = x.join(related, ["map_id", "rid", "other"], "left_semi").select("map_id", "seg_id", "node_id").distinct()
    return hits.join(near, ["map_id", "seg_id", "node_id"], "left_anti")


def merged_maps(nodes: DataFrame, segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, segments) of all maps as one: ids have the map's before them, reactions drawn on several maps the map's behind."""
    name = lambda c: F.concat(F.col("map_id").cast("string"), F.lit("_"), F.col(c).cast("string"))
    clash = segs.select("rid", "map_id").distinct().groupBy("rid").agg((F.count("*") > 1).alias("clash"))
    lines = segs.join(clash, "rid", "left")
    rid = F.when(F.coalesce("clash", F.lit(False)), F.concat("rid", F.lit("~"), F.col("map_id").cast("string"))).otherwise(F.col("rid"))
    return nodes.select(name("node_id").alias("id"), "node_type", "bigg_id", "x", "y"), lines.select(name("seg_id").alias("id"), rid.alias("rid"), name("n1").alias("from_id"), name("n2").alias("to_id"))
