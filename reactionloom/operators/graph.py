"""Graph operators as loops of joins over edge tables.

Each round is a written table, so a plan never grows with the number of rounds and a lost executor costs one round. Rounds
of distances and layers are bounded by the graph's diameter, within one model; those of components by its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactionloom.storage import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("model_id", "u", "v").union(edges.select("model_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component of the undirected `links` (u, v), any orderable type.

    Alternating large and small stars: a node hangs its greater neighbours on its smallest one, then itself and its smaller
    neighbours. The number of rounds follows the logarithm of the nodes, not the diameter. Each round is one written table,
    whose count and checksum, taken as it is written, tell when nothing changes any more. A node linked to itself only is a
    component of its own; nulls are no nodes; no links give no rows.
    """
    known = links.where("u is not null and v is not null").select("u", "v")
    now, before = written(known.where("u <> v").distinct(), "stars"), None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        seen = Observation()
        stars = small.select("e.u", "e.v").where("u <> v").distinct()
        now = written(stars.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")), "stars")
        after = (seen.get["n"], seen.get["sum"])
        if after == before or not after[0]:
            break
        before = after
    nodes = known.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(model_id, node, component): the smallest node of each weakly connected component."""
    node = lambda c: F.struct("model_id", F.col(c).alias("node"))
    found = connected(written(edges.select("model_id", "u", "v").distinct(), "edges").select(node("u").alias("u"), node("v").alias("v")))
    return found.select("node.model_id", "node.node", F.col("component.node").alias("component"))


def distances(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(model_id, node, distance) of every node reached from the sources (model_id, node), at most `limit` steps away."""
    both = written(undirected(edges), "edges")
    seen = written(sources.select("model_id", "node").distinct().withColumn("distance", F.lit(0)), "reached")
    step = 0
    while limit is None or step < limit:
        step += 1
        frontier = seen.where(F.col("distance") == step - 1)
        found = both.join(frontier.withColumnRenamed("node", "u"), ["model_id", "u"]).select("model_id", F.col("v").alias("node")).distinct()
        fresh = written(found.join(seen, ["model_id", "node"], "left_anti").withColumn("distance", F.lit(step)), "frontier")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if step % 10 == 0:
            seen = written(seen, "reached")
    return seen


def reaction_links(backbone: DataFrame) -> DataFrame:
    """Bipartite edges reaction - metabolite as (model_id, u, v); reactions are marked to differ from metabolites."""
    return backbone.select("model_id", F.concat(F.lit("rxn:"), "rid").alias("u"), F.col("metabolite_id").alias("v")).distinct()


def neighbourhood(backbone: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """(model_id, rid, hops): reactions within `radius` hops of the seeds (model_id, rid) through backbone metabolites."""
    start = seeds.select("model_id", F.concat(F.lit("rxn:"), "rid").alias("node"))
    reached = distances(reaction_links(backbone), start, 2 * max(radius, 1))
    return reached.where("node like 'rxn:%'").select("model_id", F.substring("node", 5, 10_000).alias("rid"), (F.col("distance") / 2).cast("int").alias("hops"))


def turned(edges: DataFrame) -> DataFrame:
    """(model_id, u, v, reversed): each line between two nodes once, from the smaller to the greater name, so that none closes a cycle.

    `reversed` where all its edges run the other way. An edge from a node to itself is no line.
    """
    return edges.where("u <> v").groupBy("model_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(F.col("u") > F.col("v")).alias("reversed")).select("model_id", F.col("a").alias("u"), F.col("b").alias("v"), "reversed")


def cycles_condensed(edges: DataFrame, steps: int = 3) -> DataFrame:
    """(model_id, node, component) of the nodes on cycles: the smallest node of each strongly connected component of two nodes or more.

    Nodes without an edge in or out are on no cycle; they are taken away until all have both, `steps` times a round. Of what
    is left, the smallest node that reaches a node spreads along the edges and colours it; what reaches the node that gave
    its colour, within the colour, is one component. Components are taken away and the rest starts anew.
    """
    e = written(edges.where("u <> v").select("model_id", "u", "v").distinct(), "edges")
    found: DataFrame | None = None
    node = lambda df, c: df.select("model_id", F.col(c).alias("node")).distinct()
    none = e.limit(0).select("model_id", F.col("u").alias("node"), F.col("u").alias("component"))

    def spread(now: DataFrame, over: DataFrame, start: str, end: str) -> DataFrame:
        """`now` (model_id, node, c): the smallest c carried along the edges from `start` to `end`, two edges a round."""
        while True:
            new = now.withColumn("old", F.col("c"))
            for _ in range(2):
                offers = over.join(new.select("model_id", F.col("node").alias(start), "c"), ["model_id", start]).groupBy("model_id", F.col(end).alias("node")).agg(F.min("c").alias("offer"))
                new = new.join(offers, ["model_id", "node"], "left").select("model_id", "node", "old", F.least("c", "offer").alias("c"))  # nulls are no offers
            seen = Observation()
            now = written(new.observe(seen, F.coalesce(F.sum((F.col("c") != F.col("old")).cast("int")), F.lit(0)).alias("n")), "colours").drop("old")
            if not seen.get["n"]:
                return now

    while True:
        size = None
        while True:  # take away what lies on no cycle
            for _ in range(steps):
                e = _inner_edges(e)
            seen = Observation()
            e = written(e.observe(seen, F.count("*").alias("n")), "core")
            if seen.get["n"] == size or not seen.get["n"]:
                break
            size = seen.get["n"]
        if not seen.get["n"]:
            return found if found is not None else none
        nodes = node(e, "u").withColumn("c", F.col("node"))
        colours = spread(nodes, e, "u", "v")
        same = e.join(colours.select("model_id", F.col("node").alias("u"), F.col("c").alias("cu")), ["model_id", "u"]).join(colours.select("model_id", F.col("node").alias("v"), F.col("c").alias("cv")), ["model_id", "v"])
        same = written(same.where("cu = cv").select("model_id", "u", "v"), "colours")
        # The node that gave a colour is the smallest of it: a node reaches it if that is the smallest that it reaches.
        back = spread(nodes, same, "v", "u").withColumnRenamed("c", "component")
        part = colours.join(back, ["model_id", "node"]).where("c = component").select("model_id", "node", "component")
        part = written(part, "components")
        several = part.groupBy("model_id", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        several = part.join(several, ["model_id", "component"]).select("model_id", "node", "component")
        found = several if found is None else found.unionByName(several)
        gone = part.select("model_id", "node")
        e = written(e.join(gone.withColumnRenamed("node", "u"), ["model_id", "u"], "left_anti").join(gone.withColumnRenamed("node", "v"), ["model_id", "v"], "left_anti"), "core")


def _inner_edges(e: DataFrame) -> DataFrame:
    """Edges whose start is an end and whose end is a start of an edge."""
    starts = e.select("model_id", F.col("u").alias("v")).distinct()
    ends = e.select("model_id", F.col("v").alias("u")).distinct()
    return e.join(starts, ["model_id", "v"], "left_semi").join(ends, ["model_id", "u"], "left_semi").select("model_id", "u", "v")


def longest_paths(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(model_id, node, layer) of `nodes`: longest path from a source along the edges of `dag`, which has no cycle."""
    dag = written(dag.select("model_id", "u", "v").distinct(), "dag")
    now = written(nodes.select("model_id", "node").distinct().withColumn("layer", F.lit(0)), "layers")
    while True:
        offers = dag.join(now.withColumnRenamed("node", "u"), ["model_id", "u"]).groupBy("model_id", F.col("v").alias("node")).agg((F.max("layer") + 1).alias("offer"))
        seen = Observation()
        new = now.join(offers, ["model_id", "node"], "left").select("model_id", "node", F.greatest("layer", "offer").alias("layer"), F.coalesce(F.col("offer") > F.col("layer"), F.lit(False)).alias("moved"))
        now = written(new.observe(seen, F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("n")), "layers").drop("moved")
        if not seen.get["n"]:
            return now


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("model_id", F.col("u").alias("node")).union(edges.select("model_id", "v")).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """(model_id, node, layer) of every node that has an edge: longest path from a source over all edges.

    The nodes of a cycle share a layer: a strongly connected component counts as one node. So no edge is dropped or turned
    round, and the layers do not depend on what nodes are called.
    """
    edges = written(edges.select("model_id", "u", "v").distinct(), "edges")
    whole = written(ends(edges).join(cycles_condensed(edges), ["model_id", "node"], "left").select("model_id", "node", F.coalesce("component", "node").alias("c")), "condensed")
    at = lambda k: whole.select("model_id", F.col("node").alias(k), F.col("c").alias(f"c{k}"))
    dag = edges.join(at("u"), ["model_id", "u"]).join(at("v"), ["model_id", "v"]).where("cu <> cv").select("model_id", F.col("cu").alias("u"), F.col("cv").alias("v"))
    found = longest_paths(dag, whole.select("model_id", F.col("c").alias("node")))
    return whole.join(found.withColumnRenamed("node", "c"), ["model_id", "c"]).select("model_id", "node", "layer")


def turned_layers(edges: DataFrame) -> DataFrame:
    """(model_id, node, layer) of every node that has an edge: longest path from a source, back edges turned round (`turned`)."""
    edges = written(edges.select("model_id", "u", "v").distinct(), "edges")
    return longest_paths(turned(edges), ends(edges))


def proper_edges(lines: DataFrame, layer: DataFrame) -> DataFrame:
    """Lines (model_id, u, v) cut at every layer they pass: (model_id, from_layer, a, b, flat); a cut point is `u>v@layer`.

    A line within a layer, on a cycle, is one row and `flat`.
    """
    at = lambda node, name: layer.select("model_id", F.col("node").alias(node), F.col("layer").alias(name))
    x = lines.select("model_id", "u", "v").where("u <> v").distinct().join(at("u", "lu"), ["model_id", "u"]).join(at("v", "lv"), ["model_id", "v"])
    flat = F.col("lu") == F.col("lv")
    x = x.withColumn("from_layer", F.explode(F.sequence(F.col("lu"), F.when(flat, F.col("lu")).otherwise(F.col("lv") - 1))))
    point = lambda k: F.when(k == F.col("lu"), F.col("u")).when(k == F.col("lv"), F.col("v")).otherwise(F.concat("u", F.lit(">"), "v", F.lit("@"), k.cast("string")))
    return x.select("model_id", "from_layer", F.when(flat, F.col("u")).otherwise(point(F.col("from_layer"))).alias("a"), F.when(flat, F.col("v")).otherwise(point(F.col("from_layer") + 1)).alias("b"), flat.alias("flat"))


def layer_crossings(proper: DataFrame) -> DataFrame:
    """Crossings between neighbouring layers when each layer is ordered by name: edges whose ends are in opposite order.

    Inversions are counted without pairs: two ends are in opposite order at the first binary digit in which their ranks
    differ. For each digit, edges whose ranks agree before it are sorted by the other end, and each with a 0 counts those
    with a 1 before it, so the work is that of sorting.
    """
    gap = ["model_id", "from_layer"]
    rank = lambda c: F.dense_rank().over(W.partitionBy(*gap).orderBy(c))
    x = proper.where("not flat").select(*gap, rank("a").alias("ra"), rank("b").alias("rb"))
    # Every edge of a gap takes part in the digits of the greatest rank of the gap.
    most = x.groupBy(*gap).agg(F.max("rb").alias("most"))
    digits = x.join(most, gap).withColumn("digit", F.explode(F.expr("sequence(0, length(bin(most)) - 1)")))
    digits = digits.select(*gap, "ra", "digit", F.expr("shiftright(rb, digit + 1)").alias("before"), F.expr("shiftright(rb, digit) & 1").alias("one"))
    earlier = W.partitionBy(*gap, "digit", "before").orderBy("ra").rangeBetween(W.unboundedPreceding, -1)
    counted = digits.withColumn("n", F.when(F.col("one") == 0, F.coalesce(F.sum("one").over(earlier), F.lit(0))).otherwise(0))
    return counted.groupBy(*gap).agg(F.sum("n").alias("n_crossings")).where("n_crossings > 0")


def hubs(edges: DataFrame, k: int = 3) -> DataFrame:
    """The `k` nodes of each model with most neighbours, by name where equal."""
    n = undirected(edges).groupBy("model_id", F.col("u").alias("node")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("n"), "node"))).where(F.col("rank") <= k)
