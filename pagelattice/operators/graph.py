"""Generic operators over edge tables (g, src, dst): many graphs side by side, keyed by ``g``.

Degree-like measures are aggregates. Iterative ones loop over joins and write each round to the shared
folder. ``node_profiles`` is the one grouped-Python operator: per graph and block of its nodes it runs breadth-first
searches and emits sums, so the pairs of an all-pairs computation are never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.urls import hash_draw
from pagelattice.operators.hubs import VertexCut
from pagelattice.tables import bucketed, cut, written_at


#: Labels in use that are broadcast at most.
MOST_LABELS = 500_000


def endpoints(edges: DataFrame) -> DataFrame:
    """(g, node), each once."""
    return edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Simple undirected edges in both directions, without loops."""
    plain = edges.where("src <> dst").select("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return plain.select("g", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("g", "e.u", "e.v")


def degrees(edges: DataFrame) -> DataFrame:
    """(g, node, out_degree, in_degree, degree)."""
    ends = edges.select("g", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("g", F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(g, n, m, density): m / (n (n - 1)), 0 for under two nodes, six decimals."""
    counted = (endpoints(edges) if nodes is None else nodes.select("g", "node").distinct()).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.join(edges.groupBy("g").agg(F.count(F.lit(1)).alias("m")).hint("merge"), "g", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return sized.withColumn("density", F.when(F.col("n") > 1, F.bround(F.col("m") / (F.col("n") * (F.col("n") - 1)), 6)).otherwise(0.0))


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(g, node, component): the smallest node reachable in either direction.

    Labels move to neighbours and then to the label's own label (pointer jumping), until nothing changes. The labels'
    own labels, one row for each label in use, are broadcast up to ``MOST_LABELS``: no task gets a whole component.
    """
    links = cut(both_ways(edges), "links")
    every = endpoints(edges) if nodes is None else nodes.select("g", "node").distinct()
    labels = cut(every.withColumn("component", F.col("node")), "labels")
    for _ in range(max_rounds):
        offers = links.join(labels, (links["g"] == labels["g"]) & (links["u"] == labels["node"])).select(links["g"], F.col("v").alias("node"), "component")
        lowest = labels.unionByName(offers).groupBy("g", "node").agg(F.min("component").alias("component"))
        lowest = cut(lowest, "lowest")
        used = lowest.select("g", "component").distinct()
        up = cut(lowest.select("g", F.col("node").alias("component"), F.col("component").alias("jump")).join(used, ["g", "component"], "left_semi"), "jumps")
        if up.count() <= MOST_LABELS:
            up = F.broadcast(up)
        new = cut(lowest.join(up, ["g", "component"]).select("g", "node", F.col("jump").alias("component")), "labels")
        moved = new.join(labels.withColumnRenamed("component", "old"), ["g", "node"]).where("component <> old").isEmpty()
        labels = new
        if moved:
            return labels
    raise RuntimeError("components did not settle")


def component_summary(components: DataFrame) -> DataFrame:
    """(g, components, largest_ratio)."""
    sizes = components.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("g").agg(F.count(F.lit(1)).alias("components"), F.bround(F.max("n") / F.sum("n"), 4).alias("largest_ratio"))


def triangles(edges: DataFrame) -> DataFrame:
    """(g, node, neighbours, triangles) of the undirected simple graph.

    Each edge points from the end with fewer neighbours to the other, so a hub's wedges stay few.
    """
    links = both_ways(edges)
    near = links.groupBy("g", "u").agg(F.count(F.lit(1)).alias("k"))
    ranked = links.join(near.hint("merge"), ["g", "u"]).withColumnRenamed("k", "ku").join(near.select("g", F.col("u").alias("v"), F.col("k").alias("kv")).hint("merge"), ["g", "v"])
    out = cut(ranked.where(F.struct("ku", "u") < F.struct("kv", "v")).select("g", "u", "v"), "oriented")
    wedges = out.join(out.select("g", "u", F.col("v").alias("w")).hint("merge"), ["g", "u"]).where("v <> w")
    closed = wedges.join(out.select("g", F.col("u").alias("v"), F.col("v").alias("w")).hint("merge"), ["g", "v", "w"])
    corners = closed.select("g", F.explode(F.array("u", "v", "w")).alias("node")).groupBy("g", "node").agg(F.count(F.lit(1)).alias("triangles"))
    return near.withColumnsRenamed({"u": "node", "k": "neighbours"}).join(corners.hint("merge"), ["g", "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))


def clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(g, average_clustering, transitivity): mean local coefficient (0 for under two neighbours), and three times triangles over triads."""
    every = endpoints(edges) if nodes is None else nodes.select("g", "node").distinct()
    local = every.join(triangles(edges).hint("merge"), ["g", "node"], "left").fillna(0, ["neighbours", "triangles"])
    triads = F.col("neighbours") * (F.col("neighbours") - 1) / 2
    summed = local.groupBy("g").agg(F.avg(F.when(triads > 0, F.col("triangles") / triads).otherwise(0.0)).alias("c"), F.sum("triangles").alias("t"), F.sum(triads).alias("w"))
    return summed.select("g", F.bround("c", 4).alias("average_clustering"), F.bround(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0), 4).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """(g, assortativity): correlation over edges of out-degree at the source and in-degree at the target; 0 where undefined."""
    outs, ins = edges.groupBy("g", "src").agg(F.count(F.lit(1)).alias("x")), edges.groupBy("g", "dst").agg(F.count(F.lit(1)).alias("y"))
    joined = edges.select("g", "src", "dst").join(outs.hint("merge"), ["g", "src"]).join(ins.hint("merge"), ["g", "dst"])
    spread = F.sqrt(F.var_pop("x") * F.var_pop("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.nullif(spread, F.lit(0.0)))
    return joined.groupBy("g").agg(F.bround(F.coalesce(r, F.lit(0.0)), 4).alias("assortativity"))


def degree_connectivity(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(g, connectivity): mean over degree classes of summed successor degree over summed out-degree (total degrees)."""
    found = degrees(edges)
    reached = edges.select("g", "src", "dst").join(found.select("g", F.col("node").alias("dst"), F.col("degree").alias("far")).hint("merge"), ["g", "dst"]).groupBy("g", F.col("src").alias("node")).agg(F.sum("far").alias("far"))
    base = found if nodes is None else nodes.select("g", "node").distinct().join(found.hint("merge"), ["g", "node"], "left").fillna(0)
    classes = base.join(reached.hint("merge"), ["g", "node"], "left").groupBy("g", "degree").agg(F.sum(F.coalesce("far", F.lit(0))).alias("far"), F.sum("degree").alias("all"))
    per_class = F.when(F.col("all") > 0, F.col("far") / F.col("all")).otherwise(0.0)
    return classes.groupBy("g").agg(F.bround(F.avg(per_class), 4).alias("connectivity"))


class BitSearch:
    """Breadth-first search along edges from many sources at once, 64 to a long.

    ``names``: (g, chunk, members), where bit k of a chunk stands for the source members[k]; ``layers``: (g, node, chunk, bits, depth), the
    sources that reach a node first at that depth. Frontiers are merged by ``bit_or``; no (source, node) pair is shuffled. A layer is written
    each round, and all are read as one table, so the plan does not grow. Hubs' edges are dealt over slots.
    """

    def __init__(self, edges: DataFrame, sources: DataFrame, max_depth: int = 10_000):
        spark, self.names = edges.sparkSession, cut(_chunks(sources), "source_names")
        steps = VertexCut(edges.select("g", F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), ["g", "node"], ["next"])
        stepped = cut(steps.rows, "steps")
        front = cut(self.names.select("g", "chunk", F.posexplode("members").alias("bit", "node")).select("g", "node", "chunk", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth")), "layer")
        schema, paths = front.schema, [written_at(front)]
        for depth in range(1, max_depth):
            reached = steps.met(front.select("g", "node", "chunk", "bits"), stepped).select("g", F.col("next").alias("node"), "chunk", "bits", F.lit(0).cast("long").alias("known"))
            known = spark.read.schema(schema).parquet(*paths).select("g", "node", "chunk", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("known"))
            merged = reached.unionByName(known).groupBy("g", "node", "chunk").agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
            fresh = F.col("bits").bitwiseAND(F.bitwise_not("known"))
            front = cut(merged.select("g", "node", "chunk", fresh.alias("bits"), F.lit(depth).alias("depth")).where("bits <> 0"), "layer")
            if front.isEmpty():
                break
            paths.append(written_at(front))
        else:
            raise RuntimeError(f"nodes left after {max_depth - 1} levels")
        self.layers = spark.read.schema(schema).parquet(*paths)

    def distances(self) -> DataFrame:
        """(g, source, node, depth): a row for each pair, made where its bits are."""
        named = self.layers.join(self.names, ["g", "chunk"])
        held = F.expr("filter(members, (m, k) -> getbit(bits, k) = 1)")
        return named.select("g", F.explode(held).alias("source"), "node", "depth")

    def incoming(self, standing: DataFrame | None = None) -> DataFrame:
        """(g, node, total, reached): the sum of the distances from the sources that reach a node, and their number, itself left out.

        ``standing`` (g, node, many) tells of sources that stand for several.
        """
        far, count = self.layers.where("depth > 0"), F.bit_count("bits").cast("long")
        if standing is not None:
            named = self.names.select("g", "chunk", F.posexplode("members").alias("bit", "node")).join(standing, ["g", "node"], "left")
            weights = named.groupBy("g", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("bit", F.coalesce("many", F.lit(1).cast("long")).alias("many")))), lambda m: m["many"]).alias("weights"))
            far = far.join(weights.where("exists(weights, w -> w > 1)"), ["g", "chunk"], "left")
            summed = F.expr("aggregate(transform(weights, (w, k) -> w * getbit(bits, k)), 0L, (a, x) -> a + x)")
            count = F.when(F.col("weights").isNull(), count).otherwise(summed)
        return far.groupBy("g", "node").agg(F.sum(F.col("depth") * count).alias("total"), F.sum(count).alias("reached"))

    def outgoing(self, standing: DataFrame | None = None, by_depth: bool = False) -> DataFrame:
        """(g, source, reached): how many nodes a source reaches, itself left out; with ``by_depth`` a row for each depth that it
        reaches. A chunk's 64 bits are summed side by side. ``standing`` (g, node, many) tells of nodes that stand for several."""
        far, depth = self.layers.where("depth > 0"), ["depth"] if by_depth else []
        far = far.withColumn("many", F.lit(1).cast("long")) if standing is None else far.join(standing, ["g", "node"], "left").withColumn("many", F.coalesce("many", F.lit(1).cast("long")))
        far = far.groupBy("g", "chunk", *depth).agg(*(F.sum(F.expr(f"getbit(bits, {k}) * many")).alias(f"b{k}") for k in range(64)))
        counts = self.names.join(far, ["g", "chunk"], "inner" if by_depth else "left").select("g", "members", *depth, F.array(*(F.coalesce(f"b{k}", F.lit(0).cast("long")) for k in range(64))).alias("n"))
        counts = counts.select("g", *depth, F.posexplode("members").alias("bit", "source"), "n").select("g", "source", *depth, F.col("n")[F.col("bit")].alias("reached"))
        return counts.where("reached > 0") if by_depth else counts


#: Neighbours of a node at most that is merged with its twins.
TWIN_NEIGHBOURS = 16


def twins(links: DataFrame) -> DataFrame:
    """(g, node, twin) of nodes with edges in one direction only that have the same few neighbours as others: ``twin`` is the least of them.

    ``links`` holds each edge once. No way leads from one twin to another, and all have the same distances to and from other nodes.
    """
    ends = links.select("g", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near"), F.lit(0).alias("out")))).alias("e")).select("g", "e.*")
    few = ends.groupBy("g", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("o")).where(f"n <= {TWIN_NEIGHBOURS} and o in (0, n)")
    keyed = cut(ends.join(few.select("g", "node"), ["g", "node"], "left_semi").groupBy("g", "node").agg(F.max("out").alias("out"), F.sort_array(F.collect_list("near")).alias("near")), "few_neighbours")
    classes = keyed.groupBy("g", "out", "near").agg(F.min("node").alias("twin"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return keyed.join(classes, ["g", "out", "near"]).select("g", "node", "twin")


class TwinSearch:
    """A ``BitSearch`` in which one node stands for all its twins; what it finds is counted by how many each stands for.

    ``sources``: (g, node, twin), each with the source that is searched from.
    """

    def __init__(self, edges: DataFrame, sources: DataFrame):
        links = cut(edges.select("g", "src", "dst").distinct(), "links")
        self.twins = cut(twins(links), "twins")
        self.merged = not self.twins.isEmpty()
        self.sources = cut(self.placed(sources.select("g", "node").distinct()), "sources")
        starts = self.sources.select("g", F.col("twin").alias("node")).distinct()
        if self.merged:
            left_out = self.twins.where("node <> twin")
            for end in ("src", "dst"):
                links = links.join(left_out.select("g", F.col("node").alias(end)), ["g", end], "left_anti")
            links = cut(links.select("g", "src", "dst"), "links")
        starts = starts.join(links.select("g", F.col("src").alias("node")), ["g", "node"], "left_semi")
        self.found = BitSearch(links, starts)

    def placed(self, nodes: DataFrame) -> DataFrame:
        """(g, node, twin) of all ``nodes``."""
        return nodes.join(self.twins, ["g", "node"], "left").select("g", "node", F.coalesce("twin", "node").alias("twin"))

    def _standing(self, members: DataFrame) -> DataFrame | None:
        return members.groupBy("g", F.col("twin").alias("node")).agg(F.count(F.lit(1)).alias("many")).where("many > 1") if self.merged else None

    def incoming(self) -> DataFrame:
        """(g, twin, total, reached), as ``BitSearch`` has it by node."""
        return self.found.incoming(self._standing(self.sources)).withColumnRenamed("node", "twin")

    def outgoing(self, by_depth: bool = False) -> DataFrame:
        """(g, twin, reached), as ``BitSearch`` has it by source; with ``by_depth`` for each depth."""
        return self.found.outgoing(self._standing(self.twins), by_depth).withColumnRenamed("source", "twin")


#: Sources that one task puts into chunks.
CHUNK_SLOT = 6400


def _chunks(sources: DataFrame) -> DataFrame:
    """(g, chunk, members): sources of a graph in chunks of at most 64."""
    each = sources.select("g", F.col("node").alias("source")).distinct()
    sized = each.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SLOT).cast("long").alias("slots"))
    dealt = each.join(sized, "g").withColumn("slot", F.pmod(F.xxhash64("source"), F.col("slots")))
    row = F.row_number().over(Window.partitionBy("g", "slot").orderBy("source")) - 1
    placed = dealt.withColumn("row", row).withColumn("chunk", F.col("slot") + F.col("slots") * F.floor(F.col("row") / 64))
    return placed.groupBy("g", "chunk").agg(F.sort_array(F.collect_list("source")).alias("members"))


def bfs_depths(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(g, source, node, depth): hops along edges from each (g, node) of ``sources``, itself included."""
    return BitSearch(edges, sources, max_depth).distances()


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, source, node): descendants of each source, itself left out."""
    return bfs_depths(edges, sources).where("depth > 0").select("g", "source", "node")


def depth_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, source, depth, nodes): how many nodes each source reaches first at a depth, itself at 0; no pair is made."""
    search = TwinSearch(edges, sources)
    far = search.sources.join(search.outgoing(by_depth=True), ["g", "twin"]).select("g", F.col("node").alias("source"), "depth", F.col("reached").alias("nodes"))
    return search.sources.select("g", F.col("node").alias("source"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("nodes")).unionByName(far)


def descendant_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, source, descendants) of each source, itself left out; no pair is made."""
    search = TwinSearch(edges, sources)
    return search.sources.join(search.outgoing(), ["g", "twin"], "left").select("g", F.col("node").alias("source"), F.coalesce("reached", F.lit(0).cast("long")).alias("descendants"))


def reach_sums(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, total, ancestors, descendants) from one search out of all ``nodes``: the sum of the distances to a node, how many reach
    it and how many it reaches."""
    search = TwinSearch(edges, nodes)
    joined = search.sources.join(search.incoming(), ["g", "twin"], "left").join(search.outgoing().withColumnRenamed("reached", "descendants"), ["g", "twin"], "left")
    return joined.select("g", "node", "total", F.coalesce("reached", F.lit(0).cast("long")).alias("ancestors"), F.coalesce("descendants", F.lit(0).cast("long")).alias("descendants"))


def closeness_of(sums: DataFrame) -> DataFrame:
    """(g, node, closeness) from ``reach_sums`` of all nodes: incoming, scaled by the share of nodes that reach the node."""
    sizes = sums.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("total") > 0, (F.col("ancestors") / F.col("total")) * (F.col("ancestors") / (F.col("n") - 1))).otherwise(0.0)
    return sums.join(sizes, "g").select("g", "node", value.alias("closeness"))


def closeness(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, closeness) from pairs that are there already: directed distances (g, source, node, depth)."""
    far = distances.where("depth > 0")
    incoming = far.groupBy("g", "node").agg(F.sum("depth").alias("total"), F.count(F.lit(1)).alias("ancestors"))
    return closeness_of(nodes.select("g", "node").join(incoming, ["g", "node"], "left"))


def reach_counts(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, ancestors, descendants) from directed distances that are there already."""
    far = distances.where("depth > 0")
    up = far.groupBy("g", "node").agg(F.count(F.lit(1)).alias("ancestors"))
    down = far.groupBy("g", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("descendants"))
    return nodes.select("g", "node").join(up, ["g", "node"], "left").join(down, ["g", "node"], "left").fillna(0, ["ancestors", "descendants"])


def _jumped(rows: DataFrame) -> DataFrame:
    """Each row (g, at, to, steps, lo) taken on to where the row of its ``to`` leads; ``to`` is null once there is no such row."""
    ahead = rows.select("g", F.col("at").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"), F.col("lo").alias("lower"))
    met = VertexCut(rows.where("to is not null"), ["g", "to"], ["at"])
    # Nodes without a successor have no row of their own: there the way ends.
    ends = rows.where("to is not null").join(ahead.select("g", "to").hint("merge"), ["g", "to"], "left_anti").select("g", "at", F.lit(None).cast("string").alias("to"), "steps", "lo")
    moved = met.met(ahead).select("g", "at", F.col("then").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("lo", "lower").alias("lo"))
    return rows.where("to is null").unionByName(moved).unionByName(ends)


def chain_depths(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(g, depth): longest walk along each node's first successor (by ``ord``) until a node repeats.

    Pointer doubling on the functional graph: a round doubles how far every row sees, so the rounds are the logarithm of the nodes. What then still
    leads somewhere leads to a cycle; a walk's depth is its way to the cycle and the cycle's length, or its way to the end.
    """
    first = cut(edges.groupBy("g", F.col("src").alias("at")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("to")), "first")
    largest = first.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if not largest:
        return first.select("g", F.lit(0).alias("depth"))

    def followed(rows: DataFrame, far: int) -> DataFrame:
        """Rows jumped until none leads on or all see at least ``far`` steps."""
        rows, sees = cut(rows, "jumps"), 1
        for _ in range(max_rounds):
            if sees >= far or rows.where("to is not null").isEmpty():
                return rows
            rows, sees = cut(_jumped(rows), "jumps"), 2 * sees
        raise RuntimeError(f"walks left after {max_rounds} rounds")

    one = F.lit(1).cast("long").alias("steps")
    # The last row of a walk without a cycle needs one more step to find that nothing follows.
    seen = followed(first.select("g", "at", "to", one, F.col("at").alias("lo")), 2 * largest + 2)
    ended = seen.where("to is null").select("g", "steps")
    cyclic = seen.where("to is not null")
    on_cycle = cut(cyclic.select("g", F.col("to").alias("at")).distinct().join(cyclic.select("g", "at", "lo").hint("merge"), ["g", "at"]), "on_cycle")
    depths = ended
    if not on_cycle.isEmpty():
        nothing, none = F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("steps")
        ways = first.join(cyclic.select("g", "at").hint("merge"), ["g", "at"], "left_semi").join(on_cycle.select("g", "at").hint("merge"), ["g", "at"], "left_anti")
        tails = followed(ways.select("g", "at", "to", one, F.col("at").alias("lo")).unionByName(on_cycle.select("g", "at", nothing, none, F.col("at").alias("lo"))), 2 * largest + 2)
        # Walks into one cycle share its least node, which only those on the cycle know: they pass it on by where they lead.
        sizes = on_cycle.groupBy("g", "lo").agg(F.count(F.lit(1)).alias("size"))
        cycle = cyclic.select("g", "at", F.col("to").alias("met")).join(on_cycle.select("g", F.col("at").alias("met"), "lo").hint("merge"), ["g", "met"]).join(sizes.hint("merge"), ["g", "lo"]).select("g", "at", "size")
        depths = depths.unionByName(tails.select("g", "at", "steps").join(cycle.hint("merge"), ["g", "at"]).select("g", (F.col("steps") + F.col("size")).alias("steps")))
    return depths.groupBy("g").agg(F.max("steps").cast("int").alias("depth"))


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """(g, tail, rank, next, next_n): undirected neighbours of each node, numbered from 0 in order of slot and name, and how many neighbours
    each of them has. A hub's neighbours are numbered slot by slot."""
    split = VertexCut(cut(both_ways(edges), "links"), ["g", "u"], ["v"])
    rows = cut(split.rows, "near")
    by_slot = rows.groupBy("g", "u", "slot").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("g", "u").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_slot.withColumn("before", before)
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("g", "u", "slot").orderBy("v")) - 1).join(offsets.select("g", "u", "slot", "before"), ["g", "u", "slot"])
    degree = by_slot.groupBy("g", "u").agg(F.sum("k").alias("next_n"))
    # Both directions are there, so a neighbour's own rows are dealt by the same cut.
    turned = split.placed(numbered.drop("slot"), ["u"], {"u": "v"}) if split.any else numbered
    far = split.mirrored(degree).withColumnRenamed("u", "v")
    return turned.join(far, ["g", "v", "slot"]).select("g", F.col("u").alias("tail"), (F.col("row") + F.col("before")).cast("long").alias("rank"), F.col("v").alias("next"), "next_n")


#: Neighbours of a node in one row of ``packed_neighbours``, and in one of its buckets, about; steps of a walk that a row carries at most.
PACKED, BUCKET, CARRIED = 1024, 500_000, 8


def packed_neighbours(edges: DataFrame) -> DataFrame:
    """(g, tail, part, near): ``ranked_neighbours`` by rank in arrays of (next, next_n), a row for each ``PACKED`` ranks, bucketed by node and part."""
    ranked = cut(ranked_neighbours(edges), "ranked")
    buckets = -(-ranked.count() // BUCKET)
    packed = ranked.groupBy("g", "tail", F.floor(F.col("rank") / PACKED).alias("part")).agg(F.sort_array(F.collect_list(F.struct("rank", "next", "next_n"))).alias("near"))
    return bucketed(packed.select("g", "tail", "part", F.transform("near", lambda e: F.struct(e["next"].alias("next"), e["next_n"].alias("next_n"))).alias("near")), "near", ["g", "tail", "part"], buckets)


#: Neighbours, both directions counted, of the largest graph that a task holds whole for walks: four bytes each, while they are put in order twenty.
WHOLE = 1 << 25


def random_walks(edges: DataFrame, nodes: DataFrame, num: int = 10, length: int = 40, seed: int = 42) -> DataFrame:
    """(g, start, walk_no, walk): uniform walks over undirected neighbours, repeatable for a seed.

    The step's choice is a hash of (seed, walk, step) modulo the number of neighbours, which are in order of their names; dead ends stop. Walks of a graph
    of at most ``WHOLE`` neighbours are made by tasks that hold its neighbours as numbers, so that no walk is shuffled or written on its way; larger graphs
    are walked step by step (``walks_by_steps``).
    """
    plain = edges.where("src <> dst").select("g", "src", "dst")
    ids = cut(numbered(endpoints(plain)), "numbered")
    one_way = coded_edges(plain, ids).select("g", F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).distinct()
    ends = F.array(F.struct(F.col("a").alias("src_id"), F.col("b").alias("dst_id")), F.struct(F.col("b").alias("src_id"), F.col("a").alias("dst_id")))
    links = cut(one_way.select("g", F.explode(ends).alias("e")).select("g", "e.*"), "both_ways")
    sizes = cut(links.groupBy("g").agg(F.count(F.lit(1)).alias("m")).join(ids.groupBy("g").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "g"), "walk_sizes")
    # Each of them has so many neighbours that they are few.
    large = [r.g for r in sizes.where(F.col("m") > WHOLE).collect()]
    inside = ~F.col("g").isin(large) if large else F.lit(True)
    found = _walks_within(ids.where(inside), links.where(inside), sizes.where(inside), nodes.where(inside), num, length, seed)
    return found.unionByName(walks_by_steps(edges.where(~inside), nodes.where(~inside), num, length, seed)) if large else found


def _walks_within(ids: DataFrame, links: DataFrame, sizes: DataFrame, nodes: DataFrame, num: int, length: int, seed: int) -> DataFrame:
    """``random_walks`` of graphs that a task can hold: ``ids`` (g, node, id) of nodes with neighbours, ``links`` (g, src_id, dst_id) in both directions, ``sizes`` (g, n, m)."""
    share, tasks = shares(sizes.select("g", F.col("n").alias("most"), F.col("n").cast("double").alias("work")))
    named = ids.groupBy("g", F.floor(F.col("id") / PACKED_NODES).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "node"))).alias("each"))
    nothing = {"codes": F.lit(None).cast("array<long>"), "names": F.lit(None).cast("array<string>"), "at": F.lit(None).cast("long")}
    rows = lambda df, kind, **known: df.select("g", F.lit(kind).alias("kind"), *[known.get(c, v).alias(c) for c, v in nothing.items()], "task")
    each_task = F.explode(F.sequence(F.lit(0), share - 1))
    first = rows(named.withColumn("task", each_task), 0, codes=F.transform("each", lambda e: e["id"]), names=F.transform("each", lambda e: e["node"]))
    second = rows(_packed_links(links, F.shiftleft("src_id", 32) + F.col("dst_id")).withColumn("task", each_task), 1, codes=F.col("codes"))
    starts = nodes.select("g", "node").distinct().join(ids.select("g", "node", "id").hint("shuffle_hash"), ["g", "node"], "left")
    third = rows(starts.where("id is not null").withColumn("task", F.pmod(F.xxhash64("id"), share).cast("int")), 2, at=F.col("id"))
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    dealt = first.unionByName(second).unionByName(third).repartition(parts, "g", "task").sortWithinPartitions("g", "task", "kind", "at")

    def walked(graph: tuple, g: int, starts: np.ndarray):
        """Batches of all walks from ``starts``; draws are those of ``hash_draw``."""
        from hashlib import md5

        names, first, near = graph
        for k in range(0, len(starts), 500):
            at = np.repeat(starts[k : k + 500], num)
            number = np.tile(np.arange(num), len(at) // num)
            tails = [f":{name}:{no}".encode() for name in names.take(pa.array(starts[k : k + 500])).to_pylist() for no in range(num)]
            walk = np.empty((len(at), length), np.int64)
            walk[:, 0] = at
            for step in range(1, length):
                head = f"{seed}:{step}".encode()
                draw = np.frombuffer(b"".join([md5(head + tail, usedforsecurity=False).digest() for tail in tails]), ">u4")[::4].astype(np.int64)
                here = walk[:, step - 1]
                walk[:, step] = near[first[here] + draw % (first[here + 1] - first[here])]
            nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, walk.size + 1, length, dtype=np.int32)), names.take(pa.array(walk.ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), names.take(pa.array(at)), pa.array(number.astype(np.int32)), nodes], ["g", "start", "walk_no", "walk"])

    def held(names: list, codes: list) -> tuple:
        """Names, and neighbours in order of their ids with where those of each node begin."""
        whole = np.sort(np.concatenate(codes))
        codes.clear()
        order = np.argsort([ids[0] for ids, _ in names])
        named = pa.concat_arrays([names[k][1] for k in order])
        first = np.searchsorted(whole, np.arange(len(named) + 1, dtype=np.int64) << 32)
        return named, first, (whole & 0x7FFFFFFF).astype(np.int32)

    def walk(batches):
        place, names, codes, graph = None, [], [], None
        for batch in batches:
            gs, of, kinds = (batch.column(c).to_numpy() for c in ("g", "task", "kind"))
            cuts = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1]), True]) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if place != (gs[a], of[a]):
                    place, names, codes, graph = (gs[a], of[a]), [], [], None
                part = batch.slice(a, b - a)
                if kinds[a] < 2:
                    each = [part.column("codes")[k].values.to_numpy(zero_copy_only=False).copy() for k in range(b - a)]
                    if kinds[a] == 1:
                        codes += each
                    else:
                        names += [(ids, pa.concat_arrays([part.column("names")[k].values])) for k, ids in enumerate(each)]
                    continue
                if graph is None:
                    graph = held(names, codes)
                yield from walked(graph, int(gs[a]), part.column("at").to_numpy())

    found = dealt.mapInArrow(walk, "g long, start string, walk_no int, walk array<string>")
    stuck = starts.where("id is null").select("g", F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("walk_no"), F.array("node").alias("walk"))
    return found.unionByName(stuck)


def walks_by_steps(edges: DataFrame, nodes: DataFrame, num: int, length: int, seed: int) -> DataFrame:
    """``random_walks`` of graphs of any size.

    A step sends each walk to the packed
    row that holds the neighbour it has drawn, which also tells how many neighbours come next: walks at a hub are spread over its rows.
    The neighbours stay where they lie, and a task holds those of one bucket. Every ``CARRIED`` steps a walk leaves the nodes it has met behind; they are put together at the end.
    """
    near = packed_neighbours(edges)
    degree = near.groupBy("g", F.col("tail").alias("start")).agg(F.sum(F.size("near")).alias("n"))
    starts = nodes.select("g", F.col("node").alias("start")).distinct().join(degree.hint("merge"), ["g", "start"], "left")
    key = ["g", "start", "walk_no"]
    walks = cut(starts.select("g", "start", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("walk_no"), F.col("start").alias("tail"), "n", F.array("start").alias("walk")), "walks")
    stuck, pieces = walks.where("n is null").select(*key, "walk"), []
    walks = walks.where("n is not null")
    for step in range(1, length):
        # Never null, so that the join needs no filter that draws once more.
        rank = F.coalesce(F.pmod(hash_draw(F.lit(seed), F.lit(step), F.col("start"), F.col("walk_no")), F.col("n")), F.lit(0))
        drawn = walks.withColumn("rank", rank).withColumn("part", F.floor(F.col("rank") / PACKED)).withColumn("at", (F.col("rank") % PACKED).cast("int")).drop("rank", "n")
        met = drawn.join(near.hint("shuffle_hash"), ["g", "tail", "part"]).select(*key, "walk", F.col("near")[F.col("at")].alias("next"))
        walks = met.select(*key, F.col("next.next").alias("tail"), F.col("next.next_n").alias("n"), F.concat("walk", F.array("next.next")).alias("walk"))
        if step % CARRIED == 0:
            walks = cut(walks, "walks")
            pieces.append(walks.select(*key, F.col("walk").alias(f"walk{len(pieces)}")))
            walks = walks.withColumn("walk", F.array().cast("array<string>"))
    whole = walks.select(*key, "walk")
    for piece in pieces:
        whole = whole.join(piece.hint("merge"), key)
    return whole.select(*key, F.concat(*[f"walk{k}" for k in range(len(pieces))], "walk").alias("walk")).unionByName(stuck)


def deepwalk(walks: DataFrame, dim: int = 128, window: int = 5, epochs: int = 5, seed: int = 42, block: int | None = None) -> DataFrame:
    """(word, vector): skip-gram vectors of the walks' nodes, trained block by block on the executors."""
    from pagelattice.operators import embeddings

    # Read twice: as pairs and as nodes.
    return embeddings.skip_gram(cut(walks.select("walk"), "walks"), dim=dim, window=window, epochs=epochs, seed=seed, block=block or embeddings.BLOCK)


FOUND_SCHEMA = """g long, id long, component long, sum_in long, n_in long, n_out long, eccentricity long, sum_undirected long,
    root_depth long, structure_depth long, from_forms boolean, from_inputs boolean, from_scripts boolean, from_storage boolean,
    from_redirects boolean, form_depth long, script_sum long, script_n long, exfil long"""
_SUMMED = ("sum_in", "n_in", "n_out", "script_sum", "script_n")
_OF_STARTS = ("eccentricity", "sum_undirected", "form_depth", "exfil")
_FLAGS = ("is_root", "is_form", "is_input", "is_script", "is_storage", "is_request", "is_redirect")
_REACHED_FROM = {"from_forms": "is_form", "from_inputs": "is_input", "from_scripts": "is_script", "from_storage": "is_storage", "from_redirects": "is_redirect"}


def search(starts, steps) -> dict[str, int]:
    """Hops from the nearest of ``starts`` to each node that they reach."""
    depth = dict.fromkeys(starts, 0)
    queue = list(depth)
    for at in queue:
        for to in steps.get(at, ()):
            if to not in depth:
                depth[to] = depth[at] + 1
                queue.append(to)
    return depth


#: Words (of 64 starts) times nodes that a search holds at once, about; words times edges that it follows at once.
HELD_WORDS, FOLLOWED_WORDS = 1 << 21, 1 << 22


class Steps:
    """Edges of one graph of nodes 0 to ``n`` - 1 by the node that they leave and by the one that they enter, for searches from many nodes at once: a bit for each start."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, self.out, self.into = n, self._by(src, src, dst), self._by(dst, src, dst)
        self.first = np.searchsorted(self.out[0], np.arange(n + 1))

    @staticmethod
    def _by(key: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return src[order].astype(np.int32, copy=False), dst[order].astype(np.int32, copy=False)

    def _met(self, front: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes after those ``at``, and the bits of ``front`` that come to them; a bounded number of edges is followed at once."""
        many = self.first[at + 1] - self.first[at]
        if 4 * many.sum() >= len(self.into[0]):
            src, dst = self.into
        else:
            edge = np.repeat(self.first[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            order = np.argsort(self.out[1][edge], kind="stable")
            src, dst = self.out[0][edge][order], self.out[1][edge][order]
        begin = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]][: len(dst)])
        bits, width = np.zeros((len(front), len(begin)), np.uint64), max(1, FOLLOWED_WORDS // len(front))
        for k in range(0, len(dst), width):
            here = np.searchsorted(begin, k, "right") - 1
            inside = np.r_[0, begin[here + 1 : np.searchsorted(begin, k + width)] - k]
            bits[:, here : here + len(inside)] |= np.bitwise_or.reduceat(np.take(front, src[k : k + width], axis=1), inside, axis=1)
        return dst[begin], bits

    def levels(self, starts: np.ndarray, together: bool = False):
        """(depth, nodes, bits): the nodes first reached at each depth from 1, and which of ``starts`` reach them: column k of the bits, which
        has bit j of word i for starts[64 * i + j], belongs to nodes[k]. ``together``: all starts share a bit."""
        bit = np.zeros(len(starts), np.int64) if together else np.arange(len(starts))
        front = np.zeros((max(1, int(bit[-1]) // 64 + 1 if len(bit) else 1), self.n), np.uint64)
        np.bitwise_or.at(front, (bit // 64, starts), np.uint64(1) << (bit % 64).astype(np.uint64))
        seen, at, depth = front.copy(), np.unique(starts), 0
        while len(at):
            depth += 1
            reached, bits = self._met(front, at)
            fresh = bits & ~seen[:, reached]
            some = fresh.any(0)
            front[:, at] = 0
            at, fresh = reached[some], fresh[:, some]
            seen[:, at] |= fresh
            front[:, at] = fresh
            if len(at):
                yield depth, at, fresh

    def depths(self, starts: np.ndarray) -> np.ndarray:
        """Hops from the nearest of ``starts`` to each node, -1 where none leads."""
        found = np.full(self.n, -1, np.int64)
        found[starts] = 0
        for depth, at, _ in self.levels(starts, together=True):
            found[at] = depth
        return found


def _bits(words: np.ndarray, many: int) -> np.ndarray:
    """A row of ``many`` zeros and ones for each column of ``words``."""
    return np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8), axis=1, bitorder="little")[:, :many]


def _counts(words: np.ndarray, many: int) -> np.ndarray:
    """How many columns have each of the first ``many`` bits."""
    if words.size <= 1 << 12:
        return _bits(words, many).sum(0, dtype=np.int64)
    found = np.zeros((len(words), 64), np.int64)
    for w, row in enumerate(words):
        row = row[row != 0]
        for k in range(0, len(row), 255 << 8):
            each = np.unpackbits(row[k : k + (255 << 8)].view(np.uint8), bitorder="little").reshape(-1, 64)
            whole = len(each) // 255 * 255
            found[w] += each[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + each[whole:].sum(0, dtype=np.int64)
    return found.ravel()[:many]


def least_linked(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of each node's weak component."""
    least = np.arange(n)
    while True:
        a, b = least[src], least[dst]
        apart = a != b
        if not apart.any():
            return least
        np.minimum.at(least, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(further := least[least], least):
            least = further


_NONE = np.iinfo(np.int64).max


class Searches:
    """Searches from all nodes of one graph, whose nodes are numbers in the order of their names.

    Starts are taken in the order of components and of the distance to their first nodes (``order``), so that those searched from at once meet the same nodes.
    """

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, structure: np.ndarray, flags: dict[str, np.ndarray]):
        self.n, self.flags = n, flags
        self.steps, self.around, self.grown = Steps(n, src, dst), Steps(n, np.r_[src, dst], np.r_[dst, src]), Steps(n, src[structure], dst[structure])
        self.component = least_linked(n, src, dst)
        sizes = np.bincount(self.component, minlength=n)
        self.wide = self.component == np.flatnonzero(sizes == sizes.max())[-1]
        self.order = np.lexsort((self.around.depths(np.flatnonzero(self.component == np.arange(n))), self.component))
        self.roots = np.flatnonzero(flags["is_root"])[:1]
        self.from_root, self.request_gap = self.steps.depths(self.roots), Steps(n, dst, src).depths(np.flatnonzero(flags["is_request"]))

    def nothing(self) -> dict[str, np.ndarray]:
        """What is found about each node, before any search; -1 is null."""
        return {name: np.zeros(self.n, np.int64) for name in _SUMMED} | {name: np.full(self.n, -1, np.int64) for name in _OF_STARTS}

    def find(self, begin: int, end: int, held: dict[str, np.ndarray]) -> None:
        """Adds what the searches from ``order[begin:end]`` find, a bounded number at once."""
        width = 64 * max(1, HELD_WORDS // max(1, self.n) if self.n > 1024 else 16)
        for k in range(begin, end, width):
            self._find(self.order[k : min(k + width, end)], held)

    def _find(self, starts: np.ndarray, held: dict[str, np.ndarray]) -> None:
        many, is_input = len(starts), self.flags["is_input"]
        script, form = self.flags["is_script"][starts], np.flatnonzero(self.flags["is_form"][starts])
        scripts = np.packbits(np.r_[script, np.zeros(-many % 64, bool)], bitorder="little").view(np.uint64)[:, None]
        any_input, gap = is_input[starts].copy(), self.request_gap[starts]
        way = np.where(any_input & (gap >= 0), gap, _NONE)
        held["script_n"][starts] += script & any_input
        for depth, at, fresh in self.steps.levels(starts):
            count = np.bitwise_count(fresh).sum(0, dtype=np.int64)
            held["n_in"][at] += count
            held["sum_in"][at] += depth * count
            held["n_out"][starts] += _counts(fresh, many)
            inputs = is_input[at]
            if inputs.any():
                met, met_at = fresh[:, inputs], at[inputs]
                by_script = np.bitwise_count(met & scripts).sum(0, dtype=np.int64)
                held["script_n"][met_at] += by_script
                held["script_sum"][met_at] += depth * by_script
                gaps = self.request_gap[met_at]
                order = np.argsort(gaps, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(gaps[order]) > 0])
                each = _bits(np.bitwise_or.reduceat(met[:, order], first, axis=1), many)
                gaps = gaps[order][first]
                any_input |= each.any(0)
                if (gaps >= 0).any():
                    way = np.minimum(way, np.where(each[gaps >= 0] > 0, depth + gaps[gaps >= 0][:, None], _NONE).min(0))
        wide = starts[self.wide[starts]]
        if len(wide):
            far, total = np.zeros(len(wide), np.int64), np.zeros(len(wide), np.int64)
            for depth, _, fresh in self.around.levels(wide):
                count = _counts(fresh, len(wide))
                far[count > 0] = depth
                total += depth * count
            held["eccentricity"][wide], held["sum_undirected"][wide] = far, total
        if len(form):
            deep = np.zeros(len(form), np.int64)
            for depth, _, fresh in self.grown.levels(starts[form]):
                deep[_bits(np.bitwise_or.reduce(fresh, axis=1)[:, None], len(form))[0] > 0] = depth
            held["form_depth"][starts[form]] = deep
            path = np.minimum(way, np.where(any_input & (gap >= 0), gap, _NONE))[form]
            root = self.from_root[starts[form]]
            held["exfil"][starts[form]] = np.where((path < _NONE) & (root >= 0), root + np.where(path < _NONE, path, 0), -1)

    def once(self) -> dict[str, np.ndarray]:
        """What depends on no block of starts; -1 is null, other than in the flags."""
        reached = {name: self.steps.depths(np.flatnonzero(self.flags[f])) >= 0 for name, f in _REACHED_FROM.items()}
        return {"root_depth": self.from_root, "structure_depth": self.grown.depths(self.roots)} | reached


class GraphProfile:
    """``Searches`` of one graph given as rows of nodes and edges, by the nodes' names."""

    def __init__(self, members: list[dict], links: list[dict]):
        kinds = {m["node"]: m for m in members}
        self.names = sorted(kinds)
        at = {n: k for k, n in enumerate(self.names)}
        src, dst = (np.array([at[e[end]] for e in links], np.int64) for end in ("src", "dst"))
        flags = {f: np.array([bool(kinds[n][f]) for n in self.names], bool) for f in _FLAGS}
        self.found = Searches(len(self.names), src, dst, np.array([bool(e["structure"]) for e in links], bool), flags)

    def block(self, nth: int, size: int) -> dict[str, dict]:
        """What the searches from one block of nodes add to each node; block 0 also has what depends on no block."""
        held = self.found.nothing()
        self.found.find(nth * size, min((nth + 1) * size, len(self.names)), held)
        rows = {}
        for k, name in enumerate(self.names):
            mine = {c: int(held[c][k]) for c in _SUMMED} | {c: int(held[c][k]) for c in _OF_STARTS if held[c][k] >= 0}
            if nth == 0 or any(mine.values()):
                rows[name] = mine | {"component": self.names[self.found.component[k]]}
        if nth == 0:
            for c, values in self.found.once().items():
                for k, name in enumerate(self.names):
                    rows[name][c] = bool(values[k]) if values.dtype == bool else int(values[k]) if values[k] >= 0 else None
        return rows


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, node, ...) with ``id``: their places from 0 in their graph in the order of their names. A graph's nodes are dealt over tasks by ranges of names."""
    dealt = cut(nodes.repartitionByRange("g", "node").withColumn("part", F.spark_partition_id()), "by_name")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("k")).withColumn("before", before).select("g", "part", "before")
    row = F.row_number().over(Window.partitionBy("g", "part").orderBy("node")) - 1
    return dealt.withColumn("row", row).join(offsets.hint("merge"), ["g", "part"]).withColumn("id", F.col("row") + F.col("before")).drop("part", "row", "before")


#: Nodes of a graph in one packed row, and nodes whose outgoing edges are packed together; tasks for each core that large graphs are dealt over.
PACKED_NODES, PACKED_SOURCES, DEALT = 1 << 16, 1 << 12, 4


def shares(sizes: DataFrame) -> tuple[Column, int]:
    """Over how many tasks each graph is dealt by its share of all ``work``, ``most`` at most, and how many tasks there are about; ``sizes``: g, most, work."""
    tasks = DEALT * sizes.sparkSession.sparkContext.defaultParallelism
    sizes = cut(sizes, "graph_sizes")
    whole, share = sizes.agg(F.sum("work")).first()[0] or 0.0, F.lit(1)
    # Graphs of more than one task are no more than there are tasks.
    for r in sizes.where(F.col("work") * tasks > whole).collect():
        share = F.when(F.col("g") == r.g, min(r.most, math.ceil(tasks * r.work / whole))).otherwise(share)
    return share, tasks


def packed_graphs(ids: DataFrame, coded: DataFrame) -> DataFrame:
    """(g, kind, codes): nodes (kind 0) as id and flags and edges (kind 1) as both ends and structure, a long each, in rows of bounded size."""
    kinds = sum((F.coalesce(flag, F.lit(False)).cast("long") * (1 << k) for k, flag in enumerate(_FLAGS)), F.lit(0).cast("long"))
    members = ids.groupBy("g", F.floor(F.col("id") / PACKED_NODES).alias("part")).agg(F.collect_list(F.shiftleft("id", len(_FLAGS)) + kinds).alias("codes"))
    edge = F.shiftleft("src_id", 32) + F.shiftleft("dst_id", 1) + F.col("structure")
    return members.select("g", F.lit(0).alias("kind"), "codes").unionByName(_packed_links(coded, edge).withColumn("kind", F.lit(1)))


def _packed_links(coded: DataFrame, code: Column) -> DataFrame:
    """(g, codes): the codes of edges (g, src_id, dst_id) in rows of bounded size."""
    return coded.groupBy("g", F.floor(F.col("src_id") / PACKED_SOURCES).alias("part"), F.floor(F.col("dst_id") / PACKED_NODES).alias("over")).agg(F.sort_array(F.collect_list(code)).alias("codes")).select("g", "codes")


def coded_edges(edges: DataFrame, ids: DataFrame, *also: Column) -> DataFrame:
    """(g, src_id, dst_id, ...): edges (g, src, dst) by the ids of their ends."""
    ends = [ids.select("g", F.col("node").alias(end), F.col("id").alias(f"{end}_id")).hint("merge") for end in ("src", "dst")]
    return edges.join(ends[0], ["g", "src"]).join(ends[1], ["g", "dst"]).select("g", "src_id", "dst_id", *also)


def node_profiles(nodes: DataFrame, edges: DataFrame, block: int = 256) -> DataFrame:
    """One row a node, from breadth-first searches inside each graph.

    ``nodes``: g, node, is_root, is_form, is_input, is_script, is_storage, is_request, is_redirect; ``edges``: g, src, dst,
    structure. Distances are directed but for eccentricity and sum_undirected, which are taken within the largest weak component;
    ``component`` is the smallest node of a node's own. Nodes are numbered; a task holds the edges of a graph as pairs of numbers, a long each, and searches from
    its share of the graph's blocks of ``block`` nodes. A graph is dealt over as many tasks as its share of all work asks for. What they add to a node is summed afterwards.
    """
    spark = nodes.sparkSession
    ids = cut(numbered(nodes), "numbered")
    coded = cut(coded_edges(edges, ids, F.coalesce("structure", F.lit(False)).cast("long").alias("structure")), "coded")
    packed = packed_graphs(ids, coded)

    sizes = ids.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(coded.groupBy("g").agg(F.count(F.lit(1)).alias("m")).hint("merge"), "g")
    share, tasks = shares(sizes.select("g", F.ceil(F.col("n") / block).alias("most"), (F.col("n").cast("double") * F.col("m")).alias("work")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    dealt = packed.withColumn("of", share).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).repartition(parts, "g", "task").sortWithinPartitions("g", "task", "kind")

    names = [f.split()[0] for f in FOUND_SCHEMA.replace("\n", " ").split(",")]
    types = [{"long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in FOUND_SCHEMA.replace("\n", " ").split(",")]

    def searched(g: int, task: int, of: int, held: list[list[np.ndarray]]):
        codes = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in held]
        n, bits = len(codes[0]), np.zeros(len(codes[0]), np.int64)
        bits[codes[0] >> len(_FLAGS)] = codes[0]
        src, dst, structure = (codes[1] >> 32).astype(np.int32), (codes[1] >> 1 & 0x7FFFFFFF).astype(np.int32), (codes[1] & 1).astype(bool)
        codes.clear()
        searches = Searches(n, src, dst, structure, {f: (bits >> k & 1).astype(bool) for k, f in enumerate(_FLAGS)})
        blocks = -(-n // block)
        begin, end = (min(n, blocks * t // of * block) for t in (task, task + 1))
        found = searches.nothing()
        searches.find(begin, end, found)
        touched = np.full(n, task == 0)
        touched[searches.order[begin:end]] = True
        for name in _SUMMED:
            touched |= found[name] > 0
        if task == 0:
            found |= searches.once()
        found |= {"id": np.arange(n), "component": searches.component}
        place = np.flatnonzero(touched)
        for k in range(0, len(place), 20_000):
            at = place[k : k + 20_000]
            columns = []
            for name, kind in zip(names, types, strict=True):
                if name == "g":
                    columns.append(pa.array(np.full(len(at), g), kind))
                elif name not in found:
                    columns.append(pa.nulls(len(at), kind))
                else:
                    values = found[name][at]
                    columns.append(pa.array(values, kind, mask=values < 0 if values.dtype != bool else None))
            yield pa.RecordBatch.from_arrays(columns, names)

    def profile(batches):
        place, held = None, [[], []]
        for batch in batches:
            of = {c: batch.column(c).to_numpy() for c in ("g", "task", "of", "kind")}
            codes = batch.column("codes")
            for k in range(batch.num_rows):
                if place != (now := tuple(int(of[c][k]) for c in ("g", "task", "of"))):
                    if place:
                        yield from searched(*place, held)
                    place, held = now, [[], []]
                held[of["kind"][k]].append(codes[k].values.to_numpy(zero_copy_only=False).copy())
        if place:
            yield from searched(*place, held)

    found = dealt.select("g", "task", "of", "kind", "codes").mapInArrow(profile, FOUND_SCHEMA)
    merge = {n: F.sum(n) if n in _SUMMED else F.bool_or(n) if n in _REACHED_FROM else F.max(n) for n in names[2:]}
    merged = found.groupBy("g", "id").agg(*[v.alias(n) for n, v in merge.items()]).withColumnRenamed("component", "least")
    known = ids.select("g", "id", "node").hint("merge")
    named = merged.join(known, ["g", "id"]).join(known.select("g", F.col("id").alias("least"), F.col("node").alias("component")).hint("merge"), ["g", "least"])
    return named.select("g", "node", "component", *names[3:])
