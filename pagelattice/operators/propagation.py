"""Label propagation over one graph of URLs, domains, addresses and URL pieces.

Messages between unlabelled nodes are rows (src, dst) kept bucketed by the receiver; what labelled nodes send is added to the
receivers' costs once. A row holds all that its receiver needs to answer it, so a sweep is: sums by receiver and slot where the rows
lie, a small sum by receiver, the sums sent back to the slots, and each row turned round into its answer. Rows of a popular receiver are dealt
over slots (``VertexCut``), so no task gets a whole hub.

Sweeps are synchronous (all messages use the sums of the sweep before) or in place in the order of a colouring, one colour a step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.urls import page_domain, path_substrings, registered_domain
from pagelattice.operators.domains import registered_domains
from pagelattice.operators.hubs import VertexCut
from pagelattice.tables import bucketed, cut, new_path, where_they_lie, written_at


def url_graph(urls: DataFrame, dns: DataFrame | None = None, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, node_type), edges (src, dst) with src < dst) of (url); dns is (domain, ip). Domains are cut by public-suffix ``rules``
    (suffix, kind), or by the bundled two-level suffixes."""
    named = urls.select("url").distinct().withColumn("name", page_domain(F.col("url")))
    domain = registered_domain(F.col("name"))
    if rules is not None:
        named = cut(named, "url_names")
        named, domain = named.join(registered_domains(named, rules).select("name", "domain"), "name", "left"), F.col("domain")
    named = cut(named.select("url", domain.alias("domain"), path_substrings(F.col("url")).alias("pieces")), "named_urls")
    links = named.select(F.col("url").alias("u"), F.lit("url").alias("ut"), F.col("domain").alias("v"), F.lit("domain").alias("vt"))
    links = links.unionByName(named.select(F.col("url").alias("u"), F.lit("url").alias("ut"), F.explode("pieces").alias("v"), F.lit("substring").alias("vt")))
    if dns is not None:
        links = links.unionByName(named.select("domain").distinct().join(dns, "domain").where("ip is not null").select(F.col("domain").alias("u"), F.lit("domain").alias("ut"), F.col("ip").alias("v"), F.lit("ip").alias("vt")))
    links = links.where("u <> v and u <> '' and v <> ''")
    vertices = links.select(F.col("u").alias("id"), F.col("ut").alias("node_type")).unionByName(links.select(F.col("v").alias("id"), F.col("vt").alias("node_type"))).groupBy("id").agg(F.min("node_type").alias("node_type"))
    return vertices, links.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def extend_graph(graph: tuple[DataFrame, DataFrame], urls: DataFrame, dns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph with the vertices and edges of URLs that it lacks."""
    vertices, edges = graph
    fresh = urls.join(vertices.where("node_type = 'url'").select(F.col("id").alias("url")), "url", "left_anti")
    more_vertices, more_edges = url_graph(fresh, dns)
    return vertices.unionByName(more_vertices.join(vertices, "id", "left_anti")), edges.unionByName(more_edges).distinct()


def vector_similarity(a: Column, b: Column, kind: str = "rbf") -> Column:
    """rbf: exp(-squared distance / 2) of raw vectors; cos: cosine of unit vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if kind == "rbf":
        gap = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
        return F.exp(-F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / 2)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))), F.lit(0.0)))


def edge_similarity(edges: DataFrame, vectors: DataFrame, kind: str = "rbf", default: float = 0.5) -> DataFrame:
    """(src, dst, sim) from (id, vector); ``default`` where a vector is missing."""
    left, right = vectors.select(F.col("id").alias("src"), F.col("vector").alias("a")), vectors.select(F.col("id").alias("dst"), F.col("vector").alias("b"))
    joined = edges.join(left, "src", "left").join(right, "dst", "left")
    return joined.select("src", "dst", F.coalesce(vector_similarity(F.col("a"), F.col("b"), kind), F.lit(default)).alias("sim"))


def init_beliefs(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, c0, c1): costs .99/.01 of phish nodes, .01/.99 of benign ones, .5/.5 of others. c0 is the cost of benign."""
    joined = vertices.select("id").join(labels.groupBy("id").agg(F.min("label").alias("label")), "id", "left")
    return joined.select("id", "label", F.when(F.col("label") == 1, 0.99).when(F.col("label") == 0, 0.01).otherwise(0.5).alias("c0"), F.when(F.col("label") == 1, 0.01).when(F.col("label") == 0, 0.99).otherwise(0.5).alias("c1"))


def compatibility(table: str = "table3", low: float = 0.7, high: float = 0.7) -> tuple[Column, Column]:
    """Cost of equal and of different labels at the ends of an edge with ``sim``."""
    sim = F.col("sim")
    if table == "table1":
        return F.lit(0.5 - 0.001), F.lit(0.5 + 0.001)
    if table == "table2":
        return F.lit(0.0), 1 - sim
    return F.least(F.lit(low), 1 - sim), F.greatest(F.lit(high), sim)


def initial_messages(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(src, dst, sim, m0, m1): messages from labelled to unlabelled nodes are fixed (1, 0 from phish; 0, 1 from benign), others start at 0."""
    ways = edges.select("src", "dst", "sim").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    sender, receiver = beliefs.select(F.col("id").alias("src"), F.col("label").alias("sl")), beliefs.select(F.col("id").alias("dst"), F.col("label").alias("rl"))
    joined = ways.join(sender, "src").join(receiver, "dst").where("rl is null")
    return joined.select("src", "dst", "sim", "sl", F.when(F.col("sl") == 1, 1.0).otherwise(0.0).alias("m0"), F.when(F.col("sl") == 0, 1.0).otherwise(0.0).alias("m1"))


def sums_of(messages: DataFrame) -> DataFrame:
    """(id, s0, s1): sums of the messages into each node."""
    return messages.groupBy(F.col("dst").alias("id")).agg(F.sum("m0").alias("s0"), F.sum("m1").alias("s1"))


def answers(met: DataFrame, same: Column, other: Column) -> list[Column]:
    """What the receiver of a message (columns m0, m1) with totals t0, t1 sends back: min-sum without the sender's own part."""
    h = [F.col(f"t{k}") - F.col(f"m{k}") for k in (0, 1)]
    return [F.least(h[0] + (same if k == 0 else other), h[1] + (other if k == 0 else same)) for k in (0, 1)]


def bp_step(messages: DataFrame, beliefs: DataFrame, table: str = "table3", low: float = 0.7, high: float = 0.7) -> DataFrame:
    """One synchronous min-sum sweep: messages between unlabelled nodes from the sums of the last sweep, without the receiver's own part."""
    free = VertexCut(messages.where("sl is null"), ["dst"], ["src"])
    totals = beliefs.join(sums_of(messages), "id", "left").select(F.col("id").alias("dst"), *[(F.col(f"c{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"t{k}") for k in (0, 1)])
    new = answers(free.rows, *compatibility(table, low, high))
    turned = free.met(totals).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "sl", new[0].alias("m0"), new[1].alias("m1"))
    return turned.unionByName(messages.where("sl is not null").select("src", "dst", "sim", "sl", "m0", "m1"))


class Exchange:
    """The messages between unlabelled nodes, dealt by receiver and slot, and the totals of the nodes.

    ``rows``: src, dst, sim, slot (of the receiver's rows), answer_slot (of the row that answers), m0, m1.
    """

    def __init__(self, edges: DataFrame, beliefs: DataFrame):
        self.beliefs = cut(beliefs, "beliefs")
        ways = edges.select("src", "dst", "sim").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
        self.split = VertexCut(cut(ways, "ways"), ["dst"], ["src"])
        labels = self.beliefs.select(F.col("id").alias("dst"), "label")
        # Each row meets its receiver's label where it lies, and its sender's where the row that answers it lies.
        heard = self.split.met(labels).where("label is null").select("src", "dst", "sim")
        both = self.split.placed(self.split.placed(heard, ["src"]), ["dst"], {"dst": "src"}, "answer_slot")
        senders = self.split.mirrored(labels).select(F.col("dst").alias("src"), F.col("slot").alias("answer_slot"), F.col("label").alias("sl"))
        both = cut(both.join(senders, ["src", "answer_slot"]), "labelled_ways")
        self.fixed = both.where("sl is not null").select("src", "dst", "sim", "sl")
        self.rows = both.where("sl is null").select("src", "dst", "sim", "slot", "answer_slot", F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1"))

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows written, bucketed by receiver and slot."""
        return bucketed(rows, "messages", ["dst", "slot"])

    def base(self, fixed: DataFrame, costs: DataFrame | None = None) -> DataFrame:
        """(dst, t0, t1): a node's costs and what labelled nodes send it."""
        costs = self.beliefs if costs is None else costs
        sent = fixed.groupBy("dst").agg(F.sum("m0").alias("s0"), F.sum("m1").alias("s1"))
        joined = costs.select(F.col("id").alias("dst"), "c0", "c1").join(sent, "dst", "left")
        return cut(joined.select("dst", *[(F.col(f"c{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"t{k}") for k in (0, 1)]), "base")

    def totals(self, base: DataFrame, rows: DataFrame) -> DataFrame:
        """``base`` with the messages of ``rows``: by slot, where they lie, and then by node."""
        by_slot = rows.groupBy("dst", "slot").agg(F.sum("m0").alias("s0"), F.sum("m1").alias("s1"))
        sums = by_slot.groupBy("dst").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
        return base.join(sums, "dst", "left").select("dst", *[(F.col(f"t{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"t{k}") for k in (0, 1)])

    def turned(self, rows: DataFrame, totals: DataFrame, same: Column, other: Column, digits: int | None = None, carried: dict[str, str] | None = None) -> DataFrame:
        """Each row as the answer to it; ``carried`` columns go along under new names."""
        met = rows.join(self.split.mirrored(totals), ["dst", "slot"])
        new = answers(met, same, other)
        new = [F.round(n, digits) for n in new] if digits else new
        return met.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", F.col("answer_slot").alias("slot"), F.col("slot").alias("answer_slot"), new[0].alias("m0"), new[1].alias("m1"), *[F.col(c).alias(n) for c, n in (carried or {}).items()])

    def gaps(self, new: DataFrame, was: DataFrame) -> DataFrame:
        """(g0, g1): by how much each message has moved; planned ``where_they_lie``, no message is shuffled."""
        was = was.select("src", "dst", "slot", F.col("m0").alias("w0"), F.col("m1").alias("w1"))
        return new.join(was.hint("merge"), ["dst", "slot", "src"]).select(*[F.abs(F.col(f"m{k}") - F.col(f"w{k}")).alias(f"g{k}") for k in (0, 1)])


def with_costs(joined: DataFrame, cost: list[Column]) -> DataFrame:
    """(id, label, cost0, cost1, map_label); ties are benign.

    Costs have nine decimals, so that the order in which messages are summed decides no tie.
    """
    cost = [F.round(c, 9) for c in cost]
    return joined.select("id", "label", cost[0].alias("cost0"), cost[1].alias("cost1"), F.when(cost[1] < cost[0], 1).otherwise(0).alias("map_label"))


def marginals(messages: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Costs with all messages."""
    joined = beliefs.join(sums_of(messages), "id", "left")
    return with_costs(joined, [F.col(f"c{k}") + F.coalesce(f"s{k}", F.lit(0.0)) for k in (0, 1)])


def marginals_of(totals: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Costs from totals by node."""
    return with_costs(beliefs.select("id", "label").join(totals.withColumnRenamed("dst", "id"), "id"), [F.col("t0"), F.col("t1")])


def energy(found: DataFrame, beliefs: DataFrame, edges: DataFrame, table: str = "table3", low: float = 0.7, high: float = 0.7) -> DataFrame:
    """(energy): costs of the labels, and of each edge's pair of labels counted from both ends."""
    same, other = compatibility(table, low, high)
    labels = found.select("id", "map_label")
    nodes = beliefs.join(labels, "id").agg(F.sum(F.when(F.col("map_label") == 1, F.col("c1")).otherwise(F.col("c0"))).alias("nodes"))
    ends = edges.join(labels.withColumnsRenamed({"id": "src", "map_label": "x"}), "src").join(labels.withColumnsRenamed({"id": "dst", "map_label": "y"}), "dst")
    pairs = ends.agg((2 * F.sum(F.when(F.col("x") == F.col("y"), same).otherwise(other))).alias("pairs"))
    return nodes.withColumn("k", F.lit(1)).join(pairs.withColumn("k", F.lit(1)), "k").select((F.col("nodes") + F.coalesce("pairs", F.lit(0.0))).alias("energy"))


def fixed_messages(fixed: DataFrame) -> DataFrame:
    """What labelled nodes send: 1, 0 from phish; 0, 1 from benign."""
    return fixed.select("dst", (F.col("sl") == 1).cast("double").alias("m0"), (F.col("sl") == 0).cast("double").alias("m1"))


def bp_run(edges: DataFrame, beliefs: DataFrame, sweeps: int = 5, table: str = "table3", low: float = 0.7, high: float = 0.7) -> DataFrame:
    """Marginals after ``sweeps`` synchronous sweeps; each is written out."""
    exchange = Exchange(edges, beliefs)
    base, rows = exchange.base(fixed_messages(exchange.fixed)), exchange.kept(exchange.rows)
    for _ in range(sweeps):
        rows = exchange.kept(exchange.turned(rows, exchange.totals(base, rows), *compatibility(table, low, high)))
    return marginals_of(exchange.totals(base, rows), exchange.beliefs)


def colours(links: DataFrame) -> DataFrame:
    """(id, colour): a greedy colouring of the undirected (src, dst): no two linked nodes share one.

    Nodes take the smallest colour that no neighbour before them has, in order of degree (larger first), of the MD5 of the id and of
    the id. A node whose neighbours before it all have colours takes its own, so the rounds are as many as the longest chain of such
    neighbours, and each link is used once.
    """
    both = links.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    degree = both.groupBy(F.col("src").alias("id")).agg((-F.count(F.lit(1))).alias("less"))
    rank = cut(degree.select("id", F.struct("less", F.md5(F.col("id").cast("binary")).alias("draw"), "id").alias("rank")), "ranks")
    split = VertexCut(both, ["src"], ["dst"])
    ranked = split.met(rank.select(F.col("id").alias("src"), F.col("rank").alias("a")))
    other = VertexCut(ranked, ["dst"], ["src"])
    before = cut(other.met(rank.select(F.col("id").alias("dst"), F.col("rank").alias("b"))).where("a < b").select("src", "dst"), "before")
    ways = VertexCut(before, ["src"], ["dst"])
    waits = before.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    state = cut(rank.select("id").join(waits, "id", "left").select("id", F.coalesce("left", F.lit(0).cast("long")).alias("left"), F.array().cast("array<int>").alias("used")), "uncoloured")
    smallest = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used"))).cast("int")
    done = []
    while True:
        front = cut(state.where("left = 0").select("id", smallest.alias("colour")), "coloured")
        if front.isEmpty():
            break
        done.append(written_at(front))
        told = ways.met(front.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("colour").alias("taken"))
        waiting = state.where("left > 0").join(told, "id", "left")
        state = cut(waiting.select("id", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.array_union("used", F.coalesce("taken", F.array().cast("array<int>"))).alias("used")), "uncoloured")
    return links.sparkSession.read.schema("id string, colour int").parquet(*done) if done else rank.select("id", F.lit(0).alias("colour")).limit(0)


def bp_run_in_order(edges: DataFrame, beliefs: DataFrame, sweeps: int = 5, table: str = "table3", low: float = 0.7, high: float = 0.7) -> DataFrame:
    """Marginals after ``sweeps`` in-place sweeps: nodes send in order of their colour, and each sees what was sent before it in its own sweep.

    Nodes of a colour are not linked, so they send in one step; the result is that of a loop over nodes sorted by colour. What a
    colour has sent is a table of its own, laid out by the receivers' colour: a step reads the messages to its colour and writes those from it,
    so a sweep reads and writes each message once.
    """
    exchange = Exchange(edges, beliefs)
    spark, base, rows = edges.sparkSession, exchange.base(fixed_messages(exchange.fixed)), cut(exchange.rows, "messages")
    named = cut(colours(rows.select("src", "dst").where("src < dst")), "colours")
    of = lambda end, slot, name: exchange.split.mirrored(named.select(F.col("id").alias("dst"), F.col("colour").alias(name))).select(F.col("dst").alias(end), F.col("slot").alias(slot), name)
    rows = cut(rows.join(of("dst", "slot", "heard_by"), ["dst", "slot"]).join(of("src", "answer_slot", "sent_by"), ["src", "answer_slot"]), "messages")
    names = ("src", "dst", "sim", "slot", "answer_slot", "m0", "m1", "heard_by")
    schema = rows.select(*names).schema
    order = [r.colour for r in named.select("colour").distinct().orderBy("colour").collect()]

    def laid_out(sent: DataFrame) -> str:
        path = new_path(spark, "sent_by_colour")
        sent.select(*names).write.partitionBy("heard_by").parquet(path)
        return path

    sent = {c: laid_out(rows.where(F.col("sent_by") == c)) for c in order}
    for _ in range(sweeps):
        for c in order:
            parts = []
            # What each other colour has sent to this one, and is answered.
            for other in order:
                if other != c:
                    parts.append(spark.read.schema(schema).parquet(sent[other]).where(F.col("heard_by") == c).withColumn("back_to", F.lit(other)))
            if not parts:
                continue
            heard = reduce(DataFrame.unionByName, parts)
            totals = exchange.totals(base, heard)
            turned = exchange.turned(heard, totals, *compatibility(table, low, high), carried={"back_to": "heard_by"})
            sent[c] = laid_out(turned)
    last = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(path) for path in sent.values()]) if sent else rows
    return marginals_of(exchange.totals(base, last), exchange.beliefs)


def bp_score(found: DataFrame) -> DataFrame:
    """(id, score): 1 - cost of phish over both costs; 0.5 if they do not exceed 0."""
    total = F.col("cost0") + F.col("cost1")
    return found.select("id", F.when(total > 0, 1 - F.col("cost1") / total).otherwise(0.5).alias("score"))


def lbp_run(edges: DataFrame, beliefs: DataFrame, max_iter: int = 6, tol: float = 1e-3, potential: str = "sim", low: float = 0.6, high: float = 1.0) -> DataFrame:
    """Loopy propagation with priors 1/0, 0/1 and .5/.5: unknown nodes hear from all neighbours.

    Stops when no message moves by ``tol`` or more. Potentials: t1, sim_only, sim, flat.
    """
    exchange = Exchange(edges, beliefs)
    prior1 = F.when(F.col("label") == 1, 1.0).when(F.col("label") == 0, 0.0).otherwise(0.5)
    priors = exchange.beliefs.select("id", "label", (1 - (1 - prior1)).alias("c0"), (1 - prior1).alias("c1"))
    sim = F.col("sim")
    same, other = {"t1": (F.lit(0.5 - 1e-4), F.lit(0.5 + 1e-4)), "sim_only": (1 - sim, sim), "sim": (F.least(F.lit(low), 1 - sim), F.greatest(F.lit(high), sim)), "flat": (F.lit(0.5), F.lit(0.5))}[potential]
    # A labelled node sends its prior, the same in each sweep; before the first it has sent nothing.
    c0, c1 = (F.col("sl") == 1).cast("double"), (F.col("sl") == 0).cast("double")
    fixed = cut(exchange.fixed.select("dst", F.round(F.least(c0 + same, c1 + other), 10).alias("m0"), F.round(F.least(c0 + other, c1 + same), 10).alias("m1")), "fixed")
    silent, base, rows = exchange.base(fixed.limit(0), priors), exchange.base(fixed, priors), exchange.kept(exchange.rows)
    heard = silent
    for sweep in range(max_iter):
        new = exchange.kept(exchange.turned(rows, exchange.totals(heard, rows), same, other, 10))
        was, heard, rows = rows, base, new
        if sweep == max_iter - 1:
            break
        with where_they_lie(edges.sparkSession):
            gaps = exchange.gaps(new, was)
            if sweep == 0:
                gaps = gaps.unionByName(fixed.select(F.abs("m0").alias("g0"), F.abs("m1").alias("g1")))
            # The first bucket in which a message moves ends the search; ``isEmpty`` would sort them all.
            if not gaps.where((F.col("g0") >= tol) | (F.col("g1") >= tol)).head(1):
                break
    return marginals_of(exchange.totals(heard, rows), priors)


def lbp_score(found: DataFrame, raw_sign: bool = False) -> DataFrame:
    """(id, score) oriented as ``bp_score``; ``raw_sign`` takes the cost of benign instead."""
    total = F.col("cost0") + F.col("cost1")
    return found.select("id", F.when(total > 0, 1 - F.col("cost0" if raw_sign else "cost1") / total).otherwise(0.5).alias("score"))
