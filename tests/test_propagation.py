import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagelattice import tables
from pagelattice.operators import hubs, propagation


def graph_of(spark, seed=4, n=40):
    """A hub in half of all edges, chains, labelled and unlabelled nodes."""
    rnd = random.Random(seed)
    edges = {("hub", f"n{k:02d}") for k in range(n)} | {tuple(sorted((f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}"))) for _ in range(n)}
    edges = sorted((a, b, rnd.randrange(100) / 100) for a, b in edges if a != b)
    labels = {f"n{k:02d}": k % 2 for k in range(0, n, 5)}
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    beliefs = propagation.init_beliefs(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(list(labels.items()), "id string, label int"))
    return edges, labels, spark.createDataFrame(edges, "src string, dst string, sim double"), beliefs


def greedy(edges, labels):
    near = {}
    for a, b, _ in edges:
        if a not in labels and b not in labels:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    colour = {}
    for x in sorted(near, key=lambda x: (-len(near[x]), hashlib.md5(x.encode()).hexdigest(), x)):
        used = {colour[y] for y in near[x] if y in colour}
        colour[x] = min(set(range(len(used) + 1)) - used)
    return near, colour


def in_place(edges, labels, sweeps, order):
    """The loop over nodes: labelled nodes send, then each node of ``order`` answers all its neighbours at once."""
    near, sim, cost = {}, {}, {}
    for a, b, s in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        sim[a, b] = sim[b, a] = s
    for x in near:
        cost[x] = [0.99, 0.01] if labels.get(x) == 1 else [0.01, 0.99] if labels.get(x) == 0 else [0.5, 0.5]
    box = {x: {y: [0.0, 0.0] for y in near[x]} for x in near}
    for x in labels:
        for y in near.get(x, ()):
            if y not in labels:
                box[y][x] = [1.0, 0.0] if labels[x] == 1 else [0.0, 1.0]
    for _ in range(sweeps):
        for x in order:
            total = [cost[x][k] + sum(m[k] for m in box[x].values()) for k in (0, 1)]
            for y in near[x]:
                if y not in labels:
                    h = [total[k] - box[x][y][k] for k in (0, 1)]
                    same, other = min(0.7, 1 - sim[x, y]), max(0.7, sim[x, y])
                    box[y][x] = [min(h[0] + same, h[1] + other), min(h[0] + other, h[1] + same)]
    return {x: [round(cost[x][k] + sum(m[k] for m in box[x].values()), 6) for k in (0, 1)] for x in near}


@pytest.mark.parametrize("slot_rows", [20_000, 6])
def test_in_place_order_against_a_loop(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(hubs, "SLOT_ROWS", slot_rows)
    edges, labels, frame, beliefs = graph_of(spark)
    near, colour = greedy(edges, labels)
    free = frame.join(beliefs.where("label is null").selectExpr("id as src"), "src", "left_semi").join(beliefs.where("label is null").selectExpr("id as dst"), "dst", "left_semi")
    assert {r.id: r.colour for r in propagation.colours(free).collect()} == colour
    assert all(colour[x] != colour[y] for x in near for y in near[x]) and len(set(colour.values())) > 2
    order = sorted(colour, key=lambda x: (colour[x], x))
    found = {r.id: [round(r.cost0, 6), round(r.cost1, 6)] for r in propagation.bp_run_in_order(frame, beliefs, sweeps=2).collect()}
    assert found == in_place(edges, labels, 2, order)


def test_split_hubs_change_nothing(spark, monkeypatch):
    _, _, frame, beliefs = graph_of(spark)
    runs = []
    for slot_rows in (20_000, 5):
        monkeypatch.setattr(hubs, "SLOT_ROWS", slot_rows)
        exchange = propagation.Exchange(frame, beliefs)
        assert exchange.split.any == (slot_rows == 5)
        largest = exchange.rows.groupBy("dst", "slot").count().agg({"count": "max"}).first()[0]
        assert slot_rows > 5 or largest <= 16
        both = [propagation.bp_run(frame, beliefs, sweeps=3), propagation.lbp_run(frame, beliefs, max_iter=3)]
        runs.append([sorted((r.id, round(r.cost0, 6), round(r.cost1, 6)) for r in found.collect()) for found in both])
    assert runs[0] == runs[1]


def test_nothing_to_propagate(spark):
    _, _, frame, beliefs = graph_of(spark)
    none = frame.limit(0)
    for run in (propagation.bp_run, propagation.bp_run_in_order, propagation.lbp_run):
        assert {(r.cost0, r.cost1) for r in run(none, beliefs).where("label is null").collect()} == {(0.5, 0.5)}


def test_a_sweep_does_not_shuffle_the_messages(spark):
    """Bucketed messages meet sums and totals where they lie: the only exchange of messages is that of the write."""
    _, _, frame, beliefs = graph_of(spark)
    exchange = propagation.Exchange(frame, beliefs)
    rows = exchange.kept(exchange.rows)
    by_slot = rows.groupBy("dst", "slot").agg({"m0": "sum"})
    assert "Exchange" not in by_slot._jdf.queryExecution().executedPlan().toString()


def test_moved_messages_are_found_in_their_buckets(spark, monkeypatch):
    _, _, frame, beliefs = graph_of(spark)
    exchange = propagation.Exchange(frame, beliefs)
    was = exchange.kept(exchange.rows)
    new = exchange.kept(exchange.rows.withColumn("m0", F.when(F.col("src") == "hub", 0.25).otherwise(0.0)))
    with tables.where_they_lie(spark):
        found = exchange.gaps(new, was)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    links = exchange.rows.where("src = 'hub'").count()
    assert sorted((r.g0, r.g1) for r in found.collect()) == [(0.0, 0.0)] * (was.count() - links) + [(0.25, 0.0)] * links
    # A run asks between sweeps and no more.
    asked, gaps = [], propagation.Exchange.gaps
    monkeypatch.setattr(propagation.Exchange, "gaps", lambda self, *a: asked.append(1) or gaps(self, *a))
    propagation.lbp_run(frame, beliefs, max_iter=3)
    assert len(asked) == 2
    asked.clear()
    still = {r.id: r.cost0 for r in propagation.lbp_run(frame, beliefs, max_iter=6, tol=1e9).collect()}
    once = {r.id: r.cost0 for r in propagation.lbp_run(frame, beliefs, max_iter=1).collect()}
    assert still == pytest.approx(once) and len(asked) == 1, "a sweep that moves nothing ends the run"
