import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagelattice.operators import embeddings, graph, hubs


def depth_of(first, start):
    seen, at, n = {start}, start, 0
    while at in first:
        at, n = first[at], n + 1
        if at in seen:
            return n
        seen.add(at)
    return n


@pytest.mark.parametrize("slot_rows", [20_000, 4])
def test_chain_depths_against_walking(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(hubs, "SLOT_ROWS", slot_rows)
    rnd = random.Random(2)
    rows, want = [], {}
    for g in range(5):
        n = 30
        first = {str(k): str(rnd.randrange(n if g else k + 1, n + 5)) if g == 0 else str(rnd.randrange(n + (g % 3))) for k in range(n)}
        if g == 4:
            first |= {str(k): "0" for k in range(1, n)}  # a hub that all lead to
        rows += [(g, a, b, 1) for a, b in first.items()] + [(g, a, "9", 2) for a in first]
        want[g] = max(depth_of(first, s) for s in first)
    found = {r.g: r.depth for r in graph.chain_depths(spark.createDataFrame(rows, "g long, src string, dst string, ord long")).collect()}
    assert found == want


def test_a_long_chain_takes_few_rounds(spark):
    """100,000 nodes in a row, and as many in a cycle with a tail, in 18 doublings each."""
    n = 100_000
    chain = spark.range(n).selectExpr("1L as g", "cast(id as string) as src", "cast(id + 1 as string) as dst", "id as ord")
    cycle = spark.range(n).selectExpr("2L as g", "cast(id as string) as src", f"cast(if(id = {n - 1}, 500, id + 1) as string) as dst", "id as ord")
    found = {r.g: r.depth for r in graph.chain_depths(chain.unionByName(cycle), max_rounds=20).collect()}
    assert found == {1: n, 2: n}


def test_ranked_neighbours_of_split_hubs(spark, monkeypatch):
    pairs = [("hub", f"n{k}") for k in range(40)] + [("n1", "n2"), ("n2", "n1"), ("n3", "n3")]
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "g long, src string, dst string")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for slot_rows in (20_000, 6):
        monkeypatch.setattr(hubs, "SLOT_ROWS", slot_rows)
        rows = graph.ranked_neighbours(edges).collect()
        for tail, mine in near.items():
            held = [r for r in rows if r.tail == tail]
            assert sorted(r["rank"] for r in held) == list(range(len(mine))) and {r.next for r in held} == mine
            assert all(r.next_n == len(near[r.next]) for r in held)
            if slot_rows == 20_000:
                assert [r.next for r in sorted(held, key=lambda r: r["rank"])] == sorted(mine)


def test_walks_are_uniform_and_stop_at_dead_ends(spark):
    edges = spark.createDataFrame([(1, "a", b) for b in "bcde"], "g long, src string, dst string")
    nodes = graph.endpoints(edges).unionByName(spark.createDataFrame([(1, "alone")], "g long, node string"))
    rows = graph.random_walks(edges, nodes, num=300, length=3).collect()
    assert {tuple(r.walk) for r in rows if r.start == "alone"} == {("alone",)} and len(rows) == 1800
    drawn = Counter(r.walk[1] for r in rows if r.start == "a")
    assert set(drawn) == set("bcde") and max(abs(n - 75) for n in drawn.values()) < 30


def test_walks_meet_packed_neighbours_where_they_lie(spark, monkeypatch):
    """A hub of several packed rows, walks of several pieces: the same walks as in a loop, and no step broadcasts the neighbours or shuffles them."""
    monkeypatch.setattr(graph, "PACKED", 4)
    monkeypatch.setattr(graph, "CARRIED", 3)
    pairs = [("hub", f"n{k:02d}") for k in range(19)] + [("n00", "n01"), ("n01", "n02")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame([(7, *p) for p in pairs], "g long, src string, dst string")
    found = graph.random_walks(edges, graph.endpoints(edges), num=3, length=9)
    want = set()
    for start in near:
        for no in range(3):
            walk = [start]
            for step in range(1, 9):
                draw = int(hashlib.md5(f"42:{step}:{start}:{no}".encode()).hexdigest()[:8], 16)
                walk.append(sorted(near[walk[-1]])[draw % len(near[walk[-1]])])
            want.add((start, no, tuple(walk)))
    assert {(r.start, r.walk_no, tuple(r.walk)) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_pair_weights_count_nearer_pairs_more(spark):
    walks = spark.createDataFrame([(["a", "b", "c", "a"],)], "walk array<string>")
    found = {(r.centre, r.context): round(r.weight, 6) for r in embeddings.pair_weights(walks, 2).collect()}
    assert found == {("a", "b"): 1.5, ("b", "a"): 1.5, ("b", "c"): 1.0, ("c", "b"): 1.0, ("a", "c"): 1.5, ("c", "a"): 1.5}


def area(positive, negative):
    """Chance that a positive outranks a negative."""
    ranks = np.argsort(np.argsort(np.r_[positive, negative])) + 1
    return (ranks[: len(positive)].sum() - len(positive) * (len(positive) + 1) / 2) / (len(positive) * len(negative))


def test_vectors_predict_held_out_links(spark):
    """Links inside four groups: held-out ones against pairs that are not linked, one block against three, and Spark ML's vectors."""
    from pyspark.ml.feature import Word2Vec

    rnd = random.Random(9)
    n = 80
    pairs = {(a, b) for a in range(n) for b in range(a) if rnd.random() < (0.35 if a % 4 == b % 4 else 0.02)}
    ordered = sorted(pairs)
    out = set(rnd.sample(ordered, len(ordered) // 5))
    edges = spark.createDataFrame([(1, str(a), str(b)) for a, b in ordered if (a, b) not in out], "g long, src string, dst string")
    walks = spark.createDataFrame(graph.random_walks(edges, graph.endpoints(edges), num=6, length=16).collect())
    others = [p for p in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(600)) if p[0] != p[1] and p not in pairs and p[::-1] not in pairs]

    def score(vectors):
        cos = lambda a, b: float(vectors[str(a)] @ vectors[str(b)] / (np.linalg.norm(vectors[str(a)]) * np.linalg.norm(vectors[str(b)]) + 1e-12))
        known = lambda p: str(p[0]) in vectors and str(p[1]) in vectors
        return area(*[np.array([cos(*p) for p in part if known(p)]) for part in (sorted(out), others)])

    one, three = ({r.word: np.array(r.vector) for r in graph.deepwalk(walks, dim=16, epochs=3, block=block).collect()} for block in (1000, 27))
    again = {r.word: np.array(r.vector) for r in graph.deepwalk(walks.repartition(3), dim=16, epochs=3, block=1000).collect()}
    assert len(one) == len(three) == n and all(v.shape == (16,) for v in one.values())
    assert all(np.allclose(one[w], again[w], atol=1e-4) for w in one), "reruns agree"
    model = Word2Vec(vectorSize=16, windowSize=5, minCount=0, maxIter=3, seed=42, inputCol="walk", outputCol="v").fit(walks)
    theirs = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert score(one) > 0.8 and score(three) > 0.8 and score(one) > score(theirs) - 0.02, (score(one), score(three), score(theirs))


def test_few_words_with_many_pairs_are_trained_by_many_tasks():
    from pagelattice.operators import embeddings

    assert embeddings.block_count(9_000, 30_000_000, embeddings.BLOCK) == 12
    assert embeddings.block_count(300_000, 30_000_000, embeddings.BLOCK) == 12
    assert embeddings.block_count(6_000_000, 30_000_000, embeddings.BLOCK) == 120
    assert embeddings.block_count(16, 200, embeddings.BLOCK) == 1 and embeddings.block_count(0, 0, embeddings.BLOCK) == 1


def walks_of_a_loop(near, num, length):
    found = set()
    for g, start in near:
        for no in range(num):
            walk = [start]
            for step in range(1, length):
                draw = int(hashlib.md5(f"42:{step}:{start}:{no}".encode()).hexdigest()[:8], 16)
                walk.append(sorted(near[g, walk[-1]])[draw % len(near[g, walk[-1]])])
            found.add((g, start, no, tuple(walk)))
    return found


@pytest.mark.parametrize("whole", [1 << 25, 100, 0])
def test_walks_are_not_shuffled_or_written_on_their_way(spark, monkeypatch, whole):
    """Graphs held by tasks, one of them by several, and walked by steps: the same walks as in a loop. Held ones write numbers of the graph only."""
    monkeypatch.setattr(graph, "WHOLE", whole)
    monkeypatch.setattr(graph, "PACKED_NODES", 16)
    monkeypatch.setattr(graph, "PACKED_SOURCES", 4)
    rnd = random.Random(4)
    pairs = [(1, "hub", f"n{k:02d}") for k in range(60)] + [(1, f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(80)] + [(2, "a", "b"), (2, "b", "a"), (2, "b", "c"), (2, "c", "c")]
    near = {}
    for g, a, b in pairs:
        if a != b:
            near.setdefault((g, a), set()).add(b)
            near.setdefault((g, b), set()).add(a)
    edges = spark.createDataFrame(pairs, "g long, src string, dst string")
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (written.append(name), plain(df, name))[1])
    rows = graph.random_walks(edges, graph.endpoints(edges), num=3, length=12).collect()
    assert {(r.g, r.start, r.walk_no, tuple(r.walk)) for r in rows} == walks_of_a_loop(near, 3, 12) and len(rows) == 3 * len(near)
    assert ("walks" in written) == (whole < 1 << 25)


def test_pairs_of_ragged_walks(spark, monkeypatch):
    """Walks of all lengths, repeats, nulls and an empty one against a plain loop, counted two walks at a time."""
    monkeypatch.setattr(embeddings, "COUNTED", 2)
    rnd = random.Random(6)
    walks = [[rnd.choice(["a", "b", "é", "zz", "aa", None]) for _ in range(n)] for n in (0, 1, 2, 3, 9, 17)]
    want = Counter()
    for walk in walks:
        for k, x in enumerate(walk):
            for d in range(1, 4):
                if k + d < len(walk) and x is not None and walk[k + d] is not None:
                    want[x, walk[k + d]] += (4 - d) / 3
                    want[walk[k + d], x] += (4 - d) / 3
    found = embeddings.pair_weights(spark.createDataFrame([(w,) for w in [*walks, None]], "walk array<string>"), 3).collect()
    assert len(found) == len(want) and all(abs(r.weight - want[r.centre, r.context]) < 1e-9 for r in found)
