import itertools
import random

import pytest

from pagelattice.operators import graph


def edges_of(spark, pairs, g=0):
    return spark.createDataFrame([(g, str(a), str(b), k) for k, (a, b) in enumerate(pairs)], "g long, src string, dst string, ord long")


def test_path_and_chorded_cycle(spark):
    path = edges_of(spark, [(0, 1), (1, 2), (2, 3)])
    nodes = graph.endpoints(path)
    distances = graph.bfs_depths(path, nodes)
    close = {r.node: r.closeness for r in graph.closeness(distances, nodes).collect()}
    assert close == {"0": 0.0, "1": 1 / 3, "2": (2 / 3) * (2 / 3), "3": (3 / 6) * (3 / 3)}
    counts = {r.node: (r.ancestors, r.descendants) for r in graph.reach_counts(distances, nodes).collect()}
    assert counts == {"0": (0, 3), "1": (1, 2), "2": (2, 1), "3": (3, 0)}
    cycle = edges_of(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    row = graph.clustering(cycle).first()
    assert (row.average_clustering, row.transitivity) == (round((2 / 3 + 1 + 2 / 3 + 1) / 4, 4), 0.75)
    assert graph.density(cycle).first().density == round(5 / 12, 6)


def test_many_graphs_against_brute_force(spark):
    rnd = random.Random(5)
    rows, truth = [], {}
    for g in range(6):
        n = rnd.randint(3, 12)
        pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(2, 16))}
        pairs = {(a, b) for a, b in pairs if a != b} or {(0, 1)}
        rows += [(g, str(a), str(b), k) for k, (a, b) in enumerate(sorted(pairs))]
        seen = sorted({x for p in pairs for x in p})
        near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in seen}
        comps, left = [], set(seen)
        while left:
            todo, comp = [min(left)], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += near[x]
            comps.append(comp)
            left -= comp
        tri = {x: sum(1 for a, b in itertools.combinations(sorted(near[x]), 2) if b in near[a]) for x in seen}
        truth[g] = (len(comps), tri, near)
    edges = spark.createDataFrame(rows, "g long, src string, dst string, ord long")
    summary = {r.g: r.components for r in graph.component_summary(graph.weak_components(edges)).collect()}
    assert summary == {g: t[0] for g, t in truth.items()}
    found = {(r.g, r.node): (r.triangles, r.neighbours) for r in graph.triangles(edges).collect()}
    assert found == {(g, str(x)): (tri[x], len(near[x])) for g, (_, tri, near) in truth.items() for x in tri}


def test_means_of_ancestors_and_descendants_agree(spark):
    rnd = random.Random(1)
    edges = edges_of(spark, {(rnd.randrange(15), rnd.randrange(15)) for _ in range(30)})
    nodes = graph.endpoints(edges)
    rows = graph.reach_counts(graph.bfs_depths(edges, nodes), nodes).collect()
    assert sum(r.ancestors for r in rows) == sum(r.descendants for r in rows)


def test_chains_and_walks(spark):
    chain = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    assert graph.chain_depths(chain).first().depth == 3
    walks = graph.random_walks(chain, graph.endpoints(chain), num=3, length=12)
    rows = sorted((r.start, r.walk_no, tuple(r.walk)) for r in walks.collect())
    near = {("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")}
    assert len(rows) == 15 and all((p, q) in near or (q, p) in near for _, _, w in rows for p, q in zip(w, w[1:]))
    assert rows == sorted((r.start, r.walk_no, tuple(r.walk)) for r in graph.random_walks(chain.repartition(3), graph.endpoints(chain), num=3, length=12).collect())


def test_single_edge_has_no_assortativity(spark):
    assert graph.assortativity(edges_of(spark, [(0, 1)])).first().assortativity == 0.0


def test_queries_take_the_operators_defaults(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pagelattice import constants as C
    from pagelattice.operators import models
    from pagelattice.plans import graph_queries, propagation_queries

    seen = {}
    monkeypatch.setattr(graph, "random_walks", lambda edges, nodes, **options: (seen.update(walks=options), edges.selectExpr("g", "src as start", "0 as walk_no", "array(src) as walk"))[1])
    monkeypatch.setattr(graph, "deepwalk", lambda walks, **options: (seen.update(vectors=options), walks.selectExpr("start as word", "array(0.0) as vector"))[1])
    monkeypatch.setattr("pyspark.ml.functions.vector_to_array", F.col)
    graph_queries.random_walks(spark, "/root/testdata/sf0.001")
    graph_queries.walk_vectors(spark, "/root/testdata/sf0.001")
    assert seen == {"walks": {}, "vectors": {}}
    monkeypatch.setattr(propagation_queries, "feature_row", lambda session, sf_dir: session.range(20).selectExpr("id as page_id", *[f"double(id) as {n}" for n in C.FEATURE_NAMES]))
    monkeypatch.setattr(models, "fit", lambda rows, name="gbt", names=None, **options: seen.update(rows=rows, names=names, options=options))
    monkeypatch.setattr(models, "predict", lambda model, rows: rows.selectExpr("page_id", "label", "0.5 as score", "'benign' as prediction"))
    propagation_queries.model_scores(spark, "/root/testdata/sf0.001")
    assert (seen["names"] or list(C.FEATURE_NAMES)) == list(C.FEATURE_NAMES) and seen["options"] == {} and set(C.FEATURE_NAMES) <= set(seen["rows"].columns)


def test_round_limits_are_errors(spark):
    chain = spark.createDataFrame([(1, str(k), str(k + 1), k) for k in range(5)], "g long, src string, dst string, ord long")
    with pytest.raises(RuntimeError):
        graph.chain_depths(chain, max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.bfs_depths(chain, chain.where("src = '0'").selectExpr("g", "src as node"), max_depth=4)
