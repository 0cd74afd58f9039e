import random
from collections import deque

import pytest

from pagelattice.operators import graph, hubs


def brute(pairs, sources):
    out = {}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    for s in sources:
        depth, todo = {s: 0}, deque([s])
        while todo:
            at = todo.popleft()
            for to in near.get(at, ()):
                if to not in depth:
                    depth[to] = depth[at] + 1
                    todo.append(to)
        out.update({(s, n): d for n, d in depth.items()})
    return out


def made(spark):
    """Three graphs: one with a hub and over 64 sources, a chain, and one with loops and repeated edges."""
    rnd = random.Random(12)
    pairs = {
        1: [("hub", f"n{k}") for k in range(90)] + [(f"n{k}", "hub") for k in range(0, 90, 2)] + [(f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(60)],
        2: [(str(k), str(k + 1)) for k in range(9)],
        3: [("a", "a"), ("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")],
    }
    edges = spark.createDataFrame([(g, a, b) for g, p in pairs.items() for a, b in p], "g long, src string, dst string")
    return pairs, edges, {g: sorted({x for p in held for x in p}) for g, held in pairs.items()}


@pytest.mark.parametrize("slot_rows", [20_000, 7])
def test_against_brute_force(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(hubs, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(graph, "CHUNK_SLOT", 64)
    pairs, edges, nodes = made(spark)
    every = graph.endpoints(edges)
    found = {(r.g, r.source, r.node): r.depth for r in graph.bfs_depths(edges, every).collect()}
    want = {(g, s, n): d for g in pairs for (s, n), d in brute(pairs[g], nodes[g]).items()}
    assert found == want
    sums = {(r.g, r.node): r for r in graph.reach_sums(edges, every).collect()}
    assert len(sums) == sum(map(len, nodes.values()))
    for (g, n), r in sums.items():
        into = [d for (h, _, to), d in want.items() if (h, to) == (g, n) and d]
        assert (r.total or 0, r.ancestors, r.descendants) == (sum(into), len(into), sum(1 for (h, s, _), d in want.items() if (h, s) == (g, n) and d))
    some = every.where("node in ('hub', 'n3', '5', 'd')")
    counts = {(r.g, r.source): r.descendants for r in graph.descendant_counts(edges, some).collect()}
    assert counts == {k: sums[k].descendants for k in counts} and len(counts) == 4
    assert {(r.g, r.source, r.node) for r in graph.reachable(edges, some).collect()} == {k for k, d in want.items() if (k[0], k[1]) in counts and d}


def test_closeness_agrees_with_pairs(spark):
    _, edges, _ = made(spark)
    every = graph.endpoints(edges)
    by_bits = {(r.g, r.node): r.closeness for r in graph.closeness_of(graph.reach_sums(edges, every)).collect()}
    assert by_bits == {(r.g, r.node): r.closeness for r in graph.closeness(graph.bfs_depths(edges, every), every).collect()}


def test_rows_hold_64_sources(spark):
    """A complete graph of 130 nodes: a row for each node, chunk and depth, not for each pair."""
    edges = spark.createDataFrame([(1, str(a), str(b)) for a in range(130) for b in range(130) if a != b], "g long, src string, dst string")
    search = graph.BitSearch(edges, graph.endpoints(edges))
    assert search.layers.count() <= 130 + 130 * 3
    assert {r.reached for r in search.incoming().collect()} == {129}
    assert {r.reached for r in search.outgoing().collect()} == {129}


def test_no_sources_or_edges(spark):
    empty = spark.createDataFrame([], "g long, src string, dst string")
    assert graph.reach_sums(empty, graph.endpoints(empty)).count() == 0
    alone = spark.createDataFrame([(1, "x")], "g long, node string")
    row = graph.reach_sums(empty, alone).first()
    assert (row.total, row.ancestors, row.descendants) == (None, 0, 0)


def twin_graph():
    """Two bundles of twin sources and twin sinks around a cycle, a complete bipartite graph, and a sink with more neighbours than are compared."""
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")]
    stars = [(f"s{k}", "a") for k in range(70)] + [("c", f"t{k}") for k in range(5)] + [("b", f"t{k}") for k in range(3)]
    both = [(f"x{k}", f"y{n}") for k in range(4) for n in range(3)]
    return cycle + stars + both + [(f"s{k}", "wide") for k in range(40)]


@pytest.mark.parametrize("bound", [16, 1])
def test_twins_count_as_each_by_itself(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "TWIN_NEIGHBOURS", bound)
    pairs = twin_graph()
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "g long, src string, dst string")
    every = graph.endpoints(edges)
    nodes = sorted({x for p in pairs for x in p})
    dist = brute(pairs, nodes)
    up = {n: [d for (s, m), d in dist.items() if m == n and d] for n in nodes}
    down = {n: sum(1 for (s, _), d in dist.items() if s == n and d) for n in nodes}
    sums = {r.node: (r.total, r.ancestors, r.descendants) for r in graph.reach_sums(edges, every).collect()}
    assert sums == {n: (sum(up[n]) if up[n] else None, len(up[n]), down[n]) for n in nodes}
    some = every.where("node like 's%1' or node like 't%' or node in ('b', 'x2', 'x3')")
    chosen = {r.node for r in some.collect()}
    levels = {}
    for (s, _), d in dist.items():
        if s in chosen:
            levels[s, d] = levels.get((s, d), 0) + 1
    assert {(r.source, r.depth): r.nodes for r in graph.depth_counts(edges, some).collect()} == levels
    assert {r.source: r.descendants for r in graph.descendant_counts(edges, some).collect()} == {s: down[s] for s in chosen}


def test_twins_are_searched_once(spark):
    """The layers of a star of twins do not grow with them."""
    grown = []
    for n in (100, 400):
        edges = spark.createDataFrame([(1, f"s{k}", "hub") for k in range(n)] + [(1, "hub", f"t{k}") for k in range(n)], "g long, src string, dst string")
        grown.append(graph.TwinSearch(edges, graph.endpoints(edges)).found.layers.count())
    assert grown[0] == grown[1]


def test_profiles_search_from_a_block_at_once(monkeypatch):
    """Sums over all blocks are those of searches one by one; single searches do not grow with the nodes."""
    rnd = random.Random(3)
    flags = graph._FLAGS
    calls = []
    for n in (60, 240):
        names = [f"v{k:03d}" for k in range(n)]
        pairs = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(rnd.choice(names), rnd.choice(names)) for _ in range(n)]
        members = [{"node": v} | {f: k % 9 == m for m, f in enumerate(flags)} for k, v in enumerate(names)]
        links = [{"src": a, "dst": b, "structure": a < b} for a, b in pairs]
        plain, counted = graph.search, []
        monkeypatch.setattr(graph, "search", lambda starts, steps, plain=plain, counted=counted: (counted.append(1), plain(starts, steps))[1])
        found = graph.GraphProfile(members, links)
        rows = [found.block(k, 50) for k in range(-(-n // 50))]
        monkeypatch.setattr(graph, "search", plain)
        calls.append(len(counted))
        down, tree = brute(pairs, names), brute([(a, b) for a, b in pairs if a < b], names)
        near = brute(pairs + [(b, a) for a, b in pairs], names)
        kind = {m["node"]: m for m in members}
        for v in names:
            merged = {k: sum(r[v][k] for r in rows if v in r) for k in graph._SUMMED}
            into = {s: d for (s, t), d in down.items() if t == v}
            scripts = [d for s, d in into.items() if kind[s]["is_script"] and kind[v]["is_input"]]
            assert merged == {"sum_in": sum(into.values()), "n_in": len(into) - 1, "n_out": sum(s == v for s, _ in down) - 1, "script_sum": sum(scripts), "script_n": len(scripts)}
            mine = {k: x for r in rows if v in r for k, x in r[v].items()}
            around = [d for (s, _), d in near.items() if s == v]
            assert (mine["eccentricity"], mine["sum_undirected"]) == (max(around), sum(around))
            if kind[v]["is_form"]:
                assert mine["form_depth"] == max(d for (s, _), d in tree.items() if s == v)
                far = {t: d for (s, t), d in down.items() if s == v}
                asked = lambda x: min((d for (s, t), d in down.items() if s == x and kind[t]["is_request"]), default=None)
                inputs = [t for t in far if kind[t]["is_input"]]
                ways = [far[t] + asked(t) for t in inputs if asked(t) is not None] + ([asked(v)] if inputs and asked(v) is not None else [])
                root = down.get((next(m["node"] for m in members if m["is_root"]), v))
                assert mine.get("exfil") == (root + min(ways) if ways and root is not None else None)
    assert calls[0] == calls[1]


def test_profiles_of_graphs_in_small_packed_rows(spark, monkeypatch):
    """Two graphs dealt over several tasks, and a lone node: no row holds a whole graph, edges are longs, and the rows are those of one block."""
    monkeypatch.setattr(graph, "PACKED_NODES", 16)
    monkeypatch.setattr(graph, "PACKED_SOURCES", 4)
    monkeypatch.setattr(graph, "HELD_WORDS", 1)
    monkeypatch.setattr(graph, "FOLLOWED_WORDS", 8)
    packed, plain = [], graph.packed_graphs
    monkeypatch.setattr(graph, "packed_graphs", lambda *a: (packed.append(plain(*a)), packed[-1])[1])
    rnd = random.Random(8)
    members, links = [], []
    for g, n in ((1, 90), (2, 40), (3, 1)):
        names = [f"v{k:03d}" for k in range(n)]
        members += [(g, v, *(k % 9 == m for m in range(7))) for k, v in enumerate(names)]
        pairs = [(a, b) for a, b in zip(names, names[1:], strict=False) if rnd.random() < 0.9] + [(rnd.choice(names), rnd.choice(names)) for _ in range(n)] * (n > 1)
        links += [(g, a, b, a < b) for a, b in pairs]
    nodes = spark.createDataFrame(members, "g long, node string, " + ", ".join(f"{f} boolean" for f in graph._FLAGS))
    edges = spark.createDataFrame(links, "g long, src string, dst string, structure boolean")
    found = {(r.g, r.node): r.asDict() for r in graph.node_profiles(nodes, edges, block=7).collect()}
    for g in (1, 2, 3):
        mine = [dict(zip(("node", *graph._FLAGS), m[1:], strict=True)) for m in members if m[0] == g]
        want = graph.GraphProfile(mine, [dict(zip(("src", "dst", "structure"), e[1:], strict=True)) for e in links if e[0] == g]).block(0, 1000)
        for node, row in want.items():
            got = found.pop((g, node))
            assert {k: v for k, v in got.items() if k not in ("g", "node") and v is not None} == {k: v for k, v in row.items() if v is not None}
    assert not found
    kinds = {k: max(len(r.codes) for r in packed[0].collect() if r.kind == k) for k in (0, 1)}
    assert kinds[0] <= 16 and kinds[1] <= 16 and dict(packed[0].dtypes)["codes"] == "array<bigint>"
