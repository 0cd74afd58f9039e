import random

import numpy as np

from pagelattice.llm import components, minhash
from pagelattice.llm.common import hot_join
from tests.llm.helpers import awkward, docs


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(texts, percent=75):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    texts = [None, "", "one two", "One  two", "one two three four"]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(8, 150))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = [w if rnd.random() > 0.03 else word() for w in base]
            texts.append(" ".join(copy) if rnd.random() < 0.7 else " ".join(base).upper())
    rnd.shuffle(texts)
    return texts


def test_components_against_brute_force(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [(rows[k].n_shingles, rows[k].component_id) for k in range(len(texts))] == brute(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_copies_of_a_missing_original(spark):
    """Copies that link in chains, where a bucket's hub does not reach all members."""
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(24):
        copy = list(base)
        for at in range(0, 6 * k, 6):
            copy[at % 200] = f"x{at}"
        texts.append(" ".join(copy))
    rnd.shuffle(texts)
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [rows[k].component_id for k in range(24)] == [c for _, c in brute(texts)]


def test_groups_that_share_buckets_but_are_not_alike(spark, monkeypatch):
    """Two groups of copies around one passage, single texts with it, and hot buckets dealt over many tasks."""
    monkeypatch.setattr(minhash, "MOST_IN_TASK", 3)
    monkeypatch.setattr(minhash, "PARTNERS", 2)
    rnd = random.Random(9)
    passage = [f"p{k}" for k in range(130)]
    texts = []
    for group in range(2):
        own = [f"g{group}w{k}" for k in range(50)]
        for k in range(14):
            copy = passage + own
            for at in rnd.sample(range(len(copy)), 2):
                copy[at] = f"x{group}.{k}.{at}"
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [f"s{n}.{k}" for k in range(60)]) for n in range(12)]
    rnd.shuffle(texts)
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    want = brute(texts)
    assert [(rows[k].n_shingles, rows[k].component_id) for k in range(len(texts))] == want
    assert len({c for _, c in want}) == 14


def test_odd_sketch_never_excludes_a_link():
    rnd = np.random.default_rng(4)
    probes = minhash.probe_sequences(225)
    for _ in range(200):
        n = int(rnd.integers(5, 3000))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rnd.random(len(a)) > 0.12]
        b = np.unique(np.r_[keep, rnd.integers(0, 2**63, max(1, n // 20)).astype(np.uint64)])
        if not len(keep):
            continue
        both = len(np.intersect1d(a, b))
        alike = 100 * both >= 75 * (len(a) + len(b) - both)
        x, y = (minhash.sketch(s, minhash.one_permutation(s, 225, probes)) for s in (a, b))
        differ = np.unpackbits((x ^ y).view(np.uint8))
        odd, signed = int(differ[: minhash.ODD_BITS].sum()), int(differ[minhash.ODD_BITS :].sum())
        assert odd <= len(a) + len(b) - 2 * both
        if alike:
            assert 175 * odd <= 25 * (len(a) + len(b)) and signed <= minhash.MOST_BITS * 225


def test_densification_fills_every_bin():
    probes = minhash.probe_sequences(225)
    one = minhash.one_permutation(np.array([5], np.uint64), 225, probes)
    assert set(one.tolist()) == {5}


def test_connected_components(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rnd.randint(0, 30), 100 + rnd.randint(0, 30)) for _ in range(25)] + [(None, 3), (7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 10)
    monkeypatch.setattr(components, "hot_join", lambda *args: hot_join(*args, most=3))
    assert found == {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert found == {n: find(n) for n in list(parent)}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].component_id == by_id[5].component_id == 4 and by_id[4].kept and not by_id[5].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[1].n_shingles == 0 and by_id[1].component_id == 1
    assert minhash.keep_first(df).columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0
