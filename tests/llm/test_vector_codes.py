import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import vector_codes
from pagelattice.llm.vector_codes import CoverTree


def lloyd(rows, parts, entries, rounds):
    """(codes, errors, digest) with every part compared with every entry, in Python integers."""
    each = len(rows[0]) // parts
    cut = [[tuple(v[p * each : (p + 1) * each]) for v in rows] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    found = [[nearest(cut[p][k], books[p]) for p in range(parts)] for k in range(len(rows))]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def vectors(n, width, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.3, (6, width))
    return (centres[rnd.integers(0, 6, n)] + rnd.normal(0, 0.05, (n, width))).astype(np.float32)


def frame(spark, rows, label=lambda k: k % 3):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], label(k)) for k, v in rows], "vec_id long, embedding array<float>, label int")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 70)  # several trees a task
    made = vectors(300, 8)
    made[50:90] = made[50]  # repeated rows
    rows = {r.vec_id: r for r in vector_codes.compress(frame(spark, list(enumerate(made)), lambda k: None if k % 4 == 0 else k % 3), entries=20).collect()}
    ints = [[int(np.floor(1024 * float(x))) for x in v] for v in made]
    codes, errors, digest = lloyd(ints, 4, 20, 4)
    assert [rows[k].code for k in range(300)] == codes and [rows[k].error for k in range(300)] == errors
    assert {r.codebooks_sha256 for r in rows.values()} == {digest}
    assert rows[0].label_error == sum(e for k, e in enumerate(errors) if k % 4 == 0)
    assert rows[1].label_error == sum(e for k, e in enumerate(errors) if k % 4 and k % 3 == 1)


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 3, 5), (40, 2, 2), (900, 2, 400), (900, 16, 60), (500, 3, 10**8)])
def test_tree_ranges_and_assignments(n, width, spread):
    rnd = np.random.default_rng(n)
    rows = rnd.integers(-spread, spread, (n, width))
    tree = CoverTree.unpacked(CoverTree(rows).packed())
    assert (tree.points[tree.inverse] == rows).all() and tree.weights.sum() == n
    for centre, start, radius in tree.levels:
        for k, (a, b) in enumerate(zip(start, [*start[1:], len(tree.points)], strict=True)):
            away = np.sqrt(((tree.points[a:b].astype(float) - tree.points[centre[k]]) ** 2).sum(1))
            assert a <= centre[k] < b and np.isclose(away.max(), radius[k])
    book = rnd.integers(-spread, spread, (17, width))
    book[9] = book[4]
    away = ((rows[:, None, :] - book) ** 2).sum(2)
    nearest, error = tree.codes(book)
    assert (nearest == away.argmin(1)).all() and (error == away.min(1)).all()
    total, count = tree.sums(book)
    for k in range(17):
        assert count[k] == (nearest == k).sum() and (total[k] == rows[nearest == k].sum(0)).all()


def test_whole_subtrees_are_assigned_in_clustered_data():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-5000, 5000, (12, 6))
    rows = centres[rnd.integers(0, 12, 3000)] + rnd.integers(-20, 20, (3000, 6))
    start, end, _ = CoverTree(rows).assign(centres)
    assert len(start) < 100 and (end - start).sum() == len(np.unique(rows, axis=0))


def test_nets_are_apart(monkeypatch):
    """Points of a level are over its scale apart and hang from a point within the scale above."""
    rnd = np.random.default_rng(5)
    rows = np.unique(rnd.integers(0, 1000, (400, 2)), axis=0)
    tree = CoverTree(rows)
    scale = np.sqrt(((tree.points - tree.points[tree.levels[0][0][0]]) ** 2).sum(1)).max()
    for centre, _, _ in tree.levels[1:]:
        scale /= vector_codes.BASE
        net = tree.points[centre].astype(float)
        away = np.sqrt(((net[:, None] - net) ** 2).sum(2)) + 1e9 * np.eye(len(net))
        assert away.min() > scale


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5] * 6), (1, None), (2, [nan] * 6), (3, [inf] + [0.0] * 5), (4, [None] + [0.0] * 5), (5, [-0.5, 0.25]), (None, [0.5] * 6), (7, []), (0, [0.25] * 6)]
    made = frame(spark, rows, lambda k: None).withColumns({c: F.lit("x") for c in ("code", "error", "part", "entry", "trees", "label_key", "n", "v")})
    found = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes.compress(made).collect())
    # Five rows are kept, each its own entry where it differs; six components become eight.
    assert [f[:2] for f in found] == [(False, 0), (False, 0), (False, 5), (False, 7), (True, 0)]
    assert {f[4] for f in found} == {sum(f[3] for f in found)}
    assert vector_codes.compress(made.limit(0)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(frame(spark, [(1, [3e30] * 4)]))
    with pytest.raises(ValueError, match="hex"):
        vector_codes.compress(made, entries=300)


def test_decode_and_text_labels(spark):
    made = frame(spark, list(enumerate(vectors(40, 8)))).withColumn("label", F.concat(F.lit("l"), F.col("label")))
    books, packed = vector_codes.train(made)
    for r in vector_codes.encode(packed, books).join(made.select("vec_id", "embedding"), "vec_id").collect():
        assert np.abs(books.decode(r.code) - np.array(r.embedding)).max() < 1 / 512
    assert vector_codes.compress(made).count() == 40
