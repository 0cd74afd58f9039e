import math

from pyspark.sql import functions as F

from pagelattice.llm import mixing
from tests.llm.helpers import awkward, docs, frame


def corpus(spark):
    rows = [(k, "w " * (1 + k % 37), "en", s, None) for k, s in enumerate(["big"] * 60 + ["mid"] * 25 + ["small"] * 15 + [None] * 9)]
    return frame(spark, rows)


def water_filled(sizes, weights, share=1.5):
    """Targets by repeated sharing of what full sources cannot take."""
    left, open_ = share * sum(sizes.values()), dict(sizes)
    target = dict.fromkeys(sizes, 0.0)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not full:
            for s in open_:
                target[s] = level * weights[s]
            return target
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_and_taken_words(spark):
    rows = mixing.mix(corpus(spark)).collect()
    assert len(rows) == 109
    sizes = {s: sum(r["size"] for r in rows if r.source == s) for s in ("big", "mid", "small", None)}
    expected = water_filled(sizes, {"big": 5, "mid": 2, "small": 1, None: 5})
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(math.isclose(r.target, expected[s], rel_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - expected[s]) <= 0.5
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)
    assert rows == mixing.mix(corpus(spark).repartition(7)).collect()


def test_schedules_shape_positions(spark):
    df = docs(spark, ["w w w w"] * 400)
    early = mixing.mix(df, weights=(5,), share=1.0, schedules={5: (2.0, 0.0)}).agg(F.avg("position")).first()[0]
    late = mixing.mix(df, weights=(5,), share=1.0, schedules={5: (0.0, 1.0, 3.0)}).agg(F.avg("position")).first()[0]
    assert abs(early - 1 / 3) < 0.02  # density 2 - 2t has mean 1/3
    assert late > 0.65


def test_passes_of_repeated_rows(spark):
    """Equal rows, rows that share an id and rows without one take in the pipeline what the mix gives them."""
    ten = "w " * 10
    rows = [(1, ten, "en", "a", 0)] * 3 + [(1, ten + "x", "en", "a", 0), (2, ten, "en", "b", 0), (None, ten, "en", "b", 0), (None, ten, "en", None, 0)] + [(k, ten, "en", "c", 0) for k in range(9, 30)]
    df = frame(spark, rows)
    for made in (df, df.limit(1000).where("doc_id > 8 or doc_id = 2")):
        out = mixing.mixed(made).collect()
        taken = {}
        for r in out:
            taken[(r.doc_id, r.source, r.text)] = taken.get((r.doc_id, r.source, r.text), 0) + r.mix_taken
        mix = mixing.arranged(made).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken")).where("taken > 0").collect()
        assert sorted((str(i), str(s), len(t.split()), n) for (i, s, t), n in taken.items()) == sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in mix)
        assert [r.mix_position for r in out] == sorted(r.mix_position for r in out)
        assert all(0 < r.mix_taken <= r.mix_size for r in out)
        assert max(r.mix_pass for r in out) == 2
    again = mixing.mixed(mixing.mixed(df))
    assert again.columns == mixing.mixed(df).columns and again.count() > 0


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mixed(df)
    assert mixed.columns[: len(df.columns)] == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
