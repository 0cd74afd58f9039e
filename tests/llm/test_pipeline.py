import random

import corpus_pipeline
from tests.llm.helpers import DOCS, awkward, frame
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import sentences


def test_run_against_the_stages_by_hand(spark, tmp_path):
    rnd = random.Random(6)
    texts = [sentences(rnd, 80) + "\n" + " ".join(f"{k}w{j}" for j in range(30)) for k in range(40)]
    texts[7] = texts[3]
    texts[11] = " ".join(texts[5].split()[:-2])
    item = " ".join(f"bench{j}" for j in range(25))
    texts[20] += " " + item
    texts += ["#$%& " * 60, "", None]
    notice = "A notice that is on many pages and is longer than forty characters."
    for k in (1, 2, 4, 6, 8, 9):
        texts[k] += "\n" + notice
    frame(spark, [(k, t, "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {k: t for k, t in enumerate(texts) if t and k < 40}
    lines = brute_lines(good)
    cleaned = {k: "\n".join(x for x in t.split("\n") if x != notice or not lines[k][1]) for k, t in good.items()}
    ids = sorted(cleaned)
    near = {k: ids[c] for k, (_, c) in zip(ids, brute_near([cleaned[k] for k in ids]), strict=True)}
    left = {k for k in ids if near[k] == k and k != 20}
    assert {r.doc_id for r in rows} <= left
    assert {r.doc_id: r.text for r in rows} == {r.doc_id: cleaned[r.doc_id] for r in rows}
    total = sum(len(cleaned[k].split()) for k in left)
    assert abs(sum(r.mix_taken for r in rows) - 1.5 * total) <= 2
    assert all(sum(r.mix_taken for r in rows if r.doc_id == k) <= 2 * len(cleaned[k].split()) for k in left)
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)


def test_stages_keep_the_columns(spark, tmp_path):
    frame(spark, [(0, "x y", "en", "a", 3)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_on_empty_and_awkward_tables(spark, tmp_path):
    """No rows; nulls in every column, repeated rows, a very long text and clashing columns. What the stages cut is gone."""
    item = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    for name, docs in (("empty", frame(spark, [], DOCS)), ("awkward", awkward(spark).withColumn("mix_taken", corpus_pipeline.mixing.F.lit(1)))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        frame(spark, item, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert len(found.columns) == len(set(found.columns)) and set(DOCS.replace(",", "").split()[::2]) <= set(found.columns)
        assert {r.doc_id for r in found.collect()} <= {3}  # the others are null, empty or short


def test_scratch_removes_what_is_not_kept(spark, tmp_path):
    import os

    from pagelattice.llm.common import cut, scratch, shared_dir

    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark) as keep:
        inner = cut(spark.range(3), "inner")
        kept, path = keep(inner.selectExpr("id + 1 AS id"), "kept")
    assert set(os.listdir(shared_dir(spark))) - before == {os.path.basename(path)}
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
