import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from pagelattice.llm import line_dedup
from tests.llm.helpers import LONG_LINE, awkward, docs, frame


def brute(texts):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(k)
    out = {}
    for k, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or k == max(holders[key(x)])]
        out[k] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(line_dedup.dedup_lines(df)).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    pool = [f"Shared line number {k} with quite some more text behind it" for k in range(30)]
    texts = ["\n".join(rnd.choice([rnd.choice(pool), rnd.choice(pool).upper() + "  ", "short", f"own {rnd.random()} " * 3]) for _ in range(rnd.randint(1, 12))) for _ in range(80)]
    df = docs(spark, texts)
    assert found(df) == brute(dict(enumerate(texts)))


def test_four_documents_keep_and_five_lose_all_but_the_last(spark):
    four, five = LONG_LINE, LONG_LINE.replace("very", "other")
    texts = [f"{four}\n{five}\n{five}"] * 4 + [five]
    out = found(docs(spark, texts))
    assert [out[k][1] for k in range(5)] == [2, 2, 2, 2, 0]


def test_rows_that_share_an_id(spark, monkeypatch):
    """Each row loses the lines of its own text; the two texts of id 1 count as one document."""
    shared, own = LONG_LINE, LONG_LINE.replace("very", "own")
    rows = [(1, f"{shared}\nshort"), (1, f"{own}\n{shared}"), (1, own), (1, own), *[(k, shared) for k in range(2, 6)]]
    df = frame(spark, rows, "doc_id long, text string")
    want = sorted([(1, "short", 2, 1), (1, own, 2, 1), (1, own, 1, 0), (1, own, 1, 0), *[(k, "", 1, 1) for k in range(2, 5)], (5, shared, 1, 0)])
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == want
    monkeypatch.setattr(line_dedup, "small_side", lambda rows, name: rows)  # the form for more ids than are broadcast
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == want
    assert sorted(r.text for r in line_dedup.without_lines(df).collect()) == sorted(t for _, t, _, _ in want)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == df.count()
    assert all(r.n_dropped == 0 for r in rows)
    assert {r.n_lines for r in rows if r.doc_id in (1, 2)} == {1}
    assert line_dedup.without_lines(df).columns == df.columns
    assert found(df.limit(0)) == {}


def test_runs_over_batches_and_edges():
    """A hot key at the edge of a partition, and runs that cross batches, come out the same as settled at once."""
    rows = [(1, 1, d, d, p) for d in range(9, 0, -1) for p in (0, 3)] + [(2, 2, d, d, 0) for d in (8, 5, 4, 3, 2, 1)] + [(3, 3, 5, 5, 0)] + [(4, 4, d, d, 1) for d in range(6, 0, -1)]
    for size in (1, 2, 5, 100):
        for most in (3, 1000):
            batches = []
            for k in range(0, len(rows), size):
                cols = list(zip(*rows[k : k + size]))
                batches.append(pa.RecordBatch.from_arrays([pa.array(np.array(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["h1", "h2", "doc_id", "row_key", "pos"]))
            out = [r for b in line_dedup.stream_runs(5, most)(iter(batches)) for r in b.to_pylist()]
            open_keys = {r["h1"] for r in out if r["open"]}
            settled = {(r["h1"], r["doc_id"], r["pos"]) for r in out if not r["open"]}
            assert {1, 4} <= open_keys
            if 2 not in open_keys:
                assert {x for x in settled if x[0] == 2} == {(2, d, 0) for d in (5, 4, 3, 2, 1)}
            assert not {x for x in settled if x[0] in open_keys}
            for key in (1, 4):
                assert {(r["doc_id"], r["pos"]) for r in out if r["open"] and r["h1"] == key} == {(d, p) for h, _, d, _, p in rows if h == key}
