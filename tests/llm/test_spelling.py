import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagelattice.llm import spelling
from tests.llm.helpers import awkward, docs


def plain(rows, shortest=5, fewest=3, ratio=2):
    """The contract word by word and pair by pair."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= shortest and c >= fewest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [n[w], len(found), form[w], n.get(form[w])]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def corpus(seed=5, size=60):
    rnd = random.Random(seed)
    letters = "abcdeéÿ×z"
    base = ["".join(rnd.choices(letters, k=rnd.randint(4, 9))) for _ in range(120)]
    words = []
    for w in base[:12]:
        if len(w) > 5:
            words += [w] * 60 + ["z" + w[1:]] * 14 + ["zz" + w[2:]] * 4  # a chain of forms
    for w in base:
        words += [w] * rnd.randint(1, 30)
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(w))
            v = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w.upper(), w[::-1]])
            words += [v] * rnd.randint(1, 6)
    rnd.shuffle(words)
    return [rnd.choice([" ", "-", "\n", "1"]).join(words[k::size]) for k in range(size)]


@pytest.mark.parametrize("cell", [4000, 20])
def test_query_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", 4)
    texts = corpus()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs(spark, texts)).collect()}
    want = plain(list(enumerate(texts)))
    assert found == want
    assert len(want) > 150 and any(w[2] and w[4] != w[2] for w in want.values()), "no chain of forms in the fixture"


def test_long_words_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 100)
    rnd = random.Random(3)
    word = "".join(rnd.choices("abc", k=5000))
    texts = [" ".join([word] * 9), " ".join([word[:77] + word[78:]] * 3), " ".join([word[:100] + "z" + word[101:]] * 4), "Word word WORDS words words " * 3]
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs(spark, texts)).collect()}
    assert found == plain(list(enumerate(texts))) and found[word][1] == 2


def test_tree_finds_all_in_range():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choices("abcdefghé", k=6)) for _ in range(700)})
    shorter = sorted({"".join(rnd.choices("abcdefghÿ", k=5)) for _ in range(200)})
    counts, fewer = (spelling.letter_counts(spelling.letters(w)) for w in (words, shorter))
    tree = spelling.CountTree(counts, leaf=5)
    for asked, up, down in ((counts, 1, 1), (fewer, 1, 0)):
        got = sorted((int(q), int(w)) for qs, ws in tree.search(asked, up, down) for q, w in zip(qs, ws, strict=True))
        differ = counts[None] - asked[:, None]
        want = np.argwhere((np.maximum(differ, 0).sum(2) == up) & (np.maximum(-differ, 0).sum(2) == down))
        assert got == [tuple(map(int, w)) for w in want] and got
    top = spelling.Top(counts, 12)
    held = {k: int(c) for rows, c in top.cells(counts, 0, 0) for k in rows.tolist()}
    assert len(held) == len(words) and 6 < len(set(held.values())) < 30
    sent = {(k, int(c)) for rows, c in top.cells(counts, 1, 1) for k in rows.tolist()}
    differ = counts[None] - counts[:, None]
    assert all((int(q), held[int(w)]) in sent for q, w in np.argwhere(np.abs(differ).sum(2) <= 2))


def test_roots_by_jumps(spark, monkeypatch):
    """A chain of forms, and many words that share one, with both ways of the join."""
    rows = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(70)] + [(f"x{k}", "w000") for k in range(30)]
    forms = spark.createDataFrame(rows, "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w070"}
    monkeypatch.setattr(spelling, "is_broadcast", lambda side: False)
    found = spelling.roots(forms).collect()
    assert {r.root for r in found} == {"w070"} and len(found) == 100


def test_awkward_rows(spark):
    df = awkward(spark)
    assert {r.word for r in spelling.variants(df).collect()} == set(plain([(r.doc_id if r.doc_id is not None else "", r.text) for r in df.collect()]))
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(docs(spark, [None, "", "12 !", "abcd abcd abcd"])).count() == 0
    assert spelling.noted(None, "hello") == spelling.noted("", "hello")
