import random
import re
import zlib

import numpy as np

from pagelattice.llm import decontaminate, license_scan, toxicity
from tests.llm.helpers import awkward, docs, frame

BAD = ("grobnik", "snartle", "vexomor")


def toxic_corpus(spark, n=600):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choices(["ta", "re", "lo", "min", "she", "on", "ca", "di"], k=rnd.randint(1, 3)))
    texts, marks = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(20, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        texts.append(" ".join(words) + ".")
        marks.append((k, 1, int(toxic)))
    return texts, docs(spark, texts), frame(spark, marks, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_with_gaps(spark):
    texts, df, labels = toxic_corpus(spark)
    extra = ["talore minshe gr.ob-ni.k onca vexxomor dita sn4rtle", "talore minshe onca dita g r o b n i k relo v*e*x*o*m*o*r", "talore minshe onca dita relo caon", None, ""]
    both = df.unionByName(docs(spark, extra).withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_id") + 10_000))
    rows = {r.doc_id: r for r in toxicity.score(both, labels).collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id < 10_000]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert [rows[10_000 + k].predicted for k in range(5)] == [1, 1, 0, 0, 0]


def test_kernel_is_the_subsequence_kernel():
    """The explicit table gives the kernel summed over all pairs of equal spread-out subsequences."""
    import itertools

    def features(letters):
        out = {}
        for at in itertools.combinations(range(len(letters)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                key = tuple(letters[k] for k in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = toxicity.token_letters(b"grobbnik"), toxicity.token_letters(b"xgroobnikk")
    fa, fb = features(a), features(b)
    expected = sum(v * fb.get(k, 0) for k, v in fa.items()) / toxicity.NORMS[len(a)] / toxicity.NORMS[len(b)]
    assert np.isclose(toxicity.Landmarks([b]).columns([a])[0, 0], expected, rtol=1e-4)


def test_machine_is_the_sentence_kernel_machine(spark):
    """The machine's value of a sentence is the weighted sum of its kernels with the landmarks, by table or by pairs of tokens."""
    _, df, labels = toxic_corpus(spark, 200)
    parts = toxicity.labelled_sentences(df.join(labels.selectExpr("doc_id", "toxic AS label"), "doc_id")).cache()
    marks = toxicity.choose_landmarks(toxicity.token_counts(parts), 30)
    assert {m for m in marks[:3]} <= {toxicity.token_letters(b.encode()) for b in BAD} and len(marks) == 30
    known = toxicity.Landmarks(marks)
    gram = known.columns(marks).astype(float)
    assert np.allclose(gram, gram.T, atol=1e-4) and np.linalg.eigvalsh(gram).min() > -1e-3
    bags = [[bytes(t) for t in r.tokens] for r in parts.limit(20).collect()]
    alpha = np.random.default_rng(1).normal(size=30)
    table = sum(np.float32(a) * toxicity.landmark_table(m) for a, m in zip(alpha, marks))
    by_table = [toxicity.TokenScorer(table).tops([b" ".join(words)], 0.0)[0][0] for words in bags]
    by_pairs = [sum(alpha @ known.columns([p])[0] for t in words for p in toxicity.token_pieces(t)) for words in bags]
    assert np.allclose(by_table, by_pairs, rtol=1e-3, atol=1e-3)
    packed = toxicity.sentence_columns(parts, marks, 1000).collect()
    summed = sorted(float(np.frombuffer(r["columns"], np.float32) @ alpha) for r in packed)
    assert np.allclose(summed, sorted(sum(alpha @ known.columns([p])[0] for t in map(bytes, r.tokens) for p in toxicity.token_pieces(t)) for r in parts.collect()), rtol=1e-3, atol=1e-3)
    table, bias = toxicity.fit_table(parts, landmarks=30)
    value = {True: [], False: []}
    for r in parts.collect():
        value[any(b.encode() in map(bytes, r.tokens) for b in BAD)].append(toxicity.TokenScorer(table).tops([b" ".join(map(bytes, r.tokens))], bias)[0][0])
    assert min(value[True]) > max(value[False])


def test_letters_of_all_alphabets_and_lengths():
    letters = toxicity.token_letters
    assert letters("Größe".encode()) == letters(b"grosse"[:4] + b"e") == letters(b"GR0\xc3\x9fe") and letters("naïve".encode()) == letters(b"na-iv.e")
    assert len(letters("дурак".encode())) == len(letters("ηλίθιος"[:5].encode())) == 5 and max(letters("дурак日本".encode())) <= 30
    assert letters("дурак".encode()) == letters("ДУРАК".encode()) and letters(b"--..") == b""
    for n in range(1, 60):
        parts = toxicity.token_pieces(b"a" * n)
        assert all(toxicity.ORDER <= len(p) <= toxicity.CHUNK for p in parts) and sum(map(len, parts)) >= n
    assert toxicity.token_pieces(b"!?") == []
    long = b" ".join(b"w%d" % k for k in range(100))
    assert {t for words in toxicity.sentences(long) for t in words} == set(long.split()) and max(map(len, toxicity.sentences(long))) == toxicity.WINDOW


def test_short_foreign_and_long_insults_are_learned(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices(["ta", "re", "lo", "min", "она", "то", "di"], k=rnd.randint(1, 3)))
    bad = ("zax", "дурхаг", "unbelievablyverybadinsultingword")
    texts, marks = [], []
    for k in range(400):
        words = [word() for _ in range(rnd.randint(10, 40))]
        if k % 4 == 0:
            words.insert(rnd.randrange(len(words)), bad[k // 4 % 3])
        texts.append(" ".join(words) + ".")
        marks.append((k, 1, int(k % 4 == 0)))
    rows = toxicity.score(docs(spark, texts), frame(spark, marks, "doc_id long, quality int, toxic int")).where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in rows) >= 0.97 * len(rows)


def test_toxicity_awkward(spark):
    df = awkward(spark)
    labels = frame(spark, [(1, 1, 1), (1, 1, 1), (2, None, None), (None, 0, 1), (3, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, labels).count() == df.count()
    assert toxicity.score(df, labels.limit(0)).where("score = 0").count() == df.count()
    assert toxicity.score(df.limit(0), labels).count() == 0


def benchmark(spark, items):
    return frame(spark, list(enumerate(items)), "item_id long, text string")


def test_decontamination_finds_copies_and_substitutions(spark, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=5))
    items = [" ".join(word() for _ in range(rnd.randint(12, 40))) for _ in range(20)]
    filler = lambda: " ".join(word() for _ in range(30))
    exact = [f"{filler()} {t.title()}, {filler()}" for t in items]
    changed = []
    for t in items:
        w = t.split()
        for k in range(3, len(w), 6):
            w[k] = word()
        changed.append(f"{filler()} {' '.join(w)} {filler()}")
    clean = [filler() for _ in range(40)]
    part = [f"{filler()} {' '.join(items[0].split()[:6])} {filler()}"]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, exact + changed + clean + part), benchmark(spark, items)).collect()}
    assert found == {(k, k) for k in range(20)} | {(20 + k, k) for k in range(20)}
    for name in ("MOST_SEEDS", "MOST_ITEMS"):
        monkeypatch.setattr(decontaminate, name, 0)  # joins by shuffle
    monkeypatch.setattr(decontaminate, "BLOCK", 1)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 16)
    by_shuffle = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, exact + changed + clean + part), benchmark(spark, items)).collect()}
    assert by_shuffle == found
    kept = decontaminate.keep_clean(docs(spark, exact + clean), benchmark(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20, 60))


def brute_overlaps(doc, item):
    """Spaced-seed matching by definition: every placing of every mask in both texts."""
    if len(item) < 5:
        return len(item) if doc == item else 0
    offsets = set()
    for mask in decontaminate.MASKS:
        read = [k for k, m in enumerate(mask) if m == "1"]
        for p in range(len(doc) - len(mask) + 1):
            for q in range(len(item) - len(mask) + 1):
                if all(doc[p + k] == item[q + k] for k in read):
                    offsets.add(p - q)
    covered = set()
    for offset in offsets:
        parts = [[q for q in range(len(item)) if 0 <= q + offset < len(doc)]]
        while parts:
            part = parts.pop()
            score = {(a, b): sum(1 if item[q] == doc[q + offset] else -1 for q in part[a:b]) for a in range(len(part)) for b in range(a + 1, len(part) + 1)}
            best = max(score.values(), default=0)
            matched = lambda qs, o=offset: [q for q in qs if item[q] == doc[q + o]]
            if len(matched(part)) < 5 or best <= 0:
                continue
            a, b = min((b, -a) for (a, b), x in score.items() if x == best)[::-1]
            a = -a
            if len(matched(part[a:b])) >= 5:
                covered |= set(matched(part[a:b]))
            parts += [part[:a], part[b:]]
    return len(covered)


def test_decontamination_against_brute_force(spark):
    """Few words, so that seeds meet by chance, items repeat words and diagonals are many; short items too."""
    rnd = random.Random(12)
    word = lambda: rnd.choice("abcd") + rnd.choice("xyz")
    items = [[word() for _ in range(n)] for n in (1, 3, 4, 5, 6, 7, 8, 9, 12, 14, 20, 26, 26)]
    items.append(["ax"] * 10)
    texts = [[word() for _ in range(rnd.randint(1, 40))] for _ in range(30)] + [[*x] for x in items] + [["by", *x, "by"] for x in items] + [["ax"] * 30]
    texts += [[w if rnd.random() < 0.8 else word() for w in items[-3]] for _ in range(6)]
    df = docs(spark, [" ".join(t).upper() for t in texts]).unionByName(docs(spark, [" ".join(items[6])]).selectExpr("cast(null as bigint) AS doc_id", "text", "lang", "source", "n_chars"))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.matched_words) for r in decontaminate.contaminated(df, benchmark(spark, [" ".join(x) for x in items])).collect())
    want = []
    for d, doc in [*enumerate(texts), (-1, items[6])]:
        for k, item in enumerate(items):
            n = brute_overlaps(doc, item)
            if n and (n >= 13 or (n >= 8 and 2 * n >= len(item)) or n == len(item)):
                want.append((d, k, n))
    assert found == sorted(want) and len(want) > 30
    kept = decontaminate.keep_clean(df, benchmark(spark, [" ".join(x) for x in items]))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({*range(len(texts))} - {d for d, _, _ in want})


def test_decontamination_awkward(spark):
    df = awkward(spark)
    marks = benchmark(spark, [None, "", "too short", "alpha beta gamma delta epsilon zeta eta theta iota"])
    assert decontaminate.contaminated(df, marks).count() == 0
    assert decontaminate.contaminated(df, marks.limit(0)).count() == 0
    assert decontaminate.keep_clean(df, marks).count() == df.count()
    assert decontaminate.keep_clean(df, marks).columns == df.columns


def test_license_scan_and_inheritance(spark):
    files = frame(
        spark,
        [
            ("a/LICENSE.txt", "x\nThis work is licensed under the GNU General Public License,\nversion 3."), ("a/b/LICENSE", "Released under the MIT License."), ("a/b/copying.txt", "Licensed under CC BY 4.0."),
            ("a/b/c/d.py", "code of a work in the public\nmore code"), ("a/x.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/y.py", None), ("z.py", "the work is of the general public"), (None, "All rights reserved."), ("q/w.py", ""),
        ],
        "path string, text string",
    )
    rows = {r.path: (r.own_license, r.license, r.inherited_from) for r in license_scan.scan_licenses(files).collect()}
    assert rows["a/LICENSE.txt"][0] == "GPL-3.0" and rows["a/b/LICENSE"][0] == "MIT"
    assert rows["a/x.py"] == ("Apache-2.0", "Apache-2.0", None)
    assert rows["a/b/c/d.py"][1:] in {("MIT", "a/b/LICENSE"), ("CC-BY-4.0", "a/b/copying.txt")}
    assert rows["a/y.py"] == (None, "GPL-3.0", "a/LICENSE.txt")
    assert rows["z.py"] == rows["q/w.py"] == (None, None, None)
    assert rows[None] == ("All-rights-reserved", "All-rights-reserved", None)
    assert license_scan.scan_licenses(files.limit(0)).count() == 0


GPL = """/* This file is part of a program.
 *
 * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 */
int main() {{}}"""


def test_license_headers_and_texts(spark):
    """Headers that differ by a version, a word or a clause, as comment blocks and as licence files."""
    known = license_scan.TEMPLATES
    bsd2 = "Copyright (c) 2020, A\nAll rights reserved.\n\n" + known["BSD-2-Clause"][2].replace(", ", ",\n")
    files = {
        "gpl2.c": (GPL.format(";", "", ";", 2), "GPL-2.0"),
        "gpl3.c": (GPL.format(":", "", ",", 3), "GPL-3.0"),
        "agpl.c": (GPL.format(":", "Affero ", ",", 3), "AGPL-3.0"),
        "lgpl.c": (GPL.format(":", "Lesser ", ",", 3), "LGPL-3.0"),
        "three/COPYING": ("        GNU GENERAL PUBLIC LICENSE\n          Version 3, 29 June 2007\n\nEveryone may copy this.", "GPL-3.0"),
        "two/COPYING": ("        GNU GENERAL PUBLIC LICENSE\n          Version 2, June 1991\n\nEveryone may copy this.", "GPL-2.0"),
        "bsd2/LICENSE": (bsd2, "BSD-2-Clause"),
        "bsd3/LICENSE": (bsd2 + "\n\n3. " + known["BSD-3-Clause"][2], "BSD-3-Clause"),
        "isc/LICENSE": ("Copyright 2004 A\n\n" + known["ISC"][1].replace(" for any", "\nfor any"), "ISC"),
        "mpl.js": ("// The contents of this file are subject to the Mozilla Public License Version\n// 1.1 (the License); you may not use this file except in\n// compliance with the License.", "MPL-1.1"),
        "tag.py": ("# SPDX-License-Identifier: LGPL-2.1\nx = 1", "LGPL-2.1"),
        "isc/x.py": ("x = 1", "ISC"),
        "y.py": ("import this", None),
    }
    df = frame(spark, [(p, t) for p, (t, _) in files.items()], "path string, text string")
    found = {r.path: r.license for r in license_scan.scan_licenses(df.selectExpr("*", "1 AS dir", "'z' AS cosine")).collect()}
    assert found == {p: name for p, (_, name) in files.items()}


def test_cosines_against_dense_vectors(spark):
    """Weights over all lines and the sparse cosines equal dense TF-IDF computed term by term."""
    import math

    import numpy as np

    known = {"A": ("alpha beta beta gamma", "delta"), "B": ("alpha delta epsilon",)}
    texts = ["alpha beta\nalpha the\n", "gamma gamma beta alpha", None, "", "epsilon delta the"]
    notices = [n.split() for group in known.values() for n in group]
    lines = [line.split() for t in texts if t for line in t.split("\n")] + [[t for n in notices for t in n]]
    weights, unknown = license_scan.term_weights(frame(spark, [("p", t) for t in texts], "path string, text string"), known)
    idf = {t: math.log((1 + len(lines)) / (1 + sum(t in x for x in lines))) + 1 for t in ("alpha", "beta", "gamma", "delta", "epsilon")}
    assert weights.keys() == idf.keys() and all(math.isclose(weights[t], idf[t]) for t in idf)
    matcher = license_scan.Matcher(known, weights, unknown, 0.6)
    vocabulary = sorted({t for x in lines for t in x})
    dense = lambda found: np.array([(1 + math.log(found.count(t))) * idf.get(t, unknown) if t in found else 0.0 for t in vocabulary])
    for line in [*lines[:-1], *notices]:
        if not line:
            continue
        mine = dense(line)
        want = {name: max(float(mine @ dense(n.split()) / np.linalg.norm(mine) / np.linalg.norm(dense(n.split()))) for n in group) for name, group in known.items()}
        got = matcher.cosines(line)
        assert all(math.isclose(got.get(name, 0.0), want[name], abs_tol=1e-5) for name in known)


def test_license_anchor_terms_lose_nothing():
    """Lines without an anchor term score under the threshold for every template."""
    known = license_scan.TEMPLATES
    weights = {t: 1 + (sum(map(ord, t)) % 7) for t in license_scan.template_terms(known)}
    matcher = license_scan.Matcher(known, weights, 8.0, 0.6)
    rnd = random.Random(4)
    common = sorted(set(weights) - matcher.keys)
    for _ in range(300):
        line = rnd.choices(common, k=rnd.randint(1, 12)) if common else []
        mine = matcher.vector(line)
        assert all(sum(v * mine.get(t, 0) for t, v in vector.items()) < 0.6 for _, vector in matcher.vectors)
    assert re.match(license_scan.LICENSE_FILE, "LICENSE.txt")


def test_substituted_passages_are_found(spark):
    item = [f"w{k}" for k in range(40)]
    split = item[:10] + [f"x{k}" for k in range(11)] + item[21:31]
    fourth = [w if k % 4 else f"y{k}" for k, w in enumerate(item)]
    docs = frame(spark, [(1, " ".join(split), "en", "a", 1), (2, " ".join(fourth), "en", "a", 1), (3, " ".join(item[:12]), "en", "a", 1)])
    found = decontaminate.contaminated(docs, frame(spark, [(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.matched_words, r.first_word, r.last_word) for r in found) == [(1, 20, 0, 30), (2, 30, 1, 39)]


def test_repeated_tokens_say_nothing_more():
    rnd = np.random.default_rng(2)
    scorer = toxicity.TokenScorer(rnd.normal(size=toxicity.CELLS).astype(np.float32))
    once, often = (scorer.tops([text], 0.0)[0] for text in (b"idle words here", b"idle words words words here idle here"))
    assert once == often and toxicity.sentences(b"er er er er ab er") == [[b"er", b"ab"]]
