import random
import re
from collections import Counter

from pagelattice.llm import quality_model, quality_rules
from tests.llm.helpers import awkward, docs, frame


def brute(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    lines = [line for line in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a" * 5000, "one\n\none\n one", "é# *|<", "x y " * 40]
    texts += [" ".join(rnd.choices(["a", "b", "c#", "dé"], k=rnd.randint(1, 60))) + rnd.choice(["\n", "\x0b", " "]) * 2 for _ in range(60)]
    rows = {r.doc_id: r for r in quality_rules.assess(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def sentences(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "to", "in", "walked", "house", "river", "green", "slowly,", "evening.", "Then", "children"]) for _ in range(n))


def test_repeated_windows_of_long_texts(spark):
    """Windows that repeat far apart, and at many places, in a text of 60,000 words."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(60_000)]
    for at in (100, 20_000, 59_980):
        words[at : at + 12] = [f"r{k}" for k in range(12)]
    row = quality_rules.measure(docs(spark, [" ".join(words)])).first()
    assert (row.n_words, row.n_repeat_words) == (60_000, 36)


def test_divergent_documents_go_and_clean_ones_stay(spark):
    rnd = random.Random(5)
    clean = [sentences(rnd, rnd.randint(60, 200)) for _ in range(60)]
    junk = [" ".join("".join(rnd.choices("#$%&*0123456789", k=6)) for _ in range(100)) for _ in range(3)]
    rows = {r.doc_id: r.kept for r in quality_rules.assess(docs(spark, clean + junk)).collect()}
    assert all(rows[k] for k in range(60)) and not any(rows[k] for k in range(60, 63))
    short = {r.doc_id: r.kept for r in quality_rules.assess(docs(spark, [*clean, "#$% " * 4 + " ".join(f"w{k}" for k in range(20))])).collect()}
    assert short[60]  # under the length guard


def test_awkward_rows(spark):
    df = awkward(spark)
    assert quality_rules.assess(df).count() == df.count()
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert quality_rules.assess(df.limit(0)).count() == 0


def labelled(spark, n=300):
    rnd = random.Random(9)
    texts = [sentences(rnd, 50) if k % 4 else " ".join(w.upper() + "!!" for w in sentences(rnd, 50).split()) for k in range(n)]
    labels = frame(spark, [(k, int(k % 4 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels


def test_classifier_learns_and_holds_out(spark):
    import zlib

    df, labels = labelled(spark)
    rows = quality_model.score(df, labels).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in quality_model.score(df.repartition(3), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def brute_vector(text):
    """Cells and values of a text, n-gram by n-gram, in Python numbers."""
    import math
    import re
    import zlib
    from collections import Counter

    top = 1 << 64

    def cell(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % top
        return (x ^ (x >> 31)) >> (64 - quality_model.BITS)

    code = lambda t: zlib.crc32(t.encode())
    found = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    words = [code(t.lower()) for t in found]
    shapes = [code("9" if t[0].isdigit() else t[:4] if not t[0].isalpha() else "a" if t.islower() else "A" if t.isupper() and len(t) > 1 else "Aa") for t in found]
    shapes = [7 if k and words[k] == words[k - 1] else s for k, s in enumerate(shapes)]
    one, two, n = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, len(found)
    keys = words + [words[k] * one + words[k + 1] for k in range(n - 1)] + [s + (1 << 40) for s in shapes]
    keys += [shapes[k] * one + shapes[k + 1] + (1 << 41) for k in range(n - 1)] + [(shapes[k] * one + shapes[k + 1]) * two + shapes[k + 2] for k in range(n - 2)]
    counts = Counter(cell(k % top) for k in keys)
    norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values()))
    return {k: (1 + math.log(c)) / norm for k, c in counts.items()}


def test_scores_against_brute_force(spark):
    """Every score is the logistic of a dot product, over n-grams taken one by one."""
    import math

    df, labels = labelled(spark, 80)
    extra = docs(spark, ["", None, "One one ONE 12 __ !!! x", "a"]).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    both = df.unionByName(extra)
    sample = quality_model.training_sample(both, labels, "quality", 5, 0, 8000).select("doc_id", "text", "label").cache()
    table, bias = quality_model.fit(sample, sample.count())
    scores = {r.doc_id: r.score for r in quality_model.score(both, labels).collect()}
    for r in both.collect():
        z = bias + sum(v * float(table[k]) for k, v in brute_vector(r.text).items())
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-z))) < 2e-5


def test_ftrl_against_coordinate_loops():
    """The vectorised updates are the published per-coordinate ones."""
    import math

    import numpy as np

    rnd = np.random.default_rng(2)
    vectors = [(np.sort(rnd.choice(20, 5, replace=False)).astype(np.int32), rnd.random(5).astype(np.float32)) for _ in range(12)]
    labels = (rnd.random(12) > 0.4).astype(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.01
    z, n, sums = {}, {}, {}
    start = math.log(labels.mean() / (1 - labels.mean()))

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(11)
    for epoch in range(6):
        for at in order.permutation(12):
            row = [(int(k), float(v)) for k, v in zip(*vectors[at])] + [(quality_model.SIZE, 1.0)]
            p = 1 / (1 + math.exp(-(start + sum(weight(k) * v for k, v in row))))
            for k, v, w in [(k, v, weight(k)) for k, v in row]:
                g = (p - labels[at]) * v
                step = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - step * w
                n[k] = n.get(k, 0.0) + g * g
        if epoch >= 3:
            for k in z:
                sums[k] = sums.get(k, 0.0) + weight(k) / 3
    table, bias = quality_model.train_ftrl(vectors, labels)
    assert all(abs(table[k] - sums.get(k, 0.0)) < 1e-6 for k in range(20)) and abs(bias - start - sums[quality_model.SIZE]) < 1e-6


def test_classifier_awkward(spark):
    df = awkward(spark)
    labels = frame(spark, [(1, 1, 0), (1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert quality_model.score(df, labels).count() == df.count()
    assert quality_model.score(df, labels.limit(0)).where("score = 0.5").count() == df.count()
    assert quality_model.score(df.limit(0), labels).count() == 0
