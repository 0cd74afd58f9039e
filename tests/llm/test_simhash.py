import random
import re

import pytest
import xxhash

from pagelattice.llm import simhash
from tests.llm.helpers import awkward, docs


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, bits=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_query_against_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(2, 7))) for _ in range(400)]
    texts = [None, "", " \t\n", "One", "one", "two words", "A B\x0bc", "Ünïcode ÉÉ words HERE"]
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 400))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), min(len(copy), rnd.randint(0, 3))):
                copy[at] = rnd.choice(vocabulary)
            texts.append(rnd.choice([" ", "\n"]).join(copy))
    rnd.shuffle(texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [rows[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    groups = components_of(prints)
    assert [rows[k].component_id for k in range(len(texts))] == groups
    assert 20 < len(set(groups)) < len(texts)


@pytest.mark.parametrize("most", [4000, 130, 3])
def test_links_of_crowded_segments(spark, most):
    """Fingerprints around a few centres: their segments, and halves of the rest, are shared by many."""
    rnd = random.Random(most)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        centre = rnd.getrandbits(64)
        prints |= {centre ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))}) for _ in range(120)}
        prints |= {centre & ~0xFFFFFFFF | rnd.getrandbits(32) for _ in range(80)}  # one segment equal
        prints |= {centre & ~0xFFFF | rnd.getrandbits(16) for _ in range(80)}
    prints = sorted(prints)
    rnd.shuffle(prints)
    made = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    at = {signed(p): k for k, p in enumerate(prints)}
    found = [(at[r.a], at[r.b]) for r in simhash.links(made, 3, most).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in found)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == components_of(prints)


def test_a_group_emits_a_forest(spark):
    """Of one entry with many close fingerprints no more links than members leave the task."""
    prints = [0xABCDEF0000000000 | 1 << k for k in range(32)]
    made = spark.createDataFrame([(1, 0, signed(p), True) for p in prints], "place int, key long, fp long, home boolean")
    assert simhash.linked(made, 3).count() == 31


def test_long_text_in_pieces():
    rnd = random.Random(1)
    text = " ".join(rnd.choices(["aa", "bb", "cc", "dé"], k=70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == "0" * 16 and by_id[2].component_id == 1
    assert by_id[None].component_id is None and by_id[None].fingerprint == f"{plain_fingerprint('some text here'):016x}"
    assert by_id[4].component_id == by_id[5].component_id == 4
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 4, 6]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(rnd.choices("abcdefghijk", k=60)) for _ in range(3))
    made = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (1, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(made).collect()) == [(1, 1), (3, 3), (5, 3), (5, 3), (9, 3)]
