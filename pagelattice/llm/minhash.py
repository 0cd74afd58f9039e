"""MinHash near-dedup (6): one-permutation hashing, optimal densification, banded buckets, stars.

1. One pass over the texts: the distinct 5-word shingles of a document are hashed once; bin k of the
   hash range keeps its smallest hash, and an empty bin borrows from the bin that a fixed random
   sequence of its own finds first (optimal densification). ``bands`` groups of ``rows`` bins give
   bucket keys.
2. Documents with equal shingle sets are one class, represented by the smallest doc_id.
3. A bucket's candidate edges form a star: its hub, the member that meets most documents over all its
   buckets, is compared with the others. Confirmed edges give components. The members that the hub did not reach
   form further stars among themselves, round by round, as long as these find links; so a group of copies takes
   pairs in proportion to its size, whether or not the hub is one of them. In the last round those members are compared
   with members of other components, in blocks. After that no pair of a bucket is both unconnected and uncompared.
   Buckets of over ``MOST_IN_TASK`` members are dealt over several tasks in every step.
   Pairs are left out before any text is read if their set sizes exclude the similarity, if their odd
   sketches do (each shingle flips one of ``ODD_BITS`` bits, so two sketches differ in at most as many
   bits as the sets differ in shingles: an exact test), or, for sets too large for that, if their
   one-bit signatures differ in more than ``MOST_BITS`` of the bins (at similarity 0.75 that is over
   six standard deviations away).
4. Each candidate pair is confirmed on the full shingle sets, recomputed from the two texts: a hub's text
   leads a block of its partners' texts, so it is sent once for ``PARTNERS`` pairs.
5. Components of the confirmed links.

With 45 bands of 5 rows a pair of similarity 0.75 shares no bucket with probability
(1 - 0.75^5)^45 = 5e-6.

Defined edge cases: a null text, or one without words, has an empty set and no links; a document of
under five words is one shingle; equal sets are linked (similarity 1); rows with a null doc_id get
their shingle count, a null component and stay; rows that repeat a doc_id are one node and each is
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import WordHasher, byte_column, cut, hot_join, marked_small, mix64, rolling, scratch, slices, small_side
from pagelattice.llm.components import components

WIDTH = 5


def shingles(text: bytes, hasher: WordHasher, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = hasher.array(words)
    return np.unique(rolling(hashes, min(width, len(words))))


def probe_sequences(bins: int, tries: int = 1024) -> np.ndarray:
    """For each attempt and bin, the bin to borrow from: fixed for all documents."""
    n = np.arange(tries * bins, dtype=np.uint64)
    return (mix64(n + np.uint64(0x1234567)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def one_permutation(found: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """The densified signature of a non-empty sorted set of hashes: one hash for each bin."""
    width = np.uint64((1 << 64) // bins + 1)
    edges = np.arange(bins, dtype=np.uint64) * width
    first = np.searchsorted(found, edges)
    last = np.r_[first[1:], len(found)]
    full = first < last
    values = found[np.minimum(first, len(found) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        out = values.copy()
        for guess in probes:
            source = guess[empty]
            hit = full[source]
            out[empty[hit]] = values[source[hit]]
            empty = empty[~hit]
            if not len(empty):
                break
        out[empty] = found[0]
        values = out
    return values


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    powers = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(rows)], np.uint64)
    mixed = mix64(signature).reshape(bands, rows) * powers
    return mix64(mixed.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


#: Share of differing signature bits beyond which a pair is not compared; 1 in 8 is expected at similarity 0.75.
MOST_BITS = 0.27
ODD_BITS = 1024
#: Sets shared by several documents that are broadcast at most (about 50 MB); more are joined by shuffle.
MOST_CLASSES = 500_000


def packed(bits: np.ndarray) -> np.ndarray:
    """0-1 values as longs."""
    data = np.packbits(bits.astype(np.uint8)).tobytes()
    return np.frombuffer(data.ljust(-(-len(data) // 8) * 8, b"\0"), np.int64)


def sketch(found: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """The odd sketch of a set, then one bit for each bin of its signature (equal hashes give equal bits)."""
    odd = np.bincount((found & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
    bits = mix64(signature + np.arange(len(signature), dtype=np.uint64)) & np.uint64(1)
    return np.r_[packed(odd), packed(bits)]


def signatures(docs: DataFrame, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), buckets, bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, probes = WordHasher(), probe_sequences(bands * rows)
        for batch in slices(batches):
            sizes, sets, keys, bits = [], [], [], []
            for text in byte_column(batch, "text"):
                found = shingles(text, hasher, width)
                signature = one_permutation(found, bands * rows, probes) if len(found) else None
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature, bands, rows) if len(found) else None)
                bits.append(sketch(found, signature) if len(found) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)], ["doc_id", "n_shingles", "set_hash", "buckets", "bits"]
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(scan, "doc_id long, n_shingles long, set_hash binary, buckets array<long>, bits array<long>")


#: Members of a bucket in one task, and partners that one copy of a hub's text is compared with.
MOST_IN_TASK, PARTNERS = 1000, 200


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose full shingle sets are ``percent`` % alike."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    needed = small_side(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair_ids")
    texts = cut(texts.join(needed, "id", "left_semi"), "pair_texts")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("blocks")).where("blocks > 1")
    blocked = pairs.join(small_side(hubs, "hubs"), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)).cast("int").alias("block"))
    heads = blocked.select("a", "block").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    others = blocked.join(texts.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(others).repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        place, mine = None, []  # rows that share the id of a hub: its texts
        for batch in slices(batches):
            left, right = [], []
            for a, block, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b")), byte_column(batch, "text"), strict=True):
                found = shingles(text, hasher, width)
                if b is None:
                    if place != (a, block):
                        place, mine = (a, block), []
                    mine.append(found)
                    continue
                for head in mine:
                    same = len(head) + len(found) - len(np.union1d(head, found))
                    if 100 * same >= percent * (len(head) + len(found) - same):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def slots(rows: DataFrame, size: str) -> DataFrame:
    """Rows of a bucket dealt over slots of about ``MOST_IN_TASK`` members by a hash of the id."""
    return rows.withColumn("slots", F.ceil(F.col(size) / MOST_IN_TASK).cast("int")).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int"))


def in_every_slot(rows: DataFrame) -> DataFrame:
    """Rows of a bucket, once for each of its ``slots``."""
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))


def bucket_members(heads: DataFrame) -> DataFrame:
    """(bucket, slot, slots, doc_id, hub) of the buckets with several members."""
    spread = heads.select("doc_id", F.explode("buckets").alias("bucket"))
    sizes = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket_sizes")
    large = small_side(sizes.where(F.col("size") > MOST_IN_TASK).select("bucket", F.col("size").alias("known")), "large_buckets")
    dealt = slots(spread.join(large, "bucket", "left").withColumn("known", F.coalesce("known", F.lit(1))), "known").drop("known", "slots")
    live = cut(dealt.join(in_every_slot(sizes.withColumn("slots", F.ceil(F.col("size") / MOST_IN_TASK).cast("int"))), ["bucket", "slot"]), "shared")
    # The hub is the member that meets most documents over all its buckets: of copies, the one they stem from.
    met = live.groupBy("doc_id").agg(F.sum("size").alias("met"))
    best = live.join(met, "doc_id").groupBy("bucket").agg(F.max(F.struct("met", -F.col("doc_id"))).alias("best"), F.first("slots").alias("slots"))
    hubs = in_every_slot(best.select("bucket", "slots", (-F.col("best")["col2"]).alias("hub"))).drop("slots")
    return cut(live.join(hubs, ["bucket", "slot"]).select("bucket", "slot", "slots", "doc_id", "hub"), "members")


class PairTest:
    """Sketches of the sets, and the condition under which a pair's sketches do not exclude the similarity."""

    def __init__(self, heads: DataFrame, percent: int, bins: int):
        n_odd, n_signed = ODD_BITS // 64, -(-bins // 64)
        differ = lambda first, n: " + ".join(f"bit_count(bits_a[{k}] ^ bits_b[{k}])" for k in range(first, first + n))
        self.alike = F.expr(
            f"""100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)
            and {100 + percent} * ({differ(0, n_odd)}) <= {100 - percent} * (size_a + size_b)
            and {differ(n_odd, n_signed)} <= {int(MOST_BITS * bins)}"""
        )
        self.heads = heads

    def side(self, name: str) -> DataFrame:
        return self.heads.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"size_{name}"), F.col("bits").alias(f"bits_{name}"))

    def passed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), each once with a hub as a, those to confirm."""
        pairs = cut(pairs.distinct(), "star_pairs")
        return hot_join(pairs.join(self.side("b"), "b"), self.side("a"), ["a"], ["b"], MOST_IN_TASK, pairs).where(self.alike).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = 45, rows: int = 5, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept."""
    signed = cut(signatures(docs, bands, rows, width), "signatures")
    classes = signed.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared_sets = small_side(classes.where("last > first").select("set_hash", "first"), "classes", MOST_CLASSES)
    named = signed.join(shared_sets, "set_hash", "left").withColumn("rep", F.when(F.col("set_hash").isNotNull(), F.coalesce("first", "doc_id")))
    of_head = lambda c: F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c)
    known = cut(named.select("doc_id", "n_shingles", "rep", of_head("buckets"), of_head("bits")), "classes")
    heads = known.where("doc_id = rep").select("doc_id", "n_shingles", "buckets", "bits")
    test = PairTest(heads, percent, bands * rows)

    # Rows that share a doc_id are one node: their classes are linked as well.
    same_id = known.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(heads.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    members = bucket_members(heads)
    tried = cut(test.passed(members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))), "pairs")
    links = cut(confirmed(tried, docs, percent, width).unionByName(same_id), "links")
    labels = cut(components(links), "labels")

    def with_components(rows: DataFrame, *names: str) -> DataFrame:
        for name in names:
            found = labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_comp"))
            rows = rows.join(found, name, "left").withColumn(f"{name}_comp", F.coalesce(f"{name}_comp", name))
        return rows

    def add(pairs: DataFrame) -> bool:
        """Confirms pairs; whether there were links among them."""
        nonlocal tried, links, labels
        fresh = pairs.selectExpr("least(a, b) as x", "greatest(a, b) as y", "a", "b").join(tried.selectExpr("least(a, b) as x", "greatest(a, b) as y"), ["x", "y"], "left_anti")
        fresh = cut(fresh.dropDuplicates(["x", "y"]).select("a", "b"), "pairs")
        if fresh.isEmpty():
            return False
        tried = tried.unionByName(fresh)
        more = cut(confirmed(fresh, docs, percent, width), "links")
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        labels = cut(components(links), "labels")
        return True

    # Members that their bucket's hub did not reach, and stars among those.
    left = cut(with_components(members, "doc_id", "hub").where("doc_id_comp <> hub_comp").select("bucket", "slot", "slots", "doc_id"), "unreached")
    left_over = left
    while not left_over.isEmpty():
        stars = left_over.groupBy("bucket").agg(F.min("doc_id").alias("star"), F.first("slots").alias("slots"))
        starred = cut(left_over.join(in_every_slot(stars).drop("slots"), ["bucket", "slot"]), "stars")
        pairs = with_components(starred, "doc_id", "star").where("doc_id_comp <> star_comp").select(F.col("star").alias("a"), F.col("doc_id").alias("b"))
        if not add(test.passed(pairs)):
            break
        left_over = cut(with_components(starred, "doc_id", "star").where("doc_id_comp <> star_comp").select("bucket", "slot", "slots", "doc_id"), "unreached")

    # What is left of them against the members of other components, in blocks: slots of members, each with all of them.
    placed = with_components(members.join(left.select("bucket").distinct(), "bucket", "left_semi"), "doc_id")
    outside = in_every_slot(with_components(left.drop("slot"), "doc_id")).select("bucket", "slot", F.col("doc_id").alias("a"), F.col("doc_id_comp").alias("comp_a")).join(test.side("a"), "a")
    others = placed.select("bucket", "slot", F.col("doc_id").alias("b"), F.col("doc_id_comp").alias("comp_b")).join(test.side("b"), "b")
    add(outside.join(others, ["bucket", "slot"]).where(F.expr("comp_a <> comp_b") & test.alike).select("a", "b"))

    named = known.join(labels, known["rep"] == labels["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **limits) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id; all columns."""
    with scratch(docs.sparkSession) as keep:
        gone, _ = keep(near_duplicates(docs, **limits).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(marked_small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT x AS node, x AS reached FROM ways UNION SELECT w.node, v.y FROM walk w JOIN ways v ON v.x = w.reached),
groups AS (SELECT node, min(reached) AS lowest FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(lowest, d.doc_id) AS component_id, coalesce(lowest, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN groups g ON g.node = d.doc_id
"""
