"""SimHash near-dedup (11): 64-bit fingerprints linked at few differing bits, by multi-index hashing.

1. One pass over the texts: a bit of the fingerprint is set if it is set in over half of the XXH64 hashes (seed 42) of the
   document's 3-word shingles, repeats included. Documents with equal fingerprints are one class from here on.
2. The fingerprint is cut into two segments. Two fingerprints that differ in at most three bits differ in at most
   one bit in one of the segments, so each is stored in a table by segment value (its home rows), and looks up the Hamming ball of
   radius one around each of its segments (its visiting rows). Of two segments one bit apart one has an even number of
   bits, so only those enumerate their ball.
3. Home rows and visitors of a table entry meet in one sorted group; complete distances are verified, and a group emits a forest
   of its links, never all its pairs.
4. An entry with over ``MOST`` rows is cut again by the halves of the bits that its key leaves open, with the same enumeration:
   keys of 32, 48 and 56 bits. Fingerprints are distinct, so at most 256 of them share 56 bits: groups stay
   small however many documents share a segment, and no link is lost.
5. Components of the links.

Defined edge cases: a null text, or one without words, has fingerprint zero and is linked like any other; under three words
are one shingle; rows that repeat a doc_id are one node, whatever their texts, and each is returned; rows with
a null doc_id get their fingerprint and a null component, and link nothing; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import byte_column, cut, hot_join, is_broadcast, marked_small, slices, small_side
from pagelattice.llm.components import components

WIDTH, SEED, BITS = 3, 42, 3
#: Rows of a table entry beyond which it is cut again.
MOST = 4000


def shingle_hashes(text: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text (A-Z lower-cased), in arrays of bounded length."""
    words = text.lower().split()
    if not words:
        return
    width = min(width, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 1 << 16):
        pairs = zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of a text, unsigned; zero without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(text, width) for text in byte_column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(scan, "doc_id long, fp long")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: The segments a key may fix: each is (its place in the tree of halves, lowest bit, number of bits). Place 1 is the whole
#: fingerprint; places 2k and 2k + 1 are the upper and lower half of what the key of place k leaves open.
def halves(low: int, bits: int) -> list[tuple[int, int]]:
    return [(low + bits // 2, bits // 2), (low, bits // 2)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def enumerated(rows: DataFrame, low: int, bits: int, place: int) -> DataFrame:
    """(place, key, fp, home): rows cut by both halves of the bits [low, low + bits), which their keys leave open.

    A home row goes home in its own half, and visits those one bit away if its half has an even number of bits set; a
    visiting row visits in all of the ball.
    """
    out = None
    for k, (at, n) in enumerate(halves(low, bits)):
        mask = ((1 << n) - 1) << at
        own = F.col("fp").bitwiseAND(F.lit(_long(mask)))
        even = F.bit_count(own) % 2 == 0
        flips = F.array(*(F.lit(_long(1 << (at + b))) for b in range(n)))
        away = F.when(~F.col("home") | even, flips).otherwise(F.array().cast("array<long>"))
        flip = F.explode(F.concat(F.array(F.lit(0).cast("long")), away)).alias("flip")
        cut_up = rows.select("key", "fp", "home", own.alias("own"), flip)
        # At the whole fingerprint the key is empty; deeper keys hold the bits fixed so far.
        key = F.col("key").bitwiseOR(F.col("own").bitwiseXOR(F.col("flip")))
        part = cut_up.select(F.lit(2 * place + k).alias("place"), key.alias("key"), "fp", (F.col("home") & (F.col("flip") == 0)).alias("home"))
        out = part if out is None else out.unionByName(part)
    return out


def linked(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): for each (place, key), a forest of the links between home rows and all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "place", "key").sortWithinPartitions("place", "key", F.col("home").desc())

    def forest(fps: np.ndarray, homes: int) -> Iterator[tuple[int, int]]:
        """Links of the first ``homes`` fingerprints with all, but for those inside what is already connected."""
        tree, plain = np.arange(len(fps)), fps.view(np.uint64)
        for k in range(homes):
            near = np.flatnonzero(np.bitwise_count(plain ^ plain[k]) <= bits)
            roots = tree[near]
            if (roots == roots[0]).all():
                continue
            found, first = np.unique(roots, return_index=True)
            for at in near[first[found != tree[k]]]:
                yield int(fps[k]), int(fps[at])
            tree[np.isin(tree, found)] = tree[k]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group, which the next batch may go on with

        def links(place, key, fp, home) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
            ends = np.r_[starts[1:], len(key)]
            # A group is worth a look if it has two rows and its first is at home.
            busy = home[starts] & (ends - starts > 1)
            pairs = [p for a, b in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True) for p in forest(fp[a:b], int(home[a:b].sum()))]
            left, right = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "key", "fp", "home")]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            differ = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            last = differ[-1] + 1 if len(differ) else 0
            held = [c[last:] for c in now]
            if last:
                yield links(*(c[:last] for c in now))
        if held is not None and len(held[0]):
            yield links(*held)

    return dealt.mapInArrow(scan, "a long, b long")


def hot_keys(rows: DataFrame, most: int) -> DataFrame:
    """(place, key, hot) of the entries with over ``most`` rows."""
    counted = rows.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return small_side(counted.select("place", "key", F.lit(True).alias("hot")), "hot_entries")


def hot_segments(classes: DataFrame, most: int) -> DataFrame:
    """``hot_keys`` of the first cut, without making its visiting rows: an entry's visitors are at home in its neighbours, and the
    neighbours of under ``most`` / 64 home rows have at most half of ``most`` together."""
    own = F.explode(F.array(*(F.struct(F.lit(2 + k).alias("place"), F.col("fp").bitwiseAND(F.lit(_long(((1 << n) - 1) << at))).alias("key")) for k, (at, n) in enumerate(halves(0, 64)))))
    heavy = cut(classes.select(own.alias("own")).groupBy("own.place", "own.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most // 64), "heavy_segments")
    ball = {2 + k: F.array(*(F.lit(_long(1 << (at + b))) for b in range(n))) for k, (at, n) in enumerate(halves(0, 64))}
    flip = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("place") == 2, ball[2]).otherwise(ball[3])))
    met = heavy.select("place", "key", "n", flip.alias("flip")).groupBy("place", F.col("key").bitwiseXOR(F.col("flip")).alias("key")).agg(F.sum("n").alias("n"))
    return small_side(met.where(F.col("n") > most // 2).select("place", "key", F.lit(True).alias("hot")), "hot_entries")


def links(classes: DataFrame, bits: int = BITS, most: int | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) at ``bits`` or fewer differing bits, enough to connect all that
    are linked."""
    if not 0 <= bits <= 3:
        raise ValueError("balls of radius one around two segments find up to three differing bits")
    most = MOST if most is None else most
    # Bits that the key of a place leaves open, from the whole fingerprint down.
    open_bits = {1: (0, 64)}
    for place in range(1, 8):
        low, n = open_bits[place]
        upper, lower = halves(low, n)
        open_bits[2 * place], open_bits[2 * place + 1] = lower, upper
    todo, found = {1: classes.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(True).alias("home"))}, []
    for level in range(3):
        rows = None
        for place, open_rows in todo.items():
            made = enumerated(open_rows, *open_bits[place], place)
            rows = made if rows is None else rows.unionByName(made)
        if level == 2:
            found.append(linked(rows, bits))
            break
        hot = hot_keys(rows, most) if level else hot_segments(classes, most)
        if hot.isEmpty():
            found.append(linked(rows, bits))
            break
        marked = rows.join(hot, ["place", "key"], "left")
        found.append(linked(marked.where("hot is null").drop("hot"), bits))
        again = cut(marked.where("hot").drop("hot"), "hot_rows")
        todo = {place: again.where(F.col("place") == place).select("key", "fp", "home") for place in range(2 << level, 4 << level)}
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included)."""
    signed = cut(fingerprints(docs, width), "fingerprints")
    known = signed.where("doc_id is not null")
    classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "fingerprint_classes")
    # Rows that share a doc_id are one node: their classes are linked as well.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("doc_id", "a")
    same_id = known.join(small_side(several, "repeated_ids"), "doc_id").select("a", F.col("fp").alias("b"))
    labels = components(links(classes, bits).unionByName(same_id))
    placed = cut(classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first", "last", F.coalesce("component", "fp").alias("root")), "placed")
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Only fingerprints with copies or links have a component other than their own document.
    groups = placed.where("first < last").select("root").unionByName(lowest.where("n > 1").select("root")).distinct()
    named = hot_join(placed, lowest.join(groups, "root", "left_semi").select("root", "component_id"), ["root"], ["fp"])
    shared = marked_small(cut(named.select("fp", "component_id"), "shared_fingerprints"))
    if is_broadcast(shared):
        out = signed.join(shared, "fp", "left")
    else:
        alone = signed.join(shared, "fp", "left_anti").withColumn("component_id", F.lit(None).cast("long"))
        out = hot_join(signed, shared, ["fp"], ["doc_id"]).unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), component.alias("component_id"))


def keep_first(docs: DataFrame, **limits) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows without an id stay; all columns."""
    gone = near_duplicates(docs, **limits).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(small_side(gone, "gone"), docs["doc_id"] == F.col("__gone"), "left_anti")
