"""Benchmark decontamination (8): spaced seeds.

Texts become lower-case words without marks. A seed mask picks some positions of a short run of words
and ignores the others, so a substituted word does not hide a match.

1. The benchmark's seeds are a table of (hash, item, place). A Bloom filter of their hashes, of at most
   2^``FILTER_BITS`` bits whatever the benchmark, is put together by a grouped OR and broadcast.
2. Every placing of every mask in every document is hashed; those that pass the filter become rows and are joined
   to the seeds by hash. Very frequent hashes are split. What the filter lets through in error goes here.
3. The hits of a text and an item are reduced to their diagonals. Text and item are compared along each:
   the best-scoring stretch (a match counts +1, a mismatch -1) is a verified overlap, and so are the
   best ones of what is left before and after it. Only texts with hits are shuffled, once for each distinct text
   and block of ``BLOCK`` items.

A document holds an item if its overlaps (at least ``MIN_RUN`` matching words each) together match
``min_words`` words of it, or ``min_share`` of it and at least ``short_words``, or all of it. An item of
under ``MIN_RUN`` words, too short to be told from ordinary prose, is held only by a document that consists
of it.

Defined edge cases: null and empty texts and items have no words and match nothing; a null item_id is an item
like any other; repeated items (equal id and text) count once; repeated documents give a row each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, hot_join, is_broadcast, marked_small, mix64, scratch, slices, small_side

WORD = re.compile(r"\w+")
#: Fixed masks: 1 is read, 0 is ignored. The last two pass over every third and every fourth word.
MASKS = ("11111", "1101011", "11100101", "1011011", "111011")
MIN_RUN = 5
WHOLE = len(MASKS)  # number of the seed of a text of under MIN_RUN words
FILTER_BITS, FILTER_TESTS = 25, 3
#: Items that are verified against a text at a time.
BLOCK = 64
#: Seeds and items that are broadcast at most (about 50 MB); more are joined by shuffle.
MOST_SEEDS, MOST_ITEMS = 1_000_000, 100_000


class WordCodes(dict):
    """64-bit hashes of words; a bounded per-process memo."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each placing of a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for k, read in enumerate(mask):
        if read == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[k : k + n]
    return mix64(out)


def text_seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The seeds of a text by mask, and the words that a mask spans."""
    if 0 < len(words) < MIN_RUN:
        yield seeds(words, "1" * len(words), WHOLE + len(words)), len(words)
    for number, mask in enumerate(MASKS):
        yield seeds(words, mask, number), len(mask)


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, words (hashes) of every distinct item with words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches):
            found = [codes.array(split_words(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("item_id"), pa.array(found, pa.list_(pa.int64()))], ["item_key", "item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    keyed = items.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text")
    return keyed.mapInArrow(scan, "item_key long, item_id long, words array<long>").where("size(words) > 0")


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, item_key, place): the seeds of the items of ``item_words``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, words in zip(batch.column("item_key").to_pylist(), batch.column("words").to_pylist(), strict=True):
                parts = [x for x, _ in text_seeds(np.array(words, np.int64).view(np.uint64))]
                places = np.concatenate([np.arange(len(x), dtype=np.int32) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.full(len(places), key, np.int64)), pa.array(places)], ["h", "item_key", "place"])

    return items.select("item_key", "words").mapInArrow(scan, "h long, item_key long, place int")


def filter_slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The slots of each hash in a Bloom filter of 2^``bits``."""
    for _ in range(FILTER_TESTS):
        yield hashes >> np.uint64(64 - bits)
        hashes = hashes * np.uint64(0xC2B2AE3D27D4EB4F)


def bloom_filter(found: DataFrame, n: int) -> tuple[bytes, int]:
    """The filter of ``n`` seeds, a bit for each slot, and its number of bits as a power of two."""
    bits = min(FILTER_BITS, max(16, (32 * n).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            places = np.concatenate(list(filter_slots(hashes, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["slot", "mask"])

    grouped = found.select("h").mapInArrow(slots, "slot int, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    rows = grouped.toPandas()  # at most 2^(FILTER_BITS - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return table.tobytes(), bits


def text_key():
    """Equal texts are searched once."""
    return F.xxhash64(F.col("text").cast("string"))


def filtered_seeds(docs: DataFrame, bloom: tuple[bytes, int], most_words: int = 200_000) -> DataFrame:
    """(text_key, h, pos): the placings of masks in documents that pass the filter.

    Texts are hashed together, up to ``most_words`` words at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # at most 2^FILTER_BITS bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits = shared.value
        table = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        codes = WordCodes()
        keys, ends, words = [], [], []

        def passing() -> pa.RecordBatch:
            hashes, stops = codes.array(words), np.array(ends, np.int64)
            starts = np.r_[0, stops[:-1]]
            found = [(seeds(hashes, mask, number), len(mask)) for number, mask in enumerate(MASKS)]
            outs = []
            for k in np.flatnonzero((stops - starts < MIN_RUN) & (stops > starts)).tolist():
                h = next(text_seeds(hashes[starts[k] : stops[k]]))[0]
                if all(table[x[0]] for x in filter_slots(h, bits)):
                    outs.append((np.array([k]), h, np.array([0])))
            for h, width in found:
                at = np.flatnonzero(table[h >> np.uint64(64 - bits)])
                at = at[np.logical_and.reduce([table[x] for x in filter_slots(h[at], bits)])]
                text = np.searchsorted(stops, at, "right")
                inside = at + width <= stops[text]
                at, text = at[inside], text[inside]
                outs.append((text, h[at], at - starts[text]))
            text, h, pos = (np.concatenate(c) for c in zip(*outs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[text]), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(pos.astype(np.int32))], ["text_key", "h", "pos"])

        for batch in slices(batches):
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words += split_words(text)
                keys.append(key)
                ends.append(len(words))
                if len(words) > most_words:
                    yield passing()
                    keys, ends, words = [], [], []
        if words:
            yield passing()

    return docs.select(text_key().alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "text_key long, h long, pos int")


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch with the highest score."""
    sums = np.r_[0, np.cumsum(np.where(same, 1, -1))]
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def stretches(same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the best stretch, then of the best ones before and after it, of at least ``MIN_RUN`` matches each."""
    parts = [(0, len(same))]
    while parts:
        a, b = parts.pop()
        if same[a:b].sum() < MIN_RUN:
            continue
        start, end = best_stretch(same[a:b])
        if same[a + start : a + end].sum() >= MIN_RUN:
            yield a + start, a + end
        parts += [(a, a + start), (a + end, b)]


def overlaps(words: np.ndarray, item: np.ndarray, offsets: list[int]) -> tuple[int, int, int]:
    """Matched words of the item over all diagonals, and the words of the document that they span."""
    if len(item) < MIN_RUN:
        return (len(item), 0, len(item) - 1) if np.array_equal(words, item) else (0, 0, -1)
    covered, first, last = np.zeros(len(item), bool), len(words), -1
    for offset in sorted(offsets):
        a, b = max(0, -offset), min(len(item), len(words) - offset)
        same = words[a + offset : b + offset] == item[a:b]
        for start, end in stretches(same):
            covered[a + start : a + end] |= same[start:end]
            first, last = min(first, a + start + offset), max(last, a + end + offset - 1)
    return int(covered.sum()), first, last


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_key, item_key, offsets): pairs of a text and an item that share a seed, and their diagonals."""
    found = cut(item_seeds(items).distinct(), "item_seeds")
    hits = cut(filtered_seeds(docs, bloom_filter(found, found.count())), "seed_hits")
    known = small_side(found, "item_seeds", MOST_SEEDS)
    met = hits.join(known, "h") if is_broadcast(known) else hot_join(hits, known, ["h"], ["text_key", "pos"])
    return met.groupBy("text_key", "item_key").agg(F.collect_set(F.col("pos") - F.col("place")).alias("offsets"))


def held_items(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.5, short_words: int = 8) -> DataFrame:
    """text_key, item_id, matched_words, item_words, first_word, last_word: the items that a distinct text holds."""
    items = cut(item_words(benchmark), "items")
    pairs = cut(candidates(docs, items), "seed_pairs")
    known = small_side(items, "items", MOST_ITEMS)
    named = pairs.join(known, "item_key") if is_broadcast(known) else hot_join(pairs, known, ["item_key"], ["text_key"])
    nth = F.row_number().over(Window.partitionBy("text_key").orderBy("item_key"))
    blocks = named.withColumn("block", F.floor((nth - 1) / BLOCK)).groupBy("text_key", "block").agg(F.collect_list(F.struct("item_id", "words", "offsets")).alias("found"))
    needed = small_side(pairs.select("text_key").distinct(), "seed_texts")
    texts = docs.select(text_key().alias("text_key"), F.col("text").cast("string").alias("text")).join(needed, "text_key", "left_semi").dropDuplicates(["text_key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, 50):
            rows = []
            for key, text, found in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "found")), strict=True):
                words = codes.array(split_words(text))
                for hit in found:
                    item = np.array(hit["words"], np.int64).view(np.uint64)
                    matched, first, last = overlaps(words, item, hit["offsets"])
                    if matched >= min_words or (matched >= short_words and matched >= min_share * len(item)) or matched == len(item):
                        rows.append((key, hit["item_id"], matched, len(item), first, last))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_key", "item_id", "matched_words", "item_words", "first_word", "last_word"])

    return texts.join(blocks, "text_key").select("text_key", "text", "found").mapInArrow(verify, "text_key long, item_id long, matched_words long, item_words long, first_word long, last_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, first_word, last_word: one row for each document and benchmark
    item that it holds. ``limits`` as ``held_items``."""
    held = cut(held_items(docs, benchmark, **limits), "held_items")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    keys = small_side(held.select("text_key").distinct(), "held_texts")
    return hot_join(cut(base.join(keys, "text_key", "left_semi"), "held_docs"), held, ["text_key"], ["doc_id"]).drop("text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents whose text holds no benchmark item, all columns, with or without an id."""
    with scratch(docs.sparkSession) as keep:
        held, _ = keep(held_items(docs, benchmark, **limits).select(F.col("text_key").alias("__key")).distinct(), "held")
    return docs.join(marked_small(held), text_key() == F.col("__key"), "left_anti")
