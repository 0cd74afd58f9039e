"""Line dedup (1): range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Every line of every document becomes a row (128-bit key hash, doc_id, row key, position). The rows are
range-partitioned by (hash, doc_id) and sorted within partitions by (hash, doc_id descending,
position), so a very frequent line spreads over as many partitions as it needs. Each partition is
streamed with memory for ``min_docs - 1`` documents: the first document of a hash run is the
keeper, the lines of later ones are dropped as soon as the run has ``min_docs`` documents. Runs
that touch a partition's edge may continue in a neighbour; their rows are settled by one small
aggregate (at most two hashes a partition). The result is a compressed bitmap per document (doc_id
and a hash of the text, so that rows which share an id have bitmaps of their own); no text is shuffled
until the bitmaps are applied, and then only texts that lose lines.

Defined edge cases: a null or empty text is one empty line; a null ``doc_id`` row keeps all its
lines and is not counted; rows that repeat a ``doc_id`` count as one document, and each row loses
lines by its own text; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import byte_column, cut, is_broadcast, scratch, slices, small_side, utf8

LINE_SCHEMA = "h1 long, h2 long, doc_id long, row_key long, pos int"
#: Keys broadcast at most: an edge run or two for each partition, and runs of over 100,000 rows.
MOST_OPEN = 200_000
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The comparison key of a UTF-8 line: stripped, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return line.strip(STRIP).lower()


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def row_key():
    """Tells rows of one doc_id apart: a hash of the text, the same wherever it is computed."""
    return F.xxhash64(F.col("text").cast("string"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, ids, rows, places = [], [], [], []
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), byte_column(batch, "text"), strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and code_points(key) >= min_chars:
                            digests.append(xxhash.xxh3_128_digest(key))
                            ids.append(doc_id)
                            rows.append(row)
                            places.append(pos)
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "row_key", "pos"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return kept.mapInArrow(scan, LINE_SCHEMA)


def stream_runs(min_docs: int, most_rows: int = 100_000):
    """Streams a sorted partition: yields the dropped lines of its inner runs, and every row of its
    first and last run and of runs over ``most_rows`` as open (to be settled by an aggregate)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc_id", "row_key", "pos"]
        carry = None  # rows of the run that the last batch ended in
        leading = True  # the carried run (or the next one) is the partition's first
        is_open = False  # earlier rows of the carried run went out as open

        def out(cols, mask, open_run):
            kept = [x[mask] for x in cols]
            return pa.RecordBatch.from_arrays([*map(pa.array, kept), pa.array(np.full(len(kept[0]), open_run))], [*names, "open"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            h1, h2, ids = cols[:3]
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            run = np.cumsum(new_run) - 1
            runs = run[-1] + 1
            if runs > 1:
                new_doc = new_run | np.r_[True, ids[1:] != ids[:-1]]
                docs = np.bincount(run, new_doc, runs)
                nth = np.cumsum(new_doc)
                rank = nth - nth[np.flatnonzero(new_run)][run] + 1
                open_first = (run == 0) & (leading or is_open)
                drop = (docs[run] >= min_docs) & (rank > 1) & (run < runs - 1) & ~open_first
                yield out(cols, drop, False)
                if open_first.any():
                    yield out(cols, open_first, True)
                leading = is_open = False
            last = run == runs - 1
            carry = [x[last] for x in cols]
            if len(carry[0]) > most_rows:
                yield out(carry, slice(1, None), True)
                carry, is_open = [x[:1] for x in carry], True  # one row stands for the key
        if carry is not None:
            yield out(carry, slice(None), True)

    return scan


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row_key, pos) of every line that loses to a copy in a document with a larger doc_id."""
    lines = cut(line_hashes(docs, min_chars), "line_hashes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "row_key", "pos")
    seen = cut(dealt.mapInArrow(stream_runs(min_docs), LINE_SCHEMA + ", open boolean"), "line_runs")
    unsettled = seen.where("open")
    frequent = unsettled.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    frequent = cut(frequent, "open_lines")
    if frequent.count() <= MOST_OPEN:
        frequent = F.broadcast(frequent)
    late = unsettled.join(frequent, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "row_key", "pos")
    return seen.where("not open").select("doc_id", "row_key", "pos").unionByName(late)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row_key, n_dropped, bitmap) of the documents that lose lines.

    ``bitmap`` is zlib-compressed: bit ``pos`` (most significant first) is 1 where a line is dropped;
    lines past its end stay.
    """

    @F.pandas_udf("binary")
    def pack(positions):
        def one(pos):
            bits = np.zeros(int(max(pos)) + 1, np.uint8)
            bits[np.asarray(pos, np.int64)] = 1
            return zlib.compress(np.packbits(bits).tobytes(), 6)

        return positions.map(one)

    grouped = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("pos"))
    return grouped.select("doc_id", "row_key", F.size("pos").cast("long").alias("n_dropped"), pack("pos").alias("bitmap"))


def surviving(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int, int]:
    """The lines that stay, the number of all lines, the number of dropped ones."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=None)[: len(lines)]
    stay = np.ones(len(lines), bool)
    stay[: len(bits)] = bits == 0
    kept = [x for x, y in zip(lines, stay, strict=True) if y]
    return kept, len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """All columns of ``docs`` and ``__map``, the bitmap of a row that loses lines (else null).

    The ids of such rows are broadcast up to ``common.MOST_IDS``, and only their texts are shuffled to
    meet the bitmaps; beyond that bound all are.
    """
    with scratch(docs.sparkSession) as keep:
        maps, _ = keep(keep_bitmaps(docs, min_chars, min_docs), "bitmaps")
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__row": row_key()})
    same = lambda left: (left["__id"] == maps["doc_id"]) & (left["__row"] == maps["row_key"])
    names = [keyed[c] for c in docs.columns]
    few = small_side(maps.select(F.col("doc_id").alias("__hit")).distinct(), "bitmap_ids")
    if not is_broadcast(few):
        return keyed.join(maps, same(keyed), "left").select(*names, maps["bitmap"].alias("__map"))
    hit = keyed.join(few, keyed["__id"] == few["__hit"], "left_semi")
    rest = keyed.join(few, keyed["__id"] == few["__hit"], "left_anti").select(*docs.columns, F.lit(None).cast("binary").alias("__map"))
    return hit.join(maps, same(hit), "left").select(*[hit[c] for c in docs.columns], maps["bitmap"].alias("__map")).unionByName(rest)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents joined to their bitmaps: doc_id, text (kept lines), n_lines, n_dropped."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def apply(batches):
        for batch in slices(batches):
            done = [surviving(t, m) for t, m in zip(byte_column(batch, "text"), batch.column("__map").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b"\n".join(k) for k, _, _ in done], pa.binary()).cast(pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([d for _, _, d in done], pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    return with_bitmaps(base, min_chars, min_docs).mapInArrow(apply, "doc_id long, text string, n_lines long, n_dropped long")


def without_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents without their dropped lines, all columns; ``n_chars`` (if there) follows the text."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([x if m is None else b"\n".join(surviving(utf8(x), m)[0]).decode("utf-8", "surrogatepass") for x, m in zip(texts, bitmaps, strict=True)], dtype=object)

    joined = with_bitmaps(docs, min_chars, min_docs).withColumn("text", rest("text", "__map"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__map").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(docs.columns)


def digests(deduped: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_lines, n_dropped, kept_sha256."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
