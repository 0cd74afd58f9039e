"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: U+0020 and U+0009 to U+000D (what ``bytes.split()`` splits at).
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pagelattice-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: For each open ``scratch``, the tables that were cut inside it.
_WRITTEN: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``cut`` has written, through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Yields ``keep``, a ``cut`` that also returns the path. All other tables cut inside are removed at the end, so
    nothing may read them later; if the work fails they stay for a look."""
    _WRITTEN.append([])
    kept = []

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        written = cut(df, name)
        kept.append(_WRITTEN[-1][-1])
        return written, kept[-1]

    try:
        yield keep
    except BaseException:
        _WRITTEN.pop()
        raise
    for path in _WRITTEN.pop():
        if path not in kept:
            remove(spark, path)
        elif _WRITTEN:
            _WRITTEN[-1].append(path)  # of the scope around this one


#: Rows of ids that are broadcast at most (16 MB); more are joined by shuffle.
MOST_IDS = 2_000_000


def small_side(rows: DataFrame, name: str, most: int = MOST_IDS) -> DataFrame:
    """Narrow ``rows`` written out, and marked for broadcast if there are at most ``most``."""
    return marked_small(cut(rows, name), most)


def marked_small(written: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` rows."""
    if written.count() > most:
        return written
    marked = F.broadcast(written)
    marked.small = True
    return marked


def is_broadcast(side: DataFrame) -> bool:
    """Whether ``small_side`` marked these rows for broadcast."""
    return getattr(side, "small", False)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], most: int = 50_000, counted_from: DataFrame | None = None) -> DataFrame:
    """Inner join on ``keys`` of narrow ``left`` rows with ``right`` rows, keys of over ``most`` left rows split.

    A hot key's left rows are dealt over slots by a hash of ``spread`` and its right rows are repeated in
    each slot. There are at most (left rows / ``most``) hot keys. ``counted_from`` has the left rows' keys where that is
    cheaper to count than ``left`` itself.
    """
    counted = (left if counted_from is None else counted_from).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    slots = small_side(counted.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__slots")), "hot_keys")
    if slots.isEmpty():
        return left.join(right, keys)
    dealt = left.join(slots, keys, "left").withColumn("__slot", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__slots")), F.lit(0)).cast("int")).drop("__slots")
    copies = right.join(slots, keys, "left").withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__slots") - 1, F.lit(0))))).drop("__slots")
    return dealt.join(copies, [*keys, "__slot"]).drop("__slot")


#: Bytes of a table up to which one of few files is dealt out; Spark splits the files of larger ones.
SMALL_TABLE = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; a small one of fewer files than there are cores is dealt out, so that all of them work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def bucket_of(doc_id: str, buckets: int, remainder: int):
    """True where crc32 of the id's decimal text leaves ``remainder``; null ids are never held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(buckets) == F.lit(remainder), F.lit(False))


class WordHasher(dict):
    """64-bit hashes of byte words; a bounded per-process memo."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbours, order-sensitive."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix64(out)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches, rows: int = 500):
    """Arrow batches in pieces of at most ``rows`` rows, so that what Python makes of a piece stays small."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def byte_column(batch, name: str) -> list:
    """A string column of an Arrow batch as Python bytes, without decoding; null is empty."""
    import pyarrow as pa

    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]
