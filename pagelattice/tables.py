"""Written intermediate tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); local sessions may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pagelattice-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Bytes of a table up to which one of few files is dealt out; Spark splits the files of larger ones.
SMALL_TABLE = 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; a small one of fewer files than there are cores is dealt out, so that all of them work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.path = path
    return written


def written_at(written: DataFrame) -> str:
    """The folder of a table that ``cut`` has written."""
    return written.path


def removed(written: DataFrame) -> None:
    """Removes the files of a table that ``cut`` has written and that nothing reads again."""
    jvm, path = written.sparkSession._jvm, written_at(written)
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bucketed(df: DataFrame, name: str, keys: list[str], least: int = 1) -> DataFrame:
    """``df`` written in as many buckets by ``keys`` as a shuffle has partitions, and ``least`` of them, so that joins and aggregates by them need none.

    The catalog entry is dropped at once; the files stay where ``cut`` would put them.
    """
    spark = df.sparkSession
    buckets = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entry = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", f"{shared_dir(spark)}/{entry}").saveAsTable(entry)
    written = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return written


#: Rows of a partition, about, inside ``spread``.
SPREAD_ROWS = 200_000
_PARTITIONS, _MERGED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside shuffles into a partition for each ``SPREAD_ROWS`` of ``rows``, and at least one a core. Spark merges partitions by
    their compressed bytes, which for rows that much repeat are many times fewer than those that a task sorts."""
    before = {k: spark.conf.get(k) for k in (_PARTITIONS, _MERGED)}
    spark.conf.set(_PARTITIONS, max(spark.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS)))
    spark.conf.set(_MERGED, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def where_they_lie(spark: SparkSession) -> Iterator[None]:
    """What is planned inside joins bucketed tables where they lie also by more keys than those of their buckets; else both sides are shuffled by all keys."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
