"""Joins of work lists with page caches and collection ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_pages(wanted: DataFrame, cache: DataFrame, key: str = "page_key") -> DataFrame:
    """Every wanted row with its page's html (empty if missing) and ``cached``; empty pages count as missing."""
    found = cache.where(F.coalesce("html", F.lit("")) != "")
    joined = wanted.join(found, key, "left").withColumn("cached", F.col("html").isNotNull())
    return joined.withColumn("html", F.coalesce("html", F.lit("")))


def pending_urls(wanted: DataFrame, cache: DataFrame, key: str = "page_key", limit: int | None = None) -> DataFrame:
    """Wanted rows that are not cached yet, at most ``limit``."""
    rest = wanted.join(cache.select(key), key, "left_anti")
    return rest if limit is None else rest.limit(limit)


def ledger_status(ledger: DataFrame) -> DataFrame:
    """One row: distinct URLs attempted, rows that succeeded, distinct URLs that did."""
    ok = F.col("status") == "ok"
    return ledger.agg(F.countDistinct("url").alias("attempted"), F.count_if(ok).alias("ok_rows"), F.countDistinct(F.when(ok, F.col("url"))).alias("ok_urls"))


def drop_stale_failures(ledger: DataFrame) -> DataFrame:
    """The successful rows."""
    return ledger.where(F.col("status") == "ok")


def ledger_pending(wanted: DataFrame, ledger: DataFrame, cap: int, newest_first: bool = True) -> DataFrame:
    """URLs not attempted yet, by position, at most ``cap`` less the successes so far."""
    room = max(0, cap - ledger.where("status = 'ok'").count())
    rest = wanted.join(ledger.select("url"), "url", "left_anti")
    return rest.orderBy(F.col("pos").desc() if newest_first else F.col("pos").asc()).limit(room)
