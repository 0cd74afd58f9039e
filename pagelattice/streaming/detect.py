"""The detection stream: certificate messages to candidates, once each, scored against a page cache.

Structured Streaming throughout. State is bounded by a watermark: a domain is remembered for
``remember`` and then forgotten.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators.feeds import annotate_hits
from pagelattice.sources.files import hits_sink
from pagelattice.tables import cut, shared_dir

CERT_SCHEMA = "message_type string, data struct<leaf_cert:struct<all_domains:array<string>>>"


def _candidates(rows: DataFrame, domains: Column, keep: list[str]) -> DataFrame:
    found = rows.select(*keep, F.explode(domains).alias("domain")).withColumn("domain", F.trim("domain"))
    return found.where("domain <> '' and not contains(domain, '*')").withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/")))


def cert_candidates(messages: DataFrame, *keep: str) -> DataFrame:
    """(domain, url) of certificate updates in a column ``value`` of JSON; wildcards, blanks and broken messages drop out."""
    parsed = messages.withColumn("m", F.from_json("value", CERT_SCHEMA)).where("m.message_type = 'certificate_update'")
    return _candidates(parsed, F.col("m.data.leaf_cert.all_domains"), list(keep))


def ct_log_candidates(records: DataFrame, *keep: str) -> DataFrame:
    """(domain, url) of log records with newline-separated names in ``name_value``."""
    return _candidates(records, F.split("name_value", "\n"), list(keep))


def dedup_stream(rows: DataFrame, key: str = "domain", time: str = "ts", remember: str = "1 hour") -> DataFrame:
    """Each key once within ``remember`` of event time; works on streams (bounded state) and batches."""
    if rows.isStreaming:
        return rows.withWatermark(time, remember).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def windowed_counts(rows: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candidates a window, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"))


def enrich_and_score(batch: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.5) -> DataFrame:
    """Positive rows of a candidate batch: joined to cached pages with html, scored by ``score`` (url, html -> url, score)."""
    pages = batch.join(cache.where("coalesce(html, '') <> ''"), "url")
    return score(pages).where(F.col("score") >= threshold).withColumn("prediction", F.lit("phish"))


def message_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A JSON file stream. ``max_files`` or ``max_bytes`` bound what a micro-batch takes: the rate limit with a processing interval."""
    source = spark.readStream.schema(schema)
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        source = source.option(name, value) if value is not None else source
    return source.json(path)


class FeedSnapshot:
    """The feeds as last read: a written copy, taken anew once it is ``refresh`` seconds old. A read that
    fails leaves the old copy in use; only the first one must succeed."""

    def __init__(self, feeds_of: Callable[[], DataFrame], refresh: float = 900.0, clock: Callable[[], float] = time.monotonic):
        self.feeds_of, self.refresh, self.clock = feeds_of, refresh, clock
        self.held: DataFrame | None = None
        self.read_at = 0.0

    def current(self) -> DataFrame:
        if self.held is None or self.clock() - self.read_at >= self.refresh:
            try:
                self.held, self.read_at = cut(self.feeds_of(), "feeds"), self.clock()
            except Exception:
                if self.held is None:
                    raise
        return self.held


def run_detection(
    candidates: DataFrame,
    cache_of: Callable[[], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    feeds_of: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    threshold: float = 0.5,
    refresh: float = 900.0,
    interval: str | None = None,
):
    """Starts the job: per micro-batch the cache is read anew, positives are annotated from the feeds' snapshot and written to
    ``sink`` (Parquet, a folder for each batch, so a batch tried again leaves its hits once). Takes all available data and ends, or
    with ``interval`` goes on at that pace."""
    feeds = FeedSnapshot(feeds_of, refresh)

    def work(batch: DataFrame, number: int) -> None:
        hits = enrich_and_score(batch, cache_of(), score, threshold).withColumnRenamed("ts", "ts_detected")
        hits_sink(annotate_hits(hits, feeds.current()), sink, number)

    pace = {"processingTime": interval} if interval else {"availableNow": True}
    return candidates.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**pace).start()


def run_until(query, seconds: float) -> bool:
    """Waits for a stream's end for at most ``seconds``, then stops it; the running micro-batch is tried again at the next
    start. Returns whether it had ended by itself."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False


def event_messages(events: DataFrame) -> DataFrame:
    """Events as certificate messages: (ts, value)."""
    domain = F.concat(F.lit("u"), F.col("user_id"), F.lit(".test"))
    names = F.array(domain, F.concat(F.lit("*."), domain), F.lit(""))
    body = F.to_json(F.struct(F.when(F.col("event_type") == "click", "heartbeat").otherwise("certificate_update").alias("message_type"), F.struct(F.struct(names.alias("all_domains")).alias("leaf_cert")).alias("data")))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), body.alias("value"))


def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, url) that a stream over the event table yields: a file stream run to its end into a Parquet sink."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = f"{shared_dir(spark)}/cert-stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    found = dedup_stream(cert_candidates(event_messages(source), "ts"), remember="60 days").select("domain", "url")
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("domain string, url string").parquet(f"{folder}/out")
