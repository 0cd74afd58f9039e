import json
import os

from pyspark.sql import functions as F

from pagelattice.streaming import detect


def message(*domains, kind="certificate_update"):
    return json.dumps({"message_type": kind, "data": {"leaf_cert": {"all_domains": list(domains)}}})


def test_candidates(spark):
    rows = spark.createDataFrame([(message("a.test", "*.b.test", ""),), (message("c.test", kind="heartbeat"),), ("{broken",), (None,)], "value string")
    assert [r.url for r in detect.cert_candidates(rows).collect()] == ["https://a.test/"]
    logs = spark.createDataFrame([("x.test\n*.y.test\n\n z.test ",)], "name_value string")
    assert {r.domain for r in detect.ct_log_candidates(logs).collect()} == {"x.test", "z.test"}


def test_detection_job_equals_the_batch(spark, tmp_path):
    for k, names in enumerate((["a.test", "b.test"], ["b.test", "c.test", "a.test"])):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{k}:00Z", "value": message(n)}) for n in names))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema("ts timestamp, value string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = detect.dedup_stream(detect.cert_candidates(source, "ts"))
    cache = spark.createDataFrame([("https://a.test/", "<p>bad</p>"), ("https://b.test/", "<p>good</p>"), ("https://c.test/", "")], "url string, html string")
    feed = spark.createDataFrame([("openphish", "https://a.test/")], "source string, url string").withColumn("first_seen", F.to_timestamp(F.lit("2024-01-01 00:10:00")))
    score = lambda pages: pages.withColumn("score", F.when(F.contains("html", F.lit("bad")), 0.9).otherwise(0.1))
    detect.run_detection(found, lambda: cache, score, lambda: feed, str(tmp_path / "hits"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "hits")).collect()
    assert [(r.url, r.prediction, r.lead_minutes) for r in rows] == [("https://a.test/", "phish", 10.0)]


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 01:10:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in detect.windowed_counts(rows).collect()) == [1, 2]


def test_snapshot_outlives_a_failing_feed(spark, tmp_path):
    """A read that fails, at once or when it is run, leaves the last copy; it is read anew only when it is old."""
    path = str(tmp_path / "feed")
    feed = spark.createDataFrame([("gsb", "u")], "source string, url string")
    feed.write.parquet(path)
    now = [0.0]
    calls = []

    def feeds_of():
        calls.append(now[0])
        if now[0] >= 200:
            raise OSError("no feed")
        return spark.read.schema(feed.schema).parquet(path)  # lazy

    snapshot = detect.FeedSnapshot(feeds_of, 100, lambda: now[0])
    assert snapshot.current().count() == 1
    now[0] = 99
    snapshot.current()
    assert calls == [0.0]
    for file in (tmp_path / "feed").glob("*.parquet"):
        file.write_bytes(b"broken")
    for now[0] in (100, 200, 300):
        assert snapshot.current().count() == 1
    assert calls == [0.0, 100, 200, 300]


def test_rate_limit_and_deadline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"ts": f"2024-01-01T00:0{k}:00Z", "value": message(f"d{k}.test")}))
    schema = "ts timestamp, value string"
    sizes = []
    limited = detect.message_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    query = limited.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
    assert detect.run_until(query, 60) and sizes == [1, 1, 1]
    cache = spark.createDataFrame([("https://d0.test/", "<p>")], "url string, html string")
    feed = spark.createDataFrame([], "source string, url string, first_seen timestamp")
    found = detect.cert_candidates(detect.message_stream(spark, str(tmp_path / "in"), schema), "ts")
    job = detect.run_detection(found, lambda: cache, lambda p: p.withColumn("score", F.lit(1.0)), lambda: feed, str(tmp_path / "hits"), str(tmp_path / "s2"), interval="1 second")
    assert not detect.run_until(job, 15) and not job.isActive
    assert [r.url for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == ["https://d0.test/"]
