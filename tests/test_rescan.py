import datetime
import random

from pyspark.sql import functions as F

from pagelattice.operators import feeds

DAY = datetime.datetime(2024, 1, 1)


def test_changed_rescans_equal_full_ones(spark):
    """Five versions of the feeds, with URLs added, removed and timed anew: what changed is enough."""
    rnd = random.Random(5)
    urls = [f"http://h{k % 9}.test/p{k}" for k in range(40)] + ["", "http://"]
    hits = spark.createDataFrame([(k, rnd.choice(urls), DAY + datetime.timedelta(hours=k), rnd.choice(["phish", "phish", "benign"])) for k in range(60)], "id int, url string, ts_detected timestamp, prediction string")
    versions, listed = [], {}
    for v in range(5):
        for _ in range(5):
            listed[rnd.choice(list(feeds.KINDS)), rnd.choice(urls)] = DAY + datetime.timedelta(days=v, minutes=rnd.randrange(1000))
        for gone in rnd.sample(sorted(listed), min(2, len(listed) - 1)):
            del listed[gone]
        versions.append(spark.createDataFrame([(s, u, t) for (s, u), t in listed.items()], "source string, url string, first_seen timestamp"))
    at = lambda v: F.lit(DAY + datetime.timedelta(days=v + 1))
    state = feeds.annotate_hits(hits, versions[0], at(0), 3).drop("earliest_source").unionByName(hits.where("prediction <> 'phish'"), allowMissingColumns=True)
    state = spark.createDataFrame(state.collect(), state.schema)
    touched = 0
    for v in range(1, 5):
        full = feeds.rescan(state, versions[v], at(v), 3)
        some = feeds.rescan_changes(state, versions[v - 1], versions[v], at(v), 3)
        rows = sorted(full.collect())
        assert rows == sorted(some.select(*full.columns).collect())
        touched += sum(r.updated for r in rows)
        state = spark.createDataFrame(rows, full.schema).drop("updated")
    assert touched
    same = feeds.rescan_changes(state, versions[4], versions[4].repartition(3), at(9), 3)
    assert same.where("updated").count() == 0 and same.count() == 60


def test_changes_and_intervals(spark):
    old = [("openphish", "http://a.test/1", DAY), ("openphish", "http://a.test/2", DAY), ("gsb", "http://b.test/", DAY)]
    new = [("openphish", "http://a.test/1", DAY), ("openphish", "http://c.test/", DAY), ("gsb", "http://b.test/", DAY + datetime.timedelta(1)), ("other", "http://d.test/", DAY)]
    frame = lambda rows: spark.createDataFrame(rows, "source string, url string, first_seen timestamp")
    urls, hosts = feeds.feed_changes(frame(old), frame(new))
    assert {r.url for r in urls.collect()} == {"http://a.test/2", "http://c.test/", "http://b.test/"} and {r.host for r in hosts.collect()} == {"c.test"}
    shown = [(v, "s", u, DAY) for u, vs in (("x", (1, 2, 4)), ("y", (2, 3, 4))) for v in vs] + [(3, "s", "z", DAY)]
    found = feeds.listing_intervals(spark.createDataFrame(shown, "version int, source string, url string, first_seen timestamp")).collect()
    assert sorted((r.url, r.listed_from, r.listed_to or 0) for r in found) == [("x", 1, 2), ("x", 4, 0), ("y", 2, 0), ("z", 3, 3)]
