"""Blacklist feeds: lookups, first listings, lead times, rescans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.urls import host, lead_minutes
from pagelattice.tables import cut

SOURCES = ("openphish", "phishtank", "gsb")


def feed_hosts(feed: DataFrame) -> DataFrame:
    """(host, first_seen): the earliest time of each host."""
    return feed.withColumn("host", host(F.col("url"))).where("host is not null").groupBy("host").agg(F.min("first_seen").alias("first_seen"))


def lookup_text_feed(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """``urls`` with ``first_seen``: of the exact URL, else of its host, else null."""
    exact = feed.groupBy("url").agg(F.min("first_seen").alias("__exact"))
    by_host = feed_hosts(feed).withColumnsRenamed({"host": "__host", "first_seen": "__by_host"})
    keyed = urls.withColumn("__host", host(F.col("url")))
    return keyed.join(exact, "url", "left").join(by_host, "__host", "left").withColumn("first_seen", F.coalesce("__exact", "__by_host")).drop("__host", "__exact", "__by_host")


def lookup_timed_feed(urls: DataFrame, feed: DataFrame, now: Column, max_age_days: int = 60) -> DataFrame:
    """As the text feed, but a host's listing counts only if it is at most ``max_age_days`` whole days old."""
    exact = feed.groupBy("url").agg(F.min("first_seen").alias("__exact"))
    by_host = feed_hosts(feed).withColumnsRenamed({"host": "__host", "first_seen": "__by_host"})
    age = F.floor((F.unix_micros(now) - F.unix_micros("__by_host")) / F.lit(86_400_000_000))
    keyed = urls.withColumn("__host", host(F.col("url"))).join(exact, "url", "left").join(by_host, "__host", "left")
    return keyed.withColumn("first_seen", F.coalesce("__exact", F.when(age <= max_age_days, F.col("__by_host")))).drop("__host", "__exact", "__by_host")


#: How a source answers: by exact URL or host, by host only while the listing is fresh, or by exact URL.
TEXT, TIMED, EXACT = "text", "timed", "exact"
KINDS = {"openphish": TEXT, "phishtank": TIMED, "gsb": EXACT}


def listings(urls: DataFrame, feeds: DataFrame, now: Column, max_age_days: int, sources: dict[str, str], suffix: str) -> DataFrame:
    """``urls`` with a column <source><suffix>: when that source listed the URL, else its host as far as the source
    tells hosts; null if it did neither. Two grouped pivots of (source, url, first_seen), by URL and by host, and two joins."""
    first = lambda s: F.min(F.when(F.col("source") == s, F.col("first_seen")))
    by_host = {s: kind for s, kind in sources.items() if kind != EXACT}
    exact = feeds.groupBy("url").agg(*[first(s).alias(f"__url_{s}") for s in sources])
    hosts = feeds.where(F.col("source").isin(*by_host)).withColumn("__host", host(F.col("url"))).where("__host is not null")
    hosts = hosts.groupBy("__host").agg(*[first(s).alias(f"__host_{s}") for s in by_host])
    found = urls.withColumn("__host", host(F.col("url"))).join(exact, "url", "left").join(hosts, "__host", "left")
    columns = {}
    for s, kind in sources.items():
        fresh = F.floor((F.unix_micros(now) - F.unix_micros(f"__host_{s}")) / F.lit(86_400_000_000)) <= max_age_days if kind == TIMED else F.lit(True)
        columns[s + suffix] = F.col(f"__url_{s}") if kind == EXACT else F.coalesce(f"__url_{s}", F.when(fresh, F.col(f"__host_{s}")))
    return found.withColumns(columns).drop("__host", *[f"__url_{s}" for s in sources], *[f"__host_{s}" for s in by_host])


def panel_lookup(urls: DataFrame, feeds: DataFrame, now: Column | None = None, max_age_days: int = 60, sources: dict[str, str] | None = None) -> DataFrame:
    """``urls`` with a column <source>_first_seen for each source, asked as its kind says; ``now`` is the time of asking."""
    return listings(urls, feeds, F.current_timestamp() if now is None else now, max_age_days, sources or KINDS, "_first_seen")


def earliest(sources: tuple[str, ...] = SOURCES) -> Column:
    """struct(first_seen, source) of the earliest listing, ties to the first source; null if there is none."""
    each = [F.when(F.col(f"{s}_first_seen").isNotNull(), F.struct(F.col(f"{s}_first_seen").alias("first_seen"), F.lit(n).alias("n"), F.lit(s).alias("source"))) for n, s in enumerate(sources)]
    return F.array_min(F.array_compact(F.array(*each)))


def annotate_hits(hits: DataFrame, feeds: DataFrame, now: Column | None = None, max_age_days: int = 60, sources: dict[str, str] | None = None) -> DataFrame:
    """Phish rows of (url, ts_detected, prediction) with listings, the earliest, and lead minutes."""
    found = panel_lookup(hits.where("prediction = 'phish'"), feeds, now, max_age_days, sources).withColumn("__first", earliest(tuple(sources or KINDS)))
    return found.withColumns({"earliest_blacklist": F.col("__first.first_seen"), "earliest_source": F.col("__first.source"), "lead_minutes": lead_minutes(F.col("__first.first_seen"), F.col("ts_detected"))}).drop("__first")


def rescan(hits: DataFrame, feeds: DataFrame, now: Column, max_age_days: int = 60, stamped: tuple[str, ...] = ("openphish", "gsb"), sources: dict[str, str] | None = None) -> DataFrame:
    """Hits whose missing listings are filled from ``feeds``; set ones stay. Adds ``updated``.

    Only phish rows with a missing source are looked at. Sources in ``stamped`` get ``now``, others their own
    time; earliest and lead are taken anew for updated rows.
    """
    kinds = sources or KINDS
    joined = listings(hits, feeds, now, max_age_days, kinds, "__new")
    fill = {}
    for s in kinds:
        value = F.when(F.col(f"{s}__new").isNotNull(), now) if s in stamped else F.col(f"{s}__new")
        fill[s] = F.when((F.col("prediction") == "phish") & F.col(f"{s}_first_seen").isNull(), value)
    updated = reduce(lambda a, b: a | b, [fill[s].isNotNull() for s in kinds])
    joined = joined.withColumn("updated", updated).withColumns({f"{s}_first_seen": F.coalesce(f"{s}_first_seen", fill[s]) for s in kinds})
    first = earliest(tuple(kinds))["first_seen"]
    lead = lead_minutes(F.col("earliest_blacklist"), F.col("ts_detected"))
    out = joined.withColumn("earliest_blacklist", F.when(F.col("updated"), first).otherwise(F.col("earliest_blacklist"))).withColumn("lead_minutes", F.when(F.col("updated"), lead).otherwise(F.col("lead_minutes")))
    return out.drop(*[f"{s}__new" for s in kinds])


def listing_intervals(versions: DataFrame) -> DataFrame:
    """(source, url, first_seen, listed_from, listed_to) from feed versions (version, source, url, first_seen): runs of versions that list a URL with
    one time. ``listed_to`` is null while the newest version lists it."""
    each = versions.groupBy("version", "source", "url").agg(F.min("first_seen").alias("first_seen"))
    order = versions.select("version").distinct().withColumn("n", F.row_number().over(Window.orderBy("version")))  # a row for each version
    newest = order.agg(F.max("n").alias("newest"))
    run = Window.partitionBy("source", "url", "first_seen").orderBy("n")
    runs = each.join(F.broadcast(order), "version").withColumn("run", F.col("n") - F.row_number().over(run)).groupBy("source", "url", "first_seen", "run").agg(F.min("version").alias("listed_from"), F.max_by("version", "n").alias("last"), F.max("n").alias("n"))
    return runs.join(F.broadcast(newest), F.lit(True)).select("source", "url", "first_seen", "listed_from", F.when(F.col("n") < F.col("newest"), F.col("last")).alias("listed_to"))


def feed_changes(old: DataFrame, new: DataFrame, sources: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(url) and (host) whose first listing by a source is another in ``new`` than in ``old``: added, removed or timed anew."""
    kinds = sources or KINDS
    times = lambda rows, key: rows.groupBy("source", key).agg(F.min(F.when(F.col("side") == 0, F.col("first_seen"))).alias("was"), F.min(F.when(F.col("side") == 1, F.col("first_seen"))).alias("now"))
    both = reduce(DataFrame.unionByName, [f.select("source", "url", "first_seen").withColumn("side", F.lit(k)) for k, f in enumerate((old, new))]).where(F.col("source").isin(*kinds))
    changed = lambda rows, key: times(rows, key).where(~F.col("was").eqNullSafe(F.col("now"))).select(key).distinct()
    hosts = both.where(F.col("source").isin(*[s for s, kind in kinds.items() if kind != EXACT])).withColumn("host", host(F.col("url"))).where("host is not null")
    return changed(both, "url"), changed(hosts, "host")


def rescan_changes(hits: DataFrame, old: DataFrame, new: DataFrame, now: Column, max_age_days: int = 60, stamped: tuple[str, ...] = ("openphish", "gsb"), sources: dict[str, str] | None = None) -> DataFrame:
    """``rescan`` of hits that were last scanned against ``old``, touching only those whose URL or host has changed its listing since.

    What ``old`` listed has been filled in by that scan, and a host's listing only grows older, so nothing else can be filled
    now. Only the feed rows of touched hosts and URLs are looked up. A hit without a host is found by its URL.
    """
    kinds = sources or KINDS
    urls, hosts = (cut(c, "feed_changes") for c in feed_changes(old, new, kinds))
    missing = reduce(lambda a, b: a | b, [F.col(f"{s}_first_seen").isNull() for s in kinds])
    keyed = hits.withColumn("__host", host(F.col("url"))).join(urls.withColumn("__url_moved", F.lit(True)), "url", "left")
    keyed = keyed.join(hosts.withColumnRenamed("host", "__host").withColumn("__host_moved", F.lit(True)), "__host", "left")
    keyed = cut(keyed.withColumn("__touched", (F.col("prediction") == "phish") & missing & (F.coalesce("__url_moved", F.lit(False)) | F.coalesce("__host_moved", F.lit(False)))).drop("__url_moved", "__host_moved"), "touched_hits")
    touched = keyed.where("__touched")
    asked = new.withColumn("__host", host(F.col("url")))
    near = asked.where("__host is not null").join(touched.select("__host").distinct(), "__host", "left_semi").unionByName(asked.where("__host is null").join(touched.select("url").distinct(), "url", "left_semi"))
    done = rescan(touched.drop("__host", "__touched"), near.drop("__host"), now, max_age_days, stamped, kinds)
    return done.unionByName(keyed.where("not __touched or __touched is null").drop("__host", "__touched").withColumn("updated", F.lit(False)))


def exact_median(rows: DataFrame, column: str, width: float) -> DataFrame:
    """(median): one row. Values are counted, and only those of the buckets of ``width`` that hold the middle are ranked:
    no task sees more than the buckets, which the range of the values bounds, or one bucket's distinct values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("v") / width))
    buckets = counts.groupBy("b").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("b")) - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy()))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = buckets.where(((F.col("before") < low) & (F.col("before") + F.col("m") >= low)) | ((F.col("before") < high) & (F.col("before") + F.col("m") >= high)))
    ranked = counts.join(F.broadcast(middle), "b").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("v")))  # at most two buckets
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("v")))
    return ranked.agg(((at(low) + at(high)) / 2).alias("median"))


def lead_summary(hits: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(metric, value): totals, absences, listings by source, mean and median lead, share of positive leads.

    "Absent" means not listed by any source in the given snapshot.
    """
    phish = hits.where("prediction = 'phish'")
    listed = F.col("earliest_blacklist").isNotNull()
    lead = F.when(listed, F.col("lead_minutes"))
    n = F.count(F.lit(1))
    values = {
        "total_phish": n, "absent_from_all": F.count_if(~listed), "confirmed_later": F.count_if(listed), **{f"{s}_listed": F.count_if(F.col(f"{s}_first_seen").isNotNull()) for s in sources},
        "mean_lead_minutes": F.bround(F.avg(lead), 4), "median_lead_minutes": F.lit(None), "positive_share": F.bround(F.try_divide(F.count_if(lead > 0), F.count(lead)), 4),
    }
    one = phish.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    one = one.join(exact_median(phish.select(lead.alias("lead")), "lead", 60.0)).withColumn("median_lead_minutes", F.col("median").cast("double"))  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values])).alias("m")).select("m.*")
