"""File sources and sinks: URL lists, page caches, feeds, site tables, other detectors' outputs, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions.urls import brand_domain, parse_iso
from pagelattice.operators.page_graph import REDIRECT_TYPE, REQUEST_TYPE, STORAGE_TYPE

TRACE_SCHEMA = f"requests {REQUEST_TYPE}, redirects {REDIRECT_TYPE}, storage_ops {STORAGE_TYPE}"


def file_order():
    """Orders rows as they stand in their files: files by path, a file's splits by start, a split's rows as read."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=False)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) of CSV files with a header; label is optional ("unknown"). A missing url column is an error."""
    rows = _csv(spark, path)
    if "url" not in rows.columns:
        raise ValueError(f"no url column in {path}")
    label = F.coalesce("label", F.lit("unknown")) if "label" in rows.columns else F.lit("unknown")
    return rows.select(F.trim("url").alias("url"), label.alias("label"))


def read_page_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(page_key, html, requests, redirects, storage_ops) of folders <key>/page.html and <key>/instrumentation.json.

    Pages without html are absent; a missing or broken trace gives empty arrays.
    """
    key = F.element_at(F.split(F.input_file_name(), "/"), -2)
    html = spark.read.text(f"{folder}/*/page.html", wholetext=True).select(key.alias("page_key"), F.col("value").alias("html")).where("html <> ''")
    traces = spark.read.option("pathGlobFilter", "instrumentation.json").text(f"{folder}/*", wholetext=True).select(key.alias("page_key"), F.from_json("value", TRACE_SCHEMA, {"mode": "PERMISSIVE"}).alias("t"))
    joined = html.join(traces, "page_key", "left")
    filled = [F.coalesce(f"t.{n}", F.array().cast(k)).alias(n) for n, k in (("requests", REQUEST_TYPE), ("redirects", REDIRECT_TYPE), ("storage_ops", STORAGE_TYPE))]
    return joined.select("page_key", "html", *filled)


def write_page_cache(pages: DataFrame, path: str) -> None:
    """Parquet; the job's commit makes it appear as a whole."""
    pages.write.mode("overwrite").parquet(path)


def redact_traces(pages: DataFrame) -> DataFrame:
    """Traces without stacks, with masked values and scrubbed URLs and keys."""
    from pagelattice.functions.urls import scrub_url

    requests = F.transform("requests", lambda r: r.withField("url", scrub_url(r["url"])))
    redirects = F.transform("redirects", lambda r: r.withField("from_url", scrub_url(r["from_url"])).withField("to_url", scrub_url(r["to_url"])))
    ops = F.transform("storage_ops", lambda o: o.withField("value", F.when(o["value"].isNotNull(), F.lit("<redacted>"))).withField("key", scrub_url(o["key"])).dropFields("stack"))
    return pages.withColumns({"requests": requests, "redirects": redirects, "storage_ops": ops})


def read_text_feed(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """(url, first_seen) of a file with a URL a line: blanks and # lines dropped, each once, all seen at ``fetched_at``."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')").distinct()
    return lines.select("url", parse_iso(F.lit(fetched_at)).alias("first_seen"))


def read_timed_feed(spark: SparkSession, path: str, loaded_at: str) -> DataFrame:
    """(url, first_seen) of CSV url, verification_time: a bad or missing time is the load time; of a repeated URL the last row holds."""
    rows = _csv(spark, path).select(F.trim("url").alias("url"), "verification_time", file_order().alias("pos")).where("coalesce(url, '') <> ''")
    seen = F.coalesce(parse_iso(F.col("verification_time")), parse_iso(F.lit(loaded_at)))
    return rows.groupBy("url").agg(F.max_by(seen, "pos").alias("first_seen"))


def read_dns_cache(spark: SparkSession, path: str) -> DataFrame:
    """(domain, ip) of JSON files with one object each; broken files and such without a domain drop out, a failed lookup has no ip."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "domain string, ip string").alias("d")).where("d.domain is not null").select("d.*")


def attach_ip(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """``domains`` with the cached ip, null if unknown."""
    return domains.join(dns.groupBy("domain").agg(F.min("ip").alias("ip")), "domain", "left")


def read_sites(spark: SparkSession, folder: str) -> DataFrame:
    """(name, url, label, shot_path, domain) of folders with a screenshot ``shot.png``; the URL is in ``info.txt``, the
    label in ``label.txt`` ("unknown" without). Screenshots are listed, not read."""
    name = F.element_at(F.split(F.col("path"), "/"), -2).alias("name")
    listed = spark.read.format("binaryFile")
    shots = listed.option("pathGlobFilter", "shot.png").load(f"{folder}/*").select(name, F.col("path").alias("shot_path"))
    texts = listed.option("pathGlobFilter", "{info,label}.txt").load(f"{folder}/*").select(name, F.endswith("path", F.lit("info.txt")).alias("is_url"), F.trim(F.regexp_replace(F.col("content").cast("string"), r"^\s+|\s+$", "")).alias("text"))
    texts = texts.groupBy("name").agg(F.max(F.when(F.col("is_url"), F.col("text"))).alias("url"), F.max(F.when(~F.col("is_url"), F.col("text"))).alias("label"))
    found = shots.join(texts, "name", "left").select("name", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("label", F.lit("unknown")).alias("label"), "shot_path")
    return found.withColumn("domain", F.when(F.col("url") != "", brand_domain(F.col("url"))).otherwise(F.lit("")))


def read_predictions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Another detector's outputs as (key, prediction, score).

    * ``table``: tab-separated with a header, by URL: url, label, mark (1 is phish), score; shorter lines drop out.
    * ``folders``: two lines a site, by folder: "site_<n> TAB url", then "TAB mark TAB brand TAB domains TAB score ..."; a bad
      mark or score is benign or 0. Of a repeated folder the last entry holds.
    * ``json``: a list of objects with ``folder``, or an object by folder. ``phish_category`` decides if there (anything but benign
      and legitimate is phish), else ``phish`` = 1; the score is the first of siamese_conf, score and confidence that is there.
    """
    if kind == "table":
        rows = spark.read.schema("url string, label string, mark int, score double").csv(path, sep="\t", header=True, quote="")
        return rows.where("score is not null").select(F.col("url").alias("key"), F.when(F.col("mark") == 1, "phish").otherwise("benign").alias("prediction"), "score")
    if kind == "folders":
        # A row is all that follows a site's name up to the next one.
        rows = spark.read.option("lineSep", "\nsite_").text(path).select(F.regexp_replace("value", "^site_", "").alias("value"), file_order().alias("pos"))
        rows = rows.where(F.col("value").rlike(r"^\d[^\n]*\n(?s:.*\n)?\t"))
        parts = F.split(F.regexp_replace(F.regexp_extract("value", r"\n\t([^\n]*)", 1), r"^\s+|\s+$", ""), "\t")
        found = rows.select(F.concat(F.lit("site_"), F.regexp_extract("value", r"^([^\t\n]*)", 1)).alias("key"), "pos", parts.alias("p"))
        given = F.get("p", F.lit(3))
        score = F.when(given.isNull() | (given == "None"), 0.0).otherwise(given.try_cast("double"))
        found = found.select("key", "pos", F.when((F.get("p", F.lit(0)).try_cast("int") == 1) & score.isNotNull(), "phish").otherwise("benign").alias("prediction"), F.coalesce(score, F.lit(0.0)).alias("score"))
        return found.groupBy("key").agg(F.max_by(F.struct("prediction", "score"), "pos").alias("last")).select("key", "last.*")
    if kind == "json":
        text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
        as_list = F.from_json("value", "array<map<string,string>>")
        by_folder = F.from_json("value", "map<string,map<string,string>>")
        listed = text.where("startswith(value, '[')").select(F.explode(as_list).alias("e")).select(F.coalesce(F.col("e")["folder"], F.lit("")).alias("key"), "e")
        keyed = text.where("not startswith(value, '[')").select(F.explode(by_folder).alias("key", "e"))
        has = lambda name: F.map_contains_key("e", name)
        score = F.when(has("siamese_conf"), F.col("e")["siamese_conf"]).when(has("score"), F.col("e")["score"]).otherwise(F.col("e")["confidence"])
        category = F.coalesce(F.col("e")["phish_category"], F.lit(""))
        phish = F.when(category != "", ~category.isin("benign", "legitimate")).otherwise(F.coalesce(F.expr("try_cast(e['phish'] AS double)") == 1, F.lit(False)))
        return listed.unionByName(keyed).select("key", F.when(phish, "phish").otherwise("benign").alias("prediction"), F.coalesce(score.try_cast("double"), F.lit(0.0)).alias("score"))
    raise ValueError(f"unknown kind of predictions: {kind}")


def match_predictions(urls: DataFrame, found: DataFrame, position: str | None = None) -> DataFrame:
    """``urls`` with prediction and score, by URL, or by the folder ``site_<position>``; unmatched ones are unknown and 0."""
    key = F.col("url") if position is None else F.concat(F.lit("site_"), F.col(position).cast("string"))
    return urls.withColumn("key", key).join(found, "key", "left").drop("key").fillna({"prediction": "unknown", "score": 0.0})


def write_predictions(rows: DataFrame, path: str) -> None:
    """CSV url, label, prediction, score with four decimals."""
    rows.select("url", "label", "prediction", F.format_string("%.4f", "score").alias("score")).write.mode("overwrite").csv(path, header=True)


def write_metric_table(metrics: DataFrame, path: str) -> None:
    """CSV metric, value."""
    metrics.select("metric", "value").write.mode("overwrite").csv(path, header=True)


def hits_sink(hits: DataFrame, path: str, batch: int) -> None:
    """The phish rows of a batch as Parquet in a folder of its own: a batch that is tried again replaces what it left."""
    hits.where("prediction = 'phish'").write.mode("overwrite").parquet(f"{path}/batch={batch}")
