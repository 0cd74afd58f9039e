"""Queries on labelled pages: label rules, samples, splits, metrics, perturbations, robustness, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions.urls import is_phish
from pagelattice.operators import evaluate, feeds, perturb, robustness
from pagelattice.plans.common import DECORATED_SQL, decorated_pages, table

NOW = "timestamp'2024-02-15 00:00:00'"
#: When the stored hits were annotated, and the days for which a host's timed listing counts.
SECOND = "timestamp'2024-01-25 00:00:00'"
STORED, MAX_AGE = "timestamp'2024-01-20 00:00:00'", 10
_LABEL = "CASE quality WHEN 0 THEN 'phish' ELSE 'benign' END"
_RULE = "CASE WHEN length(url) + 7 * (page_id % 5) > 55 THEN 'phish' ELSE 'benign' END"


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, label, toxic, prediction of pages that have a label; the prediction is a fixed rule."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr(_LABEL).alias("label"), "toxic")
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id").withColumn("prediction", F.expr(_RULE))


LABELLED_SQL = f"labelled AS (SELECT page_id, url, {_LABEL} AS label, toxic, {_RULE} AS prediction FROM pages JOIN labels ON page_id = doc_id)"


def label_rules(spark, sf_dir):
    word = F.expr("CASE doc_id % 6 WHEN 0 THEN 'phish' WHEN 1 THEN 'Phishing' WHEN 2 THEN '1' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'benign' ELSE 'unknown' END")
    rows = table(spark, sf_dir, "labels").select("doc_id", word.alias("w"))
    return rows.select("doc_id", *[is_phish(F.col("w"), r).alias(r) for r in ("model", "robustness", "baseline")])


def balanced_subsample(spark, sf_dir):
    return evaluate.balanced_subsample(labelled_pages(spark, sf_dir), 10, "page_id").select("page_id", "label")


def stratified_pick(spark, sf_dir):
    pages = labelled_pages(spark, sf_dir)
    kinds = F.explode(F.array(F.lit("html"), F.lit("instrumentation"), F.lit("screenshot"))).alias("feature_type")
    status = pages.select("page_id", "url", kinds).select("url", "feature_type", F.expr("CASE WHEN feature_type = 'instrumentation' AND page_id % 4 = 0 THEN 'fail' ELSE 'ok' END").alias("status"))
    return evaluate.stratified_pick(pages, status, {"phish": 8, "benign": 12}).select("page_id", "label")


def train_val_split(spark, sf_dir):
    return evaluate.train_val_split(labelled_pages(spark, sf_dir), "page_id").select("page_id", "part")


def class_weights(spark, sf_dir):
    return evaluate.class_weights(labelled_pages(spark, sf_dir))


def training_summary(spark, sf_dir):
    return evaluate.training_summary(labelled_pages(spark, sf_dir).withColumn("x", F.when(F.col("toxic") == 1, 1)), extra="x")


def binary_metrics(spark, sf_dir):
    rows = labelled_pages(spark, sf_dir)
    return evaluate.binary_metrics(rows.select(F.col("toxic").alias("kind"), is_phish(F.col("label")).alias("truth"), is_phish(F.col("prediction")).alias("guess")), by=("kind",))


def confusion(spark, sf_dir):
    label = F.expr("CASE WHEN page_id % 9 = 0 THEN '1' WHEN page_id % 11 = 0 THEN 'unknown' ELSE label END")
    return evaluate.confusion(labelled_pages(spark, sf_dir).withColumn("label", label))


def metric_table(spark, sf_dir):
    return evaluate.metric_table(training_summary(spark, sf_dir))


def _perturbed(attack):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All six variants; html variants as length and hash of the page."""
        column, change = perturb.PERTURBATIONS[attack]
        pages = decorated_pages(spark, sf_dir)
        value = (lambda c: c) if column == "url" else F.md5
        return pages.select("page_id", *[value(change(F.col(column), v)).alias(f"v{v}") for v in range(1, 7)])

    return query


def expand_variants(spark, sf_dir):
    grown = perturb.expand_variants(decorated_pages(spark, sf_dir))
    return grown.groupBy("attack", "variant", "surface").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.sum(F.length("url")).alias("url_chars"))


def variant_manifest(spark, sf_dir):
    grown = perturb.expand_variants(decorated_pages(spark, sf_dir)).withColumn("html", F.expr("CASE WHEN page_id % 13 <> 0 THEN html END"))
    return perturb.manifest(grown)


def backfill_clean(spark, sf_dir):
    pages = decorated_pages(spark, sf_dir)
    broken = pages.withColumns({"html": F.expr("CASE WHEN page_id % 3 <> 1 THEN concat(html, 'x') END"), "status": F.expr("CASE WHEN page_id % 4 = 0 THEN 'error' ELSE 'ok' END")})
    return perturb.backfill_clean(broken, pages).select("page_id", "backfilled", F.md5("html").alias("html_md5"))


def combo_url_html(spark, sf_dir):
    return perturb.combine(decorated_pages(spark, sf_dir), ("A1_url_shortener", 1), ("A7_html_input_obfuscate", 1)).select("page_id", "attack", "variant", "url", F.md5("html").alias("html_md5"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table over all labelled pages and 60 grid cells, by a fixed rule."""
    cells = F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(v).alias("variant"), F.lit(10 * k + n).alias("c")) for k, a in enumerate(robustness.FAMILIES) for n, v in enumerate(perturb.VARIANTS)])
    rows = labelled_pages(spark, sf_dir).select("page_id", "url", "label", F.explode(cells).alias("cell"))
    guess = F.expr("CASE WHEN (page_id * 7 + cell.c * 13) % 97 < 3 THEN 'benign' ELSE 'phish' END")
    status = F.expr("CASE WHEN (page_id + cell.c) % 29 = 0 THEN 'missing' ELSE 'ok' END")
    return rows.select("cell.attack", "cell.variant", "url", "label", guess.alias("prediction"), status.alias("status"))


def any_evaded(spark, sf_dir):
    return robustness.any_evaded(scores(spark, sf_dir))


def surface_asr(spark, sf_dir):
    return robustness.surface_asr(robustness.any_evaded(scores(spark, sf_dir)))


def robustness_table(spark, sf_dir):
    return robustness.robustness_table(robustness.any_evaded(scores(spark, sf_dir)))


def combo_asr(spark, sf_dir):
    return robustness.combo_asr(robustness.any_evaded(scores(spark, sf_dir)), ("URL", "Logo"))


# --- feeds: error events are detections; signups, purchases and views are three feeds of user pages


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("https://u"), "user_id", F.lit(".test/p"), F.col("event_id") % 97)).withColumn("ts", F.col("ts").cast("timestamp"))


def feed_rows(spark, sf_dir):
    source = F.expr("CASE event_type WHEN 'signup' THEN 'openphish' WHEN 'purchase' THEN 'phishtank' WHEN 'view' THEN 'gsb' END")
    return _events(spark, sf_dir).select(source.alias("source"), "url", F.col("ts").alias("first_seen")).where("source is not null")


def hit_rows(spark, sf_dir):
    guess = F.expr("CASE WHEN event_id % 5 = 0 THEN 'benign' ELSE 'phish' END")
    return _events(spark, sf_dir).where("event_type = 'error'").select("event_id", "url", F.col("ts").alias("ts_detected"), guess.alias("prediction"))


def feed_hosts(spark, sf_dir):
    return feeds.feed_hosts(feed_rows(spark, sf_dir))


def lookup_text_feed(spark, sf_dir):
    return feeds.lookup_text_feed(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir).where("source = 'openphish'").drop("source")).select("event_id", "first_seen")


def lookup_timed_feed(spark, sf_dir):
    return feeds.lookup_timed_feed(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir).where("source = 'phishtank'").drop("source"), F.expr(NOW), 30).select("event_id", "first_seen")


def panel_lookup(spark, sf_dir):
    return feeds.panel_lookup(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir), F.expr(NOW), MAX_AGE).select("event_id", *[f"{s}_first_seen" for s in feeds.SOURCES])


def earliest_hit(spark, sf_dir):
    found = feeds.panel_lookup(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir), F.expr(NOW), MAX_AGE).withColumn("first", feeds.earliest())
    return found.select("event_id", "first.first_seen", "first.source")


def annotate_hits(spark, sf_dir):
    return feeds.annotate_hits(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir), F.expr(NOW), MAX_AGE).select("event_id", "earliest_blacklist", "earliest_source", "lead_minutes")


def _stored_hits(spark, sf_dir):
    """Hits annotated from the January 1 to 15 part of the feeds; benign rows keep nulls."""
    old = feed_rows(spark, sf_dir).where("first_seen < timestamp'2024-01-15'")
    found = feeds.annotate_hits(hit_rows(spark, sf_dir), old, F.expr(STORED), MAX_AGE).drop("earliest_source")
    benign = hit_rows(spark, sf_dir).where("prediction <> 'phish'")
    return found.unionByName(benign, allowMissingColumns=True)


def rescan(spark, sf_dir):
    found = feeds.rescan(_stored_hits(spark, sf_dir), feed_rows(spark, sf_dir), F.expr(NOW), MAX_AGE)
    return found.select("event_id", "updated", "earliest_blacklist", "lead_minutes", *[f"{s}_first_seen" for s in feeds.SOURCES])


def rescan_changes(spark, sf_dir):
    """Two rescans on end, each of what its feeds' version has changed."""
    every = feed_rows(spark, sf_dir)
    first, second = every.where("first_seen < timestamp'2024-01-15'"), every.where("first_seen < timestamp'2024-01-22'")
    once = feeds.rescan_changes(_stored_hits(spark, sf_dir), first, second, F.expr(SECOND), MAX_AGE)
    found = feeds.rescan_changes(once.withColumnRenamed("updated", "before"), second, every, F.expr(NOW), MAX_AGE)
    return found.select("event_id", "updated", "before", "earliest_blacklist", "lead_minutes", *[f"{s}_first_seen" for s in feeds.SOURCES])


def listing_intervals(spark, sf_dir):
    """Ten versions of the feeds: version k lists what was first seen in the table's first 3 (k + 1) days, but for one URL in seven."""
    rows = feed_rows(spark, sf_dir).select("source", "url", "first_seen", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("version"))
    shown = rows.where("unix_timestamp(first_seen) < unix_timestamp(timestamp'2024-01-01') + 259200 * (version + 1) and (length(url) + version) % 7 <> 0")
    return feeds.listing_intervals(shown)


def lead_summary(spark, sf_dir):
    return feeds.lead_summary(feeds.annotate_hits(hit_rows(spark, sf_dir), feed_rows(spark, sf_dir), F.expr(NOW), MAX_AGE))


# --- SQL -------------------------------------------------------------------------------------------

_FEED_SQL = """ev AS (SELECT *, concat('https://u', user_id, '.test/p', event_id % 97) AS url, concat('u', user_id, '.test') AS host FROM events),
feed AS (SELECT CASE event_type WHEN 'signup' THEN 'openphish' WHEN 'purchase' THEN 'phishtank' WHEN 'view' THEN 'gsb' END AS source, url, host, CAST(ts AS TIMESTAMP) AS first_seen
  FROM ev WHERE event_type IN ('signup', 'purchase', 'view')),
hits AS (SELECT event_id, url, host, CAST(ts AS TIMESTAMP) AS ts_detected, CASE WHEN event_id % 5 = 0 THEN 'benign' ELSE 'phish' END AS prediction FROM ev WHERE event_type = 'error')"""


def _panel(name: str, feed: str, now: str) -> str:
    """Hits with each source's answer: by URL, by host (openphish), by host while the listing is fresh (phishtank)."""
    times = lambda alias, sources: ", ".join(f"min(first_seen) FILTER (source = '{s}') AS {alias}_{s}" for s in sources)
    return f"""{name}_urls AS (SELECT url, {times("u", feeds.SOURCES)} FROM {feed} GROUP BY url), {name}_hosts AS (SELECT host, {times("h", feeds.SOURCES[:2])} FROM {feed} GROUP BY host),
{name} AS (SELECT hits.*, coalesce(u_openphish, h_openphish) AS openphish_first_seen, u_gsb AS gsb_first_seen,
  coalesce(u_phishtank, CASE WHEN floor((epoch_us({now}) - epoch_us(h_phishtank)) / 86400000000) <= {MAX_AGE} THEN h_phishtank END) AS phishtank_first_seen
  FROM hits LEFT JOIN {name}_urls USING (url) LEFT JOIN {name}_hosts USING (host))"""


_NOW_PANEL = f"WITH {_FEED_SQL}, {_panel('panel', 'feed', NOW)}"
_FIRST = "least(openphish_first_seen, phishtank_first_seen, gsb_first_seen)"
_WHO = f"CASE {_FIRST} WHEN openphish_first_seen THEN 'openphish' WHEN phishtank_first_seen THEN 'phishtank' WHEN gsb_first_seen THEN 'gsb' END"
_LEAD = "round_even((epoch_us({0}) - epoch_us(ts_detected)) / 6e7, 2)"
_SCORES = "cells AS (SELECT unnest([" + ", ".join(f"{{'attack': '{a}', 'variant': '{v}', 'c': {10 * k + n}}}" for k, a in enumerate(robustness.FAMILIES) for n, v in enumerate(perturb.VARIANTS)) + "]) AS cell)"
_SCORES = f"""{LABELLED_SQL}, {_SCORES}, scored AS (SELECT cell.attack AS attack, cell.variant AS variant, url, label,
  CASE WHEN (page_id * 7 + cell.c * 13) % 97 < 3 THEN 'benign' ELSE 'phish' END AS prediction, CASE WHEN (page_id + cell.c) % 29 = 0 THEN 'missing' ELSE 'ok' END AS status FROM labelled, cells),
evaded AS (SELECT attack, url, bool_or(prediction <> 'phish') AS evaded FROM scored WHERE label = 'phish' AND status = 'ok' GROUP BY attack, url),
surfaced AS (SELECT url, evaded, CASE WHEN attack[1:3] IN ('A1_', 'A2_', 'A3_') THEN 'URL' WHEN attack[1:3] IN ('A4_', 'A5_', 'A6_', 'A7_') THEN 'HTML' ELSE 'Logo' END AS surface FROM evaded),
total AS (SELECT greatest(count(DISTINCT url), 1) AS total FROM evaded)"""


def _filled(name: str, before: str, panel: str, now: str) -> str:
    """Hits with their missing listings filled from a panel."""
    fresh = {"o": f"CASE WHEN p.openphish_first_seen IS NOT NULL THEN {now} END", "t": "p.phishtank_first_seen", "g": f"CASE WHEN p.gsb_first_seen IS NOT NULL THEN {now} END"}
    fill = {c: f"CASE WHEN s.prediction = 'phish' AND s.{c} IS NULL THEN {v} END" for c, v in fresh.items()}
    return f"""{name} AS (SELECT s.event_id, s.ts_detected, s.prediction, {" OR ".join(f"({v}) IS NOT NULL" for v in fill.values())} AS updated, {", ".join(f"coalesce(s.{c}, {v}) AS {c}" for c, v in fill.items())}
      FROM {before} s JOIN {panel} p USING (event_id))"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _before(html: str, tag: str, snippet: str) -> str:
    return f"""CASE WHEN regexp_matches({html}, '(?i)</{tag}\\s*>') THEN concat(regexp_extract({html}, '(?is)^(.*)</{tag}\\s*>', 1), {_quote(snippet)}, regexp_extract({html}, '(?is)^.*(</{tag}\\s*>.*)$', 1)) ELSE concat({html}, {_quote(snippet)}) END"""


_U = "(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(.*)"
_P = f"parts AS (SELECT page_id, html, url, regexp_extract(url, '^{_U}', 1) AS s, regexp_extract(url, '^{_U}', 2) AS n, regexp_extract(url, '^{_U}', 3) AS p, regexp_extract(url, '^{_U}', 4) AS r FROM decorated)"
_WITH = f"WITH {DECORATED_SQL}, {_P}"


def _six(expression) -> str:
    return f"{_WITH} SELECT page_id, " + ", ".join(f"{expression(v)} AS v{v}" for v in range(1, 7)) + " FROM parts"


def _filler(v: int) -> str:
    body, head = perturb.filler_snippets(v)
    first = _before("html", "body", body)
    return f"md5({_before('(' + first + ')', 'head', head) if head else first})"


def _inputs(v: int) -> str:
    """Input rewriting by patterns over the whole page."""
    secret = r"""(?i)(<input\b[^>]*?\stype\s*=\s*)["'']?password["'']?"""
    if v in (1, 2, 3):
        to = {1: '"text"', 2: '"email"', 3: '"text" data-role="password"'}[v]
        return f"regexp_replace(html, '{secret}', '\\1{to}', 'g')"
    if v == 4:
        return r"regexp_replace(html, '(?i)</?form\b[^>]*>', '', 'g')"
    if v == 5:
        name = r"""regexp_replace(html, '(?i)(<input\b[^>]*?\sname\s*=\s*)"[^">]*(password|passwd|pwd)[^">]*"', '\1"pw"', 'g')"""
        return rf"""regexp_replace({name}, '(?i)(<form\b[^>]*?\saction\s*=\s*)"https?://[^"]*"', '\1"/submit"', 'g')"""
    return rf"""regexp_replace(html, '{secret.replace(")[", ")([", 1).removesuffix("?")}?[^>]*?)\s*/?>', '\1\2 style="display:none"><input type="text" placeholder="Enter password" aria-hidden="true">', 'g')"""


_SHORT = lambda v: f"concat(coalesce(nullif(lower(s), ''), 'http'), '://{perturb.SHORTENERS[v - 1][0]}/', substring(md5(url), 1, {perturb.SHORTENERS[v - 1][1]}))"
_COMBO = lambda v: f"concat(lower(s), '://', n, '{perturb.COMBOSQUATS[v - 1][1]}', coalesce(nullif(p, ''), '/'), r)" if v <= 3 else f"concat(lower(s), '://{perturb.COMBOSQUATS[v - 1][1]}.', n, p, r)"
_TLD = lambda v: f"concat(lower(s), '://', CASE WHEN contains(split_part(n, ':', 1), '.') THEN regexp_replace(split_part(n, ':', 1), '\\.[^.]*$', '.{perturb.TLDS[v - 1]}') ELSE concat(split_part(n, ':', 1), '.{perturb.TLDS[v - 1]}') END, regexp_extract(n, '^[^:]*(:.+)$', 1), p, r)"
_URL_SQL = {"A1_url_shortener": _SHORT, "A2_url_combosquat": _COMBO, "A3_url_tld_sub": _TLD}
_GRID = " UNION ALL ".join(f"SELECT '{a}' AS attack, 'v{v}' AS variant, '{perturb.FAMILIES[a]}' AS surface, {_URL_SQL[a](v) if a in _URL_SQL else 'url'} AS u, page_id FROM parts" for a in perturb.BUILT for v in range(1, 7))

ORACLE = {
    "expand_variants": f"{_WITH} SELECT attack, variant, surface, count(*) AS pages, count(DISTINCT u) AS urls, CAST(sum(length(u)) AS BIGINT) AS url_chars FROM ({_GRID}) GROUP BY ALL",
    "variant_manifest": f"{_WITH} SELECT attack, variant, count(*) FILTER (page_id % 13 <> 0) AS ok, count(*) FILTER (page_id % 13 = 0) AS failed FROM ({_GRID}) GROUP BY ALL",
    "label_rules": """SELECT doc_id, CAST(doc_id % 6 IN (0, 1, 2, 3) AS INT) AS model, CAST(doc_id % 6 IN (0, 1, 2) AS INT) AS robustness, CAST(doc_id % 6 = 0 AS INT) AS baseline FROM labels""",
    "balanced_subsample": f"""WITH {LABELLED_SQL}, r AS (SELECT page_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', page_id)), page_id) AS n FROM labelled)
        SELECT page_id, label FROM r WHERE n <= 10 OR (SELECT count(*) FROM labelled) <= 20""",
    "stratified_pick": f"""WITH {LABELLED_SQL}, r AS (SELECT page_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', url)), url) AS n FROM labelled WHERE page_id % 4 <> 0)
        SELECT page_id, label FROM r WHERE n <= CASE label WHEN 'phish' THEN 8 ELSE 12 END""",
    "train_val_split": f"""WITH {LABELLED_SQL}, r AS (SELECT page_id, row_number() OVER (ORDER BY md5(concat('42:', page_id)), page_id) AS n, count(*) OVER () AS total FROM labelled)
        SELECT page_id, CASE WHEN total >= 10 AND n <= greatest(1, CAST(floor(total * 0.1) AS INT)) THEN 'val' ELSE 'train' END AS part FROM r""",
    "class_weights": f"""WITH {LABELLED_SQL}, c AS (SELECT count(*) FILTER (label = 'phish') AS p, count(*) AS n FROM labelled) SELECT round_even(p / n, 6) AS benign_weight, round_even((n - p) / n, 6) AS phish_weight FROM c WHERE p > 0 AND p < n""",
    "training_summary": f"WITH {LABELLED_SQL} SELECT count(*) AS rows, count(*) FILTER (label = 'phish') AS phish, count(*) FILTER (label <> 'phish') AS benign, count(*) FILTER (toxic = 1) AS with_extra FROM labelled",
    "metric_table": f"""WITH {LABELLED_SQL}, s AS (SELECT count(*) AS rows, count(*) FILTER (label = 'phish') AS phish, count(*) FILTER (label <> 'phish') AS benign, count(*) FILTER (toxic = 1) AS with_extra FROM labelled)
        SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value FROM s UNION ALL SELECT 'phish', phish FROM s UNION ALL SELECT 'benign', benign FROM s UNION ALL SELECT 'with_extra', with_extra FROM s""",
    "binary_metrics": f"""WITH {LABELLED_SQL}, c AS (SELECT toxic AS kind, count(*) FILTER (label = 'phish' AND prediction = 'phish') AS tp, count(*) FILTER (label <> 'phish' AND prediction = 'phish') AS fp,
        count(*) FILTER (label = 'phish' AND prediction <> 'phish') AS fn, count(*) FILTER (label <> 'phish' AND prediction <> 'phish') AS tn FROM labelled GROUP BY toxic)
        SELECT kind, round_even((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 6) ELSE 0 END AS precision,
          CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round_even(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM c""",
    "confusion": f"""WITH {LABELLED_SQL}, r AS (SELECT prediction, CASE WHEN page_id % 9 = 0 THEN '1' WHEN page_id % 11 = 0 THEN 'unknown' ELSE label END AS label FROM labelled),
        c AS (SELECT count(*) FILTER (label = 'phish' AND prediction = 'phish') AS tp, count(*) FILTER (label = 'benign' AND prediction = 'phish') AS fp, count(*) FILTER (label = 'benign' AND prediction = 'benign') AS tn,
          count(*) FILTER (label = 'phish' AND prediction = 'benign') AS fn, count(*) FILTER (label <> 'unknown') AS known FROM r)
        SELECT *, CASE WHEN known > 0 THEN round_even((tp + tn) / known, 4) ELSE 0 END AS accuracy FROM c""",
    "perturb_shortener": _six(_SHORT),
    "perturb_combosquat": _six(_COMBO),
    "perturb_tld": _six(_TLD),
    "perturb_anchors": _six(lambda v: f"md5({_before('html', 'body', perturb.anchor_snippet(*perturb.ANCHORS[v - 1]))})"),
    "perturb_filler": _six(_filler),
    "perturb_inputs": _six(lambda v: f"md5({_inputs(v)})"),
    "perturb_benign": _six(lambda v: f"md5({_before('html', 'body', perturb.benign_snippet(v))})"),
    "backfill_clean": f"WITH {DECORATED_SQL} SELECT page_id, page_id % 3 = 1 OR page_id % 4 = 0 AS backfilled, md5(CASE WHEN page_id % 3 = 1 OR page_id % 4 = 0 THEN html ELSE concat(html, 'x') END) AS html_md5 FROM decorated",
    "combo_url_html": f"""{_WITH} SELECT page_id, 'combo_URL_HTML' AS attack, 'A1v1+A7v1' AS variant, concat(coalesce(nullif(lower(s), ''), 'http'), '://bit.ly/', substring(md5(url), 1, 8)) AS url, md5({_inputs(1)}) AS html_md5 FROM parts""",
    "any_evaded": f"WITH {_SCORES} SELECT attack, url, evaded FROM evaded",
    "surface_asr": f"WITH {_SCORES} SELECT surface, count(DISTINCT url) FILTER (evaded) AS evaded_urls, round_even(count(DISTINCT url) FILTER (evaded) / any_value(total), 4) AS asr FROM surfaced, total GROUP BY surface",
    "robustness_table": f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS surfaces, {len(c)} AS size, count(DISTINCT url) AS evaded_urls, round_even(count(DISTINCT url) / any_value(total), 4) AS asr FROM surfaced, total WHERE evaded AND surface IN ({', '.join(_quote(x) for x in c)})" for c in robustness.COMBINATIONS),
    "combo_asr": f"WITH {_SCORES} SELECT 'URL+Logo' AS surfaces, count(DISTINCT url) AS evaded_urls, round_even(count(DISTINCT url) / any_value(total), 4) AS asr FROM surfaced, total WHERE evaded AND surface IN ('URL', 'Logo')",
    "feed_hosts": f"WITH {_FEED_SQL} SELECT host, min(first_seen) AS first_seen FROM feed GROUP BY host",
    "lookup_text_feed": f"WITH {_FEED_SQL}, f AS (SELECT * FROM feed WHERE source = 'openphish') SELECT event_id, coalesce((SELECT min(first_seen) FROM f WHERE f.url = h.url), (SELECT min(first_seen) FROM f WHERE f.host = h.host)) AS first_seen FROM hits h",
    "lookup_timed_feed": f"""WITH {_FEED_SQL}, f AS (SELECT * FROM feed WHERE source = 'phishtank'), b AS (SELECT host, min(first_seen) AS t FROM f GROUP BY host)
        SELECT event_id, coalesce((SELECT min(first_seen) FROM f WHERE f.url = h.url), CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-15 00:00:00') - epoch_us(b.t)) / 86400000000) <= 30 THEN b.t END) AS first_seen FROM hits h LEFT JOIN b USING (host)""",
    "panel_lookup": f"{_NOW_PANEL} SELECT event_id, openphish_first_seen, phishtank_first_seen, gsb_first_seen FROM panel",
    "earliest_hit": f"{_NOW_PANEL} SELECT event_id, {_FIRST} AS first_seen, {_WHO} AS source FROM panel",
    "annotate_hits": f"{_NOW_PANEL} SELECT event_id, {_FIRST} AS earliest_blacklist, {_WHO} AS earliest_source, {_LEAD.format(_FIRST)} AS lead_minutes FROM panel WHERE prediction = 'phish'",
    "rescan": f"""{_NOW_PANEL}, old AS (SELECT * FROM feed WHERE first_seen < TIMESTAMP '2024-01-15'), {_panel('stored', 'old', STORED)},
        grown AS (SELECT s.event_id, s.ts_detected, CASE WHEN s.prediction = 'phish' THEN s.openphish_first_seen END AS o, CASE WHEN s.prediction = 'phish' THEN s.phishtank_first_seen END AS t, CASE WHEN s.prediction = 'phish' THEN s.gsb_first_seen END AS g,
          CASE WHEN s.prediction = 'phish' AND s.openphish_first_seen IS NULL AND p.openphish_first_seen IS NOT NULL THEN {NOW} END AS no, CASE WHEN s.prediction = 'phish' AND s.phishtank_first_seen IS NULL THEN p.phishtank_first_seen END AS nt,
          CASE WHEN s.prediction = 'phish' AND s.gsb_first_seen IS NULL AND p.gsb_first_seen IS NOT NULL THEN {NOW} END AS ng FROM stored s JOIN panel p USING (event_id)),
        done AS (SELECT event_id, ts_detected, no IS NOT NULL OR nt IS NOT NULL OR ng IS NOT NULL AS updated, coalesce(o, no) AS openphish_first_seen, coalesce(t, nt) AS phishtank_first_seen, coalesce(g, ng) AS gsb_first_seen FROM grown)
        SELECT event_id, updated, {_FIRST} AS earliest_blacklist, {_LEAD.format(_FIRST)} AS lead_minutes, openphish_first_seen, phishtank_first_seen, gsb_first_seen FROM done""",
    "rescan_changes": f"""{_NOW_PANEL}, old AS (SELECT * FROM feed WHERE first_seen < TIMESTAMP '2024-01-15'), {_panel('stored', 'old', STORED)}, mid AS (SELECT * FROM feed WHERE first_seen < TIMESTAMP '2024-01-22'), {_panel('middle', 'mid', SECOND)},
        s0 AS (SELECT event_id, ts_detected, prediction, CASE WHEN prediction = 'phish' THEN openphish_first_seen END AS o, CASE WHEN prediction = 'phish' THEN phishtank_first_seen END AS t, CASE WHEN prediction = 'phish' THEN gsb_first_seen END AS g FROM stored),
        {_filled('s1', 's0', 'middle', SECOND)}, {_filled('s2', 's1', 'panel', NOW)},
        done AS (SELECT s2.event_id, s2.ts_detected, s2.updated, s1.updated AS before, s2.o AS openphish_first_seen, s2.t AS phishtank_first_seen, s2.g AS gsb_first_seen FROM s2 JOIN s1 USING (event_id))
        SELECT event_id, updated, before, {_FIRST} AS earliest_blacklist, {_LEAD.format(_FIRST)} AS lead_minutes, openphish_first_seen, phishtank_first_seen, gsb_first_seen FROM done""",
    "listing_intervals": f"""WITH {_FEED_SQL}, shown AS (SELECT version, source, url, min(first_seen) AS first_seen FROM feed, (SELECT unnest(range(10)) AS version)
          WHERE floor(epoch(first_seen)) < epoch(TIMESTAMP '2024-01-01') + 259200 * (version + 1) AND (length(url) + version) % 7 <> 0 GROUP BY ALL),
        runs AS (SELECT *, version - row_number() OVER (PARTITION BY source, url, first_seen ORDER BY version) AS run FROM shown)
        SELECT source, url, first_seen, CAST(min(version) AS INT) AS listed_from, CAST(CASE WHEN max(version) < 9 THEN max(version) END AS INT) AS listed_to FROM runs GROUP BY source, url, first_seen, run""",
    "lead_summary": f"""{_NOW_PANEL}, a AS (SELECT openphish_first_seen AS o, phishtank_first_seen AS t, gsb_first_seen AS g, {_FIRST} AS f, {_LEAD.format(_FIRST)} AS l FROM panel WHERE prediction = 'phish')
        SELECT unnest(['total_phish', 'absent_from_all', 'confirmed_later', 'openphish_listed', 'phishtank_listed', 'gsb_listed', 'mean_lead_minutes', 'median_lead_minutes', 'positive_share']) AS metric,
          unnest([count(*)::DOUBLE, count(*) FILTER (f IS NULL), count(f), count(o), count(t), count(g), round_even(avg(l), 4), median(l), round_even(count(*) FILTER (l > 0) / count(l), 4)]) AS value FROM a""",
}
QUERIES = {n: globals()[n] for n in ORACLE if n in globals()}
QUERIES |= {f"perturb_{short}": _perturbed(attack) for short, attack in (("shortener", "A1_url_shortener"), ("combosquat", "A2_url_combosquat"), ("tld", "A3_url_tld_sub"), ("anchors", "A4_html_invisible_link"), ("filler", "A5_html_object_ratio"), ("benign", "A6_html_dom_expand"), ("inputs", "A7_html_input_obfuscate"))}
