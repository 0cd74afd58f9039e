"""Queries over pages: URL functions, URL and HTML features, static graph counts, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions import urls
from pagelattice.operators import tags
from pagelattice.plans.common import DECORATED_SQL, URL_SQL, decorated_pages, table, with_domain

WITH_URLS = f"WITH {DECORATED_SQL}, {URL_SQL}"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def split_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = decorated_pages(spark, sf_dir)
    parts = urls.split_url(F.col("url"))
    return pages.select("page_id", *[parts[k].alias(k) for k in ("scheme", "netloc", "path", "query")], urls.page_domain(F.col("url")).alias("domain"))


def url_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = decorated_pages(spark, sf_dir)
    found = urls.url_feature_columns(F.col("url"))
    return pages.select("page_id", *[found[n].alias(n) for n in C.FEATURE_GROUPS["content_url_lexical"]])


def url_entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = decorated_pages(spark, sf_dir)
    found = urls.url_feature_columns(F.col("url"))
    return pages.select("page_id", *[found[n].alias(n) for n in C.FEATURE_GROUPS["content_url_entropy_token"]])


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return decorated_pages(spark, sf_dir).select(
        "page_id", urls.url_key(url).alias("page_key"), urls.short_hash(url, 8).alias("short"), urls.host(url).alias("host"),
        urls.brand_domain(url).alias("brand_domain"), urls.registered_domain(urls.page_domain(url)).alias("registered_domain"),
    )


def url_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated_pages(spark, sf_dir).select("page_id", F.array_join(urls.path_substrings(F.col("url")), " ").alias("substrings"), F.array_join(urls.url_tokens(F.col("url")), " ").alias("tokens"))


def scrub_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.expr("CASE page_id % 4 WHEN 0 THEN concat('?token=t', page_id, '&page=1') WHEN 1 THEN concat('?q=1&API_KEY=', page_id) WHEN 2 THEN concat('/sk-', repeat('a', 24), '?x=1') ELSE '' END")
    url = F.concat(F.regexp_extract("url", r"^[^?#]*", 0), extra)
    return table(spark, sf_dir, "pages").select("page_id", urls.scrub_url(url).alias("scrubbed"))


def html_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.html_features(with_domain(decorated_pages(spark, sf_dir)))
    return found.select("page_id", "num_password_inputs", "num_hidden_inputs", "num_iframes", "has_title", "title_length", "has_favicon", "favicon_external", "html_length", "external_brand_resource", "obfuscation_indicator", "empty_link_node_ratio")


def html_tag_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.html_features(with_domain(decorated_pages(spark, sf_dir))).select("page_id", *C.TAG_GROUPS)


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_tokens(decorated_pages(spark, sf_dir)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("closing").alias("closing"), F.countDistinct("page_id").alias("pages"))


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = F.filter(tags.tokens(F.col("html")), lambda t: tags.tag_name(t) == "script")
    inline = F.size(F.filter(scripts, lambda t: F.trim(tags.body(t)) != ""))
    return decorated_pages(spark, sf_dir).select("page_id", F.size(scripts).alias("scripts"), inline.alias("inline_scripts"), (F.size(scripts) - inline).alias("other_scripts"))


def static_network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.operators.page_graph import static_resources

    found = static_resources(with_domain(decorated_pages(spark, sf_dir)))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_third_party").alias("third_party"), F.countDistinct("resource").alias("resources"))


def static_storage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.operators.page_graph import storage_counts

    return decorated_pages(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in storage_counts(F.col("html")).items()])


def page_graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the layers above the DOM, from the whole graph build."""
    from pagelattice.operators.page_graph import build_page_graph

    nodes, edges, _ = build_page_graph(decorated_pages(spark, sf_dir))
    of = lambda column, kind, name: F.count_if(F.col(column) == kind).alias(name)
    counted = nodes.groupBy("page_id").agg(of("node_type", C.SCRIPT, "scripts"), of("node_type", C.NETWORK, "requests"), of("node_type", C.STORAGE, "storage"), F.count_if("is_third_party").alias("third_party"))
    linked = edges.groupBy("page_id").agg(of("edge_type", C.EXECUTE, "execute_edges"), of("edge_type", C.REQUEST, "request_edges"), of("edge_type", C.ACCESS, "access_edges"))
    return counted.join(linked, "page_id")


def attach_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.sources.tables import attach_pages as attach

    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source")
    cache = table(spark, sf_dir, "pages").select("page_id", "html")
    found = attach(wanted, cache, "page_id")
    return found.groupBy("source").agg(F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("missing"), F.sum(F.length("html")).alias("chars"))


def pending_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.sources.tables import pending_urls as pending

    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang")
    return pending(wanted, table(spark, sf_dir, "pages"), "page_id").groupBy("lang").agg(F.count(F.lit(1)).alias("pending"))


def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.sources.tables import ledger_pending as pending

    wanted = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("pos"))
    ledger = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select("url", F.expr("CASE WHEN page_id % 2 = 0 THEN 'ok' ELSE 'fail' END").alias("status"))
    return pending(wanted, ledger, cap=100).select("pos", "url")


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.sources.tables import ledger_status as status

    return status(table(spark, sf_dir, "events").select(F.concat(F.lit("https://u"), "user_id", F.lit(".test/")).alias("url"), F.expr("CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END").alias("status")))


_TOKEN = r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|</?[a-z][^>]*>)"
_TOKENS = f"toks AS (SELECT *, regexp_extract_all(html, '{_TOKEN}', 1) AS toks FROM named)"
_NAME = "lower(regexp_extract({t}, '^<([a-zA-Z][a-zA-Z0-9:_-]*)', 1))"
_BODY = r"regexp_replace(regexp_replace({t}, '^<[^>]*>', ''), '(?i)</[a-z]+\s*>$', '')"


def _attr(name: str, t: str = "t") -> str:
    value = rf"""regexp_extract(regexp_extract({t}, '^<[^>]*>'), '(?i)[\s"'']{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)"""
    return rf"""regexp_replace({value}, '^["'']|["'']$', '', 'g')"""


_OPEN = f"opened AS (SELECT page_id, domain, pos, t, {_NAME.format(t='t')} AS tag FROM (SELECT page_id, domain, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM toks) WHERE {_NAME.format(t='t')} <> '')"
_WORDS = "lower(concat_ws(' ', " + ", ".join(_attr(a) for a in ("class", "alt", "id", "rel", "aria-label")) + "))"
_SOURCE = f"coalesce(nullif({_attr('src')}, ''), {_attr('href')})"
_OBFUSCATED = r"(?i)(eval\s*\(|atob\s*\(|fromCharCode|unescape\s*\(|\\x[0-9a-f]{2})"
WITH_TAGS = f"{WITH_URLS}, {_TOKENS}, {_OPEN}"

ORACLE = {
    "split_urls": f"{WITH_URLS} SELECT page_id, scheme, netloc, path, query, domain FROM named",
    "url_lexical": rf"""{WITH_URLS} SELECT page_id, length(url) AS url_length, length(d) AS domain_length, length(path) AS path_length,
        length(query) AS query_length, length(list_last(string_split(d, '.'))) AS tld_length,
        len(regexp_extract_all(url, '\.')) AS num_dots_in_url, len(regexp_extract_all(d, '-')) AS num_hyphens_in_domain,
        len(regexp_extract_all(d, '[0-9]')) AS num_digits_in_domain, len(regexp_extract_all(url, '[0-9]')) AS num_digits_in_url,
        len(regexp_extract_all(url, '/')) AS num_slashes_in_url, len(regexp_extract_all(d, '/')) AS num_slashes_in_domain,
        greatest(0, len(regexp_extract_all(d, '\.')) - 1) AS num_subdomains,
        len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS path_depth,
        len(regexp_extract_all(url, '[@_~!$&*]')) AS num_special_chars, CAST(contains(url, '@') AS INT) AS has_at_symbol,
        CAST(contains(path, '//') AS INT) AS has_double_slash_redirect,
        CAST(regexp_matches(d, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') AS INT) AS has_ip_address,
        CAST(scheme = 'https' AS INT) AS is_https,
        CAST(regexp_matches(d, '(\.tk|\.ml|\.ga|\.cf|\.gq|\.xyz|\.top|\.buzz|\.club|\.work|\.info)$') AS INT) AS has_suspicious_tld FROM named""",
    "url_entropy_tokens": rf"""{WITH_URLS}, chars AS (
          SELECT page_id, 0 AS kind, unnest(string_split(url, '')) AS c FROM named UNION ALL SELECT page_id, 1, unnest(string_split(lower(d), '')) FROM named),
        grouped AS (SELECT page_id, kind, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY page_id, kind, c),
        counted AS (SELECT *, sum(n) OVER (PARTITION BY page_id, kind) AS total FROM grouped),
        entropy AS (SELECT page_id, round_even(sum(CASE WHEN kind = 0 THEN -n / total * log2(n / total) END), 4) AS url_entropy,
                    round_even(sum(CASE WHEN kind = 1 THEN -n / total * log2(n / total) END), 4) AS domain_entropy FROM counted GROUP BY page_id),
        tok AS (SELECT page_id, list_filter(list_transform(list_filter(regexp_split_to_array(url, '[./\-_?=&%#@:]+'), lambda t: length(t) > 2), lambda t: lower(t)), lambda t: t NOT IN ({_in(C.URL_STOP_WORDS)})) AS toks FROM named)
        SELECT page_id, url_entropy, domain_entropy, len(toks) AS num_url_tokens,
          len(list_filter(list_distinct(toks), lambda t: t IN ({_in(C.URL_SUSPICIOUS_WORDS)}))) AS num_suspicious_tokens,
          round_even(len(list_filter(list_distinct(toks), lambda t: t IN ({_in(C.URL_SUSPICIOUS_WORDS)}))) / greatest(len(toks), 1), 4) AS suspicious_token_ratio
        FROM entropy JOIN tok USING (page_id)""",
    "url_identity": rf"""{WITH_URLS}, plain AS (SELECT *, regexp_replace(lower(domain), ':\d*$', '') AS p FROM named)
        SELECT page_id, substring(sha256(url), 1, 16) AS page_key, substring(md5(url), 1, 8) AS short,
          nullif(lower(regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1)), '') AS host,
          regexp_replace(regexp_replace(lower(netloc), '^www\.', ''), ':[^:]*$', '') AS brand_domain,
          CASE WHEN regexp_matches(p, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN p ELSE coalesce(
            nullif(regexp_extract(p, '([^.]+\.({'|'.join(s.replace('.', chr(92) + '.') for s in C.TWO_LEVEL_SUFFIXES)}))$', 1), ''),
            nullif(regexp_extract(p, '([^.]+\.[^.]+)$', 1), ''), p) END AS registered_domain FROM plain""",
    "url_substrings": rf"""{WITH_URLS} SELECT page_id,
        array_to_string(list_transform(list_filter(regexp_split_to_array(concat_ws('?', path, nullif(query, '')), '[/\-_.?&=]'), lambda t: length(t) >= 4)[1:5], lambda t: concat('substr:', lower(t))), ' ') AS substrings,
        array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(url, '[./\-_?=&%#@:]+'), lambda t: length(t) > 2), lambda t: lower(t)), lambda t: t NOT IN ({_in(C.URL_STOP_WORDS)})), ' ') AS tokens FROM named""",
    "scrub_urls": r"""SELECT page_id, concat(regexp_extract(url, '^[^?#]*'), CASE page_id % 4 WHEN 0 THEN '?token=<redacted>&page=1'
        WHEN 1 THEN '?q=1&API_KEY=<redacted>' WHEN 2 THEN '/<redacted>?x=1' ELSE '' END) AS scrubbed FROM pages""",
    "html_counts": rf"""{WITH_TAGS}, icons AS (SELECT page_id, min(pos) AS pos FROM opened WHERE tag = 'link' AND contains(lower({_attr('rel')}), 'icon') GROUP BY page_id),
        icon AS (SELECT o.page_id, CAST(starts_with({_attr('href')}, 'http') AND NOT contains({_attr('href')}, domain) AS INT) AS outside FROM opened o JOIN icons i USING (page_id, pos)),
        titles AS (SELECT page_id, arg_min(length({_BODY.format(t='t')}), pos) AS n FROM opened WHERE tag = 'title' GROUP BY page_id),
        agg AS (SELECT page_id, count(*) FILTER (tag = 'input' AND lower({_attr('type')}) = 'password') AS num_password_inputs,
          count(*) FILTER (tag = 'input' AND lower({_attr('type')}) = 'hidden') AS num_hidden_inputs, count(*) FILTER (tag = 'iframe') AS num_iframes,
          count(*) FILTER (tag IN ('img', 'link', 'svg') AND regexp_matches({_WORDS}, 'logo|brand|icon') AND starts_with({_SOURCE}, 'http') AND NOT contains({_SOURCE}, domain)) AS branded,
          count(*) FILTER (tag = 'script' AND trim({_BODY.format(t='t')}) <> '') AS inline_n,
          count(*) FILTER (tag = 'script' AND trim({_BODY.format(t='t')}) <> '' AND regexp_matches({_BODY.format(t='t')}, '{_OBFUSCATED}')) AS obf_n,
          count(*) FILTER (tag = 'a') AS a_n,
          count(*) FILTER (tag = 'a' AND (trim({_attr('href')}) IN ('#', '') OR starts_with(trim({_attr('href')}), 'javascript:'))) AS empty_n
          FROM opened GROUP BY page_id)
        SELECT n.page_id, coalesce(num_password_inputs, 0) AS num_password_inputs, coalesce(num_hidden_inputs, 0) AS num_hidden_inputs,
          coalesce(num_iframes, 0) AS num_iframes, CAST(t.n IS NOT NULL AS INT) AS has_title, coalesce(t.n, 0) AS title_length,
          CAST(i.page_id IS NOT NULL AS INT) AS has_favicon, coalesce(i.outside, 0) AS favicon_external, length(html) AS html_length,
          CAST(coalesce(branded, 0) > 0 AS INT) AS external_brand_resource,
          round_even(coalesce(obf_n, 0) / greatest(coalesce(inline_n, 0), 1), 4) AS obfuscation_indicator,
          round_even(coalesce(empty_n, 0) / greatest(coalesce(a_n, 0), 1), 4) AS empty_link_node_ratio
        FROM named n LEFT JOIN agg USING (page_id) LEFT JOIN titles t USING (page_id) LEFT JOIN icon i USING (page_id)""",
    "html_tag_ratios": f"""{WITH_TAGS} SELECT page_id, """
    + ", ".join(f"round_even(count(*) FILTER (tag IN ({_in(g)})) / count(*), 4) AS {n}" for n, g in C.TAG_GROUPS.items())
    + " FROM opened GROUP BY page_id",
    "tag_counts": rf"""{WITH_URLS}, {_TOKENS}, flat AS (SELECT page_id, unnest(toks) AS t FROM toks),
        names AS (SELECT page_id, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) AS tag, starts_with(t, '</') AS closing FROM flat WHERE NOT starts_with(t, '<!--'))
        SELECT tag, count(*) AS n, count(*) FILTER (closing) AS closing, count(DISTINCT page_id) AS pages FROM names GROUP BY tag""",
    "script_counts": f"""{WITH_TAGS} SELECT n.page_id, count(o.tag) AS scripts, count(o.tag) FILTER (trim({_BODY.format(t='o.t')}) <> '') AS inline_scripts,
        count(o.tag) FILTER (trim({_BODY.format(t='o.t')}) = '') AS other_scripts
        FROM named n LEFT JOIN (SELECT * FROM opened WHERE tag = 'script') o USING (page_id) GROUP BY n.page_id""",
    "static_network_counts": f"""{WITH_TAGS}, attrs AS (
          SELECT page_id, domain, {_attr('src')} AS resource FROM opened UNION ALL SELECT page_id, domain, {_attr('href')} FROM opened
          UNION ALL SELECT page_id, domain, {_attr('action')} FROM opened UNION ALL SELECT page_id, domain, {_attr('src')} FROM opened WHERE tag = 'script')
        SELECT page_id, count(*) AS requests, count(*) FILTER (regexp_extract(resource, '^(?:([^:/?#]+):)?(?://([^/?#]*))?', 2) <> domain) AS third_party,
          count(DISTINCT resource) AS resources FROM attrs WHERE starts_with(resource, 'http') GROUP BY page_id""",
    "page_graph_layers": rf"""{WITH_TAGS}, attrs AS (
          SELECT page_id, domain, {_attr('src')} AS resource FROM opened UNION ALL SELECT page_id, domain, {_attr('href')} FROM opened
          UNION ALL SELECT page_id, domain, {_attr('action')} FROM opened UNION ALL SELECT page_id, domain, {_attr('src')} FROM opened WHERE tag = 'script'),
        net AS (SELECT page_id, count(*) AS n, count(*) FILTER (regexp_extract(resource, '^(?:([^:/?#]+):)?(?://([^/?#]*))?', 2) <> domain) AS third FROM attrs WHERE starts_with(resource, 'http') GROUP BY page_id),
        js AS (SELECT page_id, count(*) AS n FROM opened WHERE tag = 'script' GROUP BY page_id),
        st AS (SELECT page_id, CAST(regexp_matches(html, 'document\.cookie|(localStorage|sessionStorage)\.(getItem|setItem)') AS INT) AS n FROM named)
        SELECT page_id, coalesce(js.n, 0) AS scripts, coalesce(net.n, 0) AS requests, st.n AS storage, coalesce(net.third, 0) AS third_party,
          coalesce(js.n, 0) AS execute_edges, coalesce(net.n, 0) AS request_edges, st.n * coalesce(js.n, 0) AS access_edges
        FROM st LEFT JOIN js USING (page_id) LEFT JOIN net USING (page_id)""",
    "static_storage_counts": rf"""WITH {DECORATED_SQL} SELECT page_id, len(regexp_extract_all(html, 'document\.cookie')) AS get_cookie,
        len(regexp_extract_all(html, 'document\.cookie\s*=')) AS set_cookie,
        len(regexp_extract_all(html, '(localStorage|sessionStorage)\.getItem')) AS get_storage,
        len(regexp_extract_all(html, '(localStorage|sessionStorage)\.setItem')) AS set_storage FROM decorated""",
    "attach_pages": """SELECT source, count(p.page_id) AS cached, count(*) - count(p.page_id) AS missing, CAST(sum(length(coalesce(html, ''))) AS BIGINT) AS chars
        FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id AND html <> '' GROUP BY source""",
    "pending_urls": "SELECT lang, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) GROUP BY lang",
    "ledger_pending": """WITH ok AS (SELECT count(*) AS n FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0),
        open AS (SELECT page_id AS pos, url, row_number() OVER (ORDER BY page_id DESC) AS rn FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0))
        SELECT pos, url FROM open, ok WHERE rn <= greatest(0, 100 - n)""",
    "ledger_status": """SELECT count(DISTINCT user_id) AS attempted, count(*) FILTER (event_type <> 'error') AS ok_rows,
        count(DISTINCT user_id) FILTER (event_type <> 'error') AS ok_urls FROM events""",
}
_SHARES = ("structure", "execute", "request", "access")
_TERMS = " + ".join(f"CASE WHEN {k} > 0 THEN -({k} / edges) * log2({k} / edges) ELSE 0 END" for k in _SHARES)
ORACLE["node_edge_shares"] = f"""WITH layers AS ({ORACLE["page_graph_layers"]}), elements AS ({WITH_TAGS} SELECT page_id, count(*) AS html FROM opened GROUP BY page_id),
    counted AS (SELECT page_id, html, scripts, requests, storage, html + scripts + requests + storage AS nodes, html - 1 AS structure, execute_edges AS execute, request_edges AS request, access_edges AS access, third_party FROM layers JOIN elements USING (page_id)),
    summed AS (SELECT *, structure + execute + request + access AS edges FROM counted)
    SELECT page_id, round_even(html / nodes, 4) AS html_node_ratio, round_even(scripts / nodes, 4) AS script_node_ratio, round_even(requests / nodes, 4) AS request_node_ratio, round_even(storage / nodes, 4) AS storage_node_ratio,
      {", ".join(f"round_even({k} / edges, 4) AS {k}_edge_ratio" for k in _SHARES)}, round_even(third_party / greatest(request, 1), 4) AS cross_domain_edge_ratio, round_even({_TERMS}, 4) AS avg_edge_type_entropy FROM summed"""


def node_edge_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features on shares of node and edge types, from the whole graph build."""
    from pagelattice.operators.features import edge_features, node_features
    from pagelattice.operators.page_graph import build_page_graph
    from pagelattice.tables import cut, spread

    nodes, edges, _ = build_page_graph(decorated_pages(spark, sf_dir))
    names = [f"{k}_node_ratio" for k in ("html", "script", "request", "storage")] + [f"{k}_edge_ratio" for k in (*_SHARES, "cross_domain")] + ["avg_edge_type_entropy"]
    with spread(spark, nodes.count()):
        return cut(node_features(nodes).join(edge_features(edges, nodes), "page_id").select("page_id", *names), "shares")


#: Which query's SQL gives the features of a group that need no graph.
_MEASURED = {name: query for query in ("url_lexical", "url_entropy_tokens", "html_counts", "html_tag_ratios") for name in C.FEATURE_NAMES if f"AS {name}" in ORACLE[query]}


def measured_groups() -> dict[str, list[str]]:
    """Of each feature group the features that need no page graph, without groups that have none."""
    found = {group: [n for n in names if n in _MEASURED] for group, names in C.FEATURE_GROUPS.items()}
    return {group: names for group, names in found.items() if names}


def feature_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature groups with their category and size, how many of their features need no graph, and the largest value of these."""
    pages = tags.html_features(with_domain(decorated_pages(spark, sf_dir)))
    pages = pages.withColumns(urls.url_feature_columns(F.col("url")))
    groups = measured_groups()
    one = pages.agg(*[F.max(F.greatest(*[F.col(n).cast("double") for n in names])).alias(g) for g, names in groups.items()])
    category = lambda g: C.CATEGORY_OF[g.split("_")[0]]
    rows = [F.struct(F.lit(g).alias("feature_group"), F.lit(category(g)).alias("category"), F.lit(len(C.FEATURE_GROUPS[g])).alias("features"), F.lit(len(names)).alias("measured"), F.col(g).alias("largest")) for g, names in groups.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _largest(names: list[str]) -> str:
    parts = [f"SELECT max(greatest({', '.join(f'CAST({n} AS DOUBLE)' for n in mine)})) AS m FROM ({ORACLE[q]})" for q in dict.fromkeys(_MEASURED[n] for n in names) if (mine := [n for n in names if _MEASURED[n] == q])]
    return f"(SELECT max(m) FROM ({' UNION ALL '.join(parts)}))"


ORACLE["feature_group_counts"] = " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, '{C.CATEGORY_OF[g.split('_')[0]]}' AS category, {len(C.FEATURE_GROUPS[g])} AS features, {len(names)} AS measured, {_largest(names)} AS largest" for g, names in measured_groups().items()
)
QUERIES = {n: globals()[n] for n in ORACLE}
