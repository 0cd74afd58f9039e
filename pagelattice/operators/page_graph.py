"""The cross-layer graph of a page: typed node and edge tables.

Every operator takes and returns long tables keyed by page, so a page is never a unit that must fit
somewhere; joins and aggregates are on (page, ...). The DOM comes from ``dom.dom_nodes``. Both sides of a join grow with the pages, and the
files of such tables are many times smaller than their rows: joins are by sorted shuffles, so no table goes through the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions.urls import page_domain
from pagelattice.operators import tags


def storage_counts(html: Column) -> dict[str, Column]:
    """How often a page's source reads and writes cookies and web storage."""
    return {
        "get_cookie": F.regexp_count(html, F.lit(r"document\.cookie")),
        "set_cookie": F.regexp_count(html, F.lit(r"document\.cookie\s*=")),
        "get_storage": F.regexp_count(html, F.lit(r"(localStorage|sessionStorage)\.getItem")),
        "set_storage": F.regexp_count(html, F.lit(r"(localStorage|sessionStorage)\.setItem")),
    }


def static_resources(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, resource, is_third_party) of every absolute src, href and action of a page with a
    ``domain`` column, from tag tokens; a script's src counts for its element and for the script."""
    opened = pages.select(key, "domain", F.posexplode(tags.tokens(F.col("html"))).alias("pos", "token"))
    name = tags.tag_name(F.col("token"))
    links = F.array(*[tags.attribute(F.col("token"), a) for a in ("src", "href", "action")], F.when(name == "script", tags.attribute(F.col("token"), "src")))
    found = opened.where(name != "").select(key, "domain", "pos", F.explode(F.filter(links, lambda x: F.startswith(x, F.lit("http")))).alias("resource"))
    return found.select(key, "pos", "resource", (page_domain(F.col("resource")) != F.col("domain")).alias("is_third_party"))


REQUEST_TYPE = "array<struct<url:string,method:string,resource_type:string,is_navigation:boolean,status:int>>"
REDIRECT_TYPE = "array<struct<from_url:string,to_url:string,status:int>>"
STORAGE_TYPE = "array<struct<type:string,storage:string,key:string,value:string,stack:string,ts:bigint>>"
NODE_COLUMNS = ("page_id", "node", "seq", "node_type", "tag", "id", "src", "href", "action", "class", "is_inline", "url", "domain", "is_third_party", "is_navigation", "is_redirect", "op_type", "set_cookie")
EDGE_COLUMNS = ("page_id", "src", "dst", "edge_type", "is_redirect", "ord")
_TYPES = {"seq": "int", "is_inline": "boolean", "is_third_party": "boolean", "is_navigation": "boolean", "is_redirect": "boolean", "set_cookie": "int", "page_id": "long"}


def with_traces(pages: DataFrame) -> DataFrame:
    """page_id, url, domain, html and the three trace arrays; missing columns and nulls are empty arrays."""
    columns = [F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")]
    for name, kind in (("requests", REQUEST_TYPE), ("redirects", REDIRECT_TYPE), ("storage_ops", STORAGE_TYPE)):
        given = F.col(name) if name in pages.columns else F.lit(None).cast(kind)
        columns.append(F.coalesce(given, F.array().cast(kind)).alias(name))
    return pages.select(*columns).withColumn("domain", page_domain(F.col("url")))


def _nodes(df: DataFrame, **given) -> DataFrame:
    """``df`` in the node table's columns; names that it lacks are null, ``given`` ones are set."""
    out = []
    for name in NODE_COLUMNS:
        value = given.get(name, F.col(name) if name in df.columns else F.lit(None))
        out.append(value.cast(_TYPES.get(name, "string")).alias(name))
    return df.select(*out)


def _edges(df: DataFrame, src, dst, kind: str, order, redirect=None) -> DataFrame:
    return df.select("page_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), (F.lit(False) if redirect is None else redirect).alias("is_redirect"), order.cast("long").alias("ord"))


def _nth(prefix: str, *order: str) -> Column:
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1
    return F.concat(F.lit(prefix), rank.cast("string"))


def script_nodes(dom: DataFrame, pages: DataFrame) -> DataFrame:
    """Script elements in page order, then script requests whose URL no element names, each once."""
    parents = dom.select("page_id", F.col("seq").alias("parent"), F.col("tag").alias("parent_tag"))
    static = dom.where("tag = 'script'").select("page_id", F.col("seq").alias("pos"), "parent", F.nullif(F.col("src"), F.lit("")).alias("src"), (F.trim(F.coalesce("own_text", F.lit(""))) != "").alias("is_inline"))
    static = static.join(parents.hint("merge"), ["page_id", "parent"], "left").select("page_id", F.lit(0).alias("late"), "pos", "src", "is_inline", "parent_tag")
    asked = pages.select("page_id", F.posexplode("requests").alias("pos", "r")).where("r.resource_type = 'script' and coalesce(r.url, '') <> ''")
    asked = asked.groupBy("page_id", F.col("r.url").alias("src")).agg(F.min("pos").alias("pos"))
    dynamic = asked.join(static.select("page_id", "src").where("src is not null").hint("merge"), ["page_id", "src"], "left_anti").select("page_id", F.lit(1).alias("late"), "pos", "src", F.lit(False).alias("is_inline"), F.lit(None).cast("string").alias("parent_tag"))
    both = static.unionByName(dynamic)
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("late", "pos")) - 1).withColumn("node", F.concat(F.lit("js_"), F.col("nth").cast("string")))


def build_page_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dom) of all pages (page_id, url, html and, if there, requests, redirects, storage_ops).

    Pages without html are a single node. Edges that repeat a pair are merged: the later type holds.
    """
    from pagelattice.operators.dom import dom_nodes
    from pagelattice.tables import cut, spread

    pages = cut(with_traces(pages), "pages")
    dom = cut(dom_nodes(pages), "dom")
    with spread(pages.sparkSession, dom.count()):
        return *layers(pages, dom), dom


def layers(pages: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of written pages with traces and their elements."""
    from pagelattice.tables import cut

    page_of = pages.select("page_id", F.col("domain").alias("page_domain"), F.col("url").alias("page_url"))
    html_id = lambda c: F.concat(F.lit("html_"), F.col(c).cast("string"))
    root = F.lit("html_0")

    # html layer
    empty = pages.join(dom.select("page_id").distinct().hint("merge"), "page_id", "left_anti")
    html_nodes = _nodes(dom.withColumn("node", html_id("seq")), node_type=F.lit(C.HTML)).unionByName(_nodes(empty, node=F.lit("page_root"), seq=F.lit(0), node_type=F.lit(C.HTML), tag=F.lit("document"), url=F.lit(None), domain=F.lit(None)))
    structure = _edges(dom.where("parent is not null"), html_id("parent"), html_id("seq"), C.STRUCTURE, F.col("seq"))

    # script layer
    scripts = cut(script_nodes(dom, pages), "scripts")
    script_rows = _nodes(scripts, seq=F.col("nth") + 1_000_000, node_type=F.lit(C.SCRIPT), url=F.lit(None))
    last_of_tag = dom.groupBy("page_id", F.col("tag").alias("parent_tag")).agg(F.max("seq").alias("owner"))
    execute = _edges(scripts.where("late = 0").join(last_of_tag.hint("merge"), ["page_id", "parent_tag"]), html_id("owner"), F.col("node"), C.EXECUTE, F.col("nth") + 1_000_000)
    execute = execute.unionByName(_edges(scripts.where("late = 1"), root, F.col("node"), C.EXECUTE, F.col("nth") + 1_000_000))
    fallback = scripts.groupBy("page_id").agg(F.min_by("node", F.struct(F.col("src").isNull(), "nth")).alias("fallback"))

    # network layer: traced requests, or else what the source names
    links = dom.select("page_id", "seq", F.explode(F.array_distinct(F.array("src", "href", "action"))).alias("link")).where("link is not null")
    asked = pages.select("page_id", F.posexplode("requests").alias("pos", "r")).where("r.url like 'http%' and coalesce(r.resource_type, '') <> 'script'")
    asked = asked.select("page_id", "pos", "r.url", F.coalesce("r.resource_type", F.lit("other")).alias("kind"), F.coalesce("r.is_navigation", F.lit(False)).alias("is_navigation")).withColumn("node", _nth("request_", "pos"))
    hops = pages.select("page_id", F.posexplode("redirects").alias("pos", "h"))
    last_node = asked.groupBy("page_id", "url").agg(F.max_by("node", "pos").alias("node"))
    hops = hops.select("page_id", "pos", "h.from_url", "h.to_url")
    hops = hops.join(last_node.withColumnsRenamed({"url": "from_url", "node": "from_node"}).hint("merge"), ["page_id", "from_url"]).join(last_node.withColumnsRenamed({"url": "to_url", "node": "to_node"}).hint("merge"), ["page_id", "to_url"])
    targets = hops.select("page_id", F.col("to_node").alias("node"), F.lit(True).alias("is_redirect")).distinct()
    asked = asked.join(page_of.hint("merge"), "page_id").withColumn("domain", page_domain(F.col("url")))
    request_rows = _nodes(asked.join(targets.hint("merge"), ["page_id", "node"], "left"), seq=F.col("pos") + 2_000_000, node_type=F.lit(C.NETWORK), is_third_party=F.col("domain") != F.col("page_domain"), is_redirect=F.coalesce("is_redirect", F.lit(False)))
    navigation = _edges(asked.where("is_navigation and url = page_url"), F.col("node"), root, C.REQUEST, F.col("pos") + 2_000_000)
    linked = links.groupBy("page_id", F.col("link").alias("url")).agg(F.min("seq").alias("linked"))
    owned = asked.where("not is_navigation").join(linked.hint("merge"), ["page_id", "url"], "left").join(fallback.hint("merge"), "page_id", "left")
    by_script = F.when(F.col("kind").isin("xhr", "fetch", "ping", "beacon", "image"), F.col("fallback"))
    requested = _edges(owned, F.coalesce(html_id("linked"), by_script, root), F.col("node"), C.REQUEST, F.col("pos") + 2_000_000)
    redirected = _edges(hops, F.col("from_node"), F.col("to_node"), C.REQUEST, F.col("pos") + 3_000_000, F.lit(True))

    untraced = pages.where("size(requests) = 0").select("page_id", F.col("domain").alias("page_domain"))
    named = dom.select("page_id", html_id("seq").alias("owner"), F.col("seq").alias("a"), F.posexplode(F.array("src", "href", "action")).alias("b", "url"))
    named = named.unionByName(scripts.select("page_id", F.col("node").alias("owner"), (F.col("nth") + 1_000_000).cast("int").alias("a"), F.lit(0).alias("b"), F.col("src").alias("url")))
    named = named.where("url like 'http%'").join(untraced.hint("merge"), "page_id").withColumn("domain", page_domain(F.col("url")))
    named = named.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("a", "b")) - 1).withColumn("node", F.concat(F.lit("request_"), F.col("pos").cast("string")))
    named_rows = _nodes(named, seq=F.col("pos") + 2_000_000, node_type=F.lit(C.NETWORK), is_third_party=F.col("domain") != F.col("page_domain"), is_redirect=F.lit(False))
    named_edges = _edges(named, F.col("owner"), F.col("node"), C.REQUEST, F.col("pos") + 2_000_000)

    # storage layer: traced operations, or else counts in the source
    ops = pages.select("page_id", F.posexplode("storage_ops").alias("pos", "o")).select("page_id", "pos", "o.type", "o.stack").withColumn("node", F.concat(F.lit("storage_"), F.col("pos").cast("string")))
    op_rows = _nodes(ops, seq=F.col("pos") + 4_000_000, node_type=F.lit(C.STORAGE), op_type=F.col("type"))
    by_url = scripts.where("src is not null").groupBy("page_id", "src").agg(F.min("nth").alias("first"), F.max_by("node", "nth").alias("script"))
    in_stack = ops.where("coalesce(stack, '') <> ''").join(by_url.hint("merge"), "page_id").where(F.expr("contains(stack, src)")).groupBy("page_id", "pos").agg(F.min_by("script", "first").alias("script"))
    first_inline = scripts.where("is_inline").groupBy("page_id").agg(F.min_by("node", "nth").alias("inline"))
    touched = ops.join(in_stack.hint("merge"), ["page_id", "pos"], "left").join(first_inline.hint("merge"), "page_id", "left").withColumn("to", F.coalesce("script", "inline"))
    accessed = _edges(touched.where("to is not null"), F.col("node"), F.col("to"), C.ACCESS, F.col("pos") + 4_000_000)
    counts = pages.where("size(storage_ops) = 0 and html <> ''").select("page_id", *[c.alias(n) for n, c in storage_counts(F.col("html")).items()])
    counted = counts.where("get_cookie + set_cookie + get_storage + set_storage > 0").withColumn("node", F.lit("storage_0"))
    counted_rows = _nodes(counted, seq=F.lit(4_000_000), node_type=F.lit(C.STORAGE))
    counted_edges = _edges(counted.join(scripts.select("page_id", F.col("node").alias("script"), "nth").hint("merge"), "page_id"), F.col("node"), F.col("script"), C.ACCESS, F.col("nth") + 4_000_000)

    nodes, edges = html_nodes, structure
    for more in (script_rows, request_rows, named_rows, op_rows, counted_rows):
        nodes = nodes.unionByName(more)
    for more in (execute, navigation, requested, redirected, named_edges, accessed, counted_edges):
        edges = edges.unionByName(more)
    merged = edges.groupBy("page_id", "src", "dst").agg(F.max_by("edge_type", "ord").alias("edge_type"), F.max("is_redirect").alias("is_redirect"), F.min("ord").alias("ord"))
    return cut(nodes, "nodes"), cut(merged, "edges")
