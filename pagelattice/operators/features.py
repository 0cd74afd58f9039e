"""The 101 features of a page, from its URL, tags, element table and graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions.urls import count_entropy, page_domain, url_feature_columns
from pagelattice.operators import graph, tags
from pagelattice.operators.page_graph import build_page_graph
from pagelattice.tables import cut


def _any(words) -> str:
    return "(" + "|".join(w.replace("-", r"\-") for w in words) + ")"


def text_cues(dom: DataFrame, pages: DataFrame) -> DataFrame:
    """Features that need element texts, from the flags of the element table: one aggregate, one row a page with elements."""
    labelled = F.lower(F.concat_ws(" ", "alt", "title")).rlike(_any(C.BRAND_WORDS))
    counted = dom.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("tags_n"), F.count_if(F.col("tag") == "form").alias("forms_n"), F.avg(F.when(F.col("has_credential"), F.col("depth"))).alias("credential_depth"),
        F.count_if("has_urgency").alias("urgent_n"), F.count_if(F.col("has_brand") | labelled).alias("brand_n"), F.count_if(F.col("has_action") & (F.col("tag") == "form")).alias("action_n"),
        F.max("spaced_text").alias("spaced_text"),
    )
    joined = counted.join(pages.select("page_id", F.lower("domain").alias("d")).hint("merge"), "page_id")
    in_text = reduce(lambda a, b: a | b, [F.contains("spaced_text", F.lit(w)) & ~F.contains("d", F.lit(w)) for w in C.BRAND_WORDS])
    ratio = lambda a, b: F.bround(F.coalesce(F.col(a), F.lit(0)) / F.greatest(F.col(b), F.lit(1)), 4)
    return joined.select(
        "page_id", F.coalesce(F.bround("credential_depth", 2), F.lit(0.0)).alias("credential_keyword_depth"), ratio("brand_n", "tags_n").alias("brand_keyword_in_nodes"),
        F.coalesce(in_text.cast("int"), F.lit(0)).alias("brand_in_text_not_domain"), ratio("urgent_n", "tags_n").alias("urgency_keyword_ratio"),
        ratio("action_n", "forms_n").alias("action_keyword_in_form"),
    )


def node_features(nodes: DataFrame) -> DataFrame:
    """Counts over a page's nodes: one aggregate."""
    html = F.col("node_type") == C.HTML
    total, n_html = F.count(F.lit(1)), F.greatest(F.count_if(html), F.lit(1))
    words = F.lower(F.concat_ws(" ", "id", "class", "src", "href", "action")).rlike(_any(C.CUE_WORDS))
    link = F.trim(F.coalesce("href", F.lit("")))
    share = lambda condition, of: F.bround(F.count_if(condition) / of, 4)
    data = F.coalesce(F.startswith("src", F.lit("data:")), F.lit(False)) | F.coalesce(F.startswith("href", F.lit("data:")), F.lit(False))
    aggs = {
        "n_nodes": total,
        "phishing_keyword_in_nodes": share(html & words, total),
        "data_uri_node_ratio": share(data, total),
        "empty_link_node_ratio": F.bround(F.count_if((F.col("tag") == "a") & (link.isin("#", "") | F.startswith(link, F.lit("javascript:")))) / F.greatest(F.count_if(F.col("tag") == "a"), F.lit(1)), 4),
        "html_node_ratio": share(html, total),
        "script_node_ratio": share(F.col("node_type") == C.SCRIPT, total),
        "request_node_ratio": share(F.col("node_type") == C.NETWORK, total),
        "storage_node_ratio": share(F.col("node_type") == C.STORAGE, total),
        "cookie_set_with_form": (F.max(F.coalesce("set_cookie", F.lit(0)) > 0) & F.max(F.coalesce(F.col("tag") == "form", F.lit(False)))).cast("int"),
    } | {name: share(html & F.lower("tag").isin(*group), n_html) for name, group in C.TAG_GROUPS.items()}
    return nodes.groupBy("page_id").agg(*[v.alias(k) for k, v in aggs.items()])


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shares of edge types, flags of targets, entropy: one aggregate after one join on the target."""
    ends = nodes.select("page_id", F.col("node").alias("dst"), F.col("node_type").alias("to_type"), F.coalesce("is_third_party", F.lit(False)).alias("third"))
    starts = nodes.where("tag = 'form'").select("page_id", F.col("node").alias("src"), F.lit(True).alias("from_form"))
    joined = edges.join(ends.hint("merge"), ["page_id", "dst"], "left").join(starts.hint("merge"), ["page_id", "src"], "left")
    total, kind = F.count(F.lit(1)), F.col("edge_type")
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    requests = count(kind == C.REQUEST)
    aggs = {f"{k}_edge_ratio": F.bround(count(kind == k) / total, 4) for k in (C.STRUCTURE, C.REQUEST, C.EXECUTE, C.ACCESS)}
    aggs["redirect_edge_ratio"] = F.bround(count((kind == C.REQUEST) & F.col("is_redirect")) / total, 4)
    aggs["cross_domain_edge_ratio"] = F.bround(count((kind == C.REQUEST) & F.col("third")) / F.greatest(requests, F.lit(1)), 4)
    aggs["form_to_external_edge"] = (count(F.col("from_form") & (F.col("to_type") == C.NETWORK) & F.col("third")) > 0).cast("int")
    kinds = F.create_map(*[x for k in (C.STRUCTURE, C.REQUEST, C.EXECUTE, C.ACCESS) for x in (F.lit(k), count(kind == k))])
    aggs["avg_edge_type_entropy"] = F.bround(count_entropy(kinds), 4)
    return joined.groupBy("page_id").agg(*[v.alias(k) for k, v in aggs.items()])


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topology, shape, hierarchy, path and flow features: one row a page."""
    keyed = edges.select(F.col("page_id").alias("g"), "src", "dst", (F.col("edge_type") == C.STRUCTURE).alias("structure"), "ord")
    points = nodes.select(F.col("page_id").alias("g"), "node", "seq", "node_type", "tag", F.coalesce("is_redirect", F.lit(False)).alias("is_redirect"), F.coalesce("is_third_party", F.lit(False)).alias("third"))
    entered = keyed.select("g", F.col("dst").alias("node"), F.lit(True).alias("entered")).distinct()
    html = points.where(F.col("node_type") == C.HTML).join(entered.hint("merge"), ["g", "node"], "left")
    roots = html.groupBy("g").agg(F.min_by("node", F.struct(F.col("entered").isNotNull(), "seq")).alias("root"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    flagged = points.join(roots.hint("merge"), "g", "left").select(
        "g", "node", (F.col("node") == F.col("root")).alias("is_root"), is_(F.col("tag") == "form").alias("is_form"), is_(F.col("tag").isin(*C.INPUT_TAGS)).alias("is_input"),
        (F.col("node_type") == C.SCRIPT).alias("is_script"), (F.col("node_type") == C.STORAGE).alias("is_storage"), (F.col("node_type") == C.NETWORK).alias("is_request"), "is_redirect",
    )
    profiles = cut(graph.node_profiles(flagged.withColumn("is_root", is_(F.col("is_root"))), keyed), "profiles")
    components = profiles.select("g", "node", "component")
    sizes = components.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("g").agg(F.max("n").alias("big_n"))
    outs = keyed.groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_n"))
    children = keyed.where("structure").groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("child_n"))
    full = points.join(profiles.hint("merge"), ["g", "node"]).join(largest.hint("merge"), "g").join(outs.hint("merge"), ["g", "node"], "left").join(children.hint("merge"), ["g", "node"], "left")
    per_graph = full.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    full = full.join(per_graph.hint("merge"), "g")

    n = F.first("n")
    in_form, html_only = F.col("from_forms"), F.col("node_type") == C.HTML
    close = F.when(F.col("sum_in") > 0, (F.col("n_in") / F.col("sum_in")) * (F.col("n_in") / (F.col("n") - 1))).otherwise(0.0)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False))).cast("int")
    inputs = F.col("tag").isin(*C.INPUT_TAGS)
    text_tag = F.coalesce(F.col("tag").isin(*C.TEXT_TAGS), F.lit(False))
    big = F.first("big_n")
    aggs = {
        "graph_diameter": F.max("eccentricity"),
        "graph_avg_shortest_path": F.bround(F.when(big > 1, F.sum("sum_undirected") / (big * (big - 1))).otherwise(0.0), 4),
        "dom_depth_max": F.max(F.when(html_only, F.col("structure_depth"))),
        "dom_depth_avg": F.bround(F.avg(F.when(html_only, F.col("structure_depth"))), 2),
        "dom_breadth_max": F.max(F.when(html_only, F.coalesce("child_n", F.lit(0)))),
        "dom_leaf_ratio": F.bround(F.count_if(F.col("out_n").isNull()) / n, 4),
        "form_subgraph_size": F.count_if(in_form),
        "form_subgraph_ratio": F.bround(F.count_if(in_form) / n, 4),
        "form_subgraph_depth": F.max("form_depth"),
        "input_to_root_avg_distance": F.bround(F.avg(F.when(inputs, F.col("root_depth"))), 2),
        "script_to_input_path_length": F.when(F.sum(F.when(inputs, F.col("script_n"))) > 0, F.bround(F.sum(F.when(inputs, F.col("script_sum"))) / F.sum(F.when(inputs, F.col("script_n"))), 2)).otherwise(-1.0),
        "exfil_path_length": F.min("exfil"),
        "non_form_content_ratio": F.bround(F.count_if(text_tag & ~in_form) / F.greatest(F.count_if(text_tag), F.lit(1)), 4),
        "script_to_form_path_exists": flag((F.col("tag") == "form") & F.col("from_scripts")),
        "form_data_exfil_path": flag((F.col("node_type") == C.NETWORK) & F.col("third") & in_form),
        "input_to_request_flow": flag((F.col("node_type") == C.NETWORK) & F.col("from_inputs")),
        "storage_to_request_flow": flag((F.col("node_type") == C.NETWORK) & F.col("third") & F.col("from_storage")),
        "redirect_to_form_pattern": flag((F.col("tag") == "form") & F.col("from_redirects")),
        "form_to_redirect_pattern": flag(F.col("is_redirect") & in_form),
    }
    for name, value in (("closeness_centrality", close), ("ancestors", F.col("n_in")), ("descendants", F.col("n_out"))):
        exact = name == "closeness_centrality"
        aggs |= {f"{name}_mean": F.bround(F.avg(value), 4), f"{name}_std": F.bround(F.stddev_pop(value), 4)}
        aggs |= {f"{name}_max": F.bround(F.max(value), 4) if exact else F.max(value), f"{name}_min": F.bround(F.min(value), 4) if exact else F.min(value)}
    made = full.groupBy("g").agg(*[v.alias(k) for k, v in aggs.items()])

    chains = graph.chain_depths(keyed.join(points.where(F.col("node_type") == C.NETWORK).select("g", F.col("node").alias("src")).hint("merge"), ["g", "src"], "left_semi").join(points.where(F.col("node_type") == C.NETWORK).select("g", F.col("node").alias("dst")).hint("merge"), ["g", "dst"], "left_semi"))
    parts = (
        graph.density(keyed, points).select("g", F.col("density").alias("graph_density")),
        graph.component_summary(components).withColumnsRenamed({"components": "graph_num_components", "largest_ratio": "graph_largest_component_ratio"}),
        graph.clustering(keyed, points).withColumnsRenamed({"average_clustering": "graph_clustering_coefficient", "transitivity": "graph_transitivity"}),
        graph.assortativity(keyed).withColumnRenamed("assortativity", "graph_assortativity"),
        graph.degree_connectivity(keyed, points).withColumnRenamed("connectivity", "average_degree_connectivity"),
        chains.withColumnRenamed("depth", "resource_dependency_depth"),
    )
    for part in parts:
        made = made.join(part.hint("merge"), "g", "left")
    return made.withColumnRenamed("g", "page_id")


def feature_row(pages: DataFrame) -> DataFrame:
    """page_id and the 101 features of pages (page_id, url, html and, if there, traces), in canonical order.

    A page without html keeps its URL features; the others are those of a single node.
    """
    nodes, edges, dom = build_page_graph(pages)
    base = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("domain", page_domain(F.col("url"))), "base")
    urls = base.select("page_id", *[c.alias(n) for n, c in url_feature_columns(F.col("url")).items()])
    counted = tags.html_features(base).select("page_id", "external_brand_resource", "obfuscation_indicator", *C.FEATURE_GROUPS["content_html_content"][2:])
    joined = urls
    for part in (counted, text_cues(dom, base), node_features(nodes), edge_features(edges, nodes), graph_features(nodes, edges)):
        joined = joined.join(part.hint("merge"), "page_id", "left")
    default = lambda name: -1.0 if name == "script_to_input_path_length" else 0.0
    return joined.select("page_id", *[F.coalesce(F.col(n).cast("double"), F.lit(default(n))).alias(n) for n in C.FEATURE_NAMES])
