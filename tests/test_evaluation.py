import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.operators import evaluate, feeds, models, perturb, propagation, refmatch, robustness
from pagelattice.sources import files, tables

SCORES = "attack string, variant string, url string, label string, prediction string, status string"


def test_robustness_unions(spark):
    rows = []
    for url, evades in (("a", {"A1_url_shortener"}), ("b", {"A8_logo_masking"}), ("c", set())):
        for attack in perturb.FAMILIES:
            for v in perturb.VARIANTS:
                rows.append((attack, v, url, "phish", "benign" if attack in evades and v == "v3" else "phish", "ok"))
    rows += [("A1_url_shortener", "v1", "d", "benign", "benign", "ok"), ("A4_html_invisible_link", "v1", "c", "phish", "benign", "missing")]
    evaded = robustness.any_evaded(spark.createDataFrame(rows, SCORES))
    table = {r.surfaces: r.asr for r in robustness.robustness_table(evaded).collect()}
    assert table == {"URL": 0.3333, "HTML": 0.0, "Logo": 0.3333, "URL+HTML": 0.3333, "URL+Logo": 0.6667, "HTML+Logo": 0.3333, "URL+HTML+Logo": 0.6667}
    assert all(table[a] <= table[b] for a in table for b in table if set(a.split("+")) <= set(b.split("+")))


def test_perturbations_by_hand(spark):
    html = '<html><head></head><body><form action="http://e.test/x"><input type="password" name="passwd"></form></body></html>'
    page = spark.createDataFrame([(1, "http://a.b.com:8/p?q#f", html)], "page_id long, url string, html string")
    one = lambda attack, v: perturb.perturb(page, attack, v).first()
    assert one("A2_url_combosquat", 1).url == "http://a.b.com:8/secure-login/p?q#f"
    assert one("A2_url_combosquat", 4).url == "http://secure.a.b.com:8/p?q#f"
    assert one("A3_url_tld_sub", 1).url == "http://a.b.xyz:8/p?q#f"
    assert one("A1_url_shortener", 6).url.startswith("http://is.gd/") and len(one("A1_url_shortener", 6).url) == 17
    assert one("A4_html_invisible_link", 1).html.count("<a ") == 10 and one("A4_html_invisible_link", 1).html.endswith("</a></body></html>")
    assert one("A7_html_input_obfuscate", 1).html == html.replace('type="password"', 'type="text"')
    assert "<form" not in one("A7_html_input_obfuscate", 4).html and "</form" not in one("A7_html_input_obfuscate", 4).html
    assert 'name="pw"' in one("A7_html_input_obfuscate", 5).html and 'action="/submit"' in one("A7_html_input_obfuscate", 5).html
    assert one("A7_html_input_obfuscate", 6).html.count("<input") == 2
    grown = perturb.expand_variants(page)
    assert grown.count() == 42 and grown.select("attack", "variant").distinct().count() == 42
    assert grown.where("attack = 'A3_url_tld_sub' and variant = 'v1'").first().url == "http://a.b.xyz:8/p?q#f"


def test_feeds_and_rescan(spark):
    at = lambda m: F.to_timestamp(F.lit(f"2024-01-01 00:{m:02d}:00"))
    feed = spark.createDataFrame([("openphish", "https://x.test/", 5), ("phishtank", "https://x.test/", 2), ("gsb", "https://x.test/", 7)], "source string, url string, m int").withColumn("first_seen", F.to_timestamp(F.format_string("2024-01-01 00:%02d:00", "m")))
    hits = spark.createDataFrame([("https://x.test/", "phish"), ("https://y.test/", "phish"), ("https://x.test/", "benign")], "url string, prediction string").withColumn("ts_detected", at(0))
    found = {r.url: r for r in feeds.annotate_hits(hits, feed).collect()}
    assert (found["https://x.test/"].earliest_source, found["https://x.test/"].lead_minutes) == ("phishtank", 2.0)
    assert found["https://y.test/"].earliest_blacklist is None
    summary = {r.metric: r.value for r in feeds.lead_summary(feeds.annotate_hits(hits, feed)).collect()}
    assert summary["total_phish"] == 2 and summary["absent_from_all"] == 1 and summary["mean_lead_minutes"] == 2.0 and summary["positive_share"] == 1.0
    stored = feeds.annotate_hits(hits, feed.where("source = 'gsb'")).drop("earliest_source")
    once = feeds.rescan(stored, feed, at(30))
    row = {r.url: r for r in once.collect()}["https://x.test/"]
    assert row.updated and row.openphish_first_seen.minute == 30 and row.phishtank_first_seen.minute == 2 and row.gsb_first_seen.minute == 7 and row.lead_minutes == 2.0
    assert feeds.rescan(once.drop("updated"), feed, at(40)).where("updated").count() == 0
    old = spark.createDataFrame([("https://h.test/a",)], "url string").withColumn("first_seen", F.to_timestamp(F.lit("2024-01-01")))
    asked = spark.createDataFrame([("https://h.test/a",), ("https://h.test/b",)], "url string")
    late = {r.url: r.first_seen for r in feeds.lookup_timed_feed(asked, old, F.to_timestamp(F.lit("2024-03-02"))).collect()}
    assert late["https://h.test/a"] is not None and late["https://h.test/b"] is None  # 61 days
    assert all(r.first_seen for r in feeds.lookup_text_feed(asked, old).collect())


def test_panel_asks_hosts_while_fresh(spark):
    """A text feed and a fresh timed listing speak for the host, an old one and the exact source for their URL only."""
    rows = [("openphish", "https://h.test/a", "2024-01-01"), ("phishtank", "https://old.test/a", "2024-01-01"), ("phishtank", "https://new.test/a", "2024-02-01"), ("gsb", "https://g.test/a", "2024-02-01")]
    feed = spark.createDataFrame(rows, "source string, url string, t string").withColumn("first_seen", F.to_timestamp("t"))
    asked = spark.createDataFrame([(f"https://{h}.test/{p}",) for h in ("h", "old", "new", "g", "none") for p in "ab"] + [(None,)], "url string")
    now = F.to_timestamp(F.lit("2024-03-02"))
    found = {r.url: tuple(x is not None for x in (r.openphish_first_seen, r.phishtank_first_seen, r.gsb_first_seen)) for r in feeds.panel_lookup(asked, feed, now).collect()}
    want = {"h/a": "100", "h/b": "100", "old/a": "010", "old/b": "000", "new/a": "010", "new/b": "010", "g/a": "001", "g/b": "000", "none/a": "000", "none/b": "000"}
    assert found == {None: (False,) * 3} | {f"https://{k.replace('/', '.test/')}": tuple(x == "1" for x in v) for k, v in want.items()}
    tied = feeds.panel_lookup(asked.limit(1), feed.unionByName(feed.where("url = 'https://h.test/a'").withColumn("source", F.lit("gsb"))), now).withColumn("first", feeds.earliest())
    assert tied.first()["first"].source == "openphish"


def test_exact_median(spark):
    import statistics

    rnd = random.Random(3)
    for n in (0, 1, 2, 7, 50):
        values = [round(rnd.choice([rnd.uniform(-500, 500), 17.25]), 2) for _ in range(n)] + [None]
        found = feeds.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", 60.0).first().median
        assert found == (statistics.median(values[:-1]) if n else None)


def test_other_detectors_outputs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('url\tlabel\tpredict\tscore\nhttps://a.test/"\t1\t1\t0.9\nhttps://b.test/\t-1\t-1\t0.1\nshort\t1\n')
    found = files.match_predictions(spark.createDataFrame([('https://a.test/"',), ("https://z.test/",)], "url string"), files.read_predictions(spark, str(tmp_path / "t.tsv"), "table"))
    assert {(r.url, r.prediction, r.score) for r in found.collect()} == {('https://a.test/"', "phish", 0.9), ("https://z.test/", "unknown", 0.0)}
    (tmp_path / "f.txt").write_text("site_0\thttps://a.test/\n\t1\tbrand\t['x']\t0.75\t1.0\t2.0\nsite_1\thttps://b.test/\nsite_2\thttps://c.test/\n\t0\tNone\tNone\tNone\t1\nsite_3\thttps://d.test/\n\tx\n\t1\tb\td\t0.5\nsite_4\tu\n\t1\tb\td\tbad\n")
    urls = spark.createDataFrame([(k, f"u{k}") for k in range(6)], "n int, url string")
    got = {r.n: (r.prediction, r.score) for r in files.match_predictions(urls, files.read_predictions(spark, str(tmp_path / "f.txt"), "folders"), "n").collect()}
    assert got == {0: ("phish", 0.75), 1: ("unknown", 0.0), 2: ("benign", 0.0), 3: ("benign", 0.0), 4: ("benign", 0.0), 5: ("unknown", 0.0)}
    entries = {"site_0": {"phish_category": "credential", "phish": 0, "siamese_conf": 0.8}, "site_1": {"phish": 1, "score": 0.4}, "site_2": {"phish_category": "legitimate", "phish": 1}, "site_3": {"phish": 1, "siamese_conf": None, "score": 0.9}}
    (tmp_path / "d.json").write_text(json.dumps(entries, indent=1))
    (tmp_path / "l.json").write_text(json.dumps([{"folder": k, "url": "u", **v} for k, v in entries.items()]))
    for name in ("d.json", "l.json"):
        got = {r.key: (r.prediction, r.score) for r in files.read_predictions(spark, str(tmp_path / name), "json").collect()}
        assert got == {"site_0": ("phish", 0.8), "site_1": ("phish", 0.4), "site_2": ("benign", 0.0), "site_3": ("phish", 0.0)}
    with pytest.raises(ValueError):
        files.read_predictions(spark, "x", "other")


def test_dns_cache_sites_and_sinks(spark, tmp_path):
    for k, text in enumerate(('{"domain": "a.test", "ip": "10.0.0.1"}', '{\n "domain": "b.test", "ip": null}', "{broken")):
        (tmp_path / "dns").mkdir(exist_ok=True)
        (tmp_path / "dns" / f"{k}.json").write_text(text)
    domains = spark.createDataFrame([("a.test",), ("b.test",), ("c.test",)], "domain string")
    assert {r.domain: r.ip for r in files.attach_ip(domains, files.read_dns_cache(spark, str(tmp_path / "dns"))).collect()} == {"a.test": "10.0.0.1", "b.test": None, "c.test": None}
    for name, info, label, shot in (("s1", " https://www.A.test:8/x\n", "phish\n", True), ("s2", "https://b.test/", None, True), ("s3", "https://c.test/", "benign", False), ("s4", None, None, True)):
        folder = tmp_path / "sites" / name
        folder.mkdir(parents=True)
        for file, text in (("info.txt", info), ("label.txt", label), ("shot.png", "x" if shot else None)):
            if text is not None:
                (folder / file).write_text(text)
    sites = {r.name: (r.url, r.label, r.domain) for r in files.read_sites(spark, str(tmp_path / "sites")).collect()}
    assert sites == {"s1": ("https://www.A.test:8/x", "phish", "a.test"), "s2": ("https://b.test/", "unknown", "b.test"), "s4": ("", "unknown", "")}
    rows = spark.createDataFrame([("u", "phish", "phish", 0.123456), ("v", "benign", "benign", 0.5)], "url string, label string, prediction string, score double")
    for _ in range(2):
        files.hits_sink(rows, str(tmp_path / "hits"), 0)  # a batch that is tried again
    files.hits_sink(rows, str(tmp_path / "hits"), 1)
    assert [(r.url, r.batch) for r in spark.read.parquet(str(tmp_path / "hits")).orderBy("batch").collect()] == [("u", 0), ("u", 1)]
    files.write_predictions(rows, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {("u", "phish", "phish", "0.1235"), ("v", "benign", "benign", "0.5000")}
    files.write_metric_table(spark.createDataFrame([("rows", 2.0, 1)], "metric string, value double, other int"), str(tmp_path / "metrics"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "metrics"), header=True).collect()] == [("rows", "2.0")]
    pages = spark.createDataFrame([("k", "<p>")], "page_key string, html string")
    files.write_page_cache(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).collect() == pages.collect()


def test_samples_and_metrics(spark):
    rows = spark.range(100).selectExpr("id", "if(id < 90, 'benign', 'phish') as label")
    picked = {r.label: r.n for r in evaluate.balanced_subsample(rows, 20, "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert picked == {"benign": 20, "phish": 10}
    assert evaluate.balanced_subsample(rows, 50, "id").count() == 100
    parts = {r.part: r.n for r in evaluate.train_val_split(rows, "id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 90, "val": 10}
    assert {r.part for r in evaluate.train_val_split(rows.limit(9), "id").collect()} == {"train"}
    nothing = evaluate.binary_metrics(spark.createDataFrame([(0, 0)], "truth int, guess int")).first()
    assert (nothing.accuracy, nothing.precision, nothing.recall, nothing.f1) == (1, 0, 0, 0)
    assert evaluate.class_weights(rows.where("label = 'phish'")).count() == 0


def model_rows(spark, n=240):
    rnd = random.Random(2)
    rows = [(k, "phish" if k % 2 else "benign", *[rnd.gauss(1.5 * (k % 2), 1) for _ in range(6)]) for k in range(n)]
    names = [f"x{j}" for j in range(6)]
    return spark.createDataFrame(rows, "page_id long, label string, " + ", ".join(f"{n} double" for n in names)), names


def test_classifiers_learn_and_save(spark, tmp_path):
    rows, names = model_rows(spark)
    for name in models.CLASSIFIERS:
        model = models.fit(rows, name, names, trees=5, depth=3)
        assert models.evaluate(model, rows).first().accuracy > 0.85, name
    model = models.fit(rows, "svm", names)
    models.save_model(model, str(tmp_path / "m"))
    assert models.evaluate(models.load_model(str(tmp_path / "m")), rows).first().accuracy > 0.85
    again = models.predict(models.load_model(str(tmp_path / "m")), rows)
    assert again.columns == [*rows.columns, "score", "prediction"]
    assert again.where("score between 0 and 1").count() == rows.count()


def test_category_ablation_shapes(spark):
    rnd = random.Random(3)
    rows = spark.createDataFrame([(k, "phish" if k % 2 else "benign", *[float(k % 2) + rnd.random() for _ in C.FEATURE_NAMES]) for k in range(40)], "page_id long, label string, " + ", ".join(f"{n} double" for n in C.FEATURE_NAMES))
    found = models.category_ablation(rows, rows, "forest", trees=2, depth=2).collect()
    assert [r.n_features for r in found] == [42, 43, 16, 85, 58, 59, 101]


def test_belief_propagation_by_hand(spark):
    vertices = spark.createDataFrame([(v, "url") for v in "pabc"], "id string, node_type string")
    edges = spark.createDataFrame([("p", "a", 0.9), ("a", "b", 0.9)], "src string, dst string, sim double")
    beliefs = propagation.init_beliefs(vertices, spark.createDataFrame([("p", 1)], "id string, label int"))
    first = {(r.src, r.dst): (r.m0, r.m1) for r in propagation.bp_step(propagation.initial_messages(edges, beliefs), beliefs).collect()}
    assert first[("p", "a")] == (1.0, 0.0)
    same, other = min(0.7, 0.1), max(0.7, 0.9)
    h0, h1 = 0.5 + 1.0, 0.5 + 0.0
    assert all(abs(x - y) < 1e-9 for x, y in zip(first[("a", "b")], (min(h0 + same, h1 + other), min(h0 + other, h1 + same))))
    found = propagation.bp_run(edges, beliefs, sweeps=3)
    assert {r.id: r.map_label for r in found.collect()} == {"p": 1, "a": 1, "b": 1, "c": 0}
    scores = {r.id: r.score for r in propagation.bp_score(found).collect()}
    assert scores["a"] > 0.5 and scores["c"] == 0.5
    assert propagation.energy(found, beliefs, edges).first().energy > 0
    loopy = {r.id: r.score for r in propagation.lbp_score(propagation.lbp_run(edges, beliefs)).collect()}
    assert loopy["a"] > 0.5


def test_url_graph_extension(spark):
    first = spark.createDataFrame([("https://a.example.com/login/page",)], "url string")
    both = first.unionByName(spark.createDataFrame([("https://b.example.com/login/other",)], "url string"))
    dns = spark.createDataFrame([("example.com", "10.0.0.1")], "domain string, ip string")
    grown, whole = propagation.extend_graph(propagation.url_graph(first, dns), both, dns), propagation.url_graph(both, dns)
    for part in (0, 1):
        assert sorted(map(tuple, grown[part].collect())) == sorted(map(tuple, whole[part].collect()))


def test_contrastive_pairs(spark):
    items = spark.createDataFrame([(k, f"b{k % 4}", [float(k % 4), float(k)]) for k in range(17)], "key long, brand string, vector array<float>")
    brand = {k: k % 4 for k in range(17)}
    rows = refmatch.contrastive_pairs(items, 60).collect()
    assert len(rows) == 60 and sum(r.y for r in rows) == 30
    assert all((brand[r.a] != brand[r.b]) == bool(r.y) for r in rows) and all(r.a != r.b for r in rows)
    pairs = spark.createDataFrame([(0, 4, 0), (0, 1, 1)], "a long, b long, y int")
    row = refmatch.contrastive_loss(pairs, items).first()
    assert row.pairs == 2 and abs(row.loss - (16 / 2 + 0) / 2) < 1e-9


def test_file_sources(spark, tmp_path):
    (tmp_path / "urls.csv").write_text("url,label\nhttps://a.test/,phish\nhttps://b.test/[x]?q=%20,\n")
    assert {(r.url, r.label) for r in files.read_url_list(spark, str(tmp_path / "urls.csv")).collect()} == {("https://a.test/", "phish"), ("https://b.test/[x]?q=%20", "unknown")}
    (tmp_path / "feed.txt").write_text("# c\n\n https://a.test/ \nhttps://a.test/\nhttps://b.test/\n")
    assert files.read_text_feed(spark, str(tmp_path / "feed.txt"), "2024-01-01T00:00:00Z").count() == 2
    (tmp_path / "timed.csv").write_text("url,verification_time\nhttps://a.test/,2024-01-02T00:00:00Z\nhttps://a.test/,2024-01-03T00:00:00Z\nhttps://b.test/,soon\n,2024-01-01\n")
    timed = {r.url: r.first_seen.day for r in files.read_timed_feed(spark, str(tmp_path / "timed.csv"), "2024-01-09T00:00:00Z").collect()}
    assert timed == {"https://a.test/": 3, "https://b.test/": 9}
    for key, html, trace in (("k1", "<p>x</p>", '{"requests": [{"url": "https://r.test/", "status": 200}], "storage_ops": [{"type": "get_cookie", "ts": 5}]}'), ("k2", "<p>y</p>", "{broken"), ("k3", "", "{}"), ("k4", "<p>z</p>", None)):
        (tmp_path / "cache" / key).mkdir(parents=True)
        (tmp_path / "cache" / key / "page.html").write_text(html)
        if trace is not None:
            (tmp_path / "cache" / key / "instrumentation.json").write_text(trace)
    cache = {r.page_key: r for r in files.read_page_cache(spark, str(tmp_path / "cache")).collect()}
    assert set(cache) == {"k1", "k2", "k4"} and len(cache["k1"].requests) == 1 and cache["k2"].requests == [] and cache["k4"].storage_ops == []
    ops = files.redact_traces(files.read_page_cache(spark, str(tmp_path / "cache"))).where("page_key = 'k1'").first().storage_ops
    assert "stack" not in ops[0].asDict()
    for k in range(2):  # the last row holds over several files
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{k}.csv").write_text(f"url,verification_time\nhttps://a.test/,2024-01-0{k + 4}T00:00:00Z\n")
    assert [r.first_seen.day for r in files.read_timed_feed(spark, str(tmp_path / "many"), "2024-01-09T00:00:00Z").collect()] == [5]
    ledger = spark.createDataFrame([("a", "ok"), ("b", "fail")], "url string, status string")
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "url string, pos int")
    assert [r.url for r in tables.ledger_pending(wanted, ledger, cap=3).collect()] == ["e", "d"]
    assert tables.drop_stale_failures(ledger).count() == 1


def test_a_page_is_cut_into_tokens_once_for_all_variants(spark):
    odd = ["<p>a</p>", "", "x</BODY >y</body>\nz</head>", '<body>$1\\<input type=password name="pwd">\n</body></html>\n', "<!-- </body> --><form action='http://x/'>é</form>"]
    pages = spark.createDataFrame([(k, "http://a.b/c", h) for k, h in enumerate([*odd, None])], "page_id long, url string, html string")
    grown = perturb.expand_variants(pages)
    plan = grown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("^(.*)</body") == 0
    found = {(r.page_id, r.attack, r.variant): r.html for r in grown.collect()}
    for k, html in enumerate(odd):
        at = [m.start() for m in re.finditer(r"(?i)</body\s*>", html)]
        head, tail = (html[: at[-1]], html[at[-1] :]) if at else (html, "")
        for v in range(1, 7):
            assert found[k, "A4_html_invisible_link", f"v{v}"] == head + perturb.anchor_snippet(*perturb.ANCHORS[v - 1]) + tail
            assert found[k, "A6_html_dom_expand", f"v{v}"] == head + perturb.benign_snippet(v) + tail
            alone = pages.select("page_id", perturb.obfuscate_inputs(pages.html, v).alias("h")).where(f"page_id = {k}").first().h
            assert found[k, "A7_html_input_obfuscate", f"v{v}"] == alone
    assert found[len(odd), "A4_html_invisible_link", "v1"] is None and {r.failed for r in perturb.manifest(grown).collect()} == {1}
