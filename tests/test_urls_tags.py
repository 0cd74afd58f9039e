import hashlib
import math
from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions import urls
from pagelattice.operators import tags

URLS = [
    "https://www.bank-login.example.com:8080/a/b;p=1/c;x?key=1&q=2#frag", "http://user:pw@Sub.Example.CO.UK/path//x", "http://1.2.3.4/secure/login.php", "example.com/only/path", "http://h/[%20]?q", "https://x.tk", "",
]


def frame(spark, texts, name="url"):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"id int, {name} string")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_split_url_matches_the_standard_library(spark):
    df = frame(spark, URLS)
    parts = urls.split_url(F.col("url"))
    for name in ("scheme", "netloc", "query", "fragment"):
        assert values(df, parts[name]) == [getattr(urlsplit(u), name) for u in URLS]
    assert values(df, parts["path"])[:2] == ["/a/b;p=1/c", "/path//x"]


def test_domains_and_keys(spark):
    df = frame(spark, URLS)
    assert values(df, urls.page_domain(F.col("url")))[3] == "example.com"
    assert values(df, urls.host(F.col("url")))[1:4] == ["sub.example.co.uk", "1.2.3.4", "example.com"]
    assert values(df, urls.host(F.col("url")))[-1] is None
    assert values(df, urls.registered_domain(urls.page_domain(F.col("url"))))[0] == "example.com"
    assert values(df, urls.registered_domain(F.lit("a.b.co.uk")))[0] == "b.co.uk"
    assert values(df, urls.registered_domain(F.lit("10.0.0.1")))[0] == "10.0.0.1"
    assert values(df, urls.url_key(F.col("url"))) == [hashlib.sha256(u.encode()).hexdigest()[:16] for u in URLS]


def test_tokens_and_entropy(spark):
    df = frame(spark, ["https://www.Login-verify.com/ab/abc_DEF"])
    assert values(df, urls.url_tokens(F.col("url"))) == [["login", "verify", "abc", "def"]]
    assert values(df, urls.path_substrings(F.col("url"))) == [[]]
    text = "aabbbbcd"
    expected = -sum(n / 8 * math.log2(n / 8) for n in Counter(text).values())
    assert abs(values(frame(spark, [text]), urls.char_entropy(F.col("url")))[0] - expected) < 1e-12


def test_labels_numbers_times(spark):
    df = frame(spark, ["phish", "PHISHING", "1", "true", "benign", None])
    for rule, expected in (("model", [1, 1, 1, 1, 0, 0]), ("robustness", [1, 1, 1, 0, 0, 0]), ("baseline", [1, 0, 0, 0, 0, 0])):
        assert values(df, urls.is_phish(F.col("url"), rule)) == expected
    numbers = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, None), (3, 2.5)], "id int, x double")
    assert values(numbers, urls.clean_number(F.col("x"))) == [0.0, 0.0, 0.0, 2.5]
    times = frame(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "soon", None])
    found = values(times, urls.parse_iso(F.col("url")))
    assert found[0] == found[1] and found[2:] == [None, None]
    pair = spark.createDataFrame([(0, "2024-01-01 00:12:00", "2024-01-01 00:00:00")], "id int, a string, b string")
    assert values(pair, urls.lead_minutes(F.to_timestamp("a"), F.to_timestamp("b"))) == [12.0]


def test_scrub(spark):
    secret = "sk-" + "a" * 24
    df = frame(spark, [f"https://h/{secret}?Token=abc&q=1&sig=zz#k=1", "https://h/x?tokens=1", "https://h/x"])
    assert values(df, urls.scrub_url(F.col("url"))) == ["https://h/<redacted>?Token=<redacted>&q=1&sig=<redacted>#k=1", "https://h/x?tokens=1", "https://h/x"]


def test_url_features_by_hand(spark):
    found = urls.url_feature_columns(F.col("url"))
    assert set(found) == set(C.FEATURE_GROUPS["content_url_lexical"]) | set(C.FEATURE_GROUPS["content_url_entropy_token"])
    row = frame(spark, ["https://secure.a-1.example.tk:81/login//x.php?a=1&b=@~"]).select(*[c.alias(n) for n, c in found.items()]).first()
    expected = {
        "domain_length": 21, "path_length": 13, "query_length": 8, "tld_length": 2, "num_subdomains": 2, "path_depth": 2, "num_hyphens_in_domain": 1, "num_digits_in_domain": 1, "num_special_chars": 3,
        "has_at_symbol": 1, "has_double_slash_redirect": 1, "has_ip_address": 0, "is_https": 1, "has_suspicious_tld": 1, "num_suspicious_tokens": 2, "num_slashes_in_domain": 0,
    }
    assert {k: row[k] for k in expected} == expected


PAGE = """<html><head><title>Sign in</title><link rel="shortcut ICON" href="https://cdn.test/i.ico"></head><body><!-- <iframe> --><script>document.cookie = "<input type=password>"; eval("x")</script>
<a href="#">a</a><a href="/ok">b</a><form action="https://evil.test/p"><input type="password"><input type='hidden'><button>Go</button></form><img class="brand" src="https://cdn.test/l.png"><iframe></iframe></body></html>"""


def test_html_features(spark):
    df = frame(spark, [PAGE, None], "html").withColumn("domain", F.lit("page.test"))
    row = tags.html_features(df).orderBy("id").collect()
    first = row[0]
    expected = {
        "num_password_inputs": 1, "num_hidden_inputs": 1, "num_iframes": 1, "has_title": 1, "title_length": 7, "has_favicon": 1, "favicon_external": 1, "external_brand_resource": 1, "obfuscation_indicator": 1.0,
        "empty_link_node_ratio": 0.5,
    }
    assert {k: first[k] for k in expected} == expected
    assert row[1]["num_iframes"] == 0 and row[1]["div_span_ratio"] == 0


def test_feature_names():
    assert len(C.FEATURE_NAMES) == len(set(C.FEATURE_NAMES)) == 101
    assert [len(C.features_of(c)) for c in ("C", "S", "B", "CS", "CB", "SB", "CSB")] == [42, 43, 16, 85, 58, 59, 101]


def test_count_entropy_and_words(spark):
    rows = spark.createDataFrame([({"a": 1, "b": 1, "c": 2},), ({"a": 5},), ({"a": 0, "b": 3},), ({},)], "m map<string,int>")
    assert [round(r.e, 6) for r in rows.select(urls.count_entropy(F.col("m")).alias("e")).collect()] == [1.5, 0.0, 0.0, 0.0]
    texts = spark.createDataFrame([("log in now",), ("nothing",), (None,)], "t string")
    assert [r.x for r in texts.select(urls.contains_any(F.col("t"), ("sign", "log")).alias("x")).collect()] == [True, False, False]
