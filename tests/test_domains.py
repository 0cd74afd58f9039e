from pyspark.sql import functions as F

from pagelattice.operators import domains, propagation

FILE = """// a remark
// ===BEGIN ICANN DOMAINS===
com
uk
co.uk   a remark after the rule
jp
*.kobe.jp
!city.kobe.jp

*.ck
!www.ck
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogs.com
// ===END PRIVATE DOMAINS===
"""
#: By hand from the rules: (name, suffix, domain).
WANT = [
    ("a.b.Example.COM:443", "com", "example.com"), ("com", "com", "com"), ("x.co.uk", "co.uk", "x.co.uk"), ("co.uk", "co.uk", "co.uk"), ("y.uk.", "uk", "y.uk"), ("c.kobe.jp", "c.kobe.jp", "c.kobe.jp"),
    ("b.c.kobe.jp", "c.kobe.jp", "b.c.kobe.jp"), ("city.kobe.jp", "kobe.jp", "city.kobe.jp"), ("www.city.kobe.jp", "kobe.jp", "city.kobe.jp"), ("kobe.jp", "jp", "kobe.jp"), ("ck", "ck", "ck"), ("a.ck", "a.ck", "a.ck"),
    ("b.a.ck", "a.ck", "b.a.ck"), ("www.ck", "ck", "www.ck"), ("z.www.ck", "ck", "www.ck"), ("a.nowhere", "nowhere", "a.nowhere"), ("nowhere", "nowhere", "nowhere"), ("10.0.0.1", None, "10.0.0.1"), ("", "", ""), ("me.blogs.com", "com", "blogs.com"),
]


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(FILE)
    rules = domains.read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert {(r.suffix, r.kind) for r in rules.where("kind <> 'plain'").collect()} == {("kobe.jp", "wildcard"), ("city.kobe.jp", "exception"), ("ck", "wildcard"), ("www.ck", "exception")}
    names = spark.createDataFrame([(n,) for n, _, _ in WANT] + [(None,), ("com",)], "name string")
    found = {r.name: (r.name, r.suffix, r.domain) for r in domains.registered_domains(names, rules).collect()}
    assert [found[n] for n, _, _ in WANT] == WANT and len(found) == len(WANT)
    private = domains.read_suffix_rules(spark, str(tmp_path / "rules.dat"), private=True)
    assert domains.registered_domains(names.where("name = 'me.blogs.com'"), private).first().domain == "me.blogs.com"


def test_graph_by_rules(spark):
    urls = spark.createDataFrame([("http://a.b.kobe.jp/x",), ("http://www.city.kobe.jp/",), ("http://shop.co.uk/",)], "url string")
    rules = domains.suffix_rules(spark.createDataFrame([("jp",), ("*.kobe.jp",), ("!city.kobe.jp",), ("co.uk",)], "rule string"))
    vertices, _ = propagation.url_graph(urls, rules=rules)
    assert {r.id for r in vertices.where(F.col("node_type") == "domain").collect()} == {"a.b.kobe.jp", "city.kobe.jp", "shop.co.uk"}
