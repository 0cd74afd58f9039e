"""Perturbed copies of pages: URL and HTML rewrites, their grid, and combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions.urls import URL_PARTS, short_hash
from pagelattice.operators.tags import tokens

# Variants 1 to 6 of each family.
SHORTENERS = (("bit.ly", 8), ("tinyurl.com", 7), ("goo.gl", 5), ("t.co", 10), ("ow.ly", 6), ("is.gd", 4))
COMBOSQUATS = (("path", "/secure-login"), ("path", "/account-verify"), ("path", "/auth/signin"), ("sub", "secure"), ("sub", "account"), ("sub", "login-verify"))
TLDS = ("xyz", "top", "tk", "co", "io", "net")
ANCHORS = ((10, "display:none"), (25, "display:none"), (50, "display:none"), (25, "visibility:hidden"), (25, "position:absolute;left:-9999px;top:-9999px"), (25, "font-size:1px;color:transparent"))
FAMILIES = {
    "A1_url_shortener": "URL", "A2_url_combosquat": "URL", "A3_url_tld_sub": "URL", "A4_html_invisible_link": "HTML", "A5_html_object_ratio": "HTML",
    "A6_html_dom_expand": "HTML", "A7_html_input_obfuscate": "HTML", "A8_logo_masking": "Logo", "A9_logo_manipulation": "Logo", "A10_logo_font_subst": "Logo",
}
BUILT = tuple(name for name, surface in FAMILIES.items() if surface != "Logo")
VARIANTS = tuple(f"v{k}" for k in range(1, 7))
SEMANTIC = ("header", "nav", "main", "footer", "article", "section", "aside")
#: Own filler texts and link targets: what they say does not matter, how many there are does.
PARAGRAPHS = tuple(f"Community news, part {k}: stories, guides and events from around the region." for k in range(1, 16))
COMMENTS = tuple(f" Section: block {k} " for k in range(1, 21))
NAV_LINKS = (("Home", "/"), ("About", "/about"), ("Products", "/products"), ("Services", "/services"), ("Blog", "/blog"), ("Contact", "/contact"), ("Careers", "/careers"), ("Terms", "/terms"), ("Privacy", "/privacy"), ("Help", "/help"))


def anchor_snippet(count: int, style: str) -> str:
    return "".join(f'<a href="/section/{k}" style="{style}">nav{k}</a>' for k in range(count))


def filler_snippets(variant: int) -> tuple[str, str]:
    """What goes before </body> and before </head>."""
    if variant in (1, 2):
        return "<div></div>" * (10 if variant == 1 else 50), ""
    if variant == 3:
        return "".join(f"<{SEMANTIC[k % 7]}></{SEMANTIC[k % 7]}>" for k in range(10)), ""
    if variant == 4:
        return "".join(f"<span>t{k}</span>" for k in range(25)), ""
    if variant == 5:
        return "<div>" * 10 + "</div>" * 10, ""
    body = '<img src="data:image/gif;base64,R0lGODlhAQABAAAAACw="/>' * 5 + "<script></script>" * 5 + "<style></style>" * 5
    return body, '<meta name="filler" content="x"/>' * 5 + '<link rel="preconnect" href="https://example.com"/>' * 5


def benign_snippet(variant: int) -> str:
    paragraphs = lambda n: "".join(f'<div style="display:none"><p>{p}</p></div>' for p in PARAGRAPHS[:n])
    comments = lambda n: "".join(f"<!--{c}-->" for c in COMMENTS[:n])
    nav = '<nav style="display:none">' + "".join(f'<a href="{h}">{t}</a>' for t, h in NAV_LINKS) + "</nav>"
    return {1: paragraphs(5), 2: paragraphs(15), 3: comments(5), 4: comments(20), 5: nav, 6: paragraphs(5) + comments(5) + nav}[variant]


def before_tag(html: Column, tag: str, snippet: str) -> Column:
    """``snippet`` before the last closing ``tag``, or at the end: one search of the page, whose match is what goes before the snippet."""
    quoted = snippet.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(html, rf"(?is)\A(?:.*(?=</{tag}\s*>)|.*)", F.lit("$0" + quoted))


def _parts(url: Column) -> dict[str, Column]:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    part = lambda k: F.regexp_extract(full, URL_PARTS, k)
    rest = F.concat(F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise(""), F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""))
    return {"scheme": F.lower(part(1)), "netloc": part(2), "path": part(3), "rest": rest}


def shorten(url: Column, variant: int) -> Column:
    name, n = SHORTENERS[variant - 1]
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, URL_PARTS, 1)), F.lit("")), F.lit("http"))
    return F.concat(scheme, F.lit(f"://{name}/"), short_hash(url, n))


def combosquat(url: Column, variant: int) -> Column:
    kind, value = COMBOSQUATS[variant - 1]
    p = _parts(url)
    if kind == "path":
        return F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit(value), F.coalesce(F.nullif(p["path"], F.lit("")), F.lit("/")), p["rest"])
    return F.concat(p["scheme"], F.lit(f"://{value}."), p["netloc"], p["path"], p["rest"])


def substitute_tld(url: Column, variant: int) -> Column:
    p = _parts(url)
    name, port = F.regexp_extract(p["netloc"], r"^([^:]*)", 1), F.regexp_extract(p["netloc"], r"^[^:]*(:.+)$", 1)
    swapped = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", f".{TLDS[variant - 1]}")).otherwise(F.concat(name, F.lit(f".{TLDS[variant - 1]}")))
    return F.concat(p["scheme"], F.lit("://"), swapped, port, p["path"], p["rest"])


def hide_anchors(html: Column, variant: int) -> Column:
    return before_tag(html, "body", anchor_snippet(*ANCHORS[variant - 1]))


def add_filler(html: Column, variant: int) -> Column:
    body, head = filler_snippets(variant)
    out = before_tag(html, "body", body)
    return F.when(out.rlike(r"(?i)</head\s*>"), before_tag(out, "head", head)).otherwise(before_tag(out, "body", head)) if head else out


def add_benign(html: Column, variant: int) -> Column:
    return before_tag(html, "body", benign_snippet(variant))


_TYPE = r"""(?i)(\stype\s*=\s*)["']?password["']?"""


def pieces(html: Column) -> Column:
    """(between, tokens): the tag tokens of a page and the texts around them."""
    between = F.split(html, r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|</?[a-z][^>]*>")
    return F.struct(between.alias("between"), tokens(html).alias("tokens"))


def _rewrite(parts: Column, change) -> Column:
    """A page of ``pieces`` with each tag token replaced by ``change(token)``: the text between tokens stays."""
    return F.array_join(F.zip_with(parts["between"], F.transform(parts["tokens"], change), lambda text, token: F.concat(text, F.coalesce(token, F.lit("")))), "")


def obfuscate_inputs(html: Column, variant: int, parts: Column | None = None) -> Column:
    """Password inputs retyped (1 to 3), forms unwrapped (4), names and actions changed (5), a visible decoy beside a hidden password (6).
    ``parts`` are the page's ``pieces``, where they are at hand."""
    parts = pieces(html) if parts is None else parts
    secret = lambda t: t.rlike(r"(?i)^<input\b") & t.rlike(_TYPE)
    if variant in (1, 2, 3):
        to = {1: "$1\"text\"", 2: "$1\"email\"", 3: "$1\"text\" data-role=\"password\""}[variant]
        return _rewrite(parts, lambda t: F.when(secret(t), F.regexp_replace(t, _TYPE, to)).otherwise(t))
    if variant == 4:
        return _rewrite(parts, lambda t: F.when(t.rlike(r"(?i)^</?form\b"), F.lit("")).otherwise(t))
    if variant == 5:
        named = lambda t: F.when(t.rlike(r"(?i)^<input\b"), F.regexp_replace(t, r"""(?i)(\sname\s*=\s*)("[^"]*(?:password|passwd|pwd)[^"]*"|'[^']*(?:password|passwd|pwd)[^']*')""", '$1"pw"')).otherwise(t)
        return _rewrite(parts, lambda t: F.when(t.rlike(r"(?i)^<form\b"), F.regexp_replace(t, r"""(?i)(\saction\s*=\s*)(?:"https?://[^"]*"|'https?://[^']*')""", '$1"/submit"')).otherwise(named(t)))
    decoy = '<input type="text" placeholder="Enter password" aria-hidden="true">'
    return _rewrite(parts, lambda t: F.when(secret(t), F.concat(F.regexp_replace(t, r"\s*/?>$", ' style="display:none">'), F.lit(decoy))).otherwise(t))


PERTURBATIONS = {
    "A1_url_shortener": ("url", shorten), "A2_url_combosquat": ("url", combosquat), "A3_url_tld_sub": ("url", substitute_tld), "A4_html_invisible_link": ("html", hide_anchors),
    "A5_html_object_ratio": ("html", add_filler), "A6_html_dom_expand": ("html", add_benign), "A7_html_input_obfuscate": ("html", obfuscate_inputs),
}


def perturb(pages: DataFrame, attack: str, variant: int) -> DataFrame:
    """``pages`` with the url or html of one perturbation, and columns attack and variant."""
    column, change = PERTURBATIONS[attack]
    return pages.withColumn(column, change(F.col(column), variant)).withColumns({"attack": F.lit(attack), "variant": F.lit(f"v{variant}")})


def variant_grid(spark: SparkSession) -> DataFrame:
    """(attack, variant, surface) of the families that are built: 42 rows."""
    return spark.createDataFrame([(a, v, FAMILIES[a]) for a in BUILT for v in VARIANTS], "attack string, variant string, surface string")


def expand_variants(pages: DataFrame) -> DataFrame:
    """A row for each page and grid cell: attack, variant, surface, and url and html so perturbed.

    The grid is 42 literal rows inside the projection: no join, no shuffle. A page is cut into tokens once, for all six variants that rewrite them.
    """
    cells = [F.struct(F.lit(a).alias("attack"), F.lit(v).alias("variant"), F.lit(FAMILIES[a]).alias("surface"), F.lit(100 * k + n).alias("cell")) for k, a in enumerate(BUILT) for n, v in enumerate(VARIANTS, 1)]
    rows = pages.withColumn("__pieces", pieces(F.col("html"))).withColumn("__cell", F.explode(F.array(*cells)))
    for column in ("url", "html"):
        value = F.col(column)
        for k, attack in enumerate(BUILT):
            target, change = PERTURBATIONS[attack]
            for n in range(1, 7) if target == column else ():
                given = (F.col("__pieces"),) if change is obfuscate_inputs else ()
                value = F.when(F.col("__cell.cell") == 100 * k + n, change(F.col(column), n, *given)).otherwise(value)
        rows = rows.withColumn(f"__{column}", value)
    kept = [c for c in pages.columns if c not in ("url", "html")]
    return rows.select(*kept, F.col("__cell.attack").alias("attack"), F.col("__cell.variant").alias("variant"), F.col("__cell.surface").alias("surface"), F.col("__url").alias("url"), F.col("__html").alias("html"))


def backfill_clean(perturbed: DataFrame, clean: DataFrame, key: str = "page_id") -> DataFrame:
    """Perturbed rows whose html is missing or whose status is not ok take the clean page's html."""
    good = F.col("html").isNotNull() & (F.coalesce("status", F.lit("ok")) == "ok") if "status" in perturbed.columns else F.col("html").isNotNull()
    joined = perturbed.join(clean.select(key, F.col("html").alias("__clean")), key, "left").withColumn("backfilled", ~good)
    return joined.withColumn("html", F.when(F.col("backfilled"), F.col("__clean")).otherwise(F.col("html"))).drop("__clean")


def combine(pages: DataFrame, *cells: tuple[str, int]) -> DataFrame:
    """Several perturbations one after another, as one variant named by them."""
    out = reduce(lambda df, cell: perturb(df, *cell), cells, pages)
    return out.withColumns({"attack": F.lit("combo_" + "_".join(FAMILIES[a] for a, _ in cells)), "variant": F.lit("+".join(f"{a.split('_')[0]}v{v}" for a, v in cells))})


def manifest(variants: DataFrame) -> DataFrame:
    """(attack, variant, ok, failed): how many pages each cell could perturb."""
    bad = F.col("html").isNull() | F.col("url").isNull()
    return variants.groupBy("attack", "variant").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))
