"""Tag tokens of raw HTML and the features counted from them: Catalyst expressions inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions.urls import safe_ratio

#: A comment, an element with raw text, or one tag; what a comment or a script holds is no tag.
TOKEN = r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|</?[a-z][^>]*>)"


def tokens(html: Column) -> Column:
    """Array of tokens in page order; empty for null."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def tag_name(token: Column) -> Column:
    """Lower-case name of an opening tag; empty for closing tags and comments."""
    return F.lower(F.regexp_extract(token, r"^<([a-zA-Z][a-zA-Z0-9:_-]*)", 1))


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of the token's first tag; empty if absent."""
    value = F.regexp_extract(F.regexp_extract(token, r"^<[^>]*>", 0), rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def body(token: Column) -> Column:
    """Raw text of a script, style or title token."""
    return F.regexp_replace(F.regexp_replace(token, r"^<[^>]*>", ""), r"(?i)</[a-z]+\s*>$", "")


def tag_tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, tag, closing, token), one row a tag, comments left out."""
    rows = pages.select(key, F.posexplode(tokens(F.col("html"))).alias("pos", "token")).where(~F.col("token").startswith("<!--"))
    closing = F.col("token").startswith("</")
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9:_-]*)", 1))
    return rows.select(key, "pos", name.alias("tag"), closing.alias("closing"), "token")


def html_features(pages: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds the HTML features that tokens decide. ``domain`` names the page domain's column.

    One pass over each page's token array; no shuffle.
    """
    page = pages.withColumn("__tokens", tokens(F.col("html"))).withColumn("__tags", F.filter(F.transform("__tokens", tag_name), lambda t: t != ""))
    tags, all_tokens = F.col("__tags"), F.col("__tokens")
    of = lambda name: F.filter(all_tokens, lambda t: tag_name(t) == name)
    page = page.withColumns({f"__{n}": of(n) for n in ("a", "input", "link", "img", "svg", "script", "title")})
    n_tags = F.greatest(F.size(tags), F.lit(1))
    kind = lambda value: F.size(F.filter(F.col("__input"), lambda t: F.lower(attribute(t, "type")) == value))
    empty = lambda t: F.trim(attribute(t, "href")).isin("#", "") | F.startswith(F.trim(attribute(t, "href")), F.lit("javascript:"))
    inline = F.filter(F.transform("__script", body), lambda s: F.trim(s) != "")
    icons = F.filter(F.col("__link"), lambda t: F.lower(attribute(t, "rel")).contains("icon"))
    words = lambda t: F.lower(F.concat_ws(" ", *[attribute(t, a) for a in ("class", "alt", "id", "rel", "aria-label")]))
    source = lambda t: F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "href"))
    outside = lambda t: F.startswith(source(t), F.lit("http")) & ~F.contains(source(t), F.col(domain))
    branded = lambda t: words(t).rlike("logo|brand|icon") & outside(t)
    found = {
        "external_brand_resource": (F.size(F.filter(F.concat("__img", "__link", "__svg"), branded)) > 0).cast("int"),
        "obfuscation_indicator": F.bround(F.size(F.filter(inline, lambda s: s.rlike(C.OBFUSCATION))) / F.greatest(F.size(inline), F.lit(1)), 4),
        "empty_link_node_ratio": F.bround(F.size(F.filter(F.col("__a"), empty)) / F.greatest(F.size("__a"), F.lit(1)), 4),
        "html_length": F.length("html"),
        "num_password_inputs": kind("password"),
        "num_hidden_inputs": kind("hidden"),
        "num_iframes": F.size(F.filter(tags, lambda t: t == "iframe")),
        "has_title": (F.size("__title") > 0).cast("int"),
        "title_length": F.coalesce(F.length(body(F.get("__title", F.lit(0)))), F.lit(0)),
        "has_favicon": (F.size(icons) > 0).cast("int"),
        "favicon_external": F.coalesce((F.startswith(attribute(F.get(icons, F.lit(0)), "href"), F.lit("http")) & ~F.contains(attribute(F.get(icons, F.lit(0)), "href"), F.col(domain))).cast("int"), F.lit(0)),
    }
    among = lambda group: F.filter(tags, lambda t: t.isin(*group))
    for name, group in C.TAG_GROUPS.items():
        found[name] = F.bround(safe_ratio(F.size(among(group)).cast("double"), n_tags), 4)
    missing = F.coalesce(F.col("html"), F.lit("")) == ""
    return page.withColumns({n: F.when(missing, F.lit(0)).otherwise(c) for n, c in found.items()}).drop("__tokens", "__tags", *[f"__{n}" for n in ("a", "input", "link", "img", "svg", "script", "title")])
