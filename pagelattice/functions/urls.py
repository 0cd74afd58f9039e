"""URL, label and time functions: Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice import constants as C

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def split_url(url: Column) -> dict[str, Column]:
    """scheme (lower case), netloc, path (without ;parameters of its last segment), query, fragment; never null for a non-null URL."""
    part = lambda k: F.regexp_extract(url, URL_PARTS, k)
    return {"scheme": F.lower(part(1)), "netloc": part(2), "path": F.regexp_replace(part(3), r";[^/]*$", ""), "query": part(4), "fragment": part(5)}


def page_domain(url: Column) -> Column:
    """The authority with port and user; for a URL without one, the first path segment."""
    parts = split_url(url)
    return F.coalesce(F.nullif(parts["netloc"], F.lit("")), F.split(parts["path"], "/")[0])


def host(url: Column) -> Column:
    """Lower-case host without user and port, assuming http where no scheme is given; null if empty."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(F.regexp_extract(full, URL_PARTS, 2), r"^.*@", ""), r"^([^:]*)", 1)), F.lit(""))


def brand_domain(url: Column) -> Column:
    """Lower-case authority without a leading www. and without port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL_PARTS, 2)), r"^www\.", ""), r":[^:]*$", "")


def registered_domain(name: Column) -> Column:
    """The label before the public suffix, with it; the name itself where there is none.

    Suffixes: the bundled two-level ones, else the last label; IPv4 addresses stay whole.
    """
    two = "|".join(s.replace(".", r"\.") for s in C.TWO_LEVEL_SUFFIXES)

    def found(plain: Column) -> Column:
        long, short = F.regexp_extract(plain, rf"([^.]+\.(?:{two}))$", 1), F.regexp_extract(plain, r"([^.]+\.[^.]+)$", 1)
        return F.when(plain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), plain).otherwise(F.coalesce(F.nullif(long, F.lit("")), F.nullif(short, F.lit("")), plain))

    # As the only element of an array, so that the plain name is worked out once and not written out five times.
    return F.get(F.transform(F.array(F.regexp_replace(F.lower(name), r":\d*$", "")), found), F.lit(0))


def url_key(url: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def short_hash(url: Column, n: int) -> Column:
    return F.substring(F.md5(url), 1, n)


def hash_draw(*parts: Column) -> Column:
    """A whole number below 2^32, fixed by the parts: the first eight hex digits of their MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def url_tokens(url: Column) -> Column:
    """Lower-case tokens of over two characters that are no stop words."""
    pieces = F.filter(F.split(url, r"[./\-_?=&%#@:]+"), lambda t: F.length(t) > 2)
    return F.filter(F.transform(pieces, F.lower), lambda t: ~t.isin(*C.URL_STOP_WORDS))


def path_substrings(url: Column, min_len: int = 4, most: int = 5) -> Column:
    """The first ``most`` pieces of path and query with ``min_len`` characters, lower case, prefixed."""
    parts = split_url(url)
    pieces = F.filter(F.split(F.concat_ws("?", parts["path"], F.nullif(parts["query"], F.lit(""))), r"[/\-_.?&=]"), lambda t: F.length(t) >= min_len)
    return F.transform(F.slice(pieces, 1, most), lambda t: F.concat(F.lit("substr:"), F.lower(t)))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` unless b is positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words; false for null."""
    return F.coalesce(reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def count_entropy(counts: Column) -> Column:
    """Shannon entropy in bits of a map of counts; zeros and an empty map add nothing."""
    values = F.transform(F.map_values(counts), lambda v: v.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(values, F.lit(0.0), lambda s, v: s - F.when(v > 0, v / total * F.log2(v / total)).otherwise(0.0))


#: Labels that mean "phish", by rule.
LABEL_RULES = {"model": ("phish", "1", "true", "phishing"), "robustness": ("phish", "1", "phishing"), "baseline": ("phish",)}


def is_phish(label: Column, rule: str = "model") -> Column:
    """1 for a phish label under the rule, else 0; the baseline rule is case-sensitive."""
    text = label.cast("string") if rule == "baseline" else F.lower(label.cast("string"))
    return F.coalesce(text.isin(*LABEL_RULES[rule]), F.lit(False)).cast("int")


def parse_iso(text: Column) -> Column:
    """ISO-8601 time (a trailing Z allowed) in the session's zone; null if invalid."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def lead_minutes(first_seen: Column, detected: Column) -> Column:
    """Minutes from detection to first listing, two decimals; positive where detection came first."""
    return F.bround((F.unix_micros(first_seen) - F.unix_micros(detected)) / F.lit(6e7), 2)


def scrub_url(url: Column) -> Column:
    """Masks key-shaped tokens anywhere, and the values of sensitive query keys."""
    masked = F.regexp_replace(url, C.SECRET_TOKEN, "<redacted>")
    keys = "|".join(C.SENSITIVE_KEYS)
    pairs = F.transform(F.split(F.regexp_extract(masked, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.regexp_replace(p, rf"(?i)^({keys})=.*$", "$1=<redacted>"))
    head, tail = F.regexp_extract(masked, r"^([^?#]*\?)", 1), F.regexp_extract(masked, r"(#.*)$", 1)
    return F.when(head != "", F.concat(head, F.array_join(pairs, "&"), tail)).otherwise(masked)


def clean_number(value: Column) -> Column:
    """0 for null, NaN and infinities."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(number)


def url_feature_columns(url: Column) -> dict[str, Column]:
    """The 24 URL features: projections, no shuffle."""
    parts = split_url(url)
    domain, path = F.split(parts["netloc"], ":")[0], parts["path"]
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    tokens = url_tokens(url)
    suspicious = F.size(F.array_intersect(F.array_distinct(tokens), F.array(*map(F.lit, C.URL_SUSPICIOUS_WORDS))))
    tlds = "|".join(t.replace(".", r"\.") for t in C.SUSPICIOUS_TLDS)
    return {
        "url_length": F.length(url),
        "domain_length": F.length(domain),
        "path_length": F.length(path),
        "query_length": F.length(parts["query"]),
        "tld_length": F.length(F.element_at(F.split(domain, r"\."), -1)),
        "num_dots_in_url": count(url, r"\."),
        "num_hyphens_in_domain": count(domain, "-"),
        "num_digits_in_domain": count(domain, "[0-9]"),
        "num_digits_in_url": count(url, "[0-9]"),
        "num_slashes_in_url": count(url, "/"),
        "num_slashes_in_domain": count(domain, "/"),
        "num_subdomains": F.greatest(F.lit(0), count(domain, r"\.") - 1),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "num_special_chars": count(url, "[@_~!$&*]"),
        "has_at_symbol": F.contains(url, F.lit("@")).cast("int"),
        "has_double_slash_redirect": F.contains(path, F.lit("//")).cast("int"),
        "has_ip_address": domain.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}").cast("int"),
        "is_https": (parts["scheme"] == "https").cast("int"),
        "has_suspicious_tld": domain.rlike(rf"(?:{tlds})$").cast("int"),
        "url_entropy": F.bround(char_entropy(url), 4),
        "domain_entropy": F.bround(char_entropy(F.lower(domain)), 4),
        "num_url_tokens": F.size(tokens),
        "num_suspicious_tokens": suspicious,
        "suspicious_token_ratio": F.bround(suspicious / F.greatest(F.size(tokens), F.lit(1)), 4),
    }
