"""Registered domains by a table of public-suffix rules: plain, wildcard and exception rules, the longest match deciding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN, WILDCARD, EXCEPTION = "plain", "wildcard", "exception"
#: Rules that are broadcast at most; published lists have about 10,000.
MOST_RULES = 500_000


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """(suffix, kind) of a rule file in the published form: a rule a line, ``*.`` before wildcards, ``!`` before exceptions,
    ``//`` before remarks. The section of private domains is left out unless asked for."""
    text = F.col("value") if private else F.regexp_replace("value", r"(?s)// ===BEGIN PRIVATE DOMAINS===.*?(// ===END PRIVATE DOMAINS===|\z)", "")
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(text, r"\r?\n")).alias("line"))
    return suffix_rules(lines.select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("rule")).where("rule <> '' and not startswith(rule, '//')"))


def suffix_rules(rules: DataFrame) -> DataFrame:
    """(suffix, kind) of rules (column rule) as they are written in a rule file, each once."""
    rule = F.lower(F.regexp_replace("rule", r"^\.", ""))
    kind = F.when(F.startswith(rule, F.lit("!")), EXCEPTION).when(F.startswith(rule, F.lit("*.")), WILDCARD).otherwise(PLAIN)
    return rules.select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).where("suffix <> ''").distinct()


def plain_name(name: Column) -> Column:
    """Lower case, without port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r":\d*$", ""), r"\.+$", "")


def registered_domains(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, suffix, domain) for each distinct ``name``: its public suffix and the label before it with the suffix.

    Every tail of a name's labels is looked up. An exception rule gives the suffix one label shorter than itself; else the longest
    match holds, where a wildcard stands for one more label; else the last label is the suffix. A name that is a suffix itself, an
    IPv4 address and an empty name are their own domain. Null names are left out.
    """
    each = names.select("name").where("name is not null").distinct().withColumn("labels", F.split(plain_name(F.col("name")), r"\."))
    n = F.size("labels")
    tails = each.select("name", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("size"), F.array_join(F.slice("labels", n - k + 1, k), ".").alias("suffix")))).alias("tail"), n.alias("n")).select("name", "n", "tail.*")
    rules = F.broadcast(rules) if rules.count() <= MOST_RULES else rules
    matched = tails.join(rules, "suffix").select("name", F.when(F.col("kind") == EXCEPTION, F.col("size") - 1).alias("but"), F.when(F.col("kind") == PLAIN, F.col("size")).when((F.col("kind") == WILDCARD) & (F.col("n") > F.col("size")), F.col("size") + 1).alias("long"))
    longest = matched.groupBy("name").agg(F.coalesce(F.max("but"), F.max("long")).alias("found"))
    joined = each.join(longest, "name", "left").withColumn("size", F.greatest(F.coalesce("found", F.lit(1)), F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    whole = plain_name(F.col("name"))
    address = whole.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return joined.select("name", F.when(~address, last(F.col("size"))).alias("suffix"), F.when(address, whole).otherwise(last(F.col("size") + 1)).alias("domain"))
