"""Roll-ups of scores on perturbed pages: which URLs evade, by surface and by set of surfaces."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.urls import is_phish
from pagelattice.operators.perturb import FAMILIES

SURFACES = ("URL", "HTML", "Logo")
COMBINATIONS = tuple(c for n in range(1, 4) for c in itertools.combinations(SURFACES, n))


def scored_phish(scores: DataFrame, true_positives: DataFrame | None = None) -> DataFrame:
    """Scored rows of phish-labelled URLs; only URLs of ``true_positives`` if given."""
    rows = scores.where((is_phish(F.col("label"), "robustness") == 1) & (F.col("status") == "ok"))
    return rows if true_positives is None else rows.join(true_positives.select("url").distinct(), "url", "left_semi")


def any_evaded(scores: DataFrame) -> DataFrame:
    """(attack, url, evaded): whether any variant was taken for benign."""
    return scored_phish(scores).groupBy("attack", "url").agg(F.bool_or(~F.lower("prediction").isin("phish", "1", "phishing")).alias("evaded"))


def surface_of(attack):
    """Surface of an attack name; null for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[attack]


def url_surfaces(evaded: DataFrame) -> DataFrame:
    """(url, surfaces): the surfaces on which a URL evaded."""
    hit = F.when(F.col("evaded"), surface_of(F.col("attack")))
    return evaded.groupBy("url").agg(F.collect_set(hit).alias("surfaces"))


def surface_asr(evaded: DataFrame) -> DataFrame:
    """(surface, evaded_urls, asr) for each surface; the denominator is all scored phish URLs."""
    sums = [F.countDistinct(F.when(F.col("evaded") & (surface_of(F.col("attack")) == s), F.col("url"))).alias(s) for s in SURFACES]
    one = evaded.agg(F.countDistinct("url").alias("total"), *sums)
    rows = F.array(*[F.struct(F.lit(s).alias("surface"), F.col(s).alias("evaded_urls")) for s in SURFACES])
    return one.select("total", F.explode(rows).alias("r")).select("r.surface", "r.evaded_urls", F.bround(F.col("r.evaded_urls") / F.greatest("total", F.lit(1)), 4).alias("asr"))


def robustness_table(evaded: DataFrame) -> DataFrame:
    """(surfaces, size, evaded_urls, asr) for all seven sets of surfaces, smallest first: one aggregate."""
    found = url_surfaces(evaded)
    sums = [F.count_if(F.arrays_overlap("surfaces", F.array(*map(F.lit, c)))).alias("+".join(c)) for c in COMBINATIONS]
    one = found.agg(F.count(F.lit(1)).alias("total"), *sums)
    rows = F.array(*[F.struct(F.lit("+".join(c)).alias("surfaces"), F.lit(len(c)).alias("size"), F.col("+".join(c)).alias("evaded_urls")) for c in COMBINATIONS])
    return one.select("total", F.explode(rows).alias("r")).select("r.surfaces", "r.size", "r.evaded_urls", F.bround(F.col("r.evaded_urls") / F.greatest("total", F.lit(1)), 4).alias("asr")).orderBy("size")


def combo_asr(evaded: DataFrame, surfaces: tuple[str, ...]) -> DataFrame:
    """(surfaces, evaded_urls, asr) for one set of surfaces."""
    return robustness_table(evaded).where(F.col("surfaces") == "+".join(surfaces)).drop("size")
