"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, curriculum mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and hands it on. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import decontaminate, line_dedup, minhash, mixing, quality_rules
from pagelattice.llm.common import remove, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Texts that are null or empty are rejected; rows that repeat are judged
    one by one; a row without an id or a language is judged like any other."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, except in the document with the largest id. A row without an id keeps its
    lines; a text that loses all lines stays, empty; ``n_chars`` follows the text."""
    return line_dedup.without_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id. Rows without an id, and texts without words,
    are copies of nothing and stay; rows that share the id that stays, stay."""
    return minhash.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without an id."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in training order: a row for each pass over a document, with the words it takes. Texts without
    words are not taken; columns named like the mix's own are replaced."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
]

#: Near-dedup and decontamination cannot be stated in SQL at this size; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage wrote on its way, and the documents it read, are removed once its
    own are written; what the last stage reads stays."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, written = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if path:
            remove(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
