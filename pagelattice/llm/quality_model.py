"""Quality classifier (5): logistic regression over hashed word n-grams, trained with FTRL-proximal.

Texts are split into words and runs of marks. Features are hashed one- and two-grams of the
case-folded tokens, and one- to three-grams of their shapes (lower, title, upper case, digits, the
marks themselves, "same as the token before"), so unseen words still carry evidence. Counts are
damped (1 + log) and each document has length one. Weights are learned by
follow-the-regularised-leader updates with per-coordinate rates and an L1 bound that keeps them
sparse; documents are scored by sparse dot products.

Training takes a bounded sample of labelled documents, dealt over shards of ``shard_rows`` that are
trained side by side; the shards' weights are averaged.

Defined edge cases: a null or empty text has no features and gets the bias alone; without usable
labels every score is 0.5, with one class only its share; null labels and null ids are not learned from;
repeated label rows count once; repeated documents are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import bucket_of, cut, mix64, slices
from pagelattice.llm.toxicity import training_sample

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS = 18
SIZE = 1 << BITS  # cells of the weight table; the bias is kept apart


class TokenCodes(dict):
    """Token to (hash of its folded form) << 32 | (hash of its shape); a bounded per-process memo."""

    LIMIT = 100_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        if token[0].isalpha():
            shape = "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa"
        elif token[0].isdigit():
            shape = "9"
        else:
            shape = token[:4]
        value = self[token] = zlib.crc32(token.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))
        return value


def document_vector(text: str | None, codes: TokenCodes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells and values of a document."""
    found = TOKEN.findall(text) if text else []
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    words, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shapes = shapes.copy()
    shapes[1:][words[1:] == words[:-1]] = 7  # a repeated token
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    kinds = [words, words[:-1] * one + words[1:], shapes + np.uint64(1 << 40), shapes[:-1] * one + shapes[1:] + np.uint64(1 << 41), (shapes[:-2] * one + shapes[1:-1]) * two + shapes[2:]]
    cells, counts = np.unique(np.concatenate([mix64(k) for k in kinds]) >> np.uint64(64 - BITS), return_counts=True)
    values = 1 + np.log(counts)
    return cells.astype(np.int32), (values / np.sqrt((values * values).sum())).astype(np.float32)


def train_ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes in a fixed shuffled order; averaged over the last half."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    order = np.random.default_rng(seed)
    prior = np.clip(labels.mean(), 0.01, 0.99)
    start = np.log(prior / (1 - prior))

    def weights(cells):
        part, grown = z[cells], np.sqrt(n[cells])
        return np.where(np.abs(part) <= l1, 0.0, -(part - np.sign(part) * l1) / ((beta + grown) / alpha + l2))

    total, taken = np.zeros(SIZE + 1), 0
    for epoch in range(epochs):
        for k in order.permutation(len(vectors)):
            cells, values = vectors[k]
            cells, values = np.r_[cells, SIZE], np.r_[values, 1.0]
            w = weights(cells)
            p = 1 / (1 + np.exp(-np.clip(start + w @ values, -30, 30)))
            g = (p - labels[k]) * values
            z[cells] += g - (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / alpha * w
            n[cells] += g * g
        if 2 * epoch >= epochs:
            total += weights(np.arange(SIZE + 1))
            taken += 1
    total /= max(1, taken)
    return total[:SIZE], float(total[SIZE] + start)


def fit(sample: DataFrame, rows: int, shard_rows: int = 4000) -> tuple[np.ndarray, float]:
    """Weight table and bias from (doc_id, text, label), averaged over shards."""
    shards = max(1, -(-rows // shard_rows))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = TokenCodes()
        pdf = pdf.sort_values("doc_id")
        table, bias = train_ftrl([document_vector(x, codes) for x in pdf["text"]], pdf["label"].to_numpy(float))
        cells = np.flatnonzero(table)
        return pd.DataFrame({"cell": np.r_[cells, SIZE], "weight": np.r_[table[cells], bias]})

    dealt = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards)))
    learned = dealt.groupBy("shard").applyInPandas(train, "cell int, weight double")
    mean = learned.groupBy("cell").agg((F.sum(F.round("weight", 9).cast("decimal(20,9)")) / shards).cast("double").alias("weight")).toPandas()  # at most SIZE + 1 rows
    table = np.zeros(SIZE + 1)
    table[mean["cell"]] = mean["weight"]
    return table[:SIZE].astype(np.float32), float(table[SIZE])


def score(docs: DataFrame, labels: DataFrame, per_class: int = 8000, buckets: int = 5, held: int = 0, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from at most ``per_class``
    labelled documents of each class."""
    spark = docs.sparkSession
    sample = cut(training_sample(docs, labels, "quality", buckets, held, per_class).select("doc_id", "text", "label"), "quality_sample")
    known = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(known) < 2:
        scored = base.select("doc_id", F.lit(float(next(iter(known), 0.5))).alias("score"))
    else:
        table, bias = fit(sample, sum(known.values()))
        shared = spark.sparkContext.broadcast(table)  # 1 MB, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, weights = TokenCodes(), shared.value
            for batch in slices(batches):
                out = []
                for text in batch.column("text").to_pylist():
                    cells, values = document_vector(text, codes)
                    out.append(float(weights[cells] @ values) + bias)
                scores = np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", bucket_of("doc_id", buckets, held).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
