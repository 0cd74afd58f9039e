"""Toxicity (10): subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. A token is reduced to letters (case, accents and common digit spellings folded, other marks
left out), so inserted characters become gaps or vanish; letters of other alphabets have codes too. Tokens of
fewer than ``ORDER`` letters are set between boundary letters, long ones are cut into overlapping pieces. Two tokens are
compared by their common subsequences of ``ORDER`` letters spread over at most ``SPAN`` letters, each weighted by
``DECAY`` to the power of the letters it spans, normalised by token length. The kernel of two sentences is the
sum over their pairs of distinct tokens: a harmless token that is repeated says nothing more. Its feature map is explicit (one cell for each subsequence), so a trained
machine collapses into one table of 32^4 weights that is looked up along a token.

Training on a bounded sample of labelled documents: a sentence (long ones in windows of ``WINDOW`` tokens) carries its
document's label. Landmarks are tokens: those that stand out most in toxic sentences, and the most frequent others.
Sentences are mapped by their kernel with the landmarks, whitened by the landmarks' kernel matrix (Nyström), and a
linear machine with squared hinge loss is fitted to them. A toxic document has harmless sentences as well, so in
further rounds only its best sentence and those on the toxic side stay positive (multi-instance training).
A document's two highest sentences are turned into a probability by a logistic curve.

Defined edge cases: a null or empty text gets the score of a document without tokens; without any
usable labels, or without one of the classes, every score is the share of toxic labels (0 when there
are none); null labels and null ids are not learned from; repeated label rows count once; repeated
documents are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import bucket_of, byte_column, cut, slices

ORDER, SPAN, DECAY = 4, 7, 0.7
CHUNK, STEP = 24, 12  # longer tokens are taken in overlapping pieces
WINDOW = 30  # tokens; longer sentences are taken in overlapping windows
OFFSETS = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), ORDER - 1)]
CELLS = 32**ORDER
SPACED = re.compile(rb"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")  # letters written one by one
SENTENCE_END = re.compile(rb"[.!?\n]+(?=\s|$)")
BOUNDARY = 31


class LetterCodes(dict):
    """Code point to letter code as a character, or None where it is left out: a-z are 1 to 26; letters of other
    alphabets share 1 to 30."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point).lower()
        base = {"ß": "s", "ø": "o"}.get(char, unicodedata.normalize("NFKD", char)[:1])
        base = dict(zip("0134578$@", "oieastbsa", strict=True)).get(base, base)
        if "a" <= base <= "z":
            value = chr(ord(base) - 96)
        else:
            value = chr(1 + ord(base) * 2654435761 % (1 << 32) % 30) if base.isalpha() else None
        self[point] = value
        return value


LETTERS = LetterCodes()
ASCII_CODES = bytes(ord(LETTERS[k] or "\0") if k < 128 else 0 for k in range(256))


def token_letters(token: bytes) -> bytes:
    """The letter codes of a UTF-8 token."""
    if token.isascii():
        return token.translate(ASCII_CODES).replace(b"\0", b"")
    return token.decode("utf-8", "replace").translate(LETTERS).encode("latin-1")


def token_pieces(token: bytes) -> list[bytes]:
    """The letter strings that stand for a token: itself, with boundaries if short, in pieces if long; none without letters."""
    letters = token_letters(token)
    if not letters:
        return []
    if len(letters) < ORDER:
        return [bytes([BOUNDARY]) * max(1, ORDER - 1 - len(letters)) + letters + bytes([BOUNDARY])]
    if len(letters) <= CHUNK:
        return [letters]
    return [letters[k : k + CHUNK] for k in range(0, len(letters) - STEP, STEP)]


def sentences(text: bytes) -> list[list[bytes]]:
    """The distinct tokens of each sentence or window of one, in order; letters written one by one are a sentence of one token."""
    found = []
    for part in SENTENCE_END.split(text.lower()):
        words = part.split()
        if len(words) <= WINDOW:
            if words:
                found.append(words)
        else:
            found += [words[k : k + WINDOW] for k in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
    found += [[b"".join(x.split())] for x in SPACED.findall(text.lower())]
    return [list(dict.fromkeys(words)) for words in found]


def cell_numbers(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each spread of a subsequence, its cells along each row of a padded code matrix, and its weight."""
    wide = codes.astype(np.int32)
    for spread in OFFSETS:
        length = wide.shape[1] - spread[-1]
        if length <= 0:
            continue
        cells = np.zeros((len(wide), length), np.int32)
        whole = np.ones((len(wide), length), bool)
        for k in spread:
            part = wide[:, k : k + length]
            cells = (cells << 5) | part
            if k in (0, spread[-1]):
                whole &= part > 0
        yield np.where(whole, cells, 0), DECAY ** (spread[-1] + 1)


NORMS = np.array([max(1e-9, sum(max(n - o[-1], 0) * DECAY ** (2 * (o[-1] + 1)) for o in OFFSETS)) for n in range(CHUNK + 1)]) ** 0.5


def padded(chunks: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(len(chunks), width)


def chunk_values(chunks: list[bytes], table: np.ndarray) -> np.ndarray:
    """Normalised value of each chunk under a weight table over the cells."""
    out = np.zeros(len(chunks))
    sizes = np.array([len(c) for c in chunks])
    for low, high in ((ORDER, 6), (7, 8), (9, 12), (13, CHUNK)):
        here = np.flatnonzero((sizes >= low) & (sizes <= high))
        for part in np.array_split(here, len(here) // 20_000 + 1):
            if len(part):
                total = np.zeros(len(part))
                for cells, weight in cell_numbers(padded([chunks[k] for k in part], high)):
                    total += weight * table[cells].sum(axis=1, dtype=np.float64)
                out[part] = total / NORMS[sizes[part]]
    return out


class TokenScorer(dict):
    """Values of tokens under a table: the sum over their pieces; a bounded memo."""

    LIMIT = 100_000

    def __init__(self, table: np.ndarray):
        self.table = table

    def learn(self, found: set[bytes]) -> None:
        if len(self) > self.LIMIT:
            self.clear()
        new = [t for t in found if t not in self]
        parts = [token_pieces(t) for t in new]
        chunks = list({p for x in parts for p in x})
        values = dict(zip(chunks, chunk_values(chunks, self.table).tolist(), strict=True))
        self.update((t, sum(map(values.__getitem__, x))) for t, x in zip(new, parts, strict=True))

    def tops(self, texts: list[bytes], bias: float) -> list[tuple[float, float, int]]:
        """The two highest sentence values of each text (the bias where there are fewer), and its number of tokens."""
        out = []
        for k in range(0, len(texts), 100):
            parts = [sentences(t) for t in texts[k : k + 100]]
            self.learn({t for found in parts for words in found for t in words})
            for found in parts:
                best = sorted(sum(map(self.__getitem__, words)) + bias for words in found)[-2:]
                best = [bias] * (2 - len(best)) + best
                out.append((best[1], best[0], sum(map(len, found))))
        return out


# --- training ------------------------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, target: str, buckets: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents a class, the same ones on every run."""
    plain = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    plain = plain.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~bucket_of("doc_id", buckets, held)).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = plain.where("label = 0").orderBy(*order).limit(per_class).unionByName(plain.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class narrow rows


def labelled_sentences(sample: DataFrame) -> DataFrame:
    """(doc_id, label, tokens, docs): distinct sentences of each label, each with the ids of the sample that hold it and the smallest of them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            rows = [(i, label, words) for i, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label")), byte_column(batch, "text"), strict=True) for words in sentences(text)]
            ids, labels, tokens = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(tokens, pa.list_(pa.binary()))], ["doc_id", "label", "tokens"])

    found = sample.select("doc_id", "label", "text").mapInArrow(split, "doc_id long, label long, tokens array<binary>")
    return found.groupBy("label", "tokens").agg(F.min("doc_id").alias("doc_id"), F.collect_set("doc_id").alias("docs"))


def token_counts(parts: DataFrame) -> DataFrame:
    """(letters, pos, neg): toxic and other documents that hold a piece of a token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, list[bytes]] = {}
        for batch in slices(batches, 100):
            keys, toxic, ids = [], [], []
            for docs, label, words in zip(*(batch.column(c).to_pylist() for c in ("docs", "label", "tokens")), strict=True):
                if len(memo) > TokenScorer.LIMIT:
                    memo.clear()
                for t in words:
                    if t not in memo:
                        memo[t] = token_pieces(t)
                found = {p for t in words for p in memo[t]}
                for doc_id in docs:
                    keys += found
                    toxic += [label] * len(found)
                    ids += [doc_id] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(toxic, pa.int64()), pa.array(ids, pa.int64())], ["letters", "label", "doc_id"])

    seen = parts.select("docs", "label", "tokens").mapInArrow(scan, "letters binary, label long, doc_id long").distinct()
    return seen.groupBy("letters").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def choose_landmarks(counts: DataFrame, landmarks: int, min_z: float = 4.0, min_pure: float = 0.9) -> list[bytes]:
    """Up to three quarters tokens that toxic documents hold far more often than their share explains, then frequent others."""
    totals = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not totals[0] or not totals[1]:
        return []
    share = totals[0] / (totals[0] + totals[1])
    expected = (F.col("pos") + F.col("neg")) * F.lit(share)
    rated = counts.withColumn("z", (F.col("pos") - expected) / F.sqrt(expected * F.lit(1 - share) + 0.25)).withColumn("pure", F.col("pos") / (F.col("pos") + F.col("neg")))
    best = lambda rows, n: [bytes(r["letters"]) for r in rows.orderBy(F.col("z").desc(), "letters").limit(n).collect()]
    good = best(rated.where((F.col("z") >= min_z) & (F.col("pure") >= min_pure) & (F.col("pos") >= 3)), landmarks * 3 // 4)
    good = good or best(rated.where((F.col("pure") >= min_pure) & (F.col("pos") >= 2)), 20)  # few labels: what stands out most
    others = rated.where(F.col("z") < 2).orderBy(F.col("neg").desc(), "letters").limit(landmarks - len(good)).collect()
    return [*good, *(bytes(r["letters"]) for r in others)] if good and others else []


def landmark_table(mark: bytes) -> np.ndarray:
    table = np.zeros(CELLS, np.float32)
    for cells, weight in cell_numbers(padded([mark], CHUNK)):
        np.add.at(table, cells.ravel(), weight / NORMS[len(mark)])
    table[0] = 0
    return table


class Landmarks:
    """Kernel columns: the landmarks' cells as the rows of one table."""

    def __init__(self, marks: list[bytes]):
        tables = {}
        for k, mark in enumerate(marks):
            for cells, weight in cell_numbers(padded([mark], CHUNK)):
                for cell in cells[cells > 0].tolist():
                    tables.setdefault(cell, np.zeros(len(marks), np.float32))[k] += weight / NORMS[len(mark)]
        self.rows = np.zeros(CELLS, np.int32)
        self.rows[list(tables)] = np.arange(1, len(tables) + 1)
        self.table = np.stack([np.zeros(len(marks), np.float32), *tables.values()])

    def columns(self, chunks: list[bytes]) -> np.ndarray:
        """The kernel of each chunk with each landmark."""
        out = np.zeros((len(chunks), self.table.shape[1]), np.float32)
        sizes = np.array([len(c) for c in chunks])
        for start in range(0, len(chunks), 5000):
            here = np.arange(start, min(start + 5000, len(chunks)))
            for cells, weight in cell_numbers(padded([chunks[k] for k in here], int(sizes[here].max()))):
                for row in self.rows[cells].T:
                    hit = row > 0
                    out[here[hit]] += np.float32(weight) * self.table[row[hit]]
        return out / NORMS[sizes][:, None].astype(np.float32) if len(chunks) else out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps over the margin's violators."""
    wide = np.c_[x, np.ones(len(x))]
    v = np.zeros(wide.shape[1])
    keep = np.eye(len(v))
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (wide @ v) < 1
        part = wide[active] * weight[active, None]
        new = np.linalg.solve(keep + 2 * c * part.T @ wide[active], 2 * c * part.T @ y[active])
        if np.allclose(new, v, atol=1e-7):
            break
        v = new
    return v[:-1], float(v[-1])


def sentence_columns(parts: DataFrame, marks: list[bytes], most: int) -> DataFrame:
    """(doc_id, label, columns): the kernel of each sentence with each landmark, as packed 32-bit numbers, of at
    most ``most`` sentences a label."""
    order = F.xxhash64("tokens")
    chosen = parts.where("label = 0").orderBy(order).limit(most).unionByName(parts.where("label = 1").orderBy(order).limit(most))
    dealt = chosen.repartition(parts.sparkSession.sparkContext.defaultParallelism, "tokens")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Landmarks(marks)
        for batch in slices(batches):
            bags = [[p for t in words for p in token_pieces(t)] for words in batch.column("tokens").to_pylist()]
            chunks = sorted({p for bag in bags for p in bag})
            values, place = known.columns(chunks), {p: k for k, p in enumerate(chunks)}
            sums = [values[[place[p] for p in bag]].sum(axis=0, dtype=np.float32).tobytes() if bag else np.zeros(len(marks), np.float32).tobytes() for bag in bags]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sums, pa.binary())], ["doc_id", "label", "columns"])

    return dealt.select("doc_id", "label", "tokens").mapInArrow(scan, "doc_id long, label long, columns binary")


def train_on_sentences(x: np.ndarray, toxic: np.ndarray, doc: np.ndarray, rounds: int = 6, c: float = 0.05) -> tuple[np.ndarray, float]:
    """The linear machine; after the first round the positive sentences are each toxic document's best one and those on the toxic side.
    ``c`` is the cost of a violated margin, on average over the sentences; both classes weigh the same."""
    side = np.where(toxic, 1, -1)
    v, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        used = side != 0
        y = side[used].astype(float)
        weight = len(y) / 2 * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
        v, bias = squared_hinge(x[used].astype(float), y, weight, c)
        value = x @ v + bias
        order = np.lexsort((value, doc))
        last = order[np.r_[doc[order][1:] != doc[order][:-1], True]]  # the best sentence of each document
        best = np.zeros(len(x), bool)
        best[last] = True
        side = np.where(~toxic, -1, np.where(best | (value > 0), 1, 0))
    return v, bias


def fit_table(parts: DataFrame, landmarks: int = 160, most_sentences: int = 20_000) -> tuple[np.ndarray, float] | None:
    """The collapsed machine: a weight for each cell, and the bias. None without both classes.

    At most ``most_sentences`` sentences a label come to the driver, as ``landmarks`` numbers each.
    """
    marks = choose_landmarks(cut(token_counts(parts), "toxic_counts"), landmarks)
    if not marks:
        return None
    gram = Landmarks(marks).columns(marks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > 1e-4 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    rows = sentence_columns(parts, marks, most_sentences).toPandas().sort_values(["label", "doc_id", "columns"])
    x = np.frombuffer(b"".join(rows["columns"]), np.float32).reshape(len(rows), len(marks)) @ root.astype(np.float32)
    v, bias = train_on_sentences(x, rows["label"].to_numpy() == 1, rows["doc_id"].to_numpy())
    table = np.zeros(CELLS, np.float32)
    for a, mark in zip(root @ v, marks, strict=True):
        table += np.float32(a) * landmark_table(mark)
    return table, bias


def features(tops: np.ndarray) -> np.ndarray:
    """Highest and second highest sentence, clipped, and the logarithm of the number of tokens."""
    return np.c_[np.clip(tops[:, :2], -3, 3), np.log1p(tops[:, 2]) / 5, np.ones(len(tops))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    v = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * v
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(v))
        step = np.linalg.solve(h, g)
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    return v


def score(docs: DataFrame, labels: DataFrame, per_class: int = 6000, buckets: int = 4, held: int = 2, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from at most ``per_class``
    labelled documents of each class."""
    spark = docs.sparkSession
    sample = cut(training_sample(docs, labels, "toxic", buckets, held, per_class), "toxic_sample")
    known = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    machine = fit_table(cut(labelled_sentences(sample), "toxic_sentences")) if len(known) == 2 else None
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if machine is None:
        rate = known.get(1, 0) / max(1, sum(known.values()))
        scored = base.select("doc_id", F.lit(float(rate)).alias("score"))
    else:
        table, bias = machine
        shared = spark.sparkContext.broadcast(table)  # 4 MB, whatever the corpus

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = TokenScorer(shared.value)
            for batch in slices(batches):
                a, b, n = zip(*scorer.tops(byte_column(batch, "text"), bias), strict=True) if batch.num_rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(n, pa.int64())], [batch.schema.names[0], "top", "second", "n"])

        fitted = sample.select("label", "text").mapInArrow(tops, "label int, top double, second double, n long").toPandas()
        y = fitted["label"].to_numpy(float)
        curve = fit_logistic(features(fitted[["top", "second", "n"]].to_numpy()), y, np.ones(len(y)))

        @F.pandas_udf("double")
        def probability(top: pd.Series, second: pd.Series, n: pd.Series) -> pd.Series:
            z = features(np.c_[top, second, n]) @ curve
            return pd.Series(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6))

        scored = base.mapInArrow(tops, "doc_id long, top double, second double, n long").select("doc_id", probability("top", "second", "n").alias("score"))
    return scored.select("doc_id", bucket_of("doc_id", buckets, held).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
