"""Spelling variant grouping (13): words one edit apart, found by k-d trees over letter-count vectors.

1. ``vocabulary``: one pass over the texts counts runs of letters by document, applies the contract's rule of deleted letters to
   each (document, run), sums in the task and then by word.
2. A word is the vector of its letter counts. One edit moves it by an L1 distance of at most two: a replaced letter by two, an inserted
   or deleted one by one. So the words near a word of length L are among those of length L at distance two and those of length L + 1 at
   distance one: a range search for each pair of lengths.
3. The words of a length form a k-d tree. Its top is cut from a sample of about ``MOST_SAMPLE`` words drawn by hash and only
   decides which cell, of about ``CELL`` words, a word is held in; each word is sent to the cells whose boxes its range meets. In
   a task each cell's words form the lower part of the tree, and all its queries go down together, pruned by boxes.
4. Candidates at the right distance are verified letter by letter; the pair is emitted in both directions.
5. A word's form is its near word of largest count; roots by pointer jumping along forms, whose counts at least double.

Defined edge cases: null and empty texts have no words; a null doc_id is an empty string in the rule of deleted letters; rows that
repeat a doc_id are joined for that rule only by having equal outcomes; words of any length are taken whole; a table without words of
the needed count gives no rows; ties go to the smallest word in code-point order; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import byte_column, cut, hot_join, is_broadcast, slices, small_side

#: Words are runs of these; what lies between the two ranges has no letters of its own.
LETTERS = "[a-zÀ-ÿ]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Of 97 values of the checksum one deletes a letter; shortest word, fewest occurrences, ratio of counts.
DELETES, SHORTEST, FEWEST, RATIO = 97, 5, 3, 2
#: Words of a cell, words that the cells are cut from (they come to the driver), and cells of a length.
CELL, MOST_SAMPLE, MOST_CELLS = 4000, 50_000, 4096
#: Words of a leaf in a task; distinct words that a task counts before it emits them; characters read at once.
LEAF, MOST_COUNTED, PIECE = 128, 200_000, 1 << 20
#: Above any letter count.
FAR = (1 << 31) - 1
SCAN_WORDS = re.compile(LETTERS)


def runs(text: bytes) -> Counter:
    """Maximal runs of letters (A-Z lower-cased) of a UTF-8 text and how often each occurs."""
    lowered = text.lower().decode("utf-8", "replace")
    if len(lowered) <= PIECE:
        return Counter(SCAN_WORDS.findall(lowered))
    return Counter(m.group() for m in SCAN_WORDS.finditer(lowered))


def noted(doc_id: object, run: str, deletes: int = DELETES) -> str:
    """The run as the document has it, after the rule of deleted letters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % deletes:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, deletes: int = DELETES) -> DataFrame:
    """(word, n) of the words with at least ``shortest`` letters and ``fewest`` occurrences."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_column(batch, "text"), strict=True):
                for run, n in runs(text).items():
                    if len(run) >= shortest:
                        word = noted(doc_id, run, deletes)
                        if len(word) >= shortest:
                            total[word] += n
                if len(total) > MOST_COUNTED:
                    yield rows()
        yield rows()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = base.mapInArrow(scan, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


_PLACES = np.full(0x100, -1)
_PLACES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _PLACES[codes].reshape(len(words), -1).astype(np.int16)


def letter_counts(spelled: np.ndarray) -> np.ndarray:
    """Letter-count vectors of words of one length."""
    out = np.zeros((len(spelled), len(ALPHABET)), np.int32)
    if spelled.shape[0] * spelled.shape[1] < 1 << 22:
        np.add.at(out, (np.arange(len(spelled))[:, None], spelled), 1)
        return out
    for k, row in enumerate(spelled):
        out[k] = np.bincount(row, minlength=len(ALPHABET))
    return out


#: Letters of greatest variance that a split is chosen from.
TRIED = 6


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, value): of the letters that vary most, the split into counts up to the value and counts above it that is
    nearest to halves; None if all rows are equal."""
    spread = counts.var(0)
    best = None
    for letter in np.argsort(-spread, kind="stable")[:TRIED]:
        if spread[letter] == 0:
            break
        column = counts[:, letter]
        value = int(np.median(column))
        value = value if value < column.max() else value - 1
        away = abs(2 * int((column <= value).sum()) - len(column))
        if best is None or away < best[0]:
            best = (away, int(letter), value)
    return best and best[1:]


class CountTree:
    """A k-d tree of letter-count vectors of words of one length: nodes of (box, children, rows).

    Only letters that its words hold have columns of their own; what a query holds of others is summed in one column.
    """

    def __init__(self, counts: np.ndarray, leaf: int = LEAF):
        self.letters = np.flatnonzero(counts.any(0))
        self.counts, self.nodes = self.seen(counts), [None]
        todo = [(0, np.arange(len(counts)))]
        while todo:
            at, rows = todo.pop()
            held = self.counts[rows]
            split = split_of(held) if len(rows) > leaf else None
            children = ()
            if split:
                below = held[:, split[0]] <= split[1]
                children = len(self.nodes), len(self.nodes) + 1
                self.nodes += [None, None]
                todo += [(children[0], rows[below]), (children[1], rows[~below])]
            self.nodes[at] = held.min(0), held.max(0), children, rows

    def seen(self, counts: np.ndarray) -> np.ndarray:
        mine = counts[:, self.letters]
        out = np.c_[mine, counts.sum(1) - mine.sum(1)]
        return out.astype(np.int8 if out.max(initial=0) < 64 else np.int32)

    def search(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, tree rows): pairs with exactly ``up`` letters more and ``down`` letters less in the tree's word.

        Both are 0 or 1, and the words' lengths differ by ``up`` - ``down``, so these are the pairs whose squared distance is ``up`` + ``down``.
        """
        asked = self.seen(queries)
        kind = np.float32 if max(asked.sum(1, dtype=np.int64).max(initial=0), self.counts.sum(1, dtype=np.int64).max()) < 4000 else np.float64
        mine, theirs = self.counts.astype(kind), asked.astype(kind)
        mine_sq, theirs_sq = (mine * mine).sum(1), (theirs * theirs).sum(1)
        for alive, rows in descend(self.nodes, asked, up, down):
            for k in range(0, len(alive), 4096):
                part = alive[k : k + 4096]
                q, w = np.nonzero(theirs_sq[part][:, None] + mine_sq[rows] - 2 * (theirs[part] @ mine[rows].T) == up + down)
                if len(q):
                    yield part[q], rows[w]


def descend(nodes: list[tuple], queries: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, object]]:
    """(query rows, what a leaf holds): the leaves whose boxes have a point with at most ``up`` letters more and ``down`` less."""
    todo = [(0, np.arange(len(queries)))]
    while todo:
        at, alive = todo.pop()
        low, high, children, held = nodes[at]
        here = queries[alive]
        alive = alive[(np.maximum(low - here, 0).sum(1) <= up) & (np.maximum(here - high, 0).sum(1) <= down)]
        if not len(alive):
            continue
        if children:
            todo += [(child, alive) for child in children]
        else:
            yield alive, held


class Top:
    """The top of a k-d tree with about ``cells`` leaves, numbered, that divide the whole space."""

    def __init__(self, counts: np.ndarray, cells: int):
        self.nodes, made, used = [None], 0, set()
        todo = [(0, counts, float(cells), {})]
        while todo:
            at, rows, wanted, box = todo.pop()
            split = split_of(rows) if wanted > 1 and len(rows) > 1 else None
            if not split:
                self.nodes[at] = box, (), made
                made += 1
                continue
            letter, value = split
            used.add(letter)
            below = rows[:, letter] <= value
            share = below.mean()
            children = len(self.nodes), len(self.nodes) + 1
            self.nodes += [None, None]
            self.nodes[at] = box, children, None
            low, high = box.get(letter, (0, FAR))
            todo += [(children[0], rows[below], wanted * share, box | {letter: (low, value)}), (children[1], rows[~below], wanted * (1 - share), box | {letter: (value + 1, high)})]
        # Boxes are bounded at the letters of the splits only.
        self.letters = sorted(used)
        self.nodes = [(*(np.array([box.get(k, (0, FAR))[end] for k in self.letters], np.int32) for end in (0, 1)), children, number) for box, children, number in self.nodes]

    def cells(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, cell): the rows whose range, of at most ``up`` letters more and ``down`` less, meets a cell's box."""
        return descend(self.nodes, counts[:, self.letters], up, down)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of b are rows of a with one letter more."""
    same = lambda x, y: np.logical_and.accumulate(x == y, axis=1).sum(1)
    return same(a, b[:, :-1]) + same(a[:, ::-1], b[:, :0:-1]) >= a.shape[1]


class Cell:
    """Words of one length with their k-d tree."""

    def __init__(self, words: list[str]):
        self.spelled = letters(words)
        self.tree = CountTree(letter_counts(self.spelled))

    def near(self, queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, word index) of pairs one edit apart; queries have the words' length or one letter less."""
        size = self.spelled.shape[1]
        for shorter, up, down, verify in ((0, 1, 1, one_replaced), (1, 1, 0, one_inserted)):
            mine = np.array([k for k, q in enumerate(queries) if len(q) == size - shorter], np.int64)
            if not len(mine):
                continue
            asked = letters([queries[k] for k in mine])
            for q, w in self.tree.search(letter_counts(asked), up, down):
                good = verify(asked[q], self.spelled[w])
                if good.any():
                    yield mine[q[good]], w[good]


def tops(words: DataFrame) -> dict[int, Top]:
    """For each length of words, the cells that its k-d tree is cut into."""
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [s for s, n in sizes.items() if n > CELL]
    out = {s: Top(np.zeros((0, len(ALPHABET))), 1) for s in sizes}
    if large:
        sample: dict[int, list[str]] = {}
        share = min(1.0, MOST_SAMPLE / sum(sizes[s] for s in large))
        drawn = F.shiftrightunsigned(F.xxhash64("word"), 32) < F.lit(int(share * (1 << 32)))
        for r in words.where(F.length("word").isin(large) & drawn).select("word").collect():
            sample.setdefault(len(r.word), []).append(r.word)
        for size, found in sample.items():
            found.sort()
            out[size] = Top(letter_counts(letters(found)), min(MOST_CELLS, -(-sizes[size] // CELL)))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (columns word, n) one edit apart."""
    top = tops(words)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in found], np.int64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                counts = letter_counts(letters([found[k] for k in at]))
                # A word is held in its own cell; it asks the cells of its length and of one letter more.
                for tree, asks, up, down in ((size, False, 0, 0), (size, True, 1, 1), (size + 1, True, 1, 0)):
                    for rows, cell in top[int(tree)].cells(counts, up, down) if int(tree) in top else ():
                        k = at[rows]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), tree), pa.int32()), pa.array(np.full(len(k), cell), pa.int32()), pa.array(np.full(len(k), asks), pa.bool_()), pa.array([found[j] for j in k], pa.string()), pa.array(n[k], pa.int64())],
                            ["size", "cell", "asks", "word", "n"],
                        )

    sent = words.mapInArrow(route, "size int, cell int, asks boolean, word string, n long")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "size", "cell").sortWithinPartitions("size", "cell", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, asked, cell_words = None, [], [], None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal cell_words
            if not held or not asked:
                return
            size = place[0]
            cell_words = cell_words or Cell([h[0] for h in held])
            for q, w in cell_words.near([a[0] for a in asked]):
                rows = [(asked[i][0], *held[j]) for i, j in zip(q.tolist(), w.tolist(), strict=True)]
                # The other direction of a pair of unequal lengths is asked by nobody.
                rows += [(held[j][0], *asked[i]) for i, j in zip(q.tolist(), w.tolist(), strict=True) if len(asked[i][0]) < size]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "near", "near_n"])

        for batch in batches:
            for size, cell, asks, word, n in zip(*(batch.column(c).to_pylist() for c in ("size", "cell", "asks", "word", "n")), strict=True):
                if place != (size, cell):
                    yield from answer()
                    place, held, asked, cell_words = (size, cell), [], [], None
                (asked if asks else held).append((word, n))
                if len(asked) >= CELL:
                    yield from answer()
                    asked = []
        yield from answer()

    return dealt.mapInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (columns word, form) lead in the end, by pointer jumping."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Only words that are someone's form are looked up.
        ahead = now.join(now.select(F.col("root").alias("word")).distinct(), "word", "left_semi").select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = small_side(ahead, "ahead")
        if ahead.isEmpty():
            return now
        if is_broadcast(ahead):
            jumped = now.join(ahead, "root", "left")
        else:
            done = now.join(ahead, "root", "left_anti").withColumn("next", F.lit(None).cast("string"))
            jumped = hot_join(now, ahead, ["root"], ["word"]).select("root", "word", "next").unionByName(done.select("root", "word", "next"))
        now = cut(jumped.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO, deletes: int = DELETES) -> DataFrame:
    """word, n, n_near, form (near word of largest n if that is at least ``ratio`` times the word's own), form_n, root."""
    words = cut(vocabulary(docs, shortest, fewest, deletes), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("near_n", -F.col("best.less"))
    strong = F.col("near_n") >= ratio * F.col("n")
    formed = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")), "forms")
    led = roots(formed.where("form is not null"))
    return formed.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT k, 0 AS step, k AS c FROM range(256) t(k)
  UNION ALL SELECT k, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM turns WHERE step < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM turns WHERE step = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM found WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, c, list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b
  FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM counted)),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM bytes, crc),
noted AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM noted WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM holes a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM holes a JOIN words w ON w.word = a.rest),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1),
ways AS (SELECT word, word AS at FROM formed UNION ALL SELECT y.word, f.form FROM ways y JOIN formed f ON f.word = y.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, y.at AS root FROM formed f JOIN ways y ON y.word = f.word JOIN formed e ON e.word = y.at AND e.form IS NULL
"""
