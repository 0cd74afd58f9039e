"""Vector code compression (12): product codes, their codebooks trained by Lloyd rounds over cover trees.

1. Components become integers, floor(1024 x); a vector is cut into ``parts`` consecutive parts of equal length.
2. Each task packs its vectors into blocks of ``BLOCK`` and builds a cover tree for each part position of a block:
   nested nets of points that are over ``scale`` apart, with ``scale`` shrinking by ``BASE`` a level, and every net point
   hanging from a point of the net above that is within that net's scale. The points lie in the tree's order, so a
   node is a range of them, and prefix sums give the sum of any node. The blocks are written once.
3. A round compares the codebook with the nodes, level by level. An entry is out for a whole node if it is over
   two radii further from the node's centre than the nearest entry (triangle inequality). A node with one entry left is
   assigned whole: its sum is a difference of two prefix sums. Other nodes descend; what is left at the leaves is
   compared point by point, in exact integers.
4. A task emits one sum for each part and entry, whatever it has read; the driver sees the codebooks only (``parts`` x
   ``entries`` x dimensions). Results do not depend on how vectors fall into blocks.

Defined edge cases: null vectors, and vectors with null or non-finite components, are dropped; shorter vectors, and
a dimension that ``parts`` does not divide, are filled up with zeros at the end; rows that repeat an id are rows of
their own (as first entries they are ordered by vector); null ids come last among the first entries and keep their
code; fewer rows than ``entries`` make a smaller codebook; null labels are one group; an empty table gives no rows;
extra columns are ignored. Vectors so large that a squared distance leaves 63 bits raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, hot_join, is_broadcast, small_side

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block; factor between the scales of two levels; points a leaf has on average.
BLOCK, BASE, LEAF = 4096, 1.3, 8
#: Integers that doubles hold exactly.
EXACT = 1 << 53


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    if not len(points) or not len(book):
        return np.zeros((len(points), len(book)))
    top = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    if points.shape[1] * (2 * top) ** 2 < EXACT:
        p, b = points.astype(np.float64), book.astype(np.float64)
        return np.maximum((p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1), 0)
    return np.stack([((points - entry) ** 2).sum(1) for entry in book], axis=1)


class CoverTree:
    """A cover tree of distinct integer points with weights.

    ``points`` and ``weights`` are in the tree's order; ``inverse`` has for each row given its point. ``levels`` has from the root
    down (centre, start, radius): node k of a level is the range from start[k] to start[k + 1].
    """

    def __init__(self, rows: np.ndarray, base: float = BASE, leaf: int = LEAF):
        points, inverse, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        n = len(points)
        x = points.astype(np.float64)
        root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        far = np.sqrt(((x - x[root]) ** 2).sum(1))
        holder, nets = np.zeros(n, np.int64), [(np.array([root]), np.zeros(1, np.int64))]
        scale = far.max()
        while len(nets[-1][0]) * leaf < n and scale > 0:
            scale /= base
            centres = nets[-1][0]
            parents, new = list(range(len(centres))), []
            loose = np.flatnonzero(far > scale)
            if len(loose) and len(centres) > 1:
                away = np.sqrt(squared(points[loose], points[centres]))
                best = away.argmin(1)
                away = away[np.arange(len(loose)), best]
                held = away <= scale
                holder[loose[held]], far[loose[held]] = best[held], away[held]
                loose = loose[~held]
            while len(loose):
                first = loose[0]
                away = np.sqrt(((x[loose] - x[first]) ** 2).sum(1))
                held = away <= scale
                parents.append(holder[first])
                holder[loose[held]], far[loose[held]] = len(centres) + len(new), away[held]
                new.append(first)
                loose = loose[~held]
            nets.append((np.r_[centres, np.array(new, np.int64)], np.array(parents, np.int64)))
        above = [holder]
        for _, parents in reversed(nets[1:]):
            above.append(parents[above[-1]])
        order = np.lexsort(above)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.points, self.weights, self.inverse = points[order], weights[order], place[inverse.ravel()]
        self.levels = []
        for (centres, _), node in zip(nets, reversed(above), strict=True):
            node = node[order]
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            away = np.sqrt(((x[order] - x[centres[node]]) ** 2).sum(1))
            self.levels.append((place[centres[node[start]]], start, np.maximum.reduceat(away, start)))

    def packed(self) -> tuple:
        """The arrays of the tree, points in the smallest type that holds them."""
        kind = np.result_type(np.int8, np.min_scalar_type(int(self.points.min())), np.min_scalar_type(int(self.points.max())))
        return self.points.astype(kind if kind.kind == "i" else np.int64), self.weights, self.inverse.astype(np.int32), self.levels

    @classmethod
    def unpacked(cls, arrays: tuple) -> CoverTree:
        tree = cls.__new__(cls)
        tree.points, tree.weights, tree.inverse, tree.levels = arrays
        return tree

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, entries): ranges of points and the nearest entry of all points in each; ties to the lower index."""
        points, n = self.points.astype(np.int64), len(self.points)
        ambiguous, found = np.ones(n, bool), []
        for centre, start, radius in self.levels:
            live = np.flatnonzero(ambiguous[start])
            if not len(live):
                break
            away = np.sqrt(squared(points[centre[live]], book))
            low = away.min(1)
            # The slack covers the rounding of roots, so that a rival is never left out wrongly.
            sole = (away <= ((low + 2 * radius[live]) * (1 + 1e-9) + 1e-6)[:, None]).sum(1) == 1
            begin, end = start[live[sole]], np.r_[start, n][live[sole] + 1]
            found.append((begin, end, away[sole].argmin(1)))
            steps = np.zeros(n + 1, np.int64)
            steps[begin] += 1
            steps[end] -= 1
            ambiguous &= np.cumsum(steps)[:-1] == 0
        rest = np.flatnonzero(ambiguous)
        found.append((rest, rest + 1, squared(points[rest], book).argmin(1) if len(rest) else rest))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry, the sum and the number of the rows nearest to it, from prefix sums."""
        start, end, entry = self.assign(book)
        points = self.points.astype(np.int64)
        running = np.zeros((len(points) + 1, points.shape[1] + 1), np.int64)
        np.cumsum(np.c_[points * self.weights[:, None], self.weights], axis=0, out=running[1:])
        total = np.zeros((len(book), running.shape[1]), np.int64)
        np.add.at(total, entry, running[end] - running[start])
        return total[:, :-1], total[:, -1]

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row given, its nearest entry and the exact squared distance."""
        start, end, entry = self.assign(book)
        nearest = np.empty(len(self.points), np.int64)
        order = np.argsort(start)
        nearest[:] = np.repeat(entry[order], (end - start)[order])
        away = ((self.points.astype(np.int64) - book[nearest]) ** 2).sum(1)
        return nearest[self.inverse], away[self.inverse]


def _trees(data: pa.Scalar) -> list[CoverTree]:
    return [CoverTree.unpacked(arrays) for arrays in pickle.loads(data.as_buffer())]


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, v (array<long>) of the rows that are kept."""
    x = F.col(column).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    bounded = lambda c: F.greatest(F.least(c * F.lit(float(SCALE)), F.lit(2.0**62)), F.lit(-(2.0**62)))
    return vectors.where(whole).select("vec_id", "label", F.transform(x, lambda c: F.floor(bounded(c))).alias("v"))


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    return flat.reshape(-1, width) if (sizes == width).all() else _padded(column.to_pylist(), width)


def blocks(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """(vec_ids, labels, trees): blocks of vectors with the cover tree of each part, written."""
    each = width // parts
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, rows
            whole = pa.Table.from_batches(held)
            v = _matrix(whole.column("v"), width)
            trees = pickle.dumps([CoverTree(v[:, p * each : (p + 1) * each]).packed() for p in range(parts)])
            ids, labels = (pa.array([whole.column(c).to_pylist()], pa.list_(whole.schema.field(c).type)) for c in ("vec_id", "label"))
            held, rows = [], 0
            return pa.RecordBatch.from_arrays([ids, labels, pa.array([trees], pa.binary())], ["vec_ids", "labels", "trees"])

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, BLOCK - rows)
                held.append(piece)
                rows += piece.num_rows
                batch = batch.slice(piece.num_rows)
                if rows == BLOCK:
                    yield block()
        if rows:
            yield block()

    return cut(kept.mapInArrow(pack, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees binary"), "blocks")


def first_entries(kept: DataFrame, packed: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` smallest ids, as the first codebooks."""
    ids = packed.select(F.explode("vec_ids").alias("vec_id")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    last = ids[-1].vec_id if ids else None
    rows = kept if last is None else kept.where(F.col("vec_id") <= F.lit(last))
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.split(_padded([r.v for r in found], width), parts, axis=1)


def lloyd_round(packed: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round; an entry without rows stays."""
    each = books[0].shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for data in batch.column("trees"):
                for p, tree in enumerate(_trees(data)):
                    total, n = tree.sums(books[p])
                    sums[p] += total
                    counts[p] += n
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            rows = pa.array(list(sums[p][used]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), rows], ["part", "entry", "n", "sums"])

    partial = packed.select("trees").mapInArrow(scan, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(each)))
    out = [b.copy() for b in books]
    for row in total.collect():
        out[row.part][row.entry] = np.array(row[3:], np.int64) // row.n
    return out


class Codebooks:
    """Trained codebooks, one array of integer entries for each part position."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def digest(self) -> str:
        """SHA-256 of all components in order, decimal and comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([b[int(code[2 * p : 2 * p + 2], 16)] for p, b in enumerate(self.books)]) / SCALE


def train(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks, and the blocks of vectors that ``encode`` takes."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = integers(vectors, column)
    size, low, high = kept.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width = -(-max(size or 0, 1) // parts) * parts
    top = max(abs(low or 0), abs(high or 0))
    if width * (2 * top) ** 2 >= 1 << 63:
        raise ValueError("components are too large for squared distances in 63 bits")
    packed = blocks(kept, width, parts)
    books = first_entries(kept, packed, width, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = lloyd_round(packed, books)
    return Codebooks(books), packed


def encode(packed: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error (squared distance over all parts) of every vector in the blocks."""
    found, kinds = books.books, {f.name: f.dataType.elementType.simpleString() for f in packed.schema.fields if f.name != "trees"}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for row in range(batch.num_rows):
                pairs = [tree.codes(found[p]) for p, tree in enumerate(_trees(batch.column("trees")[row]))]
                code = digits[pairs[0][0]]
                for nearest, _ in pairs[1:]:
                    code = np.char.add(code, digits[nearest])
                error = sum(away for _, away in pairs)
                ids, labels = (batch.column(c)[row].values for c in ("vec_ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(scan, f"vec_id {kinds['vec_ids']}, label {kinds['labels']}, code string, error long")


def compress(vectors: DataFrame, column: str = "embedding", **options) -> DataFrame:
    """vec_id, code, error, label_error (sum over equal labels, nulls together), codebooks_sha256."""
    books, packed = train(vectors, column, **options)
    coded = cut(encode(packed, books).withColumn("unlabelled", F.col("label").isNull()), "codes")
    kind = coded.schema["label"].dataType
    nothing = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    keyed = coded.withColumn("label_key", F.coalesce("label", nothing)).drop("label")
    sums = small_side(keyed.groupBy("label_key", "unlabelled").agg(F.sum("error").alias("label_error")), "label_sums")
    keys = ["label_key", "unlabelled"]
    joined = keyed.join(sums, keys) if is_broadcast(sums) else hot_join(keyed, sums, keys, ["vec_id"])
    return joined.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(books.digest()))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after another, every part against every entry."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS k FROM kept),
cuts AS MATERIALIZED (
  SELECT k, p, CAST(list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS DOUBLE[]) AS x
  FROM numbered, (SELECT unnest(range({parts})) AS p)),
book_0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS b FROM cuts WHERE k <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""near_{r} AS MATERIALIZED (
  SELECT k, p, min(row(CAST(list_inner_product(x, x) + list_inner_product(b, b) - 2 * list_inner_product(x, b) AS BIGINT), e)) AS best
  FROM cuts JOIN book_{r} USING (p) GROUP BY k, p)""")
        if r < rounds:
            steps.append(f"""moved_{r} AS (
  SELECT p, e, list(m ORDER BY i) AS b FROM (
    SELECT p, e, i, floor(sum(c) / count(*)) AS m FROM (
      SELECT n.p, n.best[2] AS e, unnest(range(len(x))) AS i, unnest(x) AS c FROM near_{r} n JOIN cuts c ON c.k = n.k AND c.p = n.p)
    GROUP BY p, e, i) GROUP BY p, e),
book_{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.b, o.b) AS b FROM book_{r} o LEFT JOIN moved_{r} m ON m.p = o.p AND m.e = o.e)""")
    last = rounds
    return f"""
WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(CAST(b AS BIGINT[]), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book_{last}),
coded AS (SELECT k, string_agg(lpad(format('{{:x}}', best[2]), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near_{last} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered JOIN coded USING (k), digest
"""


ORACLE = _oracle()
