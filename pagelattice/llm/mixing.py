"""Mixing sources to target weights (3): a time-varying curriculum, in DataFrame functions only.

1. Each source's target: weights by rank of the source name, a common budget of ``share`` times all
   words, and no more than ``max_epochs`` passes over a source; what a full source cannot take is
   dealt to the others by weight (the level of this water-filling is found from prefix sums over the
   sources, one row each).
2. Each source's demand over training time t in [0, 1] follows a piecewise-linear weight schedule
   with equally spaced knots; its integral is the cumulative demand.
3. Documents of a source are ordered by the MD5 of their id and laid end to end, pass after pass.
   The inverse of the cumulative demand at a document's first word is its training position. Running
   sums are taken in two levels (blocks by hash prefix, then within a block), so no source, however
   large, is one task.
4. Rows are range-sorted by position.

The document at which a source reaches its target gives only the words still asked for, so a
source's taken words equal its rounded target.

Defined edge cases: null text has size 0 and is never taken; a null source is a source of its own,
ranked last; a null doc_id is ordered as the empty string; ties are broken by size, then by a hash of
the text; repeated rows are rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, scratch

WORD = r"[^\x20\x09-\x0D]+"

#: Knots of the default schedules, by weight: heavy sources fade, light ones grow.
SCHEDULES = {5: (1.5, 0.5), 2: (1.0, 1.0), 1: (0.5, 1.5)}


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size); one row a source."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", F.array(*map(F.lit, weights))[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")])
    levels = (
        ranked.withColumn("full", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything))
    )
    target = F.when(F.col("nth") < F.col("found.nth"), F.col("full")).otherwise(F.least(F.col("full"), F.col("found.level") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def with_segments(targets: DataFrame, schedules: dict[int, tuple[float, ...]]) -> DataFrame:
    """Adds ``segments``: of each piece of the weight schedule its start, width, weights at both ends
    and the share of demand before and after it."""
    knots = F.lit(None).cast("array<double>")
    for weight, values in schedules.items():
        knots = F.when(F.col("weight") == weight, F.array(*[F.lit(float(v)) for v in values])).otherwise(knots)
    areas = "transform(sequence(1, size(knots) - 1), i -> (knots[i - 1] + knots[i]) / 2 / (size(knots) - 1))"
    cumulative = "transform(sequence(0, size(areas)), i -> aggregate(slice(areas, 1, i), 0D, (a, x) -> a + x))"
    pieces = """transform(sequence(0, size(areas) - 1), i -> struct(
        i / size(areas) AS t0, 1D / size(areas) AS width, knots[i] AS w0, knots[i + 1] AS w1,
        sums[i] AS a0, sums[i + 1] AS a1, sums[size(areas)] AS area))"""
    found = targets.withColumn("knots", knots).withColumn("areas", F.expr(areas)).withColumn("sums", F.expr(cumulative))
    return found.withColumn("segments", F.expr(pieces)).drop("knots", "areas", "sums")


def position_at(demand: str) -> Column:
    """Training time at which the share ``demand`` of a source's words has been asked for."""
    return F.expr(
        f"""transform(slice(filter(segments, s -> s.a1 >= {demand} * s.area), 1, 1), s ->
            s.t0 + coalesce(s.width * 2 * (({demand} * s.area - s.a0) / s.width)
            / nullif(s.w0 + sqrt(greatest(0D, s.w0 * s.w0 + 2 * (s.w1 - s.w0) * (({demand} * s.area - s.a0) / s.width))), 0D), 0D))[0]"""
    )


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position (of the first word taken, null if
    none), repeat_position (of the second pass), sorted by position. ``options`` as ``arranged``."""
    return arranged(docs, **options).drop("text_hash").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def arranged(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, schedules: dict[int, tuple[float, ...]] | None = None) -> DataFrame:
    """The rows of ``mix`` with ``text_hash``, unsorted. ``max_epochs`` is at most 2."""
    if max_epochs > 2:
        raise ValueError("at most two passes over a source")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"), text_hash().alias("text_hash"))
    sizes = cut(sizes.withColumn("key", key).withColumn("block", F.substring("key", 1, 3)), "mix_sizes")
    targets = with_segments(source_targets(sizes, weights, share, max_epochs), schedules or SCHEDULES)

    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    blocks = blocks.select("source", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("block_start"))
    blocks = blocks.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target", "segments")

    inside = Window.partitionBy("source", "block").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    laid = sizes.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block"))
    rows = laid.alias("d").join(blocks.alias("b"), same).select("d.doc_id", "d.source", "text_hash", "size", "source_size", "target", "segments", (F.col("block_start") + F.col("inner_start")).alias("start"))
    rows = rows.withColumn("asked", F.round("target").cast("long"))
    within = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("asked") - start))
    rows = rows.withColumn("taken", within(F.col("start")) + within(F.col("start") + F.col("source_size")))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, F.round(position_at("(start / asked)"), 9)))
    again = (F.col("taken") > 0) & (F.col("start") + F.col("source_size") < F.col("asked"))
    rows = rows.withColumn("repeat_position", F.when(again, F.round(position_at("((start + source_size) / asked)"), 9)))
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken", "position", "repeat_position")


#: Columns that ``mixed`` adds, in place of any of the same name.
ADDED = ("mix_size", "mix_pass", "mix_taken", "mix_position")


def passes(mix_rows: DataFrame) -> DataFrame:
    """A row for each pass that takes words: its number, the words it takes and its position.

    The second pass begins where the first has ended, so the first takes the whole text if there is one.
    """
    whole = F.col("repeat_position").isNotNull()
    first = F.struct(F.lit(1).alias("mix_pass"), F.when(whole, F.col("size")).otherwise(F.col("taken")).alias("mix_taken"), F.col("position").alias("mix_position"))
    again = F.struct(F.lit(2).alias("mix_pass"), (F.col("taken") - F.col("size")).alias("mix_taken"), F.col("repeat_position").alias("mix_position"))
    found = mix_rows.where("taken > 0").withColumn("step", F.explode(F.array_compact(F.array(first, F.when(whole, again)))))
    return found.select("doc_id", "source", "text_hash", F.col("size").alias("mix_size"), "step.*")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, all columns, a row for each pass, range-sorted by training position.

    Adds ``mix_size``, ``mix_pass`` (1 or 2), ``mix_taken`` (words of this pass: a trainer reads that many
    from the start of the text) and ``mix_position``; columns of these names in ``docs`` are replaced. Rows
    find their place by id, source and text. Equal rows are dealt the places of all of them in order, so
    each place is used once; rows with a null id, source or text take part like others.
    """
    plain = docs.drop(*ADDED)
    key = {"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__hash": text_hash()}
    nth = lambda names, order: F.row_number().over(Window.partitionBy(*names).orderBy(order))
    with scratch(docs.sparkSession) as keep:
        taken, _ = keep(passes(arranged(plain, **options)).withColumn("copy", nth(["doc_id", "source", "text_hash", "mix_pass"], "mix_position")), "mix_passes")
    keyed = plain.withColumns(key)
    same = F.col("k.__id").eqNullSafe(F.col("t.doc_id")) & F.col("k.__source").eqNullSafe(F.col("t.source")) & (F.col("k.__hash") == F.col("t.text_hash"))
    copies = taken.groupBy("doc_id", "source", "text_hash").agg(F.max("copy").alias("copies")).where("copies > 1")
    alone = keyed.alias("k").join(taken.alias("t"), same)
    if copies.isEmpty():
        joined = alone
    else:
        numbered = keyed.withColumn("__copy", nth(list(key), "__hash"))
        joined = numbered.alias("k").join(taken.alias("t"), same & (F.col("k.__copy") == F.col("t.copy")))
    return joined.select(*[F.col(f"k.{c}") for c in plain.columns], *[F.col(f"t.{c}") for c in ADDED]).orderBy("mix_position", "doc_id")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
ratios AS (
  SELECT *, 2.0::DOUBLE * source_size AS full_size, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * (sum(source_size) OVER ()) AS budget
  FROM ranked),
levels AS (
  SELECT *, row_number() OVER w AS nth,
         (budget - coalesce(sum(full_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST)),
chosen AS (
  SELECT *, min(CASE WHEN level <= ratio THEN nth END) OVER () AS first_open FROM levels),
targets AS (
  SELECT source, source_size, weight,
         CASE WHEN nth < first_open THEN full_size
              ELSE least(full_size, max(CASE WHEN nth = first_open THEN level END) OVER () * weight) END AS target
  FROM chosen),
laid AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS asked,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE t.weight WHEN 5 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE t.weight WHEN 5 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS w1
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
used AS (
  SELECT *, greatest(0, least(size, asked - start)) + greatest(0, least(size, asked - start - source_size)) AS taken
  FROM laid)
SELECT doc_id, source, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * (start::DOUBLE / asked) / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * (start::DOUBLE / asked))), 9) END AS position,
       CASE WHEN taken > 0 AND start + source_size < asked
            THEN round(2 * ((start + source_size)::DOUBLE / asked)
                 / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * ((start + source_size)::DOUBLE / asked))), 9) END AS repeat_position
FROM used
"""
