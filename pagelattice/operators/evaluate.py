"""Samples, splits, weights and metrics of labelled rows: aggregates and hash-ordered ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.urls import is_phish

KNOWN_LABELS = ("phish", "benign", "0", "1")


def draw_order(key: str, seed: int) -> Column:
    """A repeatable random order of a key: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def binary_metrics(rows: DataFrame, truth: str = "truth", guess: str = "guess", by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 of 0/1 columns; 0 where a denominator is 0. One aggregate."""
    both = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    counted = rows.groupBy(*by).agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    made = {"accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn)}
    return counted.select(*by, *[F.bround(v, 6).alias(k) for k, v in made.items()])


def confusion(rows: DataFrame, normalize: bool = False) -> DataFrame:
    """(tp, fp, tn, fn, known, accuracy) of text columns label and prediction.

    Labels 0 and 1 count as known but fill no cell, unless ``normalize`` reads them as words.
    """
    label = F.lower(F.col("label").cast("string"))
    known = F.count_if(label.isin(*KNOWN_LABELS))
    word = F.when(label == "1", "phish").when(label == "0", "benign").otherwise(label) if normalize else label
    cell = lambda t, g: F.count_if((word == t) & (F.col("prediction") == g))
    counted = rows.agg(cell("phish", "phish").alias("tp"), cell("benign", "phish").alias("fp"), cell("benign", "benign").alias("tn"), cell("phish", "benign").alias("fn"), known.alias("known"))
    return counted.withColumn("accuracy", F.bround(F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("known")), F.lit(0.0)), 4))


def first_of_each(rows: DataFrame, label: str, order: list[Column], most: Column | int, slots: int = 64) -> DataFrame:
    """The first ``most`` rows of each label. Each label is dealt over ``slots`` first, and only what is within the first
    ``most`` of its slot is ranked again: no task ranks a whole label."""
    dealt = rows.withColumn("__slot", F.pmod(F.xxhash64(*order), F.lit(slots)))
    near = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(label, "__slot").orderBy(*order))).where(F.col("__n") <= most)
    return near.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("__n") <= most).drop("__n", "__slot")


def balanced_subsample(rows: DataFrame, per_label: int, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """All rows if there are at most twice ``per_label``, else that many of each label, in draw order.

    The user asks for this limit: it is the operator.
    """
    if rows.limit(2 * per_label + 1).count() <= 2 * per_label:
        return rows
    return first_of_each(rows, label, [draw_order(key, seed), F.col(key)], per_label)


def stratified_pick(urls: DataFrame, status: DataFrame, per_label: dict[str, int], seed: int = 42) -> DataFrame:
    """``per_label`` URLs of each label among those whose html and trace are both ok in (url, feature_type, status)."""
    ready = status.where("status = 'ok' and feature_type in ('html', 'instrumentation')").groupBy("url").agg(F.countDistinct("feature_type").alias("n")).where("n = 2")
    wanted = F.create_map(*[F.lit(x) for pair in per_label.items() for x in pair])
    return first_of_each(urls.join(ready, "url", "left_semi"), "label", [draw_order("url", seed), F.col("url")], F.coalesce(wanted[F.col("label")], F.lit(0)))


def train_val_split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``part``: val for the first max(1, n * share) rows in draw order, else train; all train under ten rows.

    The cut is found from counts of 65,536 hash ranges, so no task ranks all rows.
    """
    n = rows.count()
    if n < 10:
        return rows.withColumn("part", F.lit("train"))
    keyed = rows.withColumn("__key", draw_order(key, seed)).withColumn("__bucket", F.substring("__key", 1, 4))
    wanted = max(1, int(n * share))
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__bucket", before.alias("__before"))  # at most 65,536 rows
    ranked = keyed.join(starts, "__bucket").withColumn("__n", F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", F.col(key))))
    return ranked.withColumn("part", F.when(F.col("__n") <= wanted, "val").otherwise("train")).drop("__key", "__bucket", "__before", "__n")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(benign_weight, phish_weight): each the other class's share; no row if a class is empty."""
    one = rows.agg(F.count_if(is_phish(F.col(label)) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    return one.where("p > 0 and p < n").select(F.bround(F.col("p") / F.col("n"), 6).alias("benign_weight"), F.bround((F.col("n") - F.col("p")) / F.col("n"), 6).alias("phish_weight"))


def training_summary(rows: DataFrame, label: str = "label", extra: str | None = None) -> DataFrame:
    """(rows, phish, benign, with_extra)."""
    phish = is_phish(F.col(label)) == 1
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(phish).alias("phish"), F.count_if(~phish).alias("benign"), (F.count(extra) if extra else F.lit(0)).cast("long").alias("with_extra"))


def metric_table(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row frame of numbers."""
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns])).alias("m")).select("m.*")
