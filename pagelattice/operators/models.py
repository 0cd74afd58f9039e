"""Classifiers over feature rows, on Spark ML, and their ablations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice import constants as C
from pagelattice.functions.urls import clean_number, is_phish
from pagelattice.operators.evaluate import binary_metrics
from pagelattice.operators.perturb import expand_variants
from pagelattice.tables import shared_dir

CATEGORY_SETS = ("C", "S", "B", "CS", "CB", "SB", "CSB")
#: Training rows in one task at least.
ROWS_IN_TASK = 20_000
CLASSIFIERS = ("gbt", "forest", "svm", "mlp")


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel (Rahimi and Recht 2007): a linear machine on them approximates the kernel machine.

    Frequencies come from a seeded generator, so a saved pipeline keeps only the four numbers below.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "length of the input vectors", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width: exp(-gamma * squared distance)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the frequencies", TypeConverters.toInt)

    def __init__(self, inputs: int = 101, size: int = 256, gamma: float | None = None, seed: int = 42):
        super().__init__()
        self._set(inputCol="scaled", outputCol="fourier", inputs=inputs, size=size, gamma=gamma or 1.0 / inputs, seed=seed)

    def _transform(self, rows: DataFrame) -> DataFrame:
        draw = np.random.default_rng(self.getOrDefault(self.seed))
        shape = (self.getOrDefault(self.inputs), self.getOrDefault(self.size))
        w, b = draw.normal(0, (2 * self.getOrDefault(self.gamma)) ** 0.5, shape), draw.uniform(0, 2 * np.pi, shape[1])

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list((2 / shape[1]) ** 0.5 * np.cos(np.stack(x.to_numpy()) @ w + b)))

        return rows.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


def prepared(rows: DataFrame, names: list[str], label: str = "label", drop_unknown: bool = False) -> DataFrame:
    """Cleaned feature columns and a 0/1 ``truth``; labels other than the phish words are 0."""
    if drop_unknown:
        rows = rows.where(F.lower(F.col(label).cast("string")).isin("phish", "phishing", "benign", "0", "1", "true", "false"))
    return rows.withColumns({n: clean_number(F.col(n)) for n in names} | {"truth": is_phish(F.col(label)).cast("double")})


def classifier(name: str, inputs: int, seed: int = 42, trees: int | None = None, depth: int | None = None):
    """Stages after the assembler. gbt: 400 trees of depth 8, rate 0.1; forest: 200 of depth 20; svm: RBF by
    random features; mlp: 128-64. ``trees`` and ``depth`` are lowered for tests."""
    common = {"labelCol": "truth", "seed": seed}
    if name == "gbt":
        return [GBTClassifier(featuresCol="features", maxIter=trees or 400, maxDepth=depth or 8, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9", **common)]
    if name == "forest":
        return [RandomForestClassifier(featuresCol="features", numTrees=trees or 200, maxDepth=depth or 20, **common)]
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    if name == "svm":
        return [scale, RandomFourier(inputs, seed=seed), LinearSVC(featuresCol="fourier", labelCol="truth", maxIter=50, regParam=0.01)]
    if name == "mlp":
        return [scale, MultilayerPerceptronClassifier(featuresCol="scaled", layers=[inputs, 128, 64, 2], maxIter=200, **common)]
    raise ValueError(f"unknown classifier: {name}")


def fit(rows: DataFrame, name: str = "gbt", names: list[str] | None = None, label: str = "label", **options) -> PipelineModel:
    """A fitted pipeline; the feature names live in its assembler."""
    names = list(names or C.FEATURE_NAMES)
    stages = [VectorAssembler(inputCols=names, outputCol="features"), *classifier(name, len(names), **options)]
    ready = prepared(rows, names, label)
    # The tree learner cuts the lineage of its residuals only where the context has a checkpoint folder.
    rows.sparkSession.sparkContext.setCheckpointDir(shared_dir(rows.sparkSession))
    # Each level of each tree is a job over all partitions: few rows go into few of them.
    return Pipeline(stages=stages).fit(ready.coalesce(max(1, ready.count() // ROWS_IN_TASK)))


def predict(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``rows`` with score (probability of phish; for the svm a sigmoid of the margin) and prediction."""
    names = model.stages[0].getInputCols()
    kept = rows.columns
    done = model.transform(rows.withColumns({n: clean_number(F.col(n)) for n in names}).drop("prediction"))
    if "probability" in done.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return done.withColumn("score", score).select(*[c for c in kept if c not in ("score", "prediction")], "score", F.when(F.col("score") >= threshold, "phish").otherwise("benign").alias("prediction"))


def evaluate(model: PipelineModel, rows: DataFrame, label: str = "label") -> DataFrame:
    found = predict(model, rows)
    return binary_metrics(found.select(is_phish(F.col(label)).alias("truth"), is_phish(F.col("prediction")).alias("guess")))


def train_metrics(model: PipelineModel, rows: DataFrame, label: str = "label") -> DataFrame:
    """(train_accuracy, train_f1, rows, positives)."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_phish(F.col(label)) == 1).alias("positives"))
    measured = evaluate(model, rows, label).select(F.col("accuracy").alias("train_accuracy"), F.col("f1").alias("train_f1"))
    return measured.withColumn("k", F.lit(1)).join(one.withColumn("k", F.lit(1)), "k").drop("k")


def category_ablation(train: DataFrame, test: DataFrame, name: str = "gbt", **options) -> DataFrame:
    """Metrics for each of the seven sets of feature categories: seven fits on the same rows."""
    parts = []
    for cats in CATEGORY_SETS:
        names = C.features_of(cats)
        model = fit(train, name, names, **options)
        parts.append(evaluate(model, test).select(F.lit("+".join(cats)).alias("categories"), F.lit(len(names)).alias("n_features"), "*"))
    return reduce(DataFrame.unionByName, parts)


def classifier_ablation(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Metrics of the four classifiers on all features."""
    return reduce(DataFrame.unionByName, [evaluate(fit(train, n, **options), test).select(F.lit(n).alias("classifier"), "*") for n in CLASSIFIERS])


def url_html_model(rows: DataFrame, labels: DataFrame, **options) -> PipelineModel:
    """Boosted trees (100 of depth 5) on the content features; URLs without a label count as benign."""
    joined = rows.join(labels.select("url", F.col("label").alias("__label")).dropDuplicates(["url"]), "url", "left").withColumn("label", F.coalesce("__label", F.lit("benign")))
    return fit(joined, "gbt", C.features_of("C"), **({"trees": 100, "depth": 5} | options))


def score_variants(model: PipelineModel, pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(attack, variant, url, label, score, prediction, status) of every grid cell of pages
    (page_id, url, html, label). The perturbed URL and page are what is scored; a cell without html is missing."""
    from pagelattice.operators.features import feature_row

    grown = expand_variants(pages.withColumnRenamed("page_id", "page")).withColumn("page_id", F.xxhash64("page", "attack", "variant"))
    scored = predict(model, feature_row(grown.select("page_id", "url", "html")), threshold).select("page_id", "score", "prediction")
    clean = pages.select(F.col("page_id").alias("page"), F.col("url").alias("clean_url"))
    joined = grown.join(scored, "page_id", "left").join(clean, "page")
    return joined.select("attack", "variant", F.col("clean_url").alias("url"), "label", "score", "prediction", F.when(F.coalesce("html", F.lit("")) == "", "missing").otherwise("ok").alias("status"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
