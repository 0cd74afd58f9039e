"""Reference vectors of brands: lists, pairs, contrastive loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.urls import hash_draw


def reference_list(items: DataFrame) -> DataFrame:
    """(brand, members, n) of benign items (key, brand, label) with a brand."""
    kept = items.where("label = 'benign' and coalesce(brand, '') <> ''")
    return kept.groupBy("brand").agg(F.sort_array(F.collect_list("key")).alias("members"), F.count(F.lit(1)).alias("n"))


def reference_embeddings(items: DataFrame) -> DataFrame:
    """(brand, vectors): each brand's vectors by key."""
    listed = F.sort_array(F.collect_list(F.struct("key", "vector")))
    return items.groupBy("brand").agg(F.transform(listed, lambda x: x["vector"]).alias("vectors"))


def contrastive_pairs(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(slot, a, b, y): n // 2 pairs of one brand (y = 0) and n // 2 of two brands (y = 1), at most 2000 and 50 a brand.

    A slot draws its brand and members by hash from ranked tables: joins on ranks, no self-join of a brand. A brand with one
    member pairs it with itself.
    """
    brands = items.select("brand").distinct().withColumn("b_rank", F.row_number().over(Window.orderBy("brand")) - 1)
    n_brands = brands.count()
    ranked = items.join(brands, "brand").withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy("key")) - 1)
    sizes = ranked.groupBy("b_rank").agg(F.count(F.lit(1)).alias("size"))
    half = min(n, 2000, 50 * n_brands) // 2
    draw = lambda what: hash_draw(F.lit(seed), F.lit(what), F.col("slot"))
    slots = items.sparkSession.range(2 * half).withColumnRenamed("id", "slot").withColumn("y", (F.col("slot") >= half).cast("int"))
    first = F.pmod(draw("a"), F.lit(n_brands))
    step = 1 + F.pmod(draw("b"), F.lit(max(1, n_brands - 1)))
    slots = slots.withColumns({"ab": first, "bb": F.when(F.col("y") == 0, first).otherwise(F.pmod(first + step, F.lit(n_brands)))})
    for side, brand in (("a", "ab"), ("b", "bb")):
        slots = slots.join(sizes.withColumnsRenamed({"b_rank": brand, "size": f"{side}_size"}), brand)
    a_rank = F.pmod(draw("x"), F.col("a_size"))
    other = F.when(F.col("a_size") > 1, F.pmod(a_rank + 1 + F.pmod(draw("z"), F.greatest(F.col("a_size") - 1, F.lit(1))), F.col("a_size"))).otherwise(F.lit(0))
    slots = slots.withColumns({"ar": a_rank, "br": F.when(F.col("y") == 0, other).otherwise(F.pmod(draw("w"), F.col("b_size")))})
    for side, brand in (("a", "ab"), ("b", "bb")):
        slots = slots.join(ranked.select(F.col("b_rank").alias(brand), F.col("rank").cast("long").alias(f"{side}r"), F.col("key").alias(side)), [brand, f"{side}r"])
    return slots.select("slot", "a", "b", "y")


def contrastive_loss(pairs: DataFrame, vectors: DataFrame, margin: float = 1.0) -> DataFrame:
    """(pairs, loss): mean of half the squared distance of equal pairs and half the squared rest of the margin of others."""
    joined = pairs.join(vectors.withColumnsRenamed({"key": "a", "vector": "va"}).select("a", "va"), "a").join(vectors.withColumnsRenamed({"key": "b", "vector": "vb"}).select("b", "vb"), "b")
    gap = F.zip_with("va", "vb", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    d = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v))
    rest = F.greatest(F.lit(0.0), F.lit(margin) - d)
    loss = (1 - F.col("y")) * d * d / 2 + F.col("y") * rest * rest / 2
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.avg(loss).alias("loss"))


def crp_pairs(sites: DataFrame) -> DataFrame:
    """(url, y): the recorded result where there is one, else whether the site is labelled phish."""
    return sites.select("url", F.coalesce(F.col("crp_found"), F.col("label") == "phish").cast("int").alias("y"))
