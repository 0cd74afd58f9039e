"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, hot_join


#: Edges beyond which the neighbours of a star's centre are dealt over several tasks; below, one task holds them all.
FEW_EDGES = 1_000_000


def _stars(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """Every node hands its neighbours to the smallest node it knows.

    Large: all neighbours count, larger ones move. Small: only smaller neighbours count and the
    node itself moves along. Edges are (a, b) with a < b, both before and after.
    """
    if large:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    else:
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    least = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    moved = hot_join(ends, least, ["node"], ["other"]) if split else ends.join(least, "node")
    if large:
        out = moved.where("other > node").select(F.col("low").alias("a"), F.col("other").alias("b"))
    else:
        out = moved.select(F.col("low").alias("a"), F.col("other").alias("b")).unionByName(least.select(F.col("low").alias("a"), F.col("node").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its smallest node.

    Stops when a round changes nothing; each round is written to the shared folder. Null ends and
    loops are ignored.
    """
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = cut(plain, "edges")
    mark = None
    for _ in range(max_rounds):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = found
        split = found[0] > FEW_EDGES
        now = cut(_stars(cut(_stars(now, True, split), "edges") if split else _stars(now, True, split), False, split), "edges")
    raise RuntimeError("components did not settle")
