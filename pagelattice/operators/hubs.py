"""Vertex cut: the rows of a node with very many edges are dealt over slots, and the node's state is mirrored in each.

A join of node states with edges then puts no more of a hub's edges into one task than of many small nodes together; sums over a hub's
edges are formed by slot first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.tables import cut

#: Rows of a node in one slot at least, and hubs at most. With more rows than their product, slots get larger instead, so
#: the table of hubs can always be broadcast.
SLOT_ROWS, MOST_HUBS = 20_000, 1_000_000


class VertexCut:
    """``rows`` (an edge table) dealt by ``key`` (the columns of a node) and slot; ``spread`` names the columns that deal a hub's rows."""

    def __init__(self, rows: DataFrame, key: list[str], spread: list[str], slot_rows: int | None = None):
        self.key = key
        counted = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), "degrees")
        most = slot_rows or SLOT_ROWS
        total = counted.agg(F.sum("__n")).first()[0] or 0
        most = max(most, -(-total // MOST_HUBS))
        self.hubs = cut(counted.where(F.col("__n") > most).select(*key, F.ceil(F.col("__n") / most).cast("int").alias("__slots")), "hubs")
        self.any = not self.hubs.isEmpty()
        self.rows = self.placed(rows, spread)

    def placed(self, rows: DataFrame, spread: list[str], names: dict[str, str] | None = None, slot: str = "slot") -> DataFrame:
        """Rows with the slot that they have among those of their node; ``names`` says which of their columns hold the key, if others."""
        if not self.any:
            return rows.withColumn(slot, F.lit(0))
        names = names or {}
        value = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__slots")), F.lit(0)).cast("int")
        return rows.join(F.broadcast(self.hubs.withColumnsRenamed(names)), [names.get(k, k) for k in self.key], "left").withColumn(slot, value).drop("__slots")

    def mirrored(self, states: DataFrame) -> DataFrame:
        """A state for each slot of its node."""
        if not self.any:
            return states.withColumn("slot", F.lit(0))
        slots = F.sequence(F.lit(0), F.coalesce(F.col("__slots") - 1, F.lit(0)))
        return states.join(F.broadcast(self.hubs), self.key, "left").withColumn("slot", F.explode(slots)).drop("__slots")

    def met(self, states: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """``states`` joined with the rows (or others dealt like them) of their nodes; the slot is left out. Written tables are many times
        larger in memory than their files, from which Spark would judge them small: neither side is broadcast."""
        return self.mirrored(states).join((self.rows if rows is None else rows).hint("merge"), [*self.key, "slot"]).drop("slot")
