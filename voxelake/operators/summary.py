"""A summary tree over a table of nodes, so that a query reads the nodes near its location and not all of them.

Nodes are put in the order of their keys (paths of an octree, cells along the S2 curve), which keeps neighbours
together. Every FAN consecutive ones are a block, every FAN blocks a block of the tier above, up to at most FAN at
the top. A block has the box around what it holds and its points. Each tier is stored in the order of its blocks,
and a query goes down from the top: of a tier it reads only the blocks below those that the location meets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions.attributes import POSITION
from voxelake.ranking import ranked
from voxelake.staging import staged

from .geometry import IN, OUT, Location, box_columns

#: Members of a block.
FAN = 64
#: Rows of a page of a stored tier: pages without a wanted block are skipped.
PAGE_ROWS = 2048
#: Blocks of a tier up to this many are an IN list, which skips pages; more are joined.
INLINE_BLOCKS = 1000
#: Met blocks up to so many are broadcast, by their count.
BROADCAST_BLOCKS = 1_000_000
_BOX = [f"{e}_{c}" for e in ("min", "max") for c in POSITION]


def _box_around() -> list[Column]:
    return [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _BOX]


@dataclass
class Summary:
    """``tiers``: from the top, tables of block, parent, box, num_points and members; ``nodes`` with their block."""

    tiers: list[DataFrame]
    nodes: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, key: str) -> Summary:
        """Of the nodes with points of a table with ``key``, num_points and boxes."""
        placed = ranked(nodes.where("num_points > 0"), [key], label="summary")
        total = placed.agg(F.max("n")).first()[0] or 0
        nodes = placed.withColumn("parent", F.expr(f"rank div {FAN}")).drop("rank", "n")
        tiers, below, size = [], nodes, -(-total // FAN)
        while size > 0:
            block = F.col("parent").alias("block")
            tier = below.groupBy(block).agg(*_box_around(), F.sum("num_points").alias("num_points"), F.count(F.lit(1)).cast("int").alias("members"))
            below = staged(tier.withColumn("parent", F.expr(f"block div {FAN}")), "tier")
            tiers.insert(0, below)
            if size <= FAN:
                break
            size = -(-size // FAN)
        return cls(tiers, nodes)

    def write(self, path: str) -> None:
        """Each tier and the nodes in the order of their blocks, in small pages."""

        def save(df: DataFrame, name: str, *order: str) -> None:
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/{name}")

        for k, tier in enumerate(self.tiers):
            save(tier, f"tier={k}", "block")
        save(self.nodes, "nodes", "parent")

    @classmethod
    def open(cls, spark: SparkSession, path: str, tiers: int) -> Summary:
        return cls([spark.read.parquet(f"{path}/tier={k}") for k in range(tiers)], spark.read.parquet(f"{path}/nodes"))

    def related(self, location: Location, key: str) -> DataFrame:
        """``key``, ``inside`` of the nodes that a location meets, tier by tier from the top."""
        how = location.relation(*box_columns())
        met: DataFrame | None = None
        for tier in self.tiers:
            met = staged(_told(tier, met, how).select("block", "inside"), "met")
        return _told(self.nodes, met, how).select(key, "inside")


def _told(rows: DataFrame, met: DataFrame | None, how: Column) -> DataFrame:
    """Of the rows below the blocks in ``met``, those that aren't outside; below a block inside all are inside."""
    if met is None:
        rows = rows.withColumn("_whole", F.lit(False))
    else:
        few = met.limit(INLINE_BLOCKS + 1).collect()
        if len(few) <= INLINE_BLOCKS:
            whole = [r["block"] for r in few if r["inside"]]
            rows = rows.where(F.col("parent").isin([r["block"] for r in few])).withColumn("_whole", F.col("parent").isin(whole))
        else:
            above = met.select(F.col("block").alias("parent"), F.col("inside").alias("_whole"))
            rows = rows.join(F.broadcast(above) if met.count() <= BROADCAST_BLOCKS else above, "parent")
    told = rows.withColumn("_how", F.when(F.col("_whole"), IN).otherwise(how)).where(F.col("_how") != OUT)
    return told.withColumn("inside", F.col("_how") == IN).drop("_whole", "_how")
