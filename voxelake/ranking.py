"""Exact positions of rows in an order, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelake.staging import staged


def ranked(df: DataFrame, order: Sequence[str], group: str | None = None, label: str = "ranked") -> DataFrame:
    """Add ``rank``, from 0 in the order of ``order`` within ``group`` (of all rows without one), and ``n``, the
    group's rows.

    Rows are sorted by ranges over all groups and staged, so a group may hold any share of the rows; equal rows
    are parted too. The counts of each partition then say where it begins."""
    keys = [*([group] if group else []), *order, "_tie"]
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    spread = staged(spread.withColumn("_pos", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_pos", 33))
    of = F.col(group) if group else F.lit(0)
    parts = spread.groupBy(of.alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_k"), F.min("_pos").alias("_low"))
    # One row for each group and partition that holds some of it.
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_g", "_p", "_low", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"), F.sum("_k").over(whole).alias("n"))
    joined = spread.join(parts, of.eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("rank", F.col("_start") + F.col("_pos") - F.col("_low")).drop("_pos", "_part", "_g", "_p", "_low", "_start")
