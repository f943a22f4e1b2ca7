"""Things that several training-data operators share: staging, bounded samples and table access."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.shipping import ship
from voxelake.staging import shared_dir, staged

__all__ = ["arrow_batches", "hash_sample", "map_arrow", "one_per_key", "scratch", "shared_dir", "staged", "table"]

#: Rows in one Arrow batch; texts differ widely in length, so batches are kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches short enough for whole texts of any usual length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with short batches; ``fn`` takes and gives one RecordBatch."""
    arrow_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows whose hashed ``key`` is among the ``bound`` smallest.

    Only the key column is read to find the limit; the sample is the same on every run.
    """
    h = F.xxhash64(F.col(key))
    top = df.select(h.alias("h")).orderBy("h").limit(bound).agg(F.max("h").alias("h")).first()
    if top is None or top["h"] is None:
        return df.limit(0)
    return df.where(h <= F.lit(top["h"])).limit(bound)


def one_per_key(df: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """(key, text) of the ``bound`` keys with the smallest hashes, and of each the text with the smallest hash: the
    same on every run, however the rows come, and a key of many rows counts once."""
    h = F.xxhash64(F.col(key))
    many = df.agg(F.approx_count_distinct(h, 0.02)).first()[0] or 0
    # Enough keys for the bound even where the estimate is off; their number doesn't grow with the table.
    share = 1.5 * bound / max(many, 1)
    near = df if share >= 1 else df.where(h <= F.lit(int(-(1 << 63) + share * (1 << 64))))
    keys = near.select(h.alias("h")).distinct().orderBy("h").limit(bound)
    last = keys.agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return df.select(key, text).limit(0)
    first = F.min_by(F.col(text), F.struct(F.xxhash64(F.col(text)), F.col(text)))
    return near.where(h <= F.lit(last)).groupBy(key).agg(first.alias(text))
