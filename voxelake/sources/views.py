"""The driver tables as point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geodesy
from voxelake.functions.attributes import tagged


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cartesian cloud of the lineitem table."""
    t = _read(spark, sf_dir, "lineitem")
    days = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    colour = F.struct(*(c.cast("short").alias(n) for n, c in (("red", F.col("l_partkey") % 256), ("green", F.col("l_suppkey") * 2 % 256), ("blue", F.col("l_linenumber") * 36 % 256))))
    return t.select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"), (days * F.lit(0.04)).alias("z"),
        tagged(colour, "color", "U8Vec3"), tagged(F.col("l_tax") * 100, "intensity", "F32"),
        tagged(F.col("l_orderkey"), "l_orderkey", "I64"), tagged(F.col("l_linenumber"), "l_linenumber", "I32"), tagged(F.col("l_partkey"), "l_partkey", "I64"), tagged(F.col("l_suppkey"), "l_suppkey", "I64"),
    )


def event_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud with a unique id: value, user and hours."""
    t = _read(spark, sf_dir, "events")
    z = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)).cast("double") / F.lit(3600000000.0)
    return t.select(tagged(F.col("event_id"), "event_id", "I64"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), z.alias("z"))


def ecef_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near the Earth's surface, of the orders table."""
    t = _read(spark, sf_dir, "orders")
    lat = F.radians(F.lit(-80) + (F.col("o_custkey") * 37 % 16000) / F.lit(100.0))
    lon = F.radians(F.lit(-180) + (F.col("o_orderkey") * 7919 % 36000) / F.lit(100.0))
    rows = t.select(tagged(F.col("o_orderkey"), "o_orderkey", "I64"), tagged(lat, "lat", "F64"), tagged(lon, "lon", "F64"), tagged(F.col("o_totalprice") / F.lit(1000.0), "h", "F64"))
    x, y, z = geodesy.ecef(F.col("lat"), F.col("lon"), F.col("h"))
    return rows.select("*", x.alias("x"), y.alias("y"), z.alias("z"))


def embedding_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small signed cloud of the first three components."""
    t = _read(spark, sf_dir, "embeddings")
    axis = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t.select(tagged(F.col("vec_id"), "vec_id", "I64"), axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"), tagged(F.col("label"), "label", "I32"))
