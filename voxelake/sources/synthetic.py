"""Seeded clouds for tests and benchmarks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geodesy
from voxelake.functions.attributes import tagged
from voxelake.operators.xray import isometry


def local_box(spark: SparkSession, count: int, seed: int = 80293751232, half: tuple[float, float, float] = (100.0, 100.0, 10.0)) -> DataFrame:
    """Uniform points in a box around the origin; the colour is the row's number in 24 bits."""
    unit = lambda k: F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), 11) / F.lit(float(1 << 53))
    byte = lambda k: F.shiftright("id", k).bitwiseAND(F.lit(255).cast("long")).cast("short")
    colour = F.struct(byte(16).alias("red"), byte(8).alias("green"), byte(0).alias("blue"))
    axes = [((unit(k) * 2 - 1) * h).alias(c) for k, (c, h) in enumerate(zip("xyz", half, strict=True))]
    return spark.range(count).select(tagged(F.col("id"), "id", "I64"), *axes, tagged(colour, "color", "U8Vec3"))


def frame_of(seed: int) -> tuple[float, float]:
    """A latitude and longitude in radians."""
    r = np.random.default_rng(seed)
    return math.asin(r.uniform(-0.98, 0.98)), r.uniform(-math.pi, math.pi)


def ecef_box(spark: SparkSession, count: int, seed: int = 80293751232) -> DataFrame:
    """The same box standing on the Earth's surface at a place the seed picks."""
    return isometry(local_box(spark, count, seed), np.linalg.inv(geodesy.local_frame(*frame_of(seed))))
