"""Top-down raster aggregation: points grouped by tile and pixel, coloured by a strategy.

One pass over the points: tiles are part of the grouping key, never separate queries."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions import colour
from voxelake.functions.attributes import POSITION

from .geometry import Aabb, AllPoints, Location

# Fixed value: height buckets of the density strategy.
Z_BUCKETS = 1024


def isometry(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Positions after p' = R p + t (4 x 4): three linear expressions."""
    m = np.asarray(matrix, float)
    x, y, z = (F.col(c) for c in POSITION)
    moved = {c: x * float(m[k, 0]) + y * float(m[k, 1]) + z * float(m[k, 2]) + float(m[k, 3]) for k, c in enumerate(POSITION)}
    return points.withColumns(moved)


def saturated(v: Column, top: int) -> Column:
    """Truncated integer in [0, top]; NaN and null give 0."""
    clean = F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), clean))).cast("int")


def share(v: Column, low: float, extent: float) -> Column:
    """Place on an axis from 0 to 1; 0 if the axis has no extent."""
    return F.coalesce(F.try_divide(v - low, F.lit(float(extent))), F.lit(0.0))


def discretised(points: DataFrame, box: Aabb, width: int, height: int) -> DataFrame:
    """px, py, pz of each point in an image over ``box``; y points up in the world and down in the image,
    so a point on the lower edge has py = height and no pixel."""
    dx, dy, dz = map(float, box.diagonal)
    top = 2**31 - 1
    return points.withColumns({
        "px": saturated(share(F.col("x"), box.low[0], dx) * width, top),
        "py": saturated((F.lit(1.0) - share(F.col("y"), box.low[1], dy)) * height, top) if dy > 0 else F.lit(0),
        "pz": saturated(share(F.col("z"), box.low[2], dz) * Z_BUCKETS, top),
    })


def bin_of(attribute: str | None, size: float | None) -> Column:
    """Bin of an attribute, truncated towards zero; a single bin without one."""
    if attribute is None or not size:
        return F.lit(0).cast("long")
    v = F.col(attribute).cast("double") / float(size)
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")


@dataclass(frozen=True)
class Strategy:
    """How a pixel is coloured from its points; gives red, green, blue, alpha bytes for each key."""

    binning: tuple[str, float] | None = None

    def attributes(self) -> list[str]:
        return [self.binning[0]] if self.binning else []

    def pixels(self, points: DataFrame, key: list[str]) -> DataFrame:
        raise NotImplementedError

    def _binned(self, points: DataFrame, key: list[str], means: Mapping[str, Column]) -> DataFrame:
        """Means of bin means: bins weigh the same however many points they have."""
        binned = points.withColumn("_bin", bin_of(*(self.binning or (None, None))))
        inner = binned.groupBy(*key, "_bin").agg(*(F.avg(c).alias(n) for n, c in means.items()))
        return inner.groupBy(*key).agg(*(F.avg(n).alias(n) for n in means))


def _pixel(rgb, key: list[str]) -> list[Column]:
    return [*map(F.col, key), *(c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)), F.lit(255).alias("alpha")]


@dataclass(frozen=True)
class XRay(Strategy):
    """The more height buckets are filled, the darker."""

    def pixels(self, points: DataFrame, key: list[str]) -> DataFrame:
        n = points.groupBy(*key).agg(F.countDistinct("pz").alias("n"))
        grey = colour.to_byte(F.round(F.lit(1.0) - F.ln(F.col("n").cast("double")) / F.lit(float(np.log(Z_BUCKETS))), 9))
        return n.select(*_pixel([grey] * 3, key))


@dataclass(frozen=True)
class Coloured(Strategy):
    """Mean colour."""

    def attributes(self) -> list[str]:
        return ["color", *super().attributes()]

    def pixels(self, points: DataFrame, key: list[str]) -> DataFrame:
        mean = self._binned(points, key, {c: F.col(f"color.{c}").cast("double") for c in ("red", "green", "blue")})
        return mean.select(*_pixel([F.floor(F.round(c, 6)).cast("int") for c in ("red", "green", "blue")], key))


@dataclass(frozen=True)
class Intensity(Strategy):
    """Grey by the logarithm of the mean intensity between two bounds; negative points are left out.
    Where the logarithm of the range is 0 or less than nothing is left, the pixel is black."""

    low: float = 0.0
    high: float = 1.0

    def attributes(self) -> list[str]:
        return ["intensity", *super().attributes()]

    def pixels(self, points: DataFrame, key: list[str]) -> DataFrame:
        usable = points.where((F.col("intensity") >= 0) & ~F.isnan("intensity"))
        mean = self._binned(usable, key, {"i": F.col("intensity").cast("double")})
        v = F.greatest(F.lit(self.low), F.least(F.lit(self.high), F.col("i"))) - self.low
        span = float(np.log(self.high - self.low)) if self.high > self.low else 0.0
        grey = colour.to_byte(F.round(F.when(v > 0, F.ln(v)) / F.lit(span), 9)) if span else F.lit(0)
        return mean.select(*_pixel([grey] * 3, key))


@dataclass(frozen=True)
class HeightStddev(Strategy):
    """Population standard deviation of heights over a maximum, through a colormap."""

    most: float = 1.0
    colormap: str = "jet"

    def pixels(self, points: DataFrame, key: list[str]) -> DataFrame:
        s = points.groupBy(*key).agg(F.round(F.stddev_pop("z"), 6).alias("s"))
        rgb = colour.COLORMAPS[self.colormap](F.least(F.col("s"), F.lit(self.most)) / F.lit(self.most))
        return s.select(*_pixel([colour.to_byte(F.round(c, 9)) for c in rgb], key))


STRATEGIES = {"xray": XRay, "colored": Coloured, "colored_with_intensity": Intensity, "colored_with_height_stddev": HeightStddev}


@dataclass(frozen=True)
class Raster:
    """A square of ``tile_px`` * 2^``level`` pixels, in tiles."""

    low: tuple[float, float]
    edge: float
    level: int
    tile_px: int = 256

    @property
    def tiles(self) -> int:
        return 1 << self.level

    @classmethod
    def over(cls, box: Aabb, pixel_m: float, tile_px: int = 256) -> Raster:
        """The smallest one that covers the box."""
        tile, longest = tile_px * pixel_m, float(max(box.diagonal[:2]))
        level = max(0, math.ceil(math.log2(longest / tile))) if longest > 0 else 0
        level += math.ldexp(tile, level) < longest  # where the logarithm was rounded down
        return cls((box.low[0], box.low[1]), math.ldexp(tile, level), level, tile_px)


def rasterised(points: DataFrame, raster: Raster, box: Aabb) -> DataFrame:
    """tile_x, tile_y of each point, and px, py, pz inside its tile. Heights run over the whole box."""
    side = raster.edge / raster.tiles
    tile = lambda c, low: F.greatest(F.lit(0), F.least(F.lit(raster.tiles - 1), F.floor((F.col(c) - low) / side))).cast("int")
    t = points.withColumns({"tile_x": tile("x", raster.low[0]), "tile_y": tile("y", raster.low[1])})
    fx = (F.col("x") - raster.low[0]) / side - F.col("tile_x")
    fy = (F.col("y") - raster.low[1]) / side - F.col("tile_y")
    top = 2**31 - 1
    return t.withColumns({
        "px": saturated(fx * raster.tile_px, top),
        "py": saturated((F.lit(1.0) - fy) * raster.tile_px, top),
        "pz": saturated(share(F.col("z"), box.low[2], float(box.diagonal[2])) * Z_BUCKETS, top),
    })


KEY = ["tile_x", "tile_y", "px", "py"]


def render(points: DataFrame, raster: Raster, box: Aabb, strategy: Strategy, location: Location | None = None, intervals: Mapping[str, tuple[float, float]] | None = None, query_from_global: np.ndarray | None = None) -> DataFrame:
    """Pixels of all tiles: tile_x, tile_y, px, py, red, green, blue, alpha. Untouched pixels and tiles
    without points have no rows."""
    from .query import within

    if query_from_global is not None:
        points = isometry(points, query_from_global)
    where = (location or AllPoints()).contains(*(F.col(c) for c in POSITION))
    for name, (low, high) in (intervals or {}).items():
        where = where & within(F.col(name), low, high)
    own = points.where(where).select(*POSITION, *dict.fromkeys(strategy.attributes()))
    rows = rasterised(own, raster, box)
    return strategy.pixels(rows.where((F.col("px") < raster.tile_px) & (F.col("py") < raster.tile_px)), KEY)


def touched_tiles(points: DataFrame, raster: Raster, box: Aabb) -> DataFrame:
    """Tiles that hold a point, also one that has no pixel."""
    return rasterised(points.select(*POSITION), raster, box).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("num_points"))
