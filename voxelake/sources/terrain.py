"""Sparse terrain grids: ``meta.json`` and tiles of heights and colours, as rows of grid cells.

Tile files are named ``x%08d_y%08d.height`` (pairs of float32) and ``.color`` (RGBA bytes)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.shipping import ship

CHANNELS = ("red", "green", "blue", "alpha")


def read_meta(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/meta.json", wholetext=True).first()[0])


def write_meta(spark: SparkSession, folder: str, meta: dict) -> None:
    """As one JSON line in a folder of that name."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")


def _tiles(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)
    place = [F.regexp_extract("path", rf"/x(-?\d+)_y(-?\d+)\.{kind}$", k).cast("long").alias(c) for k, c in ((1, "tile_x"), (2, "tile_y"))]
    return files.select(*place, F.col("content").alias(kind))


def read_tiles(spark: SparkSession, folder: str, tile_size: int, tiles: tuple[int, int, int, int] | None = None) -> DataFrame:
    """grid_x, grid_y, height, quads, color: one row for each cell of each tile; ``tiles`` (first x, first y, last x, last y):
    those that are wanted. Heights and colours of a tile are joined by its place; a tile without colours has none."""
    ship(spark)
    heights, colours = _tiles(spark, folder, "height"), _tiles(spark, folder, "color")
    if tiles is not None:
        wanted = F.col("tile_x").between(tiles[0], tiles[2]) & F.col("tile_y").between(tiles[1], tiles[3])
        heights, colours = heights.where(wanted), colours.where(wanted)
    rows = heights.join(colours, ["tile_x", "tile_y"], "left")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tile in frame.itertuples():
                data = np.frombuffer(tile.height, "<f4").reshape(tile_size, tile_size, 2)
                rgba = None if tile.color is None else np.frombuffer(tile.color, np.uint8).reshape(-1, 4)
                y, x = np.mgrid[0:tile_size, 0:tile_size]
                out = {"grid_x": tile.tile_x * tile_size + x.ravel(), "grid_y": tile.tile_y * tile_size + y.ravel()}
                out |= {"height": data[..., 0].ravel().astype(float), "quads": data[..., 1].ravel().astype(float)}
                for k, c in enumerate(CHANNELS):
                    out[c] = [None] * (tile_size * tile_size) if rgba is None else rgba[:, k].astype(np.int32)
                yield pd.DataFrame(out)

    found = rows.mapInPandas(cells, "grid_x long, grid_y long, height double, quads double, " + ", ".join(f"{c} int" for c in CHANNELS))
    colour = F.when(F.col("red").isNotNull(), F.struct(*CHANNELS)).alias("color")
    return found.select("grid_x", "grid_y", "height", "quads", colour)


def region(spark: SparkSession, folder: str, tile_size: int, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Every cell of a rectangle, from the tiles that it meets; cells of missing tiles are 0, also their colours.

    The rectangle is told by tiles: each is looked up once and cut, and only missing ones are made."""
    first, last = (x0 // tile_size, y0 // tile_size), ((x0 + width - 1) // tile_size, (y0 + height - 1) // tile_size)
    inside = F.col("grid_x").between(x0, x0 + width - 1) & F.col("grid_y").between(y0, y0 + height - 1)
    found = read_tiles(spark, folder, tile_size, (*first, *last))
    wide = last[0] - first[0] + 1
    asked = spark.range(wide * (last[1] - first[1] + 1)).select((F.col("id") % wide + first[0]).alias("tile_x"), (F.floor(F.col("id") / wide) + first[1]).cast("long").alias("tile_y"))
    missing = asked.join(_tiles(spark, folder, "height").select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_anti")
    line = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(tile_size - 1)), lambda k: F.col(f"tile_{c}") * tile_size + k)).alias(f"grid_{c}")
    zero = F.lit(0.0)
    empty = missing.select("tile_y", line("x")).select("grid_x", line("y")).select("grid_x", "grid_y", zero.alias("height"), zero.alias("quads"), F.lit(None).cast(found.schema["color"].dataType).alias("color"))
    black = F.struct(*(F.lit(0).alias(c) for c in CHANNELS))
    return found.unionByName(empty).where(inside).withColumn("color", F.coalesce("color", black))


def vertices(cells: DataFrame, origin: tuple[float, float, float], resolution: float, terrain_to_world: np.ndarray | None = None) -> DataFrame:
    """World metres, opaque colour and quads of each cell: the grid in the terrain's frame, moved by the frame's place in
    the world (4 x 4)."""
    m = np.eye(4) if terrain_to_world is None else np.asarray(terrain_to_world, float)
    own = [F.col("grid_x") * resolution + origin[0], F.col("grid_y") * resolution + origin[1], F.col("height") + origin[2]]
    world = [(own[0] * float(m[k, 0]) + own[1] * float(m[k, 1]) + own[2] * float(m[k, 2]) + float(m[k, 3])).alias(c) for k, c in enumerate("xyz")]
    rest = [F.col("color").withField("alpha", F.lit(255)).alias("color")] if "color" in cells.columns else []
    return cells.select("grid_x", "grid_y", *world, "quads", *rest)
