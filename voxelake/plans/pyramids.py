"""Whole image pyramids: from points to tiles of all levels, their files, merging and inpainting.

A pyramid's root may be any node of the raster's quadtree; tiles keep their places in the whole raster, so
partial pyramids of one raster fit together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import ids
from voxelake.operators import pyramid, xray
from voxelake.operators.geometry import Aabb, Location
from voxelake.shipping import ship
from voxelake.sources import meta
from voxelake.sources.files import put, store_of
from voxelake.staging import staged

WHITE = (255, 255, 255, 255)
#: Files of tiles that one task writes about.
TILES_A_TASK = 2_000


@dataclass
class Pyramid:
    """``tiles`` (level, tile_x, tile_y, png) of the nodes under ``root``."""

    tiles: DataFrame
    raster: xray.Raster
    root: str = "r"

    def leaves(self) -> DataFrame:
        return self.tiles.where(F.col("level") == self.raster.level)

    def image(self, node: str) -> bytes | None:
        """The PNG of one node; None if it has none."""
        level, x, y = ids.quad_index(node)
        found = self.tiles.where((F.col("level") == level) & (F.col("tile_x") == x) & (F.col("tile_y") == y)).first()
        return bytes(found["png"]) if found else None


def _below(root: str, deepest: int):
    """Condition on (tile_x, tile_y) of the deepest level."""
    level, x, y = ids.quad_index(root)
    if level > deepest:
        raise ValueError("the root lies below the leaves")
    return (F.shiftright("tile_x", deepest - level) == x) & (F.shiftright("tile_y", deepest - level) == y)


def _rolled_up(leaves: DataFrame, raster: xray.Raster, root: str, background: Sequence[int]) -> Pyramid:
    tiles = pyramid.build_levels(pyramid.with_background(leaves, background), raster.level, ids.level(root), raster.tile_px, background)
    return Pyramid(tiles, raster, root)


def build(
    points: DataFrame, box: Aabb, pixel_m: float, strategy: xray.Strategy, tile_px: int = 256, background: Sequence[int] = WHITE, root: str = "r", inpaint_px: int = 0,
    location: Location | None = None, intervals: Mapping[str, tuple[float, float]] | None = None, query_from_global: np.ndarray | None = None,
) -> Pyramid:
    """Sizes the raster, draws the leaves under ``root``, fills their holes and the background, and rolls up."""
    if tile_px < 1 or tile_px & (tile_px - 1):
        raise ValueError("the tile size is a power of two")
    raster = xray.Raster.over(box, pixel_m, tile_px)
    pixels = xray.render(points, raster, box, strategy, location, intervals, query_from_global).where(_below(root, raster.level))
    leaves = staged(pyramid.tile_images(pixels, raster.level, tile_px), "leaves")
    return _rolled_up(pyramid.inpainted(leaves, inpaint_px, tile_px), raster, root, background)


def inpaint(own: Pyramid, d: int, neighbours: Sequence[Pyramid] = (), background: Sequence[int] = WHITE) -> Pyramid:
    """``own`` with holes of its leaves filled, also by what leaves of neighbouring pyramids show, and its
    upper levels built anew. Leaves that already have a background have no holes."""
    if any(n.raster != own.raster for n in neighbours):
        raise ValueError("the pyramids are of different rasters")
    leaves = reduce(DataFrame.unionByName, (p.leaves().select("level", "tile_x", "tile_y", "png") for p in (own, *neighbours)))
    # Of a tile in several pyramids one is enough; only those near own tiles are moved, by the operator itself.
    leaves = leaves.groupBy("level", "tile_x", "tile_y").agg(F.first("png").alias("png")) if neighbours else leaves
    filled = pyramid.inpainted(leaves, d, own.raster.tile_px).where(_below(own.root, own.raster.level))
    return _rolled_up(filled, own.raster, own.root, background)


def merge(parts: Sequence[Pyramid], background: Sequence[int] = WHITE) -> Pyramid:
    """One whole pyramid of partial ones; they must agree on raster, tile size and deepest level."""
    if len({p.raster.tile_px for p in parts}) != 1:
        raise ValueError("the pyramids have different tile sizes")
    if len({p.raster.level for p in parts}) != 1:
        raise ValueError("the pyramids have different deepest levels")
    first = parts[0].raster
    if any(not np.allclose((*p.raster.low, p.raster.edge), (*first.low, first.edge), rtol=1e-12, atol=1e-9 * first.edge) for p in parts):
        raise ValueError("the pyramids are of different rasters")
    return Pyramid(pyramid.merged([p.tiles for p in parts], [p.root for p in parts], first.tile_px, background), first)


def write(own: Pyramid, folder: str) -> int:
    """``<folder>/<node>.png`` for each tile, written by tasks, then the metadata with the names of all nodes;
    gives their number."""
    named = pyramid.node_ids(own.tiles).select("node_id", "png")

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for node, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(store, root, f"{node}.png", png)
            yield batch.select(["node_id"])

    ship(named.sparkSession)
    dealt = named.repartition(max(1, -(-own.tiles.count() // TILES_A_TASK)), "node_id")
    nodes = sorted(r["node_id"] for r in staged(dealt.mapInArrow(save, "node_id string"), "nodes").collect())  # names, which the metadata lists
    level, x, y = ids.quad_index(own.root)
    edge = own.raster.edge / (1 << level)
    low = (own.raster.low[0] + x * edge, own.raster.low[1] + y * edge)
    store, where = store_of(folder)
    store.create_dir(where, recursive=True)
    put(store, where, meta.pyramid_meta_name(own.root), meta.serialise_pyramid(meta.PyramidMeta(low, edge, own.raster.level, own.raster.tile_px, nodes)))
    return len(nodes)


def read(spark: SparkSession, folder: str, root: str = "r") -> Pyramid:
    """The pyramid of a folder with that root. Files that its metadata doesn't name are left out."""
    content = spark.read.format("binaryFile").load(f"{folder}/{meta.pyramid_meta_name(root)}").first()["content"]
    m = meta.parse_pyramid(bytes(content))
    level, x, y = ids.quad_index(root)
    whole = xray.Raster((m.low[0] - x * m.edge, m.low[1] - y * m.edge), m.edge * (1 << level), m.deepest_level, m.tile_size)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    node = F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("node_id")
    named = files.select(node, F.col("content").alias("png")).join(spark.createDataFrame([(n,) for n in m.nodes], "node_id string"), "node_id", "left_semi")
    digits = F.substring("node_id", 2, 64)
    bits = lambda to: F.coalesce(F.conv(F.translate(digits, "0123", to), 2, 10).cast("int"), F.lit(0))
    tiles = named.select((F.length("node_id") - 1).cast("int").alias("level"), bits("0011").alias("tile_x"), bits("0101").alias("tile_y"), "png")
    return Pyramid(tiles, whole, root)
