"""Commands for ``spark-submit``: ``spark-submit -m voxelake.commands build-octree --output <folder> <points.ply>``.

Clouds are folders in this library's own layout, PLY files, folders or patterns, or folders of stored nodes; pyramids are
folders of images with their metadata. All may lie on file systems that Spark and Arrow know."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.operators import build, xray
from voxelake.operators.query import PointQuery, parse_interval, parse_key_value
from voxelake.plans import pyramids
from voxelake.plans.cloud import PointCloud
from voxelake.sources import meta, ply, rawnode
from voxelake.sources.files import put, store_of

BACKGROUNDS = {"white": (255, 255, 255, 255), "transparent": (255, 255, 255, 0)}


def _ply_points(spark: SparkSession, path: str) -> DataFrame:
    return ply.read(spark, path).withColumn("id", F.monotonically_increasing_id())


def _has(spark: SparkSession, folder: str, name: str) -> bool:
    from pyarrow import fs

    store, where = store_of(folder)
    return store.get_file_info(f"{where}/{name}").type != fs.FileType.NotFound


def open_points(spark: SparkSession, location: str) -> DataFrame:
    """Points of a cloud in any of the layouts."""
    if ".ply" in location.rpartition("/")[2]:
        return ply.read(spark, location)
    if _has(spark, location, rawnode.META):
        kind = rawnode._parsed(spark, location)
        return rawnode.read_s2(spark, location).points if kind.cells else rawnode.read_octree(spark, location)
    return PointCloud.open(spark, location).query(PointQuery(None))


def build_octree(spark: SparkSession, a: argparse.Namespace) -> str:
    points = _ply_points(spark, a.input)
    tree = build.build_octree(points, a.resolution, ["id"])
    if a.nodes:
        rawnode.write_octree(tree.points.drop("id"), tree.nodes, tree.box, a.resolution, a.output)
    else:
        PointCloud.of_octree(build.Octree(tree.points.drop("id"), tree.nodes, tree.box, a.resolution)).write(a.output)
    return f"{tree.nodes.count()} nodes"


def build_s2(spark: SparkSession, a: argparse.Namespace) -> str:
    cloud = build.build_s2(ply.read(spark, a.input), a.level)
    if a.nodes:
        rawnode.write_s2(cloud, a.output)
    else:
        PointCloud.of_s2(cloud).write(a.output)
    return f"{cloud.nodes.count()} cells"


def _strategy(a: argparse.Namespace) -> xray.Strategy:
    binning = None
    if a.binning:
        name, size = parse_key_value(a.binning)
        binning = (name, float(size))
    if a.coloring == "colored_with_intensity":
        return xray.Intensity(binning, a.min_intensity, a.max_intensity)
    if a.coloring == "colored_with_height_stddev":
        return xray.HeightStddev(most=a.max_stddev, colormap=a.colormap)
    return xray.Coloured(binning) if a.coloring == "colored" else xray.XRay()


def build_xray(spark: SparkSession, a: argparse.Namespace) -> str:
    points = open_points(spark, a.clouds[0])
    for more in a.clouds[1:]:
        points = points.unionByName(open_points(spark, more))
    intervals = {k: parse_interval(v) for k, v in map(parse_key_value, a.filter_interval)}
    box = build.bounding_box(points)
    made = pyramids.build(
        points, box, a.resolution, _strategy(a), a.tile_size, BACKGROUNDS[a.background], a.root, a.inpaint, intervals=intervals
    )
    return f"{pyramids.write(made, a.output)} tiles"


def merge_xray(spark: SparkSession, a: argparse.Namespace) -> str:
    """The parts are ``folder:root`` each."""
    parts = [pyramids.read(spark, *p.rsplit(":", 1)) for p in a.parts]
    return f"{pyramids.write(pyramids.merge(parts, BACKGROUNDS[a.background]), a.output)} tiles"


def inpaint_xray(spark: SparkSession, a: argparse.Namespace) -> str:
    own = pyramids.read(spark, a.input, a.root)
    near = [pyramids.read(spark, *p.rsplit(":", 1)) for p in a.near]
    return f"{pyramids.write(pyramids.inpaint(own, a.distance, near, BACKGROUNDS[a.background]), a.output)} tiles"


def upgrade(spark: SparkSession, a: argparse.Namespace) -> str:
    """Rewrites the metadata of a stored cloud or pyramid in the current version."""
    content = bytes(spark.read.format("binaryFile").load(f"{a.folder}/{rawnode.META}").first()["content"])
    new = meta.serialise_pyramid(meta.parse_pyramid(content)) if a.pyramid else meta.upgrade(content)
    store, where = store_of(a.folder)
    put(store, where, rawnode.META, new)
    return f"{len(new)} bytes"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxelake", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *needed: str, out: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(n)
        if out:
            p.add_argument("--output", required=True)
        return p

    p = command("build-octree", build_octree, "input")
    p.add_argument("--resolution", type=float, default=0.001)
    p.add_argument("--nodes", action="store_true", help="one file for each node and attribute")
    p = command("build-s2", build_s2, "input")
    p.add_argument("--level", type=int, default=build.DEFAULT_S2_LEVEL)
    p.add_argument("--nodes", action="store_true", help="one file for each cell and attribute")
    p = command("xray", build_xray)
    p.add_argument("clouds", nargs="+")
    p.add_argument("--resolution", type=float, default=0.01)
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--coloring", choices=sorted(xray.STRATEGIES), default="xray")
    p.add_argument("--min-intensity", type=float, default=0.0)
    p.add_argument("--max-intensity", type=float, default=1.0)
    p.add_argument("--colormap", default="jet")
    p.add_argument("--max-stddev", type=float, default=1.0)
    p.add_argument("--filter-interval", action="append", default=[])
    p.add_argument("--binning")
    p.add_argument("--root", default="r")
    p.add_argument("--inpaint", type=int, default=0)
    q = command("merge-xray", merge_xray)
    q.add_argument("parts", nargs="+")
    r = command("inpaint-xray", inpaint_xray, "input")
    r.add_argument("--root", default="r")
    r.add_argument("--distance", type=int, required=True)
    r.add_argument("--near", action="append", default=[])
    for x in (p, q, r):
        x.add_argument("--background", choices=sorted(BACKGROUNDS), default="white")
    p = command("upgrade", upgrade, "folder", out=False)
    p.add_argument("--pyramid", action="store_true")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    return a.run(spark or SparkSession.builder.appName("voxelake").getOrCreate(), a)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
