"""Times the headline queries; prints one JSON line.

Catalogue queries run over BENCH_SF_DIR; those of stored clouds build theirs where the first asks for it, and
lists: a seeded box of points, indexed once, then asked by box, frustum, oriented box and cells."""

from __future__ import annotations

import json
import os
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

from voxelake import catalogue, catalogue_nodes
from voxelake.operators import build
from voxelake.operators.geometry import Aabb, AllPoints, CellUnion, Frustum, Obb, perspective_fov
from voxelake.operators.query import PointQuery
from voxelake.plans.cloud import PointCloud
from voxelake.sources import synthetic

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
POINTS = int(os.environ.get("BENCH_POINTS", "1000000"))


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def index_cases(spark: SparkSession, folder: str) -> dict[str, float]:
    out: dict[str, float] = {}

    def build_case(name: str, make, path: str) -> PointCloud:
        began = time.time()
        make().write(f"file://{folder}/{path}")
        out[name] = time.time() - began
        return PointCloud.open(spark, f"file://{folder}/{path}")

    local, ecef = synthetic.local_box(spark, POINTS // 10), synthetic.ecef_box(spark, POINTS // 10)
    octree = lambda p: PointCloud.of_octree(build.build_octree(p, 0.001, ["id"]))
    build_case("octree_building", lambda: octree(local), "small_octree")
    build_case("s2_building", lambda: PointCloud.of_s2(build.build_s2(ecef, 20)), "small_s2")
    clouds = {
        "octree": build_case("octree_building_full", lambda: octree(synthetic.ecef_box(spark, POINTS)), "octree"),
        "s2": build_case("s2_building_full", lambda: PointCloud.of_s2(build.build_s2(synthetic.ecef_box(spark, POINTS), 20)), "s2"),
    }
    box = clouds["octree"].box
    low, d = np.array(box.low), box.diagonal
    eye = np.eye(4)
    eye[:3, 3] = low + d * [0.5, 0.5, 1.0]
    cells = [int(r["cell"]) & (1 << 64) - 1 for r in clouds["s2"].nodes.orderBy("num_points", "cell").select("cell").limit(2).collect()]
    asked = {
        "all": AllPoints(),
        "box": Aabb(tuple(map(float, low + 0.2 * d)), tuple(map(float, low + 0.8 * d))),
        "frustum": Frustum.of_pose(eye, perspective_fov(1.0, 1.2, 0.1, 10.0 + float(d.max()))),
        "obb": Obb.of_box(Aabb(tuple(map(float, low + 0.25 * d)), tuple(map(float, low + 0.75 * d)))),
        "cell_union": CellUnion(tuple(cells)),
    }
    for what, location in asked.items():
        for kind, cloud in clouds.items():
            query = PointQuery(["color"], location)
            timed(cloud.query(query))
            out[f"{what}_query_{kind}"] = timed(cloud.query(query))
    return out


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, query in (catalogue.queries() | catalogue_nodes.queries()).items():
        query(spark, SF_DIR).limit(1).count() if name == "all_points" else None  # the session's first job
        began = time.time()
        df = query(spark, SF_DIR)
        planned = time.time() - began
        out[name] = planned + timed(df)
    out |= index_cases(spark, folder)
    out = {k: round(v, 3) for k, v in out.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
