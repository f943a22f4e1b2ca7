"""Point clouds: indexed points with their nodes, and queries that read only the nodes they need."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import ids
from voxelake.functions.attributes import POSITION
from voxelake.operators import build
from voxelake.operators.geometry import IN, OUT, Aabb, CellUnion, Cube, Location, box_columns
from voxelake.operators.query import PointQuery, within
from voxelake.operators.summary import FAN, Summary
from voxelake.staging import staged
from voxelake.streaming.delivery import POINTS_PER_BATCH, for_each_batch

#: Node ids up to this many are an IN list, which skips row groups; more are joined.
INLINE_NODES = 1000
#: What an index adds to the attributes.
INDEX_COLUMNS = ("node_id", "level", "cell", "leaf")


@dataclass
class PointCloud:
    """``nodes`` has a row for each node: ``key``, num_points and its box (min_*, max_*). ``summary``: a tree over
    them, which stored clouds have."""

    points: DataFrame
    nodes: DataFrame
    key: str
    box: Aabb
    summary: Summary | None = None

    @classmethod
    def of_octree(cls, tree: build.Octree) -> PointCloud:
        high = [(F.col(f"min_{c}") + F.col("edge")).alias(f"max_{c}") for c in POSITION]
        return cls(tree.points, tree.nodes.select("*", *high), "node_id", tree.box)

    @classmethod
    def of_s2(cls, cloud: build.S2Cloud) -> PointCloud:
        return cls(cloud.points, cloud.nodes, "cell", cloud.box)

    def write(self, path: str) -> None:
        """Points clustered by node, the nodes table, the box and, where a query would go down it, the summary tree."""
        build.write_clustered(self.points, f"{path}/points", self.key)
        self.nodes.write.parquet(f"{path}/nodes")
        tree = self.summary
        if tree is None and self.nodes.where("num_points > 0").count() > FAN**2:
            tree = Summary.of(self.nodes, self.key)
        if tree is not None:
            tree.write(f"{path}/summary")
        meta = [(self.key, json.dumps([self.box.low, self.box.high]), len(tree.tiers) if tree is not None else None)]
        self.points.sparkSession.createDataFrame(meta, "key string, box string, tiers int").coalesce(1).write.json(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PointCloud:
        """Clouds of few nodes have no summary tree."""
        meta = spark.read.schema("key string, box string, tiers int").json(f"{path}/meta").first()
        low, high = json.loads(meta["box"])
        tree = Summary.open(spark, f"{path}/summary", meta["tiers"]) if meta["tiers"] is not None else None
        return cls(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/nodes"), meta["key"], Aabb(tuple(low), tuple(high)), tree)

    def _near(self, location: Location) -> DataFrame:
        """The nodes with points whose boxes meet the location's bounds: comparisons that the scan can use."""
        nodes = self.nodes.where("num_points > 0")
        for c, low, high in zip(POSITION, *bounds, strict=True) if (bounds := location.bounds()) is not None else ():
            nodes = nodes.where((F.col(f"min_{c}") <= float(high)) & (F.col(f"max_{c}") >= float(low)))
        return nodes

    def related(self, location: Location) -> DataFrame:
        """``key``, ``inside`` of the nodes with points that the location meets: down the summary tree where there is
        one of several tiers, else by a filter of the nodes table."""
        if self.summary is not None and len(self.summary.tiers) > 1:
            return self.summary.related(location, self.key)
        told = self._near(location).select(self.key, location.relation(*box_columns()).alias("_how"))
        return told.where(F.col("_how") != OUT).select(self.key, (F.col("_how") == IN).alias("inside"))

    def nodes_in(self, location: Location) -> tuple[list, list] | None:
        """(inside, crossing) node keys; None if there are more than INLINE_NODES."""
        few = self.related(location).limit(INLINE_NODES + 1).collect()
        if len(few) > INLINE_NODES:
            return None
        # A half-open box may leave out points on its upper faces, so only boxes well inside skip the test.
        return [r[0] for r in few if r["inside"]], [r[0] for r in few if not r["inside"]]

    def query(self, query: PointQuery, prune: bool = True) -> DataFrame:
        """Rows of the nodes inside, and of the crossing ones those that pass the test."""
        wanted = query.check(self.points.drop(*INDEX_COLUMNS))
        points = self.points
        if isinstance(query.location, CellUnion) and "leaf" in points.columns:
            test = query.location.contains_leaf(F.col("leaf"))  # ranges of the stored leaf, which the scan can use
        else:
            test = query.location.contains(*(F.col(c) for c in POSITION))
        if prune:
            if (bounds := query.location.bounds()) is not None:
                # Comparisons with literals reach the scan; the test itself may be more than that.
                for c, a, b in zip(POSITION, *bounds, strict=True):
                    points = points.where((F.col(c) >= float(a)) & (F.col(c) <= float(b)))
            key, told = F.col(self.key), self.nodes_in(query.location)
            if told is None:
                met = staged(self.related(query.location).select(self.key), "met")
                few = met.count() <= build.BROADCAST_NODES
                points = points.join(F.broadcast(met) if few else met, self.key, "left_semi")
            else:
                inside, cross = told
                found = F.lit(False)
                if cross:
                    found = key.isin(cross) & test
                if inside:
                    found = found | (key.isin(inside) & self._within(query.location, test))
                test = found
        for name, (low, high) in query.intervals.items():
            test = test & within(F.col(name), low, high)
        return points.where(test).select(*POSITION, *wanted)

    @staticmethod
    def _within(location: Location, test):
        """Nodes inside need no test, but where the location is open or half-open on its faces."""
        from voxelake.operators.geometry import AllPoints, Obb

        return F.lit(True) if isinstance(location, (AllPoints, Obb)) else test

    def num_points(self) -> int:
        return self.nodes.agg(F.sum("num_points")).first()[0] or 0

    def node(self, key) -> DataFrame:
        return self.points.where(F.col(self.key) == key)

    def root_cube(self) -> Cube:
        return Cube.around(self.box)

    def up_to_level(self, level: int) -> DataFrame:
        """A sample: the points of the first levels of an octree."""
        return self.points.where(ids.path_level(F.col("node_id")) <= level)


@dataclass
class Client:
    """Several clouds as one."""

    clouds: Sequence[PointCloud]
    points_per_batch: int = POINTS_PER_BATCH

    def __post_init__(self) -> None:
        if not self.clouds:
            raise ValueError("no point cloud")
        if len({c.key for c in self.clouds}) != 1:
            raise ValueError("the clouds are of different kinds")

    @property
    def box(self) -> Aabb:
        return reduce(Aabb.union, (c.box for c in self.clouds))

    def query(self, query: PointQuery) -> DataFrame:
        """Rows of all clouds with ``cloud_id``."""
        return reduce(DataFrame.unionByName, (c.query(query).withColumn("cloud_id", F.lit(k)) for k, c in enumerate(self.clouds)))

    def for_each(self, query: PointQuery, callback: Callable[[pa.RecordBatch], object]) -> int:
        return for_each_batch(self.query(query), callback, self.points_per_batch)


class Providers:
    """Openers by the beginning of a location; the longest beginning wins. A location without one is opened by
    ``default``, as a cloud on Spark's file systems if not given; :func:`voxelake.plans.pyramids.read` makes it
    a registry of pyramids."""

    def __init__(self, default: Callable[[SparkSession, str], object] | None = None) -> None:
        self._openers: dict[str, Callable[[SparkSession, str], object]] = {}
        self._default = default or PointCloud.open

    def register(self, prefix: str, opener: Callable[[SparkSession, str], object]) -> Providers:
        self._openers[prefix] = opener
        return self

    def open(self, spark: SparkSession, location: str):
        fits = [p for p in self._openers if location.startswith(p)]
        return (self._openers[max(fits, key=len)] if fits else self._default)(spark, location)
