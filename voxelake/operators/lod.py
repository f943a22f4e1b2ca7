"""View-dependent choice of nodes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions import ids
from voxelake.functions.attributes import POSITION
from voxelake.ranking import ranked
from voxelake.staging import staged

from .geometry import IN, OUT, Frustum, perspective_fov


@dataclass(frozen=True)
class Slab:
    """A view of what lies between two planes only, as slices of a body are shown."""

    # Where the planes are at first, and the least depth.
    near: float = 2.0
    far: float = 5.0
    LEAST_DEPTH: ClassVar[float] = 0.5

    def moved(self, by: float) -> Slab:
        """Both planes further away; not behind the eye."""
        return Slab(self.near + by, self.far + by) if self.near + by > 0 else self

    def deepened(self, by: float) -> Slab:
        """The far plane further away."""
        return Slab(self.near, max(self.near + self.LEAST_DEPTH, self.far + by))

    def frustum(self, query_from_eye: np.ndarray, aspect: float = 1.0, fovy: float = math.pi / 4) -> Frustum:
        return Frustum.of_pose(query_from_eye, perspective_fov(aspect, fovy, self.near, self.far))


def screen_size_column(clip: np.ndarray) -> Column:
    """Area of the box around a cube's projected corners, clamped to the screen, over a nodes table (min_*, edge)."""
    m = np.asarray(clip, float)
    sides = ([], [])
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                p = [F.col("min_x") + F.col("edge") * dx, F.col("min_y") + F.col("edge") * dy, F.col("min_z") + F.col("edge") * dz]
                row = lambda k, p=p: p[0] * float(m[k, 0]) + p[1] * float(m[k, 1]) + p[2] * float(m[k, 2]) + float(m[k, 3])
                for k in (0, 1):
                    v = F.coalesce(F.try_divide(row(k), row(3)), F.lit(0.0))
                    sides[k].append(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))
    return (F.greatest(*sides[0]) - F.least(*sides[0])) * (F.greatest(*sides[1]) - F.least(*sides[1]))


def visible_nodes(nodes: DataFrame, clip: np.ndarray) -> DataFrame:
    """rank, node_id, level, num_points and screen_size of the nodes with points in a view, ranked as a best-first
    walk by screen size meets them: the root, then always the largest node whose parent has been met. Nodes outside
    the view are left out with all below them, those below a node inside are inside. ``nodes``: a table as
    :func:`voxelake.operators.build.node_table` gives it, with all ancestors; empty nodes are only passed through.

    The walk is told without a queue. Of two nodes that part below a common ancestor, the one comes first whose
    least ancestor on its own side is larger (the smaller id among equals). A node keeps, for each of its ancestors
    and itself, the least on the way down from there; a sort of those lists is the walk's order. Each level joins
    the frontier's children to it, so only nodes whose parents are in view are met."""
    frustum = Frustum.of_matrix(clip)
    if frustum is None:
        raise ValueError("the projection has no inverse")
    low = [F.col(f"min_{c}") for c in POSITION]
    how = frustum.relation(low, [v + F.col("edge") for v in low])
    # Smaller keys are met earlier.
    key = F.struct((F.lit(0.0) - F.col("screen_size")).alias("size"), F.col("node_id").alias("node"))
    sized = nodes.select("node_id", "level", "num_points", "edge", *(f"min_{c}" for c in POSITION), screen_size_column(clip).alias("screen_size")).withColumn("_key", key)
    told = ["node_id", "level", "num_points", "screen_size", "_walk", "_inside"]
    frontier = staged(sized.where("level = 0").select("*", F.array("_key").alias("_walk"), F.lit(False).alias("_inside")).select(*told), "seen")
    seen = [frontier]
    for level in range(1, ids.MAX_LEVEL + 1):
        parents = frontier.select(F.col("node_id").alias("_parent"), F.col("_walk").alias("_above"), F.col("_inside").alias("_in"))
        children = sized.where(F.col("level") == level).withColumn("_parent", ids.parent_path(F.col("node_id"))).join(parents, "_parent")
        children = children.withColumn("_how", F.when(F.col("_in"), IN).otherwise(how)).where(F.col("_how") != OUT)
        walk = F.array_append(F.transform("_above", lambda w: F.greatest(w, F.col("_key"))), F.col("_key"))
        frontier = staged(children.select("*", walk.alias("_walk"), (F.col("_how") == IN).alias("_inside")).select(*told), "seen")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    found = ranked(every.where("num_points > 0").select(*told[:-1]), ["_walk"], label="walk")
    return found.select(F.col("rank").cast("int").alias("rank"), *told[:-2])


def top_nodes(nodes: DataFrame, clip: np.ndarray, limit: int) -> DataFrame:
    """The largest nodes on screen: a top-k over the nodes table."""
    return nodes.where("num_points > 0").withColumn("screen_size", screen_size_column(clip)).orderBy(F.desc("screen_size"), "node_id").limit(limit)


def next_budget(limit: int, frames_per_second: float) -> int:
    """Fewer nodes below 20 frames a second, more above 25."""
    return int(limit * (0.9 if frames_per_second < 20 else 1.1 if frames_per_second > 25 else 1.0))


def points_at_detail(num_points: Column, detail: int) -> Column:
    return F.ceil(num_points / F.lit(detail)).cast("long")


def random_prefix(points: DataFrame, key: list[str], share: float, seed: int = 42) -> DataFrame:
    """A repeatable sample: the rows whose hashed key lies in the first ``share`` of all values."""
    unit = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return points.where(unit < share)


def up_to_level(points: DataFrame, most: int) -> DataFrame:
    """What is shown while the view moves: nodes whose ids have at most ``most`` characters."""
    return points.where(F.length("node_id") <= most)


def level_for_zoom(pixels: float, tile_size: int, deepest: int) -> int:
    """The first pyramid level at least as wide as the screen asks for."""
    return min(deepest, max(0, math.ceil(math.log2(pixels / tile_size)))) if pixels > tile_size else 0
