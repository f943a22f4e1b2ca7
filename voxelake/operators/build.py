"""Index builds: the level-of-detail octree and the S2 partition.

The octree stores each point once: of a node's points an eighth moves up to its parent, so the points of
the first levels are a sample of the cloud and those of all levels are the cloud."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.functions import codec, geodesy, ids, s2
from voxelake.functions.attributes import POSITION
from voxelake.ranking import ranked
from voxelake.staging import staged

from .geometry import Aabb, Cube

# Points of a node that isn't split, and the share that moves up.
MAX_POINTS_PER_NODE, SAMPLE = 100_000, 8
DEFAULT_S2_LEVEL = 20
#: Rows of a node that one window numbers: only nodes that the resolution keeps from splitting can be larger; their rows
#: are ranked over ranges of the order.
CELL_ROWS = 2 * MAX_POINTS_PER_NODE
#: Levels that one pass over the points counts, and that one join tells a point's way through.
STEP = 3
#: Tables of nodes up to so many rows (some hundred bytes each) are broadcast, by their counts; beyond it they
#: are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def bounding_box(points: DataFrame) -> Aabb:
    """One pass of min and max; an empty cloud has the zero box."""
    aggs = [f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in POSITION]
    r = points.agg(*aggs).first()
    if r is None or r["lx"] is None:
        return Aabb.zero()
    return Aabb(tuple(float(r[f"l{c}"]) for c in POSITION), tuple(float(r[f"h{c}"]) for c in POSITION))


def depth_for(edge: float, resolution: float) -> int:
    """The first level whose nodes are no longer than the resolution."""
    return 0 if edge <= resolution else min(ids.MAX_LEVEL, math.ceil(math.log2(edge / resolution)))


def with_path(points: DataFrame, cube: Cube, depth: int, name: str = "path") -> DataFrame:
    """The octree path of each point at ``depth``."""
    cells = {f"_cell_{c}": ids.cell_of(F.col(c), low, cube.edge, depth) for c, low in zip(POSITION, cube.low, strict=True)}
    return points.withColumns(cells).withColumn(name, ids.octree_path(*map(F.col, cells), depth)).drop(*cells)


@dataclass
class Octree:
    points: DataFrame
    nodes: DataFrame
    box: Aabb
    resolution: float


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def _prefix(level: int, path: str = "path") -> Column:
    """Of ``path``, the node at ``level``."""
    return F.substring(path, 1, level + 1)


def _digit(level: int, path: str = "path") -> Column:
    """Of ``path``, the child taken at ``level``; 0 where the path is shorter."""
    return F.coalesce(F.substring(path, level + 1, 1).try_cast("int"), F.lit(0))


@dataclass
class Splits:
    """The nodes of one level that split, with ``below``, flags of their children and grandchildren that do; ``sizes``:
    how many split of this level and the next ones."""

    level: int
    nodes: DataFrame
    sizes: dict[int, int]

    @property
    def count(self) -> int:
        return self.sizes[self.level]


def last_split(cube: Cube, depth: int, resolution: float) -> int:
    """The deepest level whose nodes may split."""
    return next((k for k in range(1, depth) if cube.edge / (1 << k) <= resolution), depth) - 1


def split_nodes(points: DataFrame, cube: Cube, depth: int, resolution: float, most: int) -> list[Splits]:
    """Every STEP levels, the nodes that split: more than ``most`` points and longer than the resolution; the
    root always does. A pass counts the nodes of STEP levels below those that were large, so never more than
    8 ** STEP for each of them. Only the number of large nodes of each level comes to the driver."""
    last = last_split(cube, depth, resolution)
    frontier, size, level = points.sparkSession.createDataFrame([("r",)], "node string"), 1, 0
    out = []
    while size:
        deep = min(level + STEP, last)
        rows = with_path(points, cube, max(deep, level)).select("path")
        if level:
            rows = rows.join(_small(frontier, size), _prefix(level) == F.col("node"), "left_semi")
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        levels = F.explode(F.array(*(F.lit(k) for k in range(level + 1, deep + 1))) if deep > level else F.array().cast("array<int>"))
        tiers = counts.select("path", "n", levels.alias("level")).groupBy(F.expr("substring(path, 1, level + 1)").alias("node"), "level").agg(F.sum("n").alias("n"))
        large = staged(tiers.where(F.col("n") > most).select("node", "level"), "large")
        sizes = {r["level"]: r["n"] for r in large.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
        place = F.when(F.col("level") == level + 1, _digit(level + 1, "node")).otherwise(8 + _digit(level + 1, "node") * 8 + _digit(level + 2, "node"))
        held = large.where(F.col("level") < level + STEP).groupBy(_prefix(level, "node").alias("_node")).agg(F.collect_set(place).alias("_at"))
        flags = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.when(F.array_contains("_at", k), "1").otherwise("0"))
        told = frontier.join(held, F.col("node") == F.col("_node"), "left")
        nodes = staged(told.select("node", F.coalesce(F.concat_ws("", flags), F.lit("0" * 72)).alias("below")), "splits")
        out.append(Splits(level, nodes, {level: size} | {k: n for k, n in sizes.items() if k < level + STEP}))
        level += STEP
        frontier, size = large.where(F.col("level") == level).select("node"), sizes.get(level, 0)
    return out


def names_of(splits: list[Splits]) -> DataFrame:
    """All nodes that split."""
    flag = F.posexplode(F.split("below", "")).alias("_at", "_flag")
    digits = F.when(F.col("_at") < 8, F.col("_at").cast("string")).otherwise(F.concat(F.floor((F.col("_at") - 8) / 8).cast("string"), ((F.col("_at") - 8) % 8).cast("string")))
    found = [s.nodes.select("node", flag).where("_flag = '1'").select(F.concat("node", digits).alias("node")) for s in splits]
    return reduce(DataFrame.unionByName, [s.nodes.select("node") for s in splits] + found)


def with_leaf(points: DataFrame, cube: Cube, splits: list[Splits]) -> DataFrame:
    """Adds ``node_id``: the leaf one below the deepest split node on a point's way, one join for STEP levels."""
    placed = with_path(points, cube, splits[-1].level + STEP)
    level = F.lit(0)
    for s in splits:
        below = f"_below{s.level}"
        nodes = s.nodes.select(F.col("node").alias(f"_node{s.level}"), F.col("below").alias(below))
        placed = placed.join(_small(nodes, s.count), _prefix(s.level) == F.col(f"_node{s.level}"), "left")
        first, second = _digit(s.level + 1), _digit(s.level + 2)
        flag = lambda at, below=below: F.substring(F.col(below), at + 1, F.lit(1)).cast("int")
        deeper = F.lit(s.level + 1) + flag(first) + flag(8 + first * 8 + second)
        level = F.when(F.col(below).isNotNull(), deeper).otherwise(level)
    helpers = [f"_{c}{s.level}" for s in splits for c in ("node", "below")]
    return placed.withColumn("node_id", F.substring(F.col("path"), F.lit(1), level + 1)).drop("path", *helpers)


def numbered(points: DataFrame, node: str, order: list[str], sizes: DataFrame | None = None, most: float = math.inf) -> DataFrame:
    """Adds ``_at``, from 0 within each node in the order of ``order``.

    Nodes above CELL_ROWS (of ``sizes``: node, _size) are sorted by ranges and numbered by the counts before, so a node
    may hold any share of the rows. ``most``: rows that no node has more of, where that is known."""
    placed = lambda rows: rows.withColumn("_at", (F.row_number().over(Window.partitionBy(node).orderBy(*order)) - 1).cast("long"))
    if most <= CELL_ROWS:
        return placed(points)
    sizes = points.groupBy(node).agg(F.count(F.lit(1)).alias("_size")) if sizes is None else sizes
    large = staged(sizes.where(F.col("_size") > CELL_ROWS).select(node), "large")
    if not (n := large.count()):
        return placed(points)
    inside = ranked(points.join(_small(large, n), node, "left_semi"), order, node, "numbered")
    inside = inside.select(*points.columns, F.col("rank").cast("long").alias("_at"))
    return placed(points.join(_small(large, n), node, "left_anti")).select(*points.columns, "_at").unionByName(inside)


def sampled_up(points: DataFrame, node: str, order: list[str]) -> DataFrame:
    """Adds ``_at``, a row's place in its node, and ``_up``: every SAMPLE-th row (from the first) moves up."""
    return numbered(points, node, order).withColumn("_up", F.col("_at") % SAMPLE == 0)


def tiers(leaves: DataFrame, deepest: int) -> DataFrame:
    """From leaves (node_id, n) all nodes: node_id, level, n (points before an eighth moves up), up (how many do) and
    start (their place in the parent's list, which takes its children's one after another)."""
    leaves = leaves.withColumn("level", ids.path_level(F.col("node_id")))
    below: DataFrame | None = None
    out, lazy = [], []
    for level in range(deepest, -1, -1):
        here = leaves.where(F.col("level") == level).select("node_id", "n")
        if below is not None:
            here = here.unionByName(below.groupBy(F.col("_parent").alias("node_id")).agg(F.sum("up").alias("n")))
        up = F.ceil(F.col("n") / SAMPLE).cast("long") if level else F.lit(0).cast("long")
        here = here.select("node_id", F.lit(level).alias("level"), "n", up.alias("up"), ids.parent_path(F.col("node_id")).alias("_parent"))
        before = Window.partitionBy("_parent").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)  # of eight children
        below = here.withColumn("start", F.coalesce(F.sum("up").over(before), F.lit(0)))
        lazy.append(below)
        if len(lazy) == STEP or not level:
            # Later levels stand on these, so they are written every few levels.
            done = staged(reduce(DataFrame.unionByName, lazy), "tiers")
            out.append(done)
            below, lazy = done.where(F.col("level") == level), []
    return reduce(DataFrame.unionByName, out).drop("_parent")


def build_octree(points: DataFrame, resolution: float, order: list[str], most: int = MAX_POINTS_PER_NODE, box: Aabb | None = None) -> Octree:
    """``order``: columns that order the points totally (the order of rows within a node).

    Points are shuffled once. A point's place in its leaf tells how far it moves up: a place that SAMPLE divides
    moves to the parent, where its place is a SAMPLE-th of it behind what earlier children moved up, and so on;
    those starts follow from the counts of nodes alone."""
    points = staged(points, "points")
    box = box or bounding_box(points)
    cube = Cube.around(box)
    depth = max(1, depth_for(cube.edge, resolution))
    splits = split_nodes(points, cube, depth, resolution, most)
    leaves = staged(with_leaf(points.select(*POSITION), cube, splits).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")), "leaves")
    sizes = {k: n for s in splits for k, n in s.sizes.items()}
    deepest = max(sizes) + 1
    every = tiers(leaves, deepest)
    # The starts that a leaf's points meet on their way up.
    level = F.explode(F.sequence(ids.path_level(F.col("node_id")), F.lit(1), F.lit(-1))).alias("_level")
    way = leaves.where(F.length("node_id") > 1).select("node_id", level).withColumn("_over", F.expr("substring(node_id, 1, _level + 1)"))
    way = way.join(every.select(F.col("node_id").alias("_over"), "start"), "_over").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("_level", "start")), False).alias("_way"))
    way = staged(way.select("node_id", F.col("_way.start").alias("_starts")), "ways")
    # Only below the last level that may split can a leaf have more than ``most``.
    full = most if deepest <= last_split(cube, depth, resolution) else math.inf
    placed = numbered(with_leaf(points, cube, splits), "node_id", order, leaves.withColumnRenamed("n", "_size"), full)
    climb = F.aggregate(
        F.col("_starts"),
        F.struct(F.col("_at").alias("at"), F.lit(0).alias("up"), F.lit(True).alias("on")),
        lambda a, start: F.when(a["on"] & (a["at"] % SAMPLE == 0), F.struct((start + F.floor(a["at"] / SAMPLE)).alias("at"), (a["up"] + 1).alias("up"), F.lit(True).alias("on"))).otherwise(
            F.struct(a["at"].alias("at"), a["up"].alias("up"), F.lit(False).alias("on"))
        ),
        lambda a: a["up"],
    )
    up = F.when(F.col("_at") % SAMPLE == 0, F.coalesce(climb, F.lit(0))).otherwise(0)
    moved = placed.join(_small(way, 8 * sum(sizes.values())), "node_id", "left").withColumn("node_id", F.substring(F.col("node_id"), F.lit(1), F.length("node_id") - up)).drop("_starts", "_at")
    final = staged(moved.withColumn("level", ids.path_level(F.col("node_id"))), "octree")
    names = names_of(splits).select(F.col("node").alias("node_id")).union(leaves.select("node_id")).distinct()
    counted = every.select("node_id", (F.col("n") - F.col("up")).alias("num_points"))
    # Stored, so that queries filter a table of nodes and not the points.
    nodes = staged(node_table(names.join(counted, "node_id", "left"), cube, resolution), "nodes")
    return Octree(final, nodes, box, resolution)


def node_table(counts: DataFrame, cube: Cube, resolution: float) -> DataFrame:
    """node_id, level, num_points (0 for nodes of which all points moved up), cube and encoding."""
    level = ids.path_level(F.col("node_id"))
    edge = F.lit(cube.edge) / F.pow(F.lit(2.0), level)

    def low(axis: int, start: float):
        cell = F.aggregate(F.transform(F.filter(F.sequence(F.lit(1), F.lit(ids.MAX_LEVEL + 1)), lambda k: k <= level), lambda k: F.substring(F.col("node_id"), k + 1, F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, d: a * 2 + F.shiftright(d, 2 - axis).bitwiseAND(1))
        return F.lit(start) + cell * edge

    return counts.select(
        "node_id", level.alias("level"), F.coalesce("num_points", F.lit(0)).cast("long").alias("num_points"),
        *(low(k, v).alias(f"min_{c}") for k, (c, v) in enumerate(zip(POSITION, cube.low, strict=True))),
        edge.alias("edge"), codec.choose_column(edge, resolution).alias("position_encoding"),
    )


def encoded(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points with positions as their node's encoding keeps them (decoded again)."""
    wide = points.join(nodes.select("node_id", "min_x", "min_y", "min_z", "edge", "position_encoding"), "node_id")
    out = wide
    for c in POSITION:
        low, edge = F.col(f"min_{c}"), F.col("edge")
        kept = None
        for name in codec.ENCODINGS:
            value = codec.decode(codec.encode(F.col(c), low, edge, name), low, edge, name)
            kept = F.when(F.col("position_encoding") == name, value) if kept is None else kept.when(F.col("position_encoding") == name, value)
        out = out.withColumn(c, kept)
    return out.drop("min_x", "min_y", "min_z", "edge", "position_encoding")


@dataclass
class S2Cloud:
    points: DataFrame
    nodes: DataFrame
    box: Aabb


def build_s2(points: DataFrame, level: int = DEFAULT_S2_LEVEL) -> S2Cloud:
    """Partition by S2 cell; points far from the Earth's surface are an error before anything is kept."""
    x, y, z = (F.col(c) for c in POSITION)
    bad = points.where(~geodesy.valid_radius(x, y, z) | (x + y + z).isNull()).limit(1).count()
    if bad:
        raise ValueError("a point is not near the Earth's surface (ECEF metres are needed)")
    celled = staged(points.withColumn("leaf", s2.leaf_column(x, y, z)).withColumn("cell", s2.parent_column(F.col("leaf"), level)), "cells")
    return S2Cloud(celled, staged(s2_nodes(celled), "nodes"), bounding_box(celled))


def s2_nodes(celled: DataFrame) -> DataFrame:
    """Cells with their counts, boxes and tokens."""
    aggs = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in POSITION]
    return celled.groupBy("cell").agg(F.count(F.lit(1)).alias("num_points"), *aggs).withColumn("token", s2.token_column(F.col("cell")))


def write_clustered(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """Rows clustered by node or cell, so that files and row groups of others are skipped by a query."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)
