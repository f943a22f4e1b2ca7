"""Clouds in SQL: functions of points and node ids, and views and table functions of a cloud.

All are SQL functions, so a query that calls them is planned as if their bodies stood in it: their comparisons
reach the scan as those of the DataFrame form do. They live as long as the session.

    sql.register(spark)
    sql.register_cloud(spark, "scan", cloud)
    spark.sql("select count(*) from scan_in_box(0, 0, 0, 10, 10, 5) where vx_in_interval(intensity, 2, 5)")
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from voxelake.functions import geodesy
from voxelake.plans.cloud import PointCloud

_BOX = ", ".join(f"{e}_{c} double" for e in ("low", "high") for c in "xyz")
_POINT = "x double, y double, z double"


def _row(k: int) -> str:
    return f"(x * m[{4 * k}] + y * m[{4 * k + 1}] + z * m[{4 * k + 2}] + m[{4 * k + 3}])"


def _side(k: int) -> str:
    """Of an oriented box: the point's way from the centre along its k-th axis."""
    return "+".join(f"({c} - centre[{j}]) * rotation[{3 * j + k}]" for j, c in enumerate("xyz"))


def _cell(c: str) -> str:
    """Grid cell of a coordinate: a point belongs to the upper half only if it is greater than the centre."""
    return f"cast(greatest(0, least(shiftleft(1L, depth) - 1, ceil(({c} - low_{c}) / edge * shiftleft(1L, depth)) - 1)) as bigint)"


_DIGIT = "+".join(f"(shiftright({_cell(c)}, k) & 1) * {v}" for c, v in zip("xyz", (4, 2, 1), strict=True))
_SINE = f"sin(greatest({-geodesy.LAT_BOUND_RAD!r}D, least({geodesy.LAT_BOUND_RAD!r}D, latitude)))"

#: name -> (parameters, type, body).
FUNCTIONS = {
    "vx_in_box": (f"{_POINT}, {_BOX}", "boolean", " and ".join(f"{c} >= low_{c} and {c} < high_{c}" for c in "xyz")),
    "vx_in_obb": (f"{_POINT}, centre array<double>, rotation array<double>, half array<double>", "boolean", " and ".join(f"abs({_side(k)}) <= half[{k}]" for k in range(3))),
    "vx_in_frustum": (
        f"{_POINT}, m array<double>", "boolean",
        "coalesce(" + " and ".join(f"try_divide({_row(k)}, {_row(3)}) > -1 and try_divide({_row(k)}, {_row(3)}) < 1" for k in range(3)) + ", false)",
    ),
    "vx_in_interval": ("v double, low double, high double", "boolean", "v >= low and v <= high and not isnan(v)"),
    "vx_octree_node": (f"{_POINT}, low_x double, low_y double, low_z double, edge double, depth int", "string", f"concat('r', array_join(transform(if(depth > 0, sequence(depth - 1, 0, -1), array()), k -> cast({_DIGIT} as string)), ''))"),
    "vx_node_level": ("node string", "int", "length(node) - 1"),
    "vx_node_parent": ("node string", "string", "if(length(node) > 1, substring(node, 1, length(node) - 1), null)"),
    "vx_node_below": ("node string, ancestor string", "boolean", "startswith(node, ancestor)"),
    "vx_in_cell": ("leaf bigint, cell bigint", "boolean", "leaf between cell - ((cell & -cell) - 1) and cell + ((cell & -cell) - 1)"),
    "vx_mercator_x": ("longitude double", "double", f"0.5D + longitude / {2 * math.pi!r}D"),
    "vx_mercator_y": ("latitude double", "double", f"0.5D - ln((1D + {_SINE}) / (1D - {_SINE})) / {4 * math.pi!r}D"),
}


def register(spark: SparkSession) -> None:
    """The functions ``vx_*``."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")


def register_cloud(spark: SparkSession, name: str, cloud: PointCloud) -> None:
    """``name``: a view of the points; ``name_nodes``: of the nodes; ``name_nodes_in_box(...)``: the nodes with points
    whose boxes meet one; ``name_in_box(...)``: the points in a box, of those nodes only."""
    register(spark)
    cloud.points.createOrReplaceTempView(name)
    cloud.nodes.createOrReplaceTempView(f"{name}_nodes")
    columns = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    meets = " and ".join(f"min_{c} <= high_{c} and max_{c} >= low_{c}" for c in "xyz")
    spark.sql(f"create or replace temporary function {name}_nodes_in_box({_BOX}) returns table({columns(cloud.nodes)}) return select * from {name}_nodes where num_points > 0 and {meets}")
    inside = "vx_in_box(x, y, z, " + ", ".join(f"{e}_{c}" for e in ("low", "high") for c in "xyz") + ")"
    listed = ", ".join(f"p.`{c}`" for c in cloud.points.columns)
    # A join, as the parameters aren't known within a subquery; a node has one row.
    spark.sql(
        f"create or replace temporary function {name}_in_box({_BOX}) returns table({columns(cloud.points)}) return select {listed} from {name} p "
        f"join {name}_nodes n on p.{cloud.key} = n.{cloud.key} where {inside.replace('(x, y, z', '(p.x, p.y, p.z')} and n.num_points > 0 and {meets}"
    )
