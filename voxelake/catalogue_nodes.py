"""Further queries over the driver tables, by name, with their SQL: maps and frames, colours, encodings, nodes
and their pruning, and what pyramids hold; also the SQL of the catalogue's octree build."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.catalogue import (
    BOX, CLIP, ECEF, EVENT, EVENT_BOX, EYE, FRUSTUM, LINE, NODE_POINTS, OBB, RASTER, RASTER_BOX, RESOLUTION, ROOT, TURN,
    Query, _blob, _events, _frustum, _half, _key, _line, _nodes_sql, _num, _octree, _orders, _pyramid, _screen, _tiles, oracle_sql as first_sql,
)
from voxelake.functions import codec, colour, geodesy, ids
from voxelake.functions.attributes import POSITION, schema_with_position
from voxelake.operators import build, lod, pyramid, xray
from voxelake.operators.geometry import Frustum, Location, perspective_fov
from voxelake.operators.query import PointQuery, parse_interval, parse_key_value
from voxelake.plans import sql
from voxelake.plans.cloud import Client, PointCloud
from voxelake.shipping import ship
from voxelake.sources import blob, png, rawnode, views
from voxelake.staging import shared_dir, staged

DEPTH = 3
FRAME_AT = (0.5, 0.3)  # latitude and longitude of a local frame
VIEW = (30.0, 10.0, 60.0, 51.2)
#: A view that looks down aslant at the raster from above.
LOW_EYE = np.array([[0.8, 0.0, 0.6, 90.0], [0.0, 1.0, 0.0, 40.0], [-0.6, 0.0, 0.8, 60.0], [0.0, 0.0, 0.0, 1.0]])
LOW_CLIP = perspective_fov(1.0, 0.5, 0.1, 150.0) @ np.linalg.inv(LOW_EYE)
LOW_VIEW = Frustum.of_matrix(LOW_CLIP)
#: A slice of what the catalogue's eye sees, a quarter of the way down.
SLAB = lod.Slab().moved(60.0).deepened(22.0).frustum(EYE)
#: Sizes of a pixel.
PIXELS = (0.05, 0.9, 3.2, 40.0)
#: A resolution that keeps positions as doubles.
FINE = 1e-7
ZOOM = 10
DETAIL = 7
GAMMA = 2.2
#: Levels that the SQL of an octree build counts.
SQL_LEVELS = 9

# --- queries ------------------------------------------------------------------------------------


def _unproject(df: DataFrame) -> DataFrame:
    lat, lon = geodesy.unmercator(*geodesy.mercator(F.col("lat"), F.col("lon")))
    return df.select("o_orderkey", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


def _map_pixels(df: DataFrame) -> DataFrame:
    px, py = (geodesy.zoomed(m, ZOOM) for m in geodesy.mercator(F.col("lat"), F.col("lon")))
    back = geodesy.unzoomed(px, py, ZOOM - 1)  # null off the smaller map
    return df.select("o_orderkey", *(F.round(v, 6).alias(n) for n, v in zip(("px", "py", "mx", "my"), (px, py, *back), strict=True)))


def _local(df: DataFrame) -> DataFrame:
    moved = xray.isometry(df, geodesy.local_frame(*FRAME_AT))
    return moved.select("o_orderkey", *(F.round(c, 1).alias(n) for c, n in zip(POSITION, ("east", "north", "up"), strict=True)))


def _grid(df: DataFrame) -> DataFrame:
    cells = (ids.grid_cell(F.col(c), 3.0, 0.5, 16).alias(f"cell_{c}") for c in ("x", "y"))
    return df.select(*cells).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))


def _gamma(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *(F.round(colour.gamma(F.col(f"color.{c}"), GAMMA), 9).alias(c) for c in ("red", "green", "blue")))


def _mixed(df: DataFrame) -> DataFrame:
    unit = [colour.to_unit(F.col(f"color.{c}")) for c in ("red", "green", "blue")]
    mixed = colour.divide(colour.add(unit, [unit[1], unit[2], unit[0]]), F.col("l_linenumber") - 1)
    return df.select("l_orderkey", "l_linenumber", *(F.round(v, 9).alias(c) for v, c in zip(mixed, ("red", "green", "blue"), strict=True)))


def _encode_float(df: DataFrame) -> DataFrame:
    low, edge = F.lit(ROOT.low[0]), F.lit(ROOT.edge)
    code = df.select("event_id", codec.encode(F.col("x"), low, edge, "F32").alias("code"))
    return code.select("event_id", "code", F.round(codec.decode(F.col("code"), low, edge, "F32"), 6).alias("decoded"))


def _encodings(df: DataFrame) -> DataFrame:
    y = F.col("y")
    return df.select("l_orderkey", "l_linenumber", codec.choose_column(y * y * y * y * y, 1.0).alias("encoding"))


def _quad_neighbours(df: DataFrame) -> DataFrame:
    x, y = ids.cell_of(F.col("x"), 0.0, 64.0, 5, True), ids.cell_of(F.col("y"), 0.0, 128.0, 5, True)
    nodes = df.select(x.alias("qx"), y.alias("qy")).distinct()
    next_to = F.array(*(F.struct(F.lit(n).alias("direction"), ids.neighbour_path(F.col("qx"), F.col("qy"), 5, dx, dy).alias("neighbour")) for n, dx, dy in ids.DIRECTIONS))
    return nodes.select(ids.quad_path(F.col("qx"), F.col("qy"), 5).alias("node_id"), F.inline(next_to))


def _event_nodes(df: DataFrame) -> DataFrame:
    counts = _key(df, DEPTH).groupBy("node_id").agg(F.count(F.lit(1)).alias("num_points"))
    return build.node_table(counts, ROOT, RESOLUTION)


def _detail(df: DataFrame) -> DataFrame:
    return _event_nodes(df).select("node_id", lod.points_at_detail(F.col("num_points"), DETAIL).alias("n"))


def _meeting(df: DataFrame, location: Location) -> DataFrame:
    tree = build.Octree(_key(df, DEPTH), staged(_event_nodes(df), "nodes"), ROOT.box, RESOLUTION)
    return PointCloud.of_octree(tree).related(location).select("node_id")


def _view(df: DataFrame) -> DataFrame:
    tiles = xray.touched_tiles(df, RASTER, RASTER_BOX).withColumn("level", F.lit(RASTER.level))
    return pyramid.nodes_for_level(tiles, RASTER.level, RASTER.low, RASTER.edge, VIEW).select("tile_x", "tile_y", "num_points")


def _seen_tiles(df: DataFrame) -> DataFrame:
    tiles = xray.touched_tiles(df, RASTER, RASTER_BOX).withColumn("level", F.lit(RASTER.level))
    return pyramid.nodes_in_view(tiles, RASTER.level, RASTER.low, RASTER.edge, LOW_VIEW).select("tile_x", "tile_y", "num_points")


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lod.up_to_level(_octree(spark, sf_dir).points, 3)
    return shown.groupBy("node_id").agg(F.count(F.lit(1)).alias("num_points"))


def _blob_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.conv(F.hex(F.substring("blob", 37, 1)), 16, 10).cast("int")
    return _blob(spark, sf_dir).select("node_id", "num_points", F.octet_length("blob").cast("long").alias("n_bytes"), width.alias("coordinate_bytes"))


def _tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.tile_pixels(_tiles(spark, sf_dir)).drop("level")


def _background(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = pyramid.tile_pixels(pyramid.with_background(_tiles(spark, sf_dir), (10, 20, 30, 255)))
    plain = (F.col("red") == 10) & (F.col("green") == 20) & (F.col("blue") == 30) & (F.col("alpha") == 255)
    return pixels.where(plain).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def _stored_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built, stored as one file for each node and attribute, and read again."""
    tree = build.build_octree(views.event_cloud(spark, sf_dir).select("event_id", *POSITION), FINE, ["event_id"], NODE_POINTS)
    folder = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    rawnode.write_octree(tree.points, tree.nodes, tree.box, FINE, folder)
    return rawnode.read_octree(spark, folder, {"event_id": "I64"}).select("event_id", *(F.round(c, 6).alias(c) for c in POSITION))


def _stored_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    points = views.ecef_cloud(spark, sf_dir).select("o_orderkey", *POSITION)
    rawnode.write_s2(build.build_s2(points, 3), folder)
    return rawnode.read_s2(spark, folder).points.select("o_orderkey", *(F.round(c, 3).alias(c) for c in POSITION))


def _blob_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed into blobs of nodes and unpacked again."""
    points = views.line_cloud(spark, sf_dir).withColumns({"id": F.col("l_orderkey") * 8 + F.col("l_linenumber")})
    tree = build.build_octree(points.select(*POSITION, "color", "id"), FINE, ["id", *POSITION], 5000)

    def unpack(frames):
        for frame in frames:
            for data in frame.blob:
                p, c = blob.unpack(data)
                yield pd.DataFrame({**{n: p[:, k] for k, n in enumerate(POSITION)}, **{n: c[:, k].astype(np.int32) for k, n in enumerate(("red", "green", "blue"))}})

    ship(spark)
    own = blob.node_blobs(tree.points, tree.nodes).select("blob").mapInPandas(unpack, "x double, y double, z double, red int, green int, blue int")
    return own.select(*(F.round(c, 6).alias(c) for c in POSITION), "red", "green", "blue")


def _raster_over(df: DataFrame) -> DataFrame:
    """The raster that covers the points at each of some pixel sizes."""
    box = build.bounding_box(df)
    sized = [(size, xray.Raster.over(box, size, 32)) for size in PIXELS]
    return df.sparkSession.createDataFrame([(size, r.level, r.edge, *map(float, r.low)) for size, r in sized], "pixel double, level int, edge double, low_x double, low_y double")


def _turned_box(df: DataFrame) -> DataFrame:
    """The box around the points' box in a turned frame."""
    box = build.bounding_box(df).transformed(TURN)
    named = {f"{e}_{c}": float(v) for e, corner in (("min", box.low), ("max", box.high)) for c, v in zip(POSITION, corner, strict=True)}
    one = df.sparkSession.createDataFrame([tuple(named.values())], ", ".join(f"{n} double" for n in named))
    return one.select(*(F.round(n, 9).alias(n) for n in named))


def _sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and an interval asked for in SQL text."""
    sql.register(spark)
    views.line_cloud(spark, sf_dir).createOrReplaceTempView("vx_line")
    corners = ", ".join(f"{v!r}D" for v in (*BOX.low, *BOX.high))
    return spark.sql(f"select x, y, z, intensity from vx_line where vx_in_box(x, y, z, {corners}) and vx_in_interval(intensity, 2, 5)")


def _sql_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    views.event_cloud(spark, sf_dir).createOrReplaceTempView("vx_event")
    node = f"vx_octree_node(x, y, z, {', '.join(f'{v!r}D' for v in ROOT.low)}, {ROOT.edge!r}D, {DEPTH})"
    return spark.sql(f"select vx_node_parent(node) as parent, count(*) as n, count(distinct node) as n_children from (select {node} as node from vx_event) group by 1")


def _sql_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a stored cloud in a box, asked for in SQL text."""
    sql.register_cloud(spark, "vx_cloud", _octree(spark, sf_dir))
    corners = ", ".join(f"{v!r}D" for v in (*EVENT_BOX.low, *EVENT_BOX.high))
    return spark.sql(f"select event_id, x, y, z from vx_cloud_in_box({corners})")


def _nan_interval(df: DataFrame) -> DataFrame:
    """A number that isn't one is in no interval."""
    gone = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("intensity").cast("double"))
    return PointQuery(["depth"], intervals={"depth": (2.0, 5.0)}).run(df.withColumn("depth", gone)).select(*POSITION, "depth")


def _parsed_interval(df: DataFrame) -> DataFrame:
    """As commands take it: ``name=low,high``."""
    name, text = parse_key_value("intensity=2,5")
    return PointQuery(["intensity"], intervals={name: parse_interval(text)}).run(df)


def _known_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a stored cloud by its nodes table, and the box around two clouds."""
    box = Client([_half(spark, sf_dir, k) for k in (0, 1)]).box
    return spark.createDataFrame([(_octree(spark, sf_dir).num_points(), *map(float, (*box.low, *box.high)))], "num_points long, " + ", ".join(f"{e}_{c} double" for e in ("min", "max") for c in POSITION))


def _schema(df: DataFrame) -> DataFrame:
    """Attributes and their types, and how many points have each."""
    kinds = schema_with_position(df)
    named = [F.struct(F.lit(n).alias("attribute"), F.lit(k).alias("type"), F.col("x" if n == "xyz" else n).isNotNull().alias("_has")) for n, k in kinds]
    return df.select(F.inline(F.array(*named))).where("_has").groupBy("attribute", "type").agg(F.count(F.lit(1)).alias("n"))


def _rolled_pixels(tiles: DataFrame, level: int) -> DataFrame:
    return pyramid.tile_pixels(tiles.where(F.col("level") == level)).drop("level")


def _parent_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = (255, 255, 255, 255)
    leaves = pyramid.with_background(_tiles(spark, sf_dir), white)
    return _rolled_pixels(pyramid.build_levels(leaves, RASTER.level, RASTER.level - 1, RASTER.tile_px, white), RASTER.level - 1)


def _merged_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of two halves of a pyramid, put together."""
    white = (255, 255, 255, 255)
    leaves = pyramid.with_background(_tiles(spark, sf_dir), white)
    levels = pyramid.build_levels(leaves, RASTER.level, 1, RASTER.tile_px, white)
    right = F.col("tile_x") >= F.pow(F.lit(2), F.col("level") - 1)
    # Each half holds two of the four nodes of the first level.
    return _rolled_pixels(pyramid.merged([levels.where(~right), levels.where(right)], ["r0", "r2"], RASTER.tile_px, white), 0)


def _seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right half of each tile mixed with the left half of the next one."""
    half = RASTER.tile_px // 2
    tiles = _tiles(spark, sf_dir)
    pairs = tiles.join(tiles.select((F.col("tile_x") - 1).alias("tile_x"), "tile_y", F.col("png").alias("after")), ["tile_x", "tile_y"])

    def mix(frames):
        for rows in frames:
            out = [(r.level, r.tile_x, r.tile_y, png.encode(pyramid.mixed(png.decode(r.png)[:, half:], png.decode(r.after)[:, :half], 1))) for r in rows.itertuples()]
            yield pd.DataFrame(out, columns=["level", "tile_x", "tile_y", "png"])

    ship(spark)
    return pyramid.tile_pixels(pairs.mapInPandas(mix, pyramid.TILE_SCHEMA)).drop("level")


def queries() -> dict[str, Query]:
    return {
        "mercator_unproject": _orders(_unproject),
        "map_pixels": _orders(_map_pixels),
        "local_frame": _orders(_local),
        "grid_cells": _events(_grid),
        "gamma_colours": _line(_gamma),
        "mixed_colours": _line(_mixed),
        "position_encode_f32": _events(_encode_float),
        "encoding_choice": _line(_encodings),
        "quad_neighbours": _line(_quad_neighbours),
        "node_cubes": _events(_event_nodes),
        "points_at_detail": _events(_detail),
        "nodes_meeting_aabb": _events(lambda df: _meeting(df, EVENT_BOX)),
        "nodes_meeting_obb": _events(lambda df: _meeting(df, OBB)),
        "nodes_meeting_frustum": _events(lambda df: _meeting(df, FRUSTUM)),
        "tiles_in_view": _line(_view),
        "nan_interval": _line(_nan_interval),
        "parsed_interval": _line(_parsed_interval),
        "known_size": _known_size,
        "cloud_schema": _line(_schema),
        "slab_view": _line(lambda df: PointQuery(["l_orderkey"], SLAB).run(df)),
        "tiles_in_frustum": _line(_seen_tiles),
        "octree_moving_view": _moving,
        "node_blob_sizes": _blob_sizes,
        "pyramid_nodes": lambda spark, d: _pyramid(spark, d).select("node_id", "level"),
        "tile_pixels": _tile_pixels,
        "background_pixels": _background,
        "seam_blend": _seams,
        "parent_pixels": _parent_pixels,
        "merged_pixels": _merged_pixels,
        "stored_octree": _stored_octree,
        "node_blob_points": _blob_points,
        "raster_over": _line(_raster_over),
        "box_in_frame": _events(_turned_box),
        "sql_box_and_interval": _sql_text,
        "sql_node_parents": _sql_nodes,
        "sql_cloud_box": _sql_cloud,
        "stored_s2": _stored_s2,
    }


# --- SQL ----------------------------------------------------------------------------------------


def _rounded(**values: str) -> str:
    return ", ".join(f"round({v}, 9) as {n}" for n, v in values.items())


def _encoding(ratio: str) -> str:
    bits = f"(case when {ratio} > 1 then floor(log2({ratio})) else 0 end + 1)"
    return f"case when {bits} <= 8 then 'U8' when {bits} <= 16 then 'U16' when {bits} <= 24 then 'F32' else 'F64' end"


def _octree_sql(source: str, most: int, cubes: bool = False) -> str:
    """Nodes of an octree build by counts alone: of a node's points every eighth, the first included, moves up.
    ``cubes``: with their lower corners and edges."""
    n = 1 << SQL_LEVELS
    digit = "+".join(f"((i{c} >> {{k}}) & 1)*{v}" for c, v in zip("xyz", (4, 2, 1), strict=True))
    path = "'r'||" + "||".join(f"cast({digit.format(k=k)} as varchar)" for k in range(SQL_LEVELS - 1, -1, -1))
    prefix = lambda k: f"substr(path, 1, {k + 1})"
    cells = ", ".join(f"cast(greatest(0, least({n - 1}, ceil(({c}-l{c})/edge*{_num(n)})-1)) as bigint) as i{c}" for c in "xyz")
    sizes = ", ".join(f"count(*) over (partition by {prefix(k)}) as n{k}" for k in range(1, SQL_LEVELS))
    level = "case " + " ".join(f"when n{k} > {most} then {k + 1}" for k in range(SQL_LEVELS - 1, 0, -1)) + " else 1 end"
    spans = ", ".join(f"max({c})-min({c})" for c in "xyz")
    parts = [
        f"pts as (select x, y, z from {source})",
        f"cube as (select min(x) as lx, min(y) as ly, min(z) as lz, greatest({spans}) as edge from pts)",
        f"paths as (select {path} as path from (select {cells} from pts, cube) a)",
        f"leaf as (select substr(path, 1, lev+1) as node, lev, count(*) as n from (select path, {level} as lev from (select path, {sizes} from paths) a) b group by 1, 2)",
        f"t{SQL_LEVELS} as (select node, n from leaf where lev = {SQL_LEVELS})",
    ]
    for k in range(SQL_LEVELS - 1, -1, -1):
        parts.append(f"t{k} as (select node, sum(n) as n from (select node, n from leaf where lev = {k} union all select substr(node, 1, {k + 1}), (n+7)//8 from t{k + 1}) a group by 1)")
    every = " union all ".join(f"select node as node_id, {k} as level, cast(n{'-(n+7)//8' if k else ''} as bigint) as num_points, edge/{_num(1 << k)} as side from t{k}, cube" for k in range(SQL_LEVELS + 1))
    if not cubes:
        return f"(with {', '.join(parts)} select node_id, level, num_points, {_encoding(f'(side/{_num(RESOLUTION)})')} as position_encoding from ({every}) e) o"
    bit = lambda k, axis: f"((cast(substr(node_id, {k + 1}, 1) as bigint)>>{2 - axis})&1)*(1<<(level-{k}))"
    cell = lambda axis: "(" + "+".join(f"case when level >= {k} then {bit(k, axis)} else 0 end" for k in range(1, SQL_LEVELS + 1)) + ")"
    lows = ", ".join(f"l{c}+{cell(a)}*side as min_{c}" for a, c in enumerate("xyz"))
    return f"(with {', '.join(parts)} select node_id, level, num_points, side as edge, {lows} from ({every}) e, cube) o"


def _visible_sql() -> str:
    """A recursion over the levels: each node keeps, for its ancestors and itself, the least (size, id) on the way down
    from there."""
    seen = _corners(CLIP)
    meets, inside = _told(seen, *_sides(seen), [f"n.min_{c}" for c in "xyz"], ["n.edge"] * 3)
    key = "{'s': 0.0 - n.s, 'n': n.node_id}"
    least = "list_transform(v.w, lambda x: case when x.s > -n.s or (x.s = -n.s and x.n > n.node_id) then x else " + key + " end)"
    return f"""with recursive n as materialized (select *, {_screen()} as s from {_octree_sql(EVENT, NODE_POINTS, True)}),
 v as (select node_id, level, num_points, [{{'s': 0.0 - s, 'n': node_id}}] as w, false as whole from n where level = 0
  union all
  select n.node_id, n.level, n.num_points, list_append({least}, {key}) as w, v.whole or ({inside}) as whole
  from v join n on n.level = v.level + 1 and substr(n.node_id, 1, length(n.node_id) - 1) = v.node_id where v.whole or ({meets}))
 select cast(row_number() over (order by w) - 1 as int) as rank, node_id, num_points from v where num_points > 0"""


def _corners(clip: np.ndarray) -> np.ndarray:
    """Of a view volume, numbered by their signs."""
    seen = np.c_[np.array(list(itertools.product((-1.0, 1.0), repeat=3))), np.ones(8)] @ np.linalg.inv(clip).T
    return seen[:, :3] / seen[:, 3:]


def _sides(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and face normals of a body of eight corners, numbered as by their signs."""
    c = corners.reshape(2, 2, 2, 3)
    edges = np.concatenate([np.diff(c, axis=k).reshape(-1, 3) for k in range(3)])
    normals = []
    for k in range(3):
        for side in (0, 1):
            face = np.take(c, side, k)
            normals.append(np.cross(face[1, 0] - face[0, 0], face[0, 1] - face[0, 0]))
    return edges, np.array(normals)


def _told(corners: np.ndarray, edges: np.ndarray, normals: np.ndarray, lows: list[str], spans: list[str]) -> tuple[str, str]:
    """(no axis parts the body from a box, the box is in the body's span on every axis). A box spans, along an axis,
    half its sides times the axis' parts about its centre."""
    square = np.eye(3)
    meets, inside = [], []
    for axis in [*normals, *square, *(np.cross(a, b) for a, b in itertools.product(edges, square))]:
        if np.linalg.norm(axis) < 1e-9:
            continue
        a = axis / np.linalg.norm(axis)
        centre = "+".join(f"({low}+{span}/2)*{_num(v)}" for low, span, v in zip(lows, spans, a, strict=True))
        reach = "+".join(f"{span}/2*{_num(abs(v))}" for span, v in zip(spans, a, strict=True))
        low, high = (corners @ a).min(), (corners @ a).max()
        meets.append(f"({centre})+({reach}) >= {_num(low)} and ({centre})-({reach}) <= {_num(high)}")
        inside.append(f"({centre})-({reach}) >= {_num(low)} and ({centre})+({reach}) <= {_num(high)}")
    return " and ".join(meets), " and ".join(inside)


def _body_sql(corners: np.ndarray) -> str:
    """The nodes that meet a body of eight corners, numbered as by their signs."""
    meets, _ = _told(corners, *_sides(corners), [f"min_{c}" for c in "xyz"], ["edge"] * 3)
    return f"select node_id from {_nodes_sql(DEPTH)} where {meets}"


def _halved_sql(pixels: str) -> str:
    """The level above ``pixels`` (all of the tiles there are): the four children of each tile side by side on white,
    then its weights along both axes."""
    px, channels = RASTER.tile_px, ("red", "green", "blue", "alpha")
    weights = pyramid._weights(px)
    listed = ", ".join(f"({o}, {i}, {_num(weights[o, i])})" for o, i in np.argwhere(weights).tolist())
    wide = f"select tile_x>>1 as tx, tile_y>>1 as ty, (tile_x&1)*{px}+px as i, (1-(tile_y&1))*{px}+py as j, {', '.join(channels)} from {pixels} p"
    grid = f"(select * from (select distinct tx, ty from wide) t, (select unnest(range({2 * px})) as i) a, (select unnest(range({2 * px})) as j) b)"
    full = f"select tx, ty, i, j, {', '.join(f'coalesce({c}, 255) as {c}' for c in channels)} from {grid} g left join wide using (tx, ty, i, j)"
    across = f"select tx, ty, w.o as px, j, {', '.join(f'sum({c}*w.v) as {c}' for c in channels)} from plain join w on w.i = plain.i group by 1, 2, 3, 4"
    down = ", ".join(f"cast(greatest(0, least(255, floor(round(sum({c}*w.v), 6)+0.5))) as int) as {c}" for c in channels)
    return f"""(with w as materialized (select * from (values {listed}) w(o, i, v)), wide as materialized ({wide}), plain as ({full}), across as materialized ({across})
 select tx as tile_x, ty as tile_y, px, w.o as py, {down} from across join w on w.i = j group by 1, 2, 3, 4)"""


def oracle_sql() -> dict[str, str]:
    known = first_sql()
    two_pi, four_pi = _num(2 * np.pi), _num(4 * np.pi)
    s = "sin(lat)"
    mx, my = f"({_num(0.5)}+lon/{two_pi})", f"({_num(0.5)}-ln((1+{s})/(1-{s}))/{four_pi})"
    size = float(geodesy.TILE_SIZE << ZOOM)
    half = f"px < {_num(size / 2)} and py < {_num(size / 2)}"
    q = {
        "mercator_unproject": f"select o_orderkey, {_rounded(lat='asin(1-2/(exp((0.5-my)*' + four_pi + ')+1))', lon='(mx-0.5)*' + two_pi)} from (select o_orderkey, {mx} as mx, {my} as my from {ECEF}) a",
        "map_pixels": f"select o_orderkey, round(px, 6) as px, round(py, 6) as py, case when {half} then round(px/{_num(size / 2)}, 6) end as mx, case when {half} then round(py/{_num(size / 2)}, 6) end as my from (select o_orderkey, {mx}*{_num(size)} as px, {my}*{_num(size)} as py from {ECEF}) a",
        "grid_cells": "select cast(floor((x-3)/0.5)-16 as bigint) as cell_x, cast(floor((y-3)/0.5)-16 as bigint) as cell_y, count(*) as n from " + EVENT + " group by 1, 2",
        "position_encode_f32": f"select event_id, code, round(cast(code as double)*{_num(ROOT.edge)}+{_num(0)}, 6) as decoded from (select event_id, cast(greatest({_num(0)}, least({_num(1)}, (x-{_num(0)})/{_num(ROOT.edge)})) as float) as code from {EVENT}) a",
        "encoding_choice": f"select l_orderkey, l_linenumber, {_encoding('(y*y*y*y*y)')} as encoding from {LINE}",
        "node_cubes": f"select node_id, {DEPTH} as level, num_points, min_x, min_y, min_z, edge, {_encoding(f'(edge/{_num(RESOLUTION)})')} as position_encoding from {_nodes_sql(DEPTH)}",
        "points_at_detail": f"select node_id, cast((num_points+{DETAIL - 1})//{DETAIL} as bigint) as n from {_nodes_sql(DEPTH)}",
        "octree_build": f"select * from {_octree_sql(EVENT, NODE_POINTS)}",
        "octree_moving_view": f"select node_id, num_points from {_octree_sql(EVENT, NODE_POINTS)} where level <= 2 and num_points > 0",
        "tile_pixels": known["xray_density"],
    }
    channels = ("red", "green", "blue")
    q["gamma_colours"] = f"select l_orderkey, l_linenumber, {_rounded(**{c: f'pow({c}/{_num(255)}, {_num(1 / GAMMA)})' for c in channels})} from {LINE}"
    mixed = {c: f"({c}/{_num(255)}+{d}/{_num(255)})/nullif(l_linenumber-1, 0)" for c, d in zip(channels, ("green", "blue", "red"), strict=True)}
    q["mixed_colours"] = f"select l_orderkey, l_linenumber, {_rounded(**mixed)} from {LINE}"
    la, lo = (_num(v) for v in FRAME_AT)
    n = f"({_num(geodesy.A)}/sqrt(1-{_num(geodesy.E2)}*sin({la})*sin({la})))"
    at = {"x": f"{n}*cos({la})*cos({lo})", "y": f"{n}*cos({la})*sin({lo})", "z": f"{n}*{_num(1 - geodesy.E2)}*sin({la})"}
    apart = ", ".join(f"{c}-({v}) as d{c}" for c, v in at.items())
    axes = {
        "east": f"-sin({lo})*dx+cos({lo})*dy",
        "north": f"-sin({la})*cos({lo})*dx-sin({la})*sin({lo})*dy+cos({la})*dz",
        "up": f"cos({la})*cos({lo})*dx+cos({la})*sin({lo})*dy+sin({la})*dz",
    }
    q["local_frame"] = f"select o_orderkey, {', '.join(f'round({v}, 1)+0.0 as {k}' for k, v in axes.items())} from (select o_orderkey, {apart} from {ECEF}) a"
    cell = lambda c, e: f"cast(greatest(0, least(31, floor(({c}-{_num(0)})/{_num(e)}*{_num(32)}))) as bigint)"
    path = lambda x, y: "'r'||" + "||".join(f"cast((({x}>>{k})&1)*2+(({y}>>{k})&1) as varchar)" for k in range(4, -1, -1))
    ways = ", ".join(f"('{name}', {dx}, {dy})" for name, dx, dy in ids.DIRECTIONS)
    q["quad_neighbours"] = f"select {path('qx', 'qy')} as node_id, direction, case when qx+dx between 0 and 31 and qy+dy between 0 and 31 then {path('(qx+dx)', '(qy+dy)')} end as neighbour from (select distinct {cell('x', 64)} as qx, {cell('y', 128)} as qy from {LINE}) c, (values {ways}) w(direction, dx, dy)"
    unit = np.array(list(itertools.product((-1.0, 1.0), repeat=3)))
    q["nodes_meeting_obb"] = _body_sql(np.array(OBB.centre) + (unit * OBB.half) @ np.array(OBB.rotation).T)
    q["nodes_meeting_frustum"] = _body_sql(_corners(CLIP))
    q["visible_nodes"] = _visible_sql()
    overlap = " and ".join(f"min_{c} <= {_num(h)} and min_{c}+edge >= {_num(a)}" for c, a, h in zip("xyz", EVENT_BOX.low, EVENT_BOX.high, strict=True))
    q["nodes_meeting_aabb"] = f"select node_id from {_nodes_sql(DEPTH)} where {overlap}"
    side = RASTER.edge / RASTER.tiles
    q["tiles_in_view"] = f"select * from ({known['touched_tiles']}) t where tile_x*{_num(side)} <= {_num(VIEW[2])} and (tile_x+1)*{_num(side)} >= {_num(VIEW[0])} and tile_y*{_num(side)} <= {_num(VIEW[3])} and (tile_y+1)*{_num(side)} >= {_num(VIEW[1])}"
    seen = _corners(LOW_CLIP)
    plate = [f"tile_x*{_num(side)}", f"tile_y*{_num(side)}", _num(-pyramid.PLATE)]
    meets, _ = _told(seen, *_sides(seen), plate, [_num(side), _num(side), _num(2 * pyramid.PLATE)])
    q["nan_interval"] = f"select x, y, z, cast(intensity as double) as depth from {LINE} where l_linenumber <> 1 and intensity between 2.0 and 5.0"
    q["parsed_interval"] = f"select x, y, z, intensity from {LINE} where intensity between 2.0 and 5.0"
    corners = ", ".join(f"{f}({c}) as {f}_{c}" for f in ("min", "max") for c in "xyz")
    q["known_size"] = f"select count(*) as num_points, {corners} from {EVENT}"
    kinds = {"color": "U8Vec3", "intensity": "F32", "xyz": "F64Vec3"} | dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey"), "I64") | {"l_linenumber": "I32"}
    listed = ", ".join(f"('{n}', '{k}')" for n, k in kinds.items())
    q["cloud_schema"] = f"select attribute, type, n from (values {listed}) k(attribute, type), (select count(*) as n from lineitem) c"
    q["slab_view"] = f"select x, y, z, l_orderkey from {LINE} where {_frustum(np.array(SLAB.clip_from_query))}"
    q["tiles_in_frustum"] = f"select * from ({known['touched_tiles']}) t where {meets}"
    width = "case position_encoding when 'U8' then 1 when 'U16' then 2 when 'F32' then 4 else 8 end"
    padded = lambda v: f"(({v}+7)//8*8)"
    q["node_blob_sizes"] = f"select node_id, num_points, cast(40+{padded('3*num_points*w')}+{padded('3*num_points')} as bigint) as n_bytes, w as coordinate_bytes from (select *, {width} as w from {_octree_sql(LINE, 5000)}) b where num_points > 0"
    drawn = f"(select distinct tile_x as tx, tile_y as ty from ({known['xray_density']}) p)"
    name = lambda k: "'r'" + "".join(f"||cast(((tx>>{b})&1)*2+((ty>>{b})&1) as varchar)" for b in range(RASTER.level - 1, RASTER.level - 1 - k, -1))
    q["pyramid_nodes"] = " union all ".join(f"select distinct {name(k)} as node_id, {k} as level from {drawn} d" for k in range(RASTER.level + 1))
    half = RASTER.tile_px // 2
    pixels, keys = f"({known['xray_density']})", "tile_x, tile_y, px, py"
    first = f"(select tile_x, tile_y, px-{half} as px, py, red, green, blue, alpha from {pixels} a where px >= {half})"
    second = f"(select tile_x-1 as tile_x, tile_y, px, py, red, green, blue, alpha from {pixels} b where px < {half})"
    tiles = f"(select distinct tile_x, tile_y from {pixels} c)"
    share = f"(px/{_num(half - 1)})"
    parts = ", ".join(f"cast(case when a.alpha is null then b.{c} when b.alpha is null then a.{c} else floor(a.{c}*(1-{share})+b.{c}*{share}+0.5) end as int) as {c}" for c in (*channels, "alpha"))
    both = f"{tiles} s join {tiles} t on t.tile_x = s.tile_x+1 and t.tile_y = s.tile_y"
    q["seam_blend"] = f"select {keys}, {parts} from {first} a full join {second} b using ({keys}) where (tile_x, tile_y) in (select (s.tile_x, s.tile_y) from {both})"
    every = f"(select * from {tiles} t, (select unnest(range({RASTER.tile_px})) as px) a, (select unnest(range({RASTER.tile_px})) as py) b)"
    leaves = f"(select {keys}, {', '.join(f'coalesce({c}, 255) as {c}' for c in (*channels, 'alpha'))} from {every} e left join {pixels} p using ({keys}))"
    q["parent_pixels"] = f"select * from {_halved_sql(leaves)} h"
    q["merged_pixels"] = f"select * from {_halved_sql(_halved_sql(leaves))} h"
    q["node_blob_points"] = f"select round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, red, green, blue from {LINE}"
    sizes = ", ".join(f"({_num(v)})" for v in PIXELS)
    box = f"(select min(x) as lx, min(y) as ly, greatest(max(x)-min(x), max(y)-min(y)) as span from {LINE})"
    fit = "cast(greatest(0, ceil(log2(span/(32*pixel)))) as int)"
    q["raster_over"] = f"select pixel, {fit} as level, 32*pixel*pow(2, {fit}) as edge, lx as low_x, ly as low_y from (values {sizes}) s(pixel), {box} b"
    spans = ", ".join(f"min({c}) as l{c}, max({c}) as h{c}" for c in "xyz")
    corners = f"(select unnest([lx, hx]) as x, ly, hy, lz, hz from (select {spans} from {EVENT}) a)"
    corners = f"(select x, unnest([ly, hy]) as y, lz, hz from {corners} b)"
    corners = f"(select x, y, unnest([lz, hz]) as z from {corners} c)"
    turned = {c: "+".join(f"{v}*{_num(m)}" for v, m in zip("xyz", TURN[k, :3], strict=True)) + f"+{_num(TURN[k, 3])}" for k, c in enumerate("xyz")}
    q["box_in_frame"] = "select " + ", ".join(f"round({f}({v}), 9) as {f}_{c}" for f in ("min", "max") for c, v in turned.items()) + f" from {corners} d"
    q["sql_box_and_interval"] = known["aabb_and_interval"]
    q["sql_node_parents"] = known["node_parent_counts"]
    q["sql_cloud_box"] = known["octree_query_pruned"]
    q["stored_octree"] = f"select event_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from {EVENT}"
    q["stored_s2"] = known["ecef_from_wgs84"]
    q["background_pixels"] = f"select tile_x, tile_y, {RASTER.tile_px ** 2}-count(*) as n from ({known['xray_density']}) p group by 1, 2"
    return q
