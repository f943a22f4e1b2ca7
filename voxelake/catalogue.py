"""Queries of the engine over the driver tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import codec, colour, geodesy, ids, s2
from voxelake.functions.attributes import POSITION
from voxelake.operators import build, lod, pyramid, xray
from voxelake.operators.geometry import Aabb, CellUnion, Cube, Frustum, MercatorRect, Obb, perspective_fov
from voxelake.operators.query import PointQuery
from voxelake.plans.cloud import Client, PointCloud
from voxelake.sources import blob, ply, views
from voxelake.staging import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "octree_query_pruned"

# --- what the queries ask for -------------------------------------------------------------------

BOX = Aabb((10.0, 20.0, 10.0), (40.0, 80.0, 90.0))
EVENT_BOX = Aabb((5.0, 10.0, 50.0), (60.0, 90.0, 500.0))
OBB = Obb((25.0, 50.0, 50.0), ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (10.0, 30.0, 40.0))
EYE = np.array([[1, 0, 0, 25.0], [0, 1, 0, 50.0], [0, 0, 1, 150.0], [0, 0, 0, 1.0]])
CLIP = perspective_fov(1.0, 0.4, 0.1, 120.0) @ np.linalg.inv(EYE)
FRUSTUM = Frustum.of_matrix(CLIP)
RECT = MercatorRect(0.25, 0.3, 0.75, 0.6)
ROOT = Cube((0.0, 0.0, 0.0), 1024.0)  # holds every event
RASTER_BOX = Aabb((0.0, 0.0, 0.0), (102.4, 102.4, 100.0))
RASTER = xray.Raster((0.0, 0.0), 102.4, 2, 64)
TURN = np.array([[0.8, -0.6, 0, 5.0], [0.6, 0.8, 0, -3.0], [0, 0, 1, 2.0], [0, 0, 0, 1]])
RESOLUTION = 0.01
#: Points of a node in the catalogue's octrees, which are small.
NODE_POINTS = 500


def _flat(df: DataFrame) -> DataFrame:
    """Colour as three integers."""
    if "color" not in df.columns:
        return df
    return df.select(*(c for c in df.columns if c != "color"), *(F.col(f"color.{c}").cast("int").alias(c) for c in ("red", "green", "blue")))


# --- SQL ----------------------------------------------------------------------------------------

LINE = """(select l_quantity as x, l_extendedprice/cast(1000 as double) as y,
 date_diff('day', timestamp '1995-01-01', l_shipdate)*cast(0.04 as double) as z,
 cast(l_partkey%256 as int) as red, cast(l_suppkey*2%256 as int) as green, cast(l_linenumber*36%256 as int) as blue,
 cast(l_tax*100 as float) as intensity, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) p"""
EVENT = """(select event_id, value as x, cast(user_id as double) as y,
 cast(epoch_us(ts)-1704067200000000 as double)/cast(3600000000 as double) as z from events) p"""
ECEF = """(select o_orderkey, lat, lon, h, (nn+h)*cos(lat)*cos(lon) as x, (nn+h)*cos(lat)*sin(lon) as y, (nn*(1-e2)+h)*sin(lat) as z
 from (select *, cast(6378137 as double)/sqrt(1-e2*sin(lat)*sin(lat)) as nn
  from (select o_orderkey, radians(-80+((o_custkey*37)%16000)/cast(100 as double)) as lat,
   radians(-180+((o_orderkey*7919)%36000)/cast(100 as double)) as lon, o_totalprice/cast(1000 as double) as h,
   cast(0.0066943799901413165 as double) as e2 from orders) a) b) p"""


def _num(v: float) -> str:
    return f"cast({float(v)!r} as double)"


def _in_box(b: Aabb) -> str:
    return " and ".join(f"{c} >= {_num(a)} and {c} < {_num(h)}" for c, a, h in zip("xyz", b.low, b.high, strict=True))


def _octal(depth: int, cube: Cube = ROOT) -> str:
    n = float(1 << depth)
    cell = [f"cast(greatest(0, least({(1 << depth) - 1}, ceil(({c}-{_num(a)})/{_num(cube.edge)}*{_num(n)})-1)) as bigint)" for c, a in zip("xyz", cube.low, strict=True)]
    digits = [f"cast(((({cell[0]})>>{k})&1)*4+((({cell[1]})>>{k})&1)*2+((({cell[2]})>>{k})&1) as varchar)" for k in range(depth - 1, -1, -1)]
    return "'r'||" + "||".join(digits)


_LINE_COLUMNS = "x, y, z, red, green, blue, intensity, l_orderkey, l_linenumber, l_partkey, l_suppkey"
_SIDE = RASTER.edge / RASTER.tiles


def _pixels(source: str) -> str:
    tile = lambda c: f"cast(greatest(0, least({RASTER.tiles - 1}, floor(({c}-{_num(0)})/{_num(_SIDE)}))) as int)"
    inner = f"select *, {tile('x')} as tile_x, {tile('y')} as tile_y from {source}"
    cut = lambda v: f"cast(floor(greatest({_num(0)}, least({_num(2**31 - 1)}, {v}))) as int)"
    fx, fy = (f"(({c}-{_num(0)})/{_num(_SIDE)}-tile_{c})" for c in "xy")
    return f"""(select * from (select *, {cut(f'{fx}*{RASTER.tile_px}')} as px, {cut(f'({_num(1)}-{fy})*{RASTER.tile_px}')} as py,
 {cut(f'(z-{_num(0)})/{_num(100)}*{xray.Z_BUCKETS}')} as pz from ({inner}) t) u where px < {RASTER.tile_px} and py < {RASTER.tile_px}) q"""


_KEY = "tile_x, tile_y, px, py"


def _byte(v: str) -> str:
    return f"cast(floor(greatest({_num(0)}, least({_num(255)}, coalesce({v}, {_num(0)})*{_num(255)}))) as int)"


def _grey(v: str, source: str) -> str:
    return f"select {_KEY}, {v} as red, {v} as green, {v} as blue, 255 as alpha from {source}"


def _clip_row(k: int, p: tuple[str, str, str], clip: np.ndarray = CLIP) -> str:
    return "(" + "+".join(f"{v}*{_num(m)}" for v, m in zip(p, clip[k, :3], strict=True)) + f"+{_num(clip[k, 3])})"


def _frustum(clip: np.ndarray = CLIP) -> str:
    p = ("x", "y", "z")
    row = [_clip_row(k, p, clip) for k in range(4)]
    return f"{row[3]} <> 0 and " + " and ".join(f"{v}/{row[3]} > -1 and {v}/{row[3]} < 1" for v in row[:3])


def _screen() -> str:
    sides: tuple[list[str], list[str]] = ([], [])
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                p = (f"(min_x+edge*{dx})", f"(min_y+edge*{dy})", f"(min_z+edge*{dz})")
                for k in (0, 1):
                    sides[k].append(f"greatest({_num(-1)}, least({_num(1)}, {_clip_row(k, p)}/{_clip_row(3, p)}))")
    a, b = (f"(greatest({','.join(s)})-least({','.join(s)}))" for s in sides)
    return f"{a}*{b}"


def _nodes_sql(depth: int) -> str:
    digit = lambda k: f"cast(substr(node_id, {k + 1}, 1) as bigint)"
    cell = lambda axis: "(" + "+".join(f"(({digit(k)}>>{2 - axis})&1)*{1 << depth - k}" for k in range(1, depth + 1)) + ")"
    edge = ROOT.edge / (1 << depth)
    lows = ", ".join(f"{_num(0)}+{cell(a)}*{_num(edge)} as min_{c}" for a, c in enumerate("xyz"))
    return f"(select node_id, num_points, {_num(edge)} as edge, {lows} from (select {_octal(depth)} as node_id, count(*) as num_points from {EVENT} group by 1) a) n"


def _latlon() -> tuple[str, str]:
    t = f"atan2(z*{_num(geodesy.A)}, sqrt(x*x+y*y)*{_num(geodesy.B)})"
    lat = f"atan2(z+{_num(geodesy.EP2 * geodesy.B)}*pow(sin({t}),3), sqrt(x*x+y*y)-{_num(geodesy.E2 * geodesy.A)}*pow(cos({t}),3))"
    return lat, "atan2(y, x)"


def _mercator(lat: str, lon: str) -> tuple[str, str]:
    s = f"sin(greatest({_num(-geodesy.LAT_BOUND_RAD)}, least({_num(geodesy.LAT_BOUND_RAD)}, {lat})))"
    return f"({_num(0.5)}+{lon}/{_num(2 * np.pi)})", f"({_num(0.5)}-ln((1+{s})/(1-{s}))/{_num(4 * np.pi)})"


def _s2_tokens(level: int) -> str:
    """ECEF rows with the token of their S2 cell: the curve's digits by one join a level with its rules."""
    face = """case when abs(x) >= abs(y) and abs(x) >= abs(z) then case when x < 0 then 3 else 0 end
 when abs(y) >= abs(z) then case when y < 0 then 4 else 1 end else case when z < 0 then 5 else 2 end end"""
    u = "case face when 0 then y/x when 1 then -x/y when 2 then -x/z when 3 then z/x when 4 then z/y else -y/z end"
    v = "case face when 0 then z/x when 1 then z/y when 2 then -y/z when 3 then y/x when 4 then -x/y else -x/z end"
    n = 1 << level
    half = "0.5*sqrt(1+3*abs({0}))"
    cell = lambda t: f"cast(greatest(0, least({n - 1}, floor((case when {t} >= 0 then {half.format(t)} else 1-{half.format(t)} end)*{n}))) as int)"
    rules = ", ".join(f"({o}, {ij}, {k}, {o ^ turn})" for o in range(4) for k, (ij, turn) in enumerate(zip(s2._POS_TO_IJ[o], s2._POS_TO_ORIENTATION, strict=True)))
    rows = f"(select o_orderkey, face, {cell('u')} as i, {cell('v')} as j, face & 1 as o, 0 as pos from (select *, {u} as u, {v} as v from (select *, {face} as face from {ECEF}) a) b)"
    for bit in range(level - 1, -1, -1):
        rows = f"(select o_orderkey, face, i, j, r.turned as o, pos*4+r.k as pos from {rows} p{bit} join (values {rules}) r(o, ij, k, turned) on r.o = p{bit}.o and r.ij = ((i>>{bit})&1)*2+((j>>{bit})&1))"
    spare = -(4 + 2 * level) % 4  # bits up to the next hexadecimal digit
    digits = (4 + 2 * level + spare) // 4
    return f"(select o_orderkey, lpad(lower(to_hex(((face::bigint << {2 * level + 1}) + pos*2+1) << {spare})), {digits}, '0') as token from {rows} c) s"


# --- queries ------------------------------------------------------------------------------------


def _line(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(views.line_cloud(spark, d))


def _events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(views.event_cloud(spark, d))


def _orders(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(views.ecef_cloud(spark, d))


def _key(df: DataFrame, depth: int) -> DataFrame:
    return build.with_path(df, ROOT, depth, "node_id")


#: Folders of the clouds that were built and stored in this process, by application, tables and name.
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], PointCloud]) -> PointCloud:
    """A cloud over the tables, built and written when it is first asked for (or if it has gone), then opened."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STORED:
        try:
            return PointCloud.open(spark, _STORED[key])
        except AnalysisException:  # the shared folder was cleared
            del _STORED[key]
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made().write(folder)
    _STORED[key] = folder
    return PointCloud.open(spark, folder)


def _built(spark: SparkSession, sf_dir: str) -> PointCloud:
    return PointCloud.of_octree(build.build_octree(views.event_cloud(spark, sf_dir), RESOLUTION, ["event_id"], NODE_POINTS))


def _octree(spark: SparkSession, sf_dir: str) -> PointCloud:
    return _stored(spark, sf_dir, "octree", lambda: _built(spark, sf_dir))


def _half(spark: SparkSession, sf_dir: str, k: int) -> PointCloud:
    """Every other event."""

    def made() -> PointCloud:
        points = views.event_cloud(spark, sf_dir).where(F.col("event_id") % 2 == k)
        return PointCloud.of_octree(build.build_octree(points, RESOLUTION, ["event_id"], NODE_POINTS))

    return _stored(spark, sf_dir, f"half{k}", made)


def _s2_cloud(spark: SparkSession, sf_dir: str) -> PointCloud:
    return _stored(spark, sf_dir, "s2", lambda: PointCloud.of_s2(build.build_s2(views.ecef_cloud(spark, sf_dir), 6)))


def _octree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _octree(spark, sf_dir).query(PointQuery(["event_id"], EVENT_BOX)).select("event_id", *POSITION)


def _octree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).nodes.select("node_id", "level", "num_points", "position_encoding")


def _octree_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _octree(spark, sf_dir).points.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids")).agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.visible_nodes(_octree(spark, sf_dir).nodes, CLIP).select("rank", "node_id", "num_points")


def _top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _key(views.event_cloud(spark, sf_dir), 3).groupBy("node_id").agg(F.count(F.lit(1)).alias("num_points"))
    top = lod.top_nodes(build.node_table(counts, ROOT, RESOLUTION).withColumn("s", F.lit(0)), CLIP, 20)
    return top.select("node_id", "num_points", F.round("screen_size", 9).alias("screen_size"))


def _every_8th(df: DataFrame) -> DataFrame:
    return build.sampled_up(_key(df, 2), "node_id", ["event_id"]).where("_up").select("event_id", "node_id")


def _neighbour(df: DataFrame) -> DataFrame:
    depth = 5
    n = df.select(ids.cell_of(F.col("x"), 0.0, 64.0, depth, True).alias("qx"), ids.cell_of(F.col("y"), 0.0, 128.0, depth, True).alias("qy")).groupBy("qx", "qy").agg(F.count(F.lit(1)).alias("n"))
    right = n.select((F.col("qx") - 1).alias("qx"), "qy", F.col("n").alias("n_right"))
    return n.join(right, ["qx", "qy"]).select(ids.quad_path(F.col("qx"), F.col("qy"), depth).alias("node_id"), "n", "n_right")


def _quadkeys(df: DataFrame) -> DataFrame:
    depth = 5
    key = ids.interleave(ids.cell_of(F.col("x"), 0.0, 64.0, depth, True), ids.cell_of(F.col("y"), 0.0, 128.0, depth, True), depth)
    n = df.select(key.alias("quadkey")).groupBy("quadkey").agg(F.count(F.lit(1)).alias("n"))
    x, y = ids.deinterleave(F.col("quadkey"), depth)
    return n.select("quadkey", x.alias("qx"), y.alias("qy"), "n")


def _bbox(df: DataFrame) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in POSITION for n, f in (("min", F.min), ("max", F.max))))


def _render(strategy: xray.Strategy) -> Query:
    return _line(lambda df: xray.render(df, RASTER, RASTER_BOX, strategy).select("tile_x", "tile_y", "px", "py", "red", "green", "blue", "alpha"))


def _s2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build_s2(views.ecef_cloud(spark, sf_dir), 6).nodes.select("token", "num_points")


def _union_cells() -> CellUnion:
    leaf = s2.leaf_cells(geodesy.ecef_np([0.3, 0.9, -0.5], [0.2, 1.5, -2.0], [0, 0, 0]))
    return CellUnion(tuple(int(c) for c in s2.parents(leaf, 3)))


def _s2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _s2_cloud(spark, sf_dir).query(PointQuery(["o_orderkey"], _union_cells())).select("o_orderkey")


def _rect_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _s2_cloud(spark, sf_dir).query(PointQuery(["o_orderkey"], RECT)).select("o_orderkey")


def _ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    ply.write_folder(views.line_cloud(spark, sf_dir), folder)
    return _flat(ply.read(spark, folder)).select(*_LINE_COLUMNS.split(", "))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = xray.render(views.line_cloud(spark, sf_dir), RASTER, RASTER_BOX, xray.XRay())
    return staged(pyramid.tile_images(pixels, RASTER.level, RASTER.tile_px), "leaves")


def _pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = (255, 255, 255, 255)
    levels = pyramid.build_levels(pyramid.with_background(_tiles(spark, sf_dir), white), RASTER.level, 0, RASTER.tile_px, white)
    return pyramid.node_ids(levels).select("node_id", "level", "png")


def _inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.inpainted(_tiles(spark, sf_dir), 3, RASTER.tile_px).select("tile_x", "tile_y", "png")


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir)
    level1 = pyramid.build_levels(tiles, RASTER.level, 1, RASTER.tile_px)
    halves = [level1.where((F.col("tile_x") < (F.when(F.col("level") == 2, 2).otherwise(1))) == left) for left in (True, False)]
    # Each half holds the nodes below one side of the first level.
    return pyramid.node_ids(pyramid.merged(halves, ["r0", "r2"], RASTER.tile_px)).select("node_id", "level", "png")


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Client([_half(spark, sf_dir, k) for k in (0, 1)]).query(PointQuery(["event_id"], EVENT_BOX)).select("cloud_id", "event_id")


def _encode(df: DataFrame) -> DataFrame:
    low, edge = F.lit(ROOT.low[0]), F.lit(ROOT.edge)
    code = df.select("event_id", codec.encode(F.col("x"), low, edge, "U16").alias("code"))
    return code.select("event_id", "code", F.round(codec.decode(F.col("code"), low, edge, "U16"), 9).alias("decoded"))


def _mercator_query(df: DataFrame) -> DataFrame:
    mx, my = geodesy.mercator(F.col("lat"), F.col("lon"))
    return df.select("o_orderkey", F.round(mx, 9).alias("mx"), F.round(my, 9).alias("my"))


def _rounded(df: DataFrame, key: list[str], digits: int) -> DataFrame:
    return df.select(*key, *(F.round(c, digits).alias(c) for c in POSITION))


def _blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.line_cloud(spark, sf_dir).withColumns({"id": F.col("l_orderkey") * 8 + F.col("l_linenumber")})
    tree = build.build_octree(points.select(*POSITION, "color", "id"), RESOLUTION, ["id", *POSITION], 5000)
    return blob.node_blobs(tree.points, tree.nodes)


def queries() -> dict[str, Query]:
    line_columns = _LINE_COLUMNS.split(", ")
    return {
        "all_points": _line(lambda df: _flat(PointQuery().run(df)).select(*line_columns)),
        "projection": _line(lambda df: PointQuery(["intensity"]).run(df)),
        "aabb": _line(lambda df: _flat(PointQuery(None, BOX).run(df)).select(*line_columns)),
        "interval_filter": _line(lambda df: PointQuery(["intensity", "l_partkey"], intervals={"intensity": (2.0, 5.0), "l_partkey": (100, 900)}).run(df)),
        "aabb_and_interval": _line(lambda df: PointQuery(["intensity"], BOX, {"intensity": (2.0, 5.0)}).run(df)),
        "obb": _line(lambda df: PointQuery(["l_orderkey"], OBB).run(df)),
        "frustum": _line(lambda df: PointQuery(["l_orderkey"], FRUSTUM).run(df)),
        "bbox": _line(_bbox),
        "octree_key_counts": _events(lambda df: _key(df, 3).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))),
        "node_parent_counts": _events(lambda df: _key(df, 3).groupBy(ids.parent_path(F.col("node_id")).alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_children"))),
        "quadkey_xy_counts": _line(_quadkeys),
        "quadkey_right_neighbor": _line(_neighbour),
        "xray_density": _render(xray.XRay()),
        "xray_colored": _render(xray.Coloured()),
        "xray_colored_binned": _render(xray.Coloured(("l_linenumber", 2.0))),
        "xray_intensity": _render(xray.Intensity(low=0.0, high=8.0)),
        "xray_intensity_binned": _render(xray.Intensity(("l_linenumber", 2.0), 0.0, 8.0)),
        "xray_height_stddev": _render(xray.HeightStddev(most=40.0, colormap="jet")),
        "xray_monochrome": _render(xray.HeightStddev(most=40.0, colormap="purplish")),
        "touched_tiles": _line(lambda df: xray.touched_tiles(df, RASTER, RASTER_BOX)),
        "lod_every_8th": _events(_every_8th),
        "ecef_from_wgs84": _orders(lambda df: _rounded(df, ["o_orderkey"], 3)),
        "s2_radius_check": _orders(lambda df: df.groupBy(geodesy.valid_radius(*map(F.col, POSITION)).alias("valid")).agg(F.count(F.lit(1)).alias("n"))),
        "mercator_project": _orders(_mercator_query),
        "mercator_rect": _orders(lambda df: PointQuery(["o_orderkey"], RECT).run(df).select("o_orderkey")),
        "isometry_transform": _events(lambda df: _rounded(xray.isometry(df, TURN), ["event_id"], 6)),
        "position_encode_u16": _events(_encode),
        "colour_units": _line(lambda df: df.select("l_orderkey", *(colour.to_byte(colour.to_unit(F.col(f"color.{c}")) * 0.5).alias(c) for c in ("red", "green", "blue")))),
        "multi_cloud_union": _multi,
        "topn_nodes": _top_nodes,
        "octree_query_pruned": _octree_query,
        "octree_each_point_once": _octree_level,
        "octree_build": _octree_nodes,
        "visible_nodes": _visible,
        "s2_partition": _s2_cells,
        "s2_union_query": _s2_query,
        "mercator_rect_pruned": _rect_pruned,
        "pyramid": _pyramid,
        "inpaint": _inpaint,
        "merge": _merge,
        "node_blob": _blob,
        "ply_roundtrip": _ply,
    }


def oracle_sql() -> dict[str, str]:
    q = {
        "all_points": f"select {_LINE_COLUMNS} from {LINE}",
        "projection": f"select x, y, z, intensity from {LINE}",
        "aabb": f"select {_LINE_COLUMNS} from {LINE} where {_in_box(BOX)}",
        "interval_filter": f"select x, y, z, intensity, l_partkey from {LINE} where intensity between 2.0 and 5.0 and l_partkey between 100 and 900",
        "aabb_and_interval": f"select x, y, z, intensity from {LINE} where {_in_box(BOX)} and intensity between 2.0 and 5.0",
        "frustum": f"select x, y, z, l_orderkey from {LINE} where {_frustum()}",
        "bbox": f"select {', '.join(f'{f}({c}) as {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} from {LINE}",
        "octree_key_counts": f"select {_octal(3)} as node_id, count(*) as n from {EVENT} group by 1",
        "node_parent_counts": f"select substr(k, 1, length(k)-1) as parent, count(*) as n, count(distinct k) as n_children from (select {_octal(3)} as k from {EVENT}) a group by 1",
        "ecef_from_wgs84": f"select o_orderkey, round(x,3)+0.0 as x, round(y,3)+0.0 as y, round(z,3)+0.0 as z from {ECEF}",
        "s2_radius_check": f"select sqrt(x*x+y*y+z*z) between 6352800 and 6384400 as valid, count(*) as n from {ECEF} group by 1",
        "octree_query_pruned": f"select event_id, x, y, z from {EVENT} where {_in_box(EVENT_BOX)}",
        "octree_each_point_once": "select cast(count(*) as bigint) as n, cast(count(distinct event_id) as bigint) as n_ids from events",
        "multi_cloud_union": f"select cast(event_id % 2 as int) as cloud_id, event_id from {EVENT} where {_in_box(EVENT_BOX)}",
        "lod_every_8th": f"select event_id, node_id from (select event_id, node_id, row_number() over (partition by node_id order by event_id)-1 as k from (select event_id, {_octal(2)} as node_id from {EVENT}) a) b where k % 8 = 0",
        "position_encode_u16": f"select event_id, code, round(code/{_num(65535)}*{_num(ROOT.edge)}+{_num(0)}, 9) as decoded from (select event_id, cast(floor(greatest({_num(0)}, least({_num(1)}, (x-{_num(0)})/{_num(ROOT.edge)}))*65535) as int) as code from {EVENT}) a",
        "colour_units": f"select l_orderkey, {', '.join(_byte(f'{c}/{_num(255)}*{_num(0.5)}') + ' as ' + c for c in ('red', 'green', 'blue'))} from {LINE}",
        "topn_nodes": f"select node_id, num_points, round(s, 9) as screen_size from (select *, {_screen()} as s from {_nodes_sql(3)}) a order by s desc, node_id limit 20",
        "touched_tiles": f"select tile_x, tile_y, count(*) as num_points from (select cast(greatest(0, least(3, floor((x-{_num(0)})/{_num(_SIDE)}))) as int) as tile_x, cast(greatest(0, least(3, floor((y-{_num(0)})/{_num(_SIDE)}))) as int) as tile_y from {LINE}) a group by 1, 2",
    }
    r, c, h = OBB.rotation, OBB.centre, OBB.half
    q["obb"] = f"select x, y, z, l_orderkey from {LINE} where " + " and ".join(f"abs((x-{_num(c[0])})*{_num(r[0][k])}+(y-{_num(c[1])})*{_num(r[1][k])}+(z-{_num(c[2])})*{_num(r[2][k])}) <= {_num(h[k])}" for k in range(3))
    rows = [f"round({'+'.join(f'{v}*{_num(m)}' for v, m in zip('xyz', TURN[k, :3], strict=True))}+{_num(TURN[k, 3])}, 6)+0.0 as {'xyz'[k]}" for k in range(3)]
    q["isometry_transform"] = f"select event_id, {', '.join(rows)} from {EVENT}"
    mx, my = _mercator("lat", "lon")
    q["mercator_project"] = f"select o_orderkey, round({mx}, 9) as mx, round({my}, 9) as my from {ECEF}"
    lat, lon = _latlon()
    mx, my = _mercator("la", "lo")
    q["mercator_rect"] = f"select o_orderkey from (select o_orderkey, {mx} as mx, {my} as my from (select o_orderkey, {lat} as la, {lon} as lo from {ECEF}) a) b where mx >= {RECT.west!r} and mx < {RECT.east!r} and my >= {RECT.north!r} and my < {RECT.south!r}"
    q["mercator_rect_pruned"] = q["mercator_rect"]
    q["s2_partition"] = f"select token, count(*) as num_points from {_s2_tokens(6)} group by 1"
    wanted = ", ".join(f"'{s2.token(c)}'" for c in _union_cells().cells)
    q["s2_union_query"] = f"select o_orderkey from {_s2_tokens(3)} where token in ({wanted})"
    q["ply_roundtrip"] = q["all_points"]
    cell = lambda c, e: f"cast(greatest(0, least(31, floor(({c}-{_num(0)})/{_num(e)}*{_num(32)}))) as bigint)"
    grid = f"(select {cell('x', 64)} as qx, {cell('y', 128)} as qy, count(*) as n from {LINE} group by 1, 2)"
    key = "+".join(f"((qx>>{k})&1)*{2 << 2 * k}+((qy>>{k})&1)*{1 << 2 * k}" for k in range(5))
    q["quadkey_xy_counts"] = f"select cast({key} as bigint) as quadkey, qx, qy, n from {grid} g"
    path = "'r'||" + "||".join(f"cast(((a.qx>>{k})&1)*2+((a.qy>>{k})&1) as varchar)" for k in range(4, -1, -1))
    q["quadkey_right_neighbor"] = f"select {path} as node_id, a.n, b.n as n_right from {grid} a join {grid} b on b.qx = a.qx+1 and b.qy = a.qy"
    pix = _pixels(LINE)
    grey = _byte(f"round({_num(1)}-ln(cast(n as double))/{_num(np.log(xray.Z_BUCKETS))}, 9)")
    q["xray_density"] = _grey(grey, f"(select {_KEY}, count(distinct pz) as n from {pix} group by {_KEY}) a")
    channels = ("red", "green", "blue")

    def coloured(inner: str) -> str:
        return f"select {_KEY}, {', '.join(f'cast(floor(round(avg({c}),6)) as int) as {c}' for c in channels)}, 255 as alpha from {inner} group by {_KEY}"

    means = lambda source, b: f"(select {_KEY}, {b} as bin, {', '.join(f'avg({c}) as {c}' for c in channels)} from {source} group by {_KEY}, {b}) a"
    bins = "cast(trunc(l_linenumber/cast(2 as double)) as bigint)"
    q["xray_colored"] = coloured(pix)
    q["xray_colored_binned"] = coloured(means(pix, bins))
    v = f"(greatest({_num(0)}, least({_num(8)}, i))-{_num(0)})"
    grey = _byte(f"case when {v} > 0 then round(ln({v})/{_num(np.log(8.0))}, 9) end")
    q["xray_intensity"] = _grey(grey, f"(select {_KEY}, avg(cast(intensity as double)) as i from {pix} where intensity >= 0 group by {_KEY}) a")
    q["xray_intensity_binned"] = _grey(grey, f"(select {_KEY}, avg(i) as i from (select {_KEY}, {bins} as b, avg(cast(intensity as double)) as i from {pix} where intensity >= 0 group by {_KEY}, {bins}) c group by {_KEY}) a")
    dev = f"(select {_KEY}, least({_num(1)}, greatest({_num(0)}, least(round(stddev_pop(z), 6), {_num(40)})/{_num(40)})) as t from {pix} group by {_KEY}) a"
    ramp = lambda t: f"case when {t} <= -0.75 then {_num(0)} when {t} <= -0.25 then ({t}+0.75)*2.0 when {t} <= 0.25 then {_num(1)} when {t} <= 0.75 then {_num(1)}-({t}-0.25)*2.0 else {_num(0)} end"
    parts = (ramp("(t-0.5)"), ramp("t"), ramp("(t+0.5)"))
    q["xray_height_stddev"] = f"select {_KEY}, {', '.join(_byte(f'round({p}, 9)') + f' as {c}' for p, c in zip(parts, channels, strict=True))}, 255 as alpha from {dev}"
    parts = tuple(f"({_num(1)}-t)*{_num(k)}" for k in colour.PURPLISH)
    q["xray_monochrome"] = f"select {_KEY}, {', '.join(_byte(f'round({p}, 9)') + f' as {c}' for p, c in zip(parts, channels, strict=True))}, 255 as alpha from {dev}"
    return q
