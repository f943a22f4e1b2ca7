import heapq
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.functions import attributes, codec, colour, geodesy, ids, s2
from voxelake.operators import build, lod, pyramid, query, summary, xray
from voxelake.operators.geometry import (
    CROSS, IN, OUT, Aabb, AllPoints, CellUnion, Cube, Frustum, Hull, MercatorRect, Obb, box_columns, box_corners, perspective, perspective_fov,
)
from voxelake.operators.summary import Summary
from voxelake import commands, staging
from voxelake.plans import pyramids, sql
from voxelake.plans.cloud import Client, PointCloud, Providers
from voxelake.sources import blob, meta, ply, png, rawnode, synthetic, terrain
from voxelake.streaming import delivery


@pytest.fixture(scope="module")
def points(spark):
    df = synthetic.local_box(spark, 6000, 11).withColumn("intensity", attributes.tagged(F.col("id") % 7, "intensity", "F32"))
    return df.select("id", "x", "y", "z", "color", attributes.tagged(F.col("intensity"), "intensity", "F32")).cache()


@pytest.fixture(scope="module")
def tree(points):
    t = build.build_octree(points, 0.5, ["id"], 300)
    return build.Octree(t.points.cache(), t.nodes.cache(), t.box, t.resolution)


def rows(df):
    return sorted(map(tuple, df.collect()))


# --- ids, codecs, colours, geodesy --------------------------------------------------------------


def test_octree_ids():
    cube = Cube((-5.0, -5.0, -5.0), 10.0).node("r13")
    assert cube.low == (-5.0, -2.5, 2.5) and cube.edge == 2.5
    assert ids.parent("r123456") == "r12345" and ids.parent("r") is None and ids.child_index("r13") == 3
    for node in ("r", "r0", "r123456", "r" + "7" * 40):
        assert ids.octree_unwire(*ids.octree_wire(node)) == node
        assert ids.octree_node(ids.level(node), *ids.octree_index(node)) == node
    assert ids.octree_unwire(0, 0, 2, 0o13) == "r13"
    with pytest.raises(ValueError):
        ids.checked("r8", 8)


def test_quadtree_ids():
    assert ids.quad_index("r301") == (3, 4, 5) and ids.quad_node(3, 4, 5) == "r301"
    assert ids.quad_from_number(6, ids.quad_number("r123323")) == "r123323"
    assert ids.quad_neighbour("r301", "right") == ids.quad_node(3, 5, 5)
    assert ids.quad_neighbour("r0", "left") is None and ids.quad_neighbour("r0", "top") == "r1"


def test_columns_agree_with_ids(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    x, y = ids.deinterleave(ids.interleave(F.col("x"), F.col("y"), 3), 3)
    for r in df.select("x", "y", ids.quad_path(F.col("x"), F.col("y"), 3).alias("p"), x.alias("bx"), y.alias("by"), ids.octree_path(F.col("x"), F.col("y"), F.col("x"), 3).alias("o")).collect():
        assert r.p == ids.quad_node(3, r.x, r.y) and (r.bx, r.by) == (r.x, r.y) and r.o == ids.octree_node(3, r.x, r.y, r.x)


def test_cells_on_borders(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 0.5000001, 1.0, 2.0, -1.0)], "v double")
    assert [r[0] for r in df.select(ids.cell_of(F.col("v"), 0.0, 1.0, 1)).collect()] == [0, 0, 1, 1, 1, 0]
    assert [r[0] for r in df.select(ids.cell_of(F.col("v"), 0.0, 1.0, 1, True)).collect()] == [0, 1, 1, 1, 1, 0]


def test_codecs(spark):
    for name, tolerance in (("U8", 1e-2), ("U16", 1e-4), ("F32", 1e-7), ("F64", 1e-14)):
        low, edge, v = np.array([40.0]), 2.0, np.array([41.33333])
        assert abs(codec.decode_np(codec.encode_np(v, low, edge, name), low, edge, name) - v)[0] < tolerance * 2
        c = codec.encode(F.lit(41.33333), F.lit(40.0), F.lit(2.0), name)
        assert abs(spark.range(1).select(codec.decode(c, F.lit(40.0), F.lit(2.0), name)).first()[0] - 41.33333) < tolerance * 2
    assert [codec.choose(e, 0.001) for e in (0.1, 10, 1000, 1e6)] == ["U8", "U16", "F32", "F64"]
    got = spark.createDataFrame([(e,) for e in (0.1, 10.0, 1000.0, 1e6)], "e double").select(codec.choose_column(F.col("e"), 0.001)).collect()
    assert [r[0] for r in got] == ["U8", "U16", "F32", "F64"]


def test_colours(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (7.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(colour.to_byte(F.col("v"))).collect()] == [0, 63, 127, 255, 255, 0]
    r, g, b = colour.jet(F.col("v"))
    assert [tuple(x) for x in df.limit(4).select(r, g, b).collect()] == [(0.5, 1.0, 0.5), (1.0, 1.0, 0.0), (1.0, 0.5, 0.0), (0.5, 0.0, 0.0)]
    assert df.limit(1).select(*colour.monochrome(F.col("v"))).first() == (0.8, 0.8, 1.0)


def test_geodesy_round_trips(spark):
    r = np.random.default_rng(4)
    lat, lon, h = r.uniform(-1.45, 1.45, 200), r.uniform(-3.1, 3.1, 200), r.uniform(-400, 9000, 200)
    p = geodesy.ecef_np(lat, lon, h)
    assert np.abs(geodesy.latitude_longitude_np(p) - np.stack([lat, lon], -1)).max() < 1e-10
    frame = geodesy.local_frame(lat[0], lon[0])
    up = frame[:3, :3] @ geodesy.ecef_np(lat[0], lon[0], 10.0) + frame[:3, 3]
    assert np.allclose(up, [0, 0, 10], atol=1e-6)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(lat, lon, strict=True)], "lat double, lon double")
    mx, my = geodesy.mercator(F.col("lat"), F.col("lon"))
    la, lo = geodesy.unmercator(F.col("mx"), F.col("my"))
    for a in df.select("*", mx.alias("mx"), my.alias("my")).select("*", la.alias("la"), lo.alias("lo")).collect():
        assert abs(a.la - a.lat) < 1e-9 and abs(a.lo - a.lon) < 1e-9
    # A known place at zoom 19.
    one = spark.range(1).select(*geodesy.mercator(F.lit(math.radians(37.407204)), F.lit(math.radians(-122.147604)))).first()
    assert abs(one[0] * 256 * 2**19 - (84253 * 256 + 165)) < 20 and abs(one[1] * 256 * 2**19 - (203324 * 256 + 18)) < 20
    assert spark.range(1).select(geodesy.zoomed(F.lit(0.5), 24)).first()[0] is None
    assert tuple(spark.range(1).select(*geodesy.unzoomed(F.lit(256.0), F.lit(0.0), 0)).first()) == (None, None)


def test_s2_cells():
    r = np.random.default_rng(0)
    p = r.standard_normal((400, 3))
    leaves = s2.leaf_cells(p)
    for c, q in zip(leaves.tolist(), p, strict=True):
        assert np.dot(s2.direction(c), q / np.linalg.norm(q)) > 1 - 1e-12
        up = int(s2.parents(np.array([c], np.uint64), 7)[0])
        low, high = s2.leaf_range(up)
        assert low <= c <= high and s2.from_token(s2.token(up)) == up and s2.level_of(np.array([up], np.uint64))[0] == 7
    assert s2.token(int(s2.parents(s2.leaf_cells([[1, 0, 0]]), 0)[0])) == "1"
    assert s2.normalised(s2.children(up)) == [up] and s2.normalised([up, *s2.children(up)]) == [up]


def test_leaf_cells_as_columns(spark):
    """All over the Earth, and at poles, face borders and corners, the centre and a NaN."""
    r = np.random.default_rng(8)
    p = r.standard_normal((20_000, 3)) * 6.4e6
    p[:2000, 1] = p[:2000, 0]
    p[2000:4000, 2] = -p[2000:4000, 1]
    special = np.array([v for v in np.ndindex(3, 3, 3)], float) - 1
    p = np.concatenate([p, special, special * 6.4e6])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "k long, x double, y double, z double")
    found = df.select("k", s2.leaf_column(*map(F.col, "xyz")).alias("leaf"))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert [x["leaf"] for x in found.orderBy("k").collect()] == s2.leaf_cells(p).view(np.int64).tolist()
    nan = spark.createDataFrame([(float("nan"), 1.0, 1.0), (None, 1.0, 1.0)], "x double, y double, z double")
    assert [x[0] for x in nan.select(s2.leaf_column(*map(F.col, "xyz"))).collect()] == [None, None]


# --- geometry -----------------------------------------------------------------------------------


def how(spark, location, low, high):
    """The relation of each box to a location."""
    boxes = [(k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    df = spark.createDataFrame(boxes, "k int, " + ", ".join(f"{e}_{c} double" for e in ("min", "max") for c in "xyz"))
    return [r[0] for r in df.orderBy("k").select(location.relation(*box_columns())).collect()]


def plain_relation(location, low, high):
    """Of one box, by the corners of both."""
    hull, box = location.hull(), box_corners(low, high)
    axes = [v for v in (*hull.normals, *np.eye(3), *(np.cross(a, b) for a in hull.edges for b in np.eye(3))) if np.linalg.norm(v) > 1e-9]
    a, b = hull.corners @ np.array(axes).T, box @ np.array(axes).T
    if ((a.min(0) > b.max(0)) | (b.min(0) > a.max(0))).any():
        return OUT
    return IN if ((b.min(0) >= a.min(0)) & (b.max(0) <= a.max(0))).all() else CROSS


def test_separating_axes(spark):
    a, b, c = (Aabb((-1.0,) * 3, (1.0,) * 3), Aabb((-0.5,) * 3, (1.5,) * 3), Aabb((-0.9,) * 3, (-0.7,) * 3))
    rel = lambda x, y: how(spark, x, [y.low], [y.high])[0]
    assert rel(a, b) == CROSS and rel(a, c) == IN and rel(c, a) == CROSS
    assert rel(b, Aabb((-3.0,) * 3, (-2.0,) * 3)) == OUT and rel(a, Aabb((1.0,) * 3, (2.0,) * 3)) == CROSS  # touching


def test_frustum_of_pose(spark):
    turn = np.diag([1.0, -1.0, -1.0, 1.0])
    f = Frustum.of_pose(turn, perspective(-0.5, 0.0, -0.5, 0.0, 1.0, 4.0))
    assert how(spark, f, [[-0.5, 0.25, 1.5]], [[-0.25, 0.5, 3.5]]) == [IN]
    with pytest.raises(ValueError):
        perspective(1, 0, 0, 1, 1, 2)
    assert Frustum.of_matrix(np.zeros((4, 4))) is None


LOCATIONS = [
    AllPoints(),
    Aabb((-40.0, -20.0, -5.0), (60.0, 50.0, 5.0)),
    Obb((10.0, 5.0, 0.0), ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (30.0, 50.0, 6.0)),
    Frustum.of_pose(np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 60.0], [0, 0, 0, 1]]), perspective_fov(1.0, 0.9, 1.0, 65.0)),
]


@pytest.mark.parametrize("location", LOCATIONS, ids=lambda v: type(v).__name__)
def test_pruned_query_equals_scan(points, tree, location):
    cloud = PointCloud.of_octree(tree)
    q = query.PointQuery(["id", "intensity"], location, {"intensity": (1.0, 4.0)})
    got = rows(cloud.query(q).select("id"))
    assert got == rows(q.run(points).select("id")) == rows(cloud.query(q, prune=False).select("id")) and got
    assert query.PointQuery.from_json(q.to_json()) == q
    inside, cross = cloud.nodes_in(location)
    if not isinstance(location, AllPoints):
        assert len(inside) + len(cross) < cloud.nodes.where("num_points > 0").count()


@pytest.mark.parametrize("location", LOCATIONS, ids=lambda v: type(v).__name__)
def test_nodes_told_by_tasks_give_the_same_rows(tree, monkeypatch, location):
    cloud, q = PointCloud.of_octree(tree), query.PointQuery(["id"], location)
    want = rows(cloud.query(q).select("id"))
    inside, cross = cloud.nodes_in(location)
    told = {r["node_id"]: r["inside"] for r in cloud.related(location).collect()}
    assert told == dict.fromkeys(inside, True) | dict.fromkeys(cross, False)
    monkeypatch.setattr("voxelake.plans.cloud.INLINE_NODES", 0)
    assert cloud.nodes_in(location) is None and rows(cloud.query(q).select("id")) == want
    assert "Python" not in cloud.related(location)._jdf.queryExecution().toString()


def test_neighbour_paths_agree_with_ids(spark):
    cells = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x long, y long")
    for name, dx, dy in ids.DIRECTIONS:
        for r in cells.select("x", "y", ids.neighbour_path(F.col("x"), F.col("y"), 2, dx, dy).alias("n")).collect():
            assert r["n"] == ids.quad_neighbour(ids.quad_node(2, r["x"], r["y"]), name)


def test_boundaries_and_nan(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.5, 0.5, 0.5), (float("nan"), 0.5, 0.5)], "x double, y double, z double")
    assert df.where(Aabb((0.0,) * 3, (1.0,) * 3).contains(*map(F.col, "xyz"))).count() == 2
    assert df.where(Obb.of_box(Aabb((0.0,) * 3, (1.0,) * 3)).contains(*map(F.col, "xyz"))).count() == 3
    assert df.where(query.within(F.col("x"), 0.5, 1.0)).count() == 2
    assert build.bounding_box(df.limit(0)) == Aabb.zero()


def test_query_errors(points):
    with pytest.raises(KeyError):
        query.PointQuery(["none"]).run(points)
    with pytest.raises(ValueError):
        query.PointQuery(["id"], intervals={"intensity": (0, 1)}).run(points)
    with pytest.raises(ValueError):
        query.PointQuery(["color"], intervals={"color": (0, 1)}).run(points)
    for bad in ("1", "1,2,3", "2,1"):
        with pytest.raises(ValueError):
            query.parse_interval(bad)
    assert query.parse_interval("1,2.5") == (1.0, 2.5) and query.parse_key_value("a=b=c") == ("a", "b=c")


def test_mercator_rect(spark):
    assert MercatorRect.of_pixels((0, 0), (10, 10), 24) is None and MercatorRect.of_pixels((0, 10), (10, 0), 2) is None
    r = np.random.default_rng(9)
    lat, lon = r.uniform(-1.2, 1.2, 400), r.uniform(-3.1, 3.1, 400)
    p = geodesy.ecef_np(lat, lon, 100.0)
    df = spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double")
    rect, wrapped = MercatorRect(0.3, 0.3, 0.6, 0.7), MercatorRect(0.9, 0.3, 0.1, 0.7)
    mx = 0.5 + lon / (2 * np.pi)
    my = 0.5 - np.log((1 + np.sin(lat)) / (1 - np.sin(lat))) / (4 * np.pi)
    assert df.where(rect.contains(*map(F.col, "xyz"))).count() == ((mx >= 0.3) & (mx < 0.6) & (my >= 0.3) & (my < 0.7)).sum()
    assert df.where(wrapped.contains(*map(F.col, "xyz"))).count() == (((mx >= 0.9) | (mx < 0.1)) & (my >= 0.3) & (my < 0.7)).sum()
    small = MercatorRect.of_pixels((84253.0, 203324.0), (84300.0, 203370.0), 11)
    centre = geodesy.ecef_np(*geodesy.unmercator_np((small.west + small.east) / 2, (small.north + small.south) / 2), 50.0)
    assert how(spark, small, centre[None] - 1, centre[None] + 1) == [CROSS]
    assert how(spark, small, -centre[None] - 1, -centre[None] + 1) == [OUT]


def test_token_of_no_cell(spark):
    cells = spark.createDataFrame([(0,), (1 << 60,), (None,)], "cell long")
    got = [r[0] for r in cells.select(s2.token_column(F.col("cell"))).collect()]
    assert got == [s2.token(0), s2.token(1 << 60), None] == ["X", "1", None]


def test_mercator_rect_limits():
    assert MercatorRect.of_pixels((0, 0), (200, 200), 0) is None and MercatorRect.of_pixels((0, 0), (0.5, 1.5), 0) is None
    assert MercatorRect.of_pixels((0, 0), (1, 1), 0) == MercatorRect(0.0, 0.0, 1 / 256, 1 / 256)
    assert MercatorRect.of_pixels((255.5, 10), (0.25, 10.5), 0) is not None  # over the date line


@pytest.fixture(scope="module")
def globe(spark):
    """Points all over the Earth and above it, some in dense spots, in small cells."""
    r = np.random.default_rng(12)
    lat, lon = np.arcsin(r.uniform(-1, 1, 3000)), r.uniform(-np.pi, np.pi, 3000)
    lat[:800], lon[:800] = r.normal(0.9, 0.05, 800), r.normal(np.pi, 0.1, 800)
    p = geodesy.ecef_np(lat, lon, r.uniform(-400, 6000, 3000))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    return PointCloud.of_s2(build.build_s2(df, 7))


ROUND = [MercatorRect(0.5 - w / 2, 0.3, 0.5 + w / 2, 0.3 + w) for w in (0.0005, 0.01, 0.05, 0.16, 0.5)]
ROUND += [MercatorRect(1 - w / 2, 0.25, w / 2, 0.25 + w) for w in (0.001, 0.02, 0.1, 0.6)]
ROUND += [MercatorRect(0.0, 0.0, 1.0, 0.1), MercatorRect(0.2, 0.8, 0.9, 1.0), MercatorRect(0.0, 0.0, 1.0, 1.0)]


def test_pruned_globe_equals_scan(globe):
    found, few = 0, 0
    for location in ROUND:
        q = query.PointQuery(["id"], location)
        got = rows(globe.query(q).select("id"))
        assert got == rows(globe.query(q, prune=False).select("id")) == rows(q.run(globe.points).select("id")), location
        found, few = found + len(got), few + (globe.related(location).count() < globe.nodes.count() / 4)
    assert found > 1000 and few >= 5
    x = 6378137.0
    for location in (Aabb((-x, 0.0, 0.0), (0.0, x, x)), Obb((0.0, 0.0, x), ((0.6, -0.8, 0.0), (0.8, 0.6, 0.0), (0.0, 0.0, 1.0)), (x, x / 2, x / 2))):
        q = query.PointQuery(["id"], location)
        assert rows(globe.query(q).select("id")) == rows(q.run(globe.points).select("id"))


def test_pruned_cells_equal_scan(globe):
    cells = [int(r["cell"]) & (1 << 64) - 1 for r in globe.nodes.orderBy(F.desc("num_points")).limit(3).collect()]
    wide = int(s2.parents(np.array(cells[:1], np.uint64), 2)[0])
    for location in (CellUnion((cells[0],)), CellUnion(tuple(cells)), CellUnion((wide, cells[2]))):
        q = query.PointQuery(["id"], location)
        found = globe.query(q)
        assert rows(found.select("id")) == rows(q.run(globe.points).select("id")) and found.count() > 0
        assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def test_relations_equal_plain(spark):
    r = np.random.default_rng(4)
    low = r.uniform(-70, 60, (300, 3)) * [1, 1, 0.5]
    high = low + r.uniform(0, 40, (300, 3))
    for location in LOCATIONS[1:]:
        want = [plain_relation(location, a, b) for a, b in zip(low, high, strict=True)]
        assert how(spark, location, low, high) == want and len(set(want)) == 3


def test_hulls_of_boxes_and_views():
    corners = np.array([[x, y, z] for x in (0, 2) for y in (0, 3) for z in (0, 5)], float)
    found = Hull.of_corners(corners)
    assert np.allclose(np.abs(found.edges), np.eye(3)) and np.allclose(np.abs(found.normals), np.eye(3))
    view = LOCATIONS[3].hull()
    # Two sides across, one for each of left, right, up and down; near and far planes are parallel.
    assert len(view.edges) == 6 and len(view.normals) == 5
    inside = view.corners.mean(0)
    for n in view.normals:
        assert (view.corners @ n).min() <= inside @ n <= (view.corners @ n).max()


# --- index builds -------------------------------------------------------------------------------


def test_octree_invariants(points, tree):
    assert rows(tree.points.select("id")) == rows(points.select("id"))
    counts = {r["node_id"]: r["num_points"] for r in tree.nodes.collect()}
    assert sum(counts.values()) == 6000 and all(n == "r" or n[:-1] in counts for n in counts)
    cube = Cube.around(tree.box)
    for r in tree.points.select("node_id", "x", "y", "z").collect():
        c = cube.node(r.node_id)
        assert all(a - 1e-9 <= v <= a + c.edge + 1e-9 for a, v in zip(c.low, (r.x, r.y, r.z), strict=True))
    for r in tree.nodes.collect():
        assert abs(r.edge - cube.node(r.node_id).edge) < 1e-9 and np.allclose((r.min_x, r.min_y, r.min_z), cube.node(r.node_id).low)
    near = build.encoded(tree.points, tree.nodes).select("id", F.col("x").alias("ex")).join(tree.points.select("id", "x"), "id")
    assert near.where(F.abs(F.col("x") - F.col("ex")) > 0.5).count() == 0


def plain_octree(pts, cube, depth, most):
    """Leaf and final node of each point, by loops over nodes; ``pts``: (id, x, y, z) by id."""

    def path(p):
        cells = [max(0, min((1 << depth) - 1, math.ceil((v - a) / cube.edge * (1 << depth)) - 1)) for v, a in zip(p[1:], cube.low, strict=True)]
        return ids.octree_node(depth, *cells)

    paths = {p[0]: path(p) for p in pts}
    lists, final = {}, {}

    def gather(node, own):
        if node != "r" and (len(own) <= most or len(node) > depth):
            return own
        out = []
        for k in range(8):
            child = f"{node}{k}"
            part = [i for i in own if paths[i].startswith(child)]
            if part:
                inner = gather(child, part)
                for at, i in enumerate(inner):
                    if at % 8 == 0:
                        out.append(i)
                    else:
                        final[i] = child
        return out

    for i in gather("r", sorted(paths)):
        final[i] = "r"
    return final


@pytest.mark.parametrize("most", [2, 40, 300])
def test_octree_equals_plain(spark, most, monkeypatch):
    monkeypatch.setattr(build, "CELL_ROWS", 10**9)
    r = np.random.default_rng(most)
    pts = [(k, *map(float, p)) for k, p in enumerate(np.concatenate([r.uniform(0, 100, (700, 3)), r.normal(30, 0.5, (500, 3)), np.full((60, 3), 7.0)]))]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    found = build.build_octree(df, 0.4, ["id"], most)
    depth = build.depth_for(Cube.around(found.box).edge, 0.4)
    want = plain_octree(pts, Cube.around(found.box), depth, most)
    assert {r["id"]: r["node_id"] for r in found.points.collect()} == want
    counts = {r["node_id"]: r["num_points"] for r in found.nodes.collect()}
    assert {n: k for n, k in counts.items() if k} == {n: list(want.values()).count(n) for n in set(want.values())}


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_octree_of_many_nodes(spark, monkeypatch, sent):
    pts = synthetic.local_box(spark, 4000, 3).select("id", "x", "y", "z").cache()
    few = build.build_octree(pts, 0.01, ["id"], 2)
    splits = few.nodes.count() - few.nodes.where("num_points > 0").count() + few.nodes.count() // 3
    assert splits > 1000
    want, tables = sorted(few.points.select("id", "node_id").collect()), sorted(few.nodes.select("node_id", "num_points").collect())
    monkeypatch.setattr(build, "BROADCAST_NODES", sent)
    many = build.build_octree(pts, 0.01, ["id"], 2)
    assert sorted(many.points.select("id", "node_id").collect()) == want
    assert sorted(many.nodes.select("node_id", "num_points").collect()) == tables


def test_identical_points(spark):
    df = spark.range(3001).select("id", *(F.when(F.col("id") == 0, v).otherwise(0.0).alias(c) for c, v in zip("xyz", (-200.0, -40.0, 30.0), strict=True)))
    t = build.build_octree(df, 1.0, ["id"], 500)
    assert t.points.count() == 3001 and t.nodes.agg(F.sum("num_points")).first()[0] == 3001


def test_large_nodes_are_numbered_exactly(spark, monkeypatch):
    monkeypatch.setattr(build, "CELL_ROWS", 100)
    df = spark.range(2000).select("id", F.lit("r").alias("node_id"))
    got = build.sampled_up(df, "node_id", ["id"])
    assert [r[0] for r in got.select("_at").orderBy("_at").collect()] == list(range(2000)) and got.where("_up").count() == 250


def test_large_nodes_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(build, "CELL_ROWS", 100)
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("id"), F.when(F.col("id") < 1950, "r1").otherwise("r2").alias("node_id")).repartition(5)
    got = build.sampled_up(df, "node_id", ["id"]).collect()
    for node in ("r1", "r2"):
        ids = sorted(r["id"] for r in got if r["node_id"] == node)
        assert {r["id"]: (r["_at"], r["_up"]) for r in got if r["node_id"] == node} == {k: (at, at % 8 == 0) for at, k in enumerate(ids)}


def test_s2_build(spark):
    pts = synthetic.ecef_box(spark, 2000, 5)
    cloud = PointCloud.of_s2(build.build_s2(pts, 16))
    assert cloud.num_points() == 2000
    cell = cloud.nodes.orderBy(F.desc("num_points")).first()["cell"] & (1 << 64) - 1
    q = query.PointQuery(["id"], CellUnion((int(cell),)))
    assert rows(cloud.query(q)) == rows(cloud.query(q, prune=False)) and cloud.query(q).count() > 0
    with pytest.raises(ValueError):
        build.build_s2(synthetic.local_box(spark, 10))


def test_cloud_files_and_client(spark, tree, tmp_path):
    cloud = PointCloud.of_octree(tree)
    cloud.write(f"file://{tmp_path}/cloud")
    again = Providers().register("mem:", lambda s, p: cloud).open(spark, f"file://{tmp_path}/cloud")
    assert again.num_points() == 6000 and again.box == cloud.box
    box = Aabb((-40.0, -20.0, -5.0), (60.0, 50.0, 5.0))
    plan = again.query(query.PointQuery(["id"], box))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(x" in plan
    client = Client([cloud, again], 1000)
    sizes = []
    n = client.for_each(query.PointQuery(["id"], box), lambda b: sizes.append(b.num_rows))
    assert n == sum(sizes) == 2 * cloud.query(query.PointQuery(["id"], box)).count() and set(sizes[:-1]) <= {1000}
    assert client.box == cloud.box
    with pytest.raises(ValueError):
        Client([])
    assert cloud.up_to_level(0).count() == cloud.node("r").count()


# --- summary trees ------------------------------------------------------------------------------


def grid_nodes(spark, side):
    """Nodes of a cubic grid of ``side`` unit cells, as an octree's table has them."""
    depth = side.bit_length() - 1
    cell = [F.expr(f"(id div {side**k}) % {side}").alias(c) for k, c in enumerate("xyz")]
    cells = spark.range(side**3).select(*cell)
    low = [F.col(c).cast("double").alias(f"min_{c}") for c in "xyz"]
    high = [(F.col(c) + 1).cast("double").alias(f"max_{c}") for c in "xyz"]
    return cells.select(ids.octree_path(*map(F.col, "xyz"), depth).alias("node_id"), F.lit(1).cast("long").alias("num_points"), *low, *high)


def scanned_rows(df):
    """Rows that the scans of a plan gave when it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()) if "Scan" in leaves.apply(k).nodeName())


@pytest.mark.parametrize("inline", [1000, 0])
def test_summary_tree_equals_scan(spark, tmp_path, monkeypatch, inline):
    monkeypatch.setattr(summary, "INLINE_BLOCKS", inline)
    table = grid_nodes(spark, 32 if not inline else 64)
    box = Aabb((0.0,) * 3, (64.0,) * 3)
    empty = spark.createDataFrame([], "node_id string, x double, y double, z double")
    path = f"file://{tmp_path}/cloud"
    PointCloud(empty, table.cache(), "node_id", box).write(path)
    cloud = PointCloud.open(spark, path)
    plain = PointCloud(empty, table, "node_id", box)
    assert len(cloud.summary.tiers) == 2
    assert cloud.summary.tiers[-1].agg(F.sum("num_points"), F.sum("members")).first() == (table.count(),) * 2
    some = [Aabb((3.5, 3.5, 3.5), (6.0, 9.0, 5.0)), Obb((20.0, 20.0, 20.0), ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (3.0, 8.0, 2.0))]
    for location in [*some, AllPoints(), Aabb((100.0,) * 3, (101.0,) * 3), LOCATIONS[3]]:
        assert rows(cloud.summary.related(location, "node_id")) == rows(plain.related(location)), location
    if inline:
        assert rows(cloud.related(some[0])) == rows(plain.related(some[0]))
        found = cloud.related(some[0])
        # Of 262,144 nodes some pages are read.
        assert scanned_rows(found) <= 12 * summary.PAGE_ROWS
        assert cloud.related(AllPoints()).where("inside").count() == 64**3


def test_summary_of_small_tables(spark):
    nodes = grid_nodes(spark, 4)
    assert Summary.of(nodes.limit(0), "node_id").related(AllPoints(), "node_id").count() == 0
    one = Summary.of(nodes, "node_id")
    assert len(one.tiers) == 1 and one.related(AllPoints(), "node_id").count() == 64


def test_staged_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(staging, "_WRITTEN", {})  # those of other tests stay
    kept = [staging.staged(spark.range(k + 1), "some") for k in range(3)]
    assert [df.count() for df in kept] == [1, 2, 3]
    folders = [f.removeprefix("file://").rsplit("/", 1)[0] for df in kept for f in df.inputFiles()[:1]]
    assert all(map(os.path.isdir, folders)) and staging.clear(spark) == 3 and not any(map(os.path.isdir, folders))
    assert staging.clear(spark) == 0


# --- views --------------------------------------------------------------------------------------


def plain_size(cube, clip):
    """Area of the box around a cube's corners on screen, in the order of the Column's sums."""
    sides = ([], [])
    for p in box_corners(cube.low, cube.high):
        row = lambda k: p[0] * clip[k, 0] + p[1] * clip[k, 1] + p[2] * clip[k, 2] + clip[k, 3]
        for k in (0, 1):
            sides[k].append(max(-1.0, min(1.0, row(k) / row(3) if row(3) else 0.0)))
    return (max(sides[0]) - min(sides[0])) * (max(sides[1]) - min(sides[1]))


def plain_walk(nodes, root, location):
    """The best-first walk with a queue: the largest open node is taken, its children in view are opened."""
    clip, heap, out = np.array(location.clip_from_query), [], []
    heapq.heappush(heap, (-plain_size(root, clip), "r", CROSS))
    while heap:
        _, node, rel = heapq.heappop(heap)
        for child in (f"{node}{k}" for k in range(8)):
            if child in nodes:
                cube = root.node(child)
                inner = IN if rel == IN else plain_relation(location, cube.low, cube.high)
                if inner != OUT:
                    heapq.heappush(heap, (-plain_size(cube, clip), child, inner))
        if nodes[node]:
            out.append(node)
    return out


def test_visible_nodes(tree):
    nodes = {r["node_id"]: r["num_points"] for r in tree.nodes.collect()}
    clip, root = np.array(LOCATIONS[3].clip_from_query), Cube.around(tree.box)
    found = lod.visible_nodes(tree.nodes, clip)
    got = [r["node_id"] for r in found.orderBy("rank").collect()]
    assert got == plain_walk(nodes, root, LOCATIONS[3]) and got[0] == "r" and len(got) > 5
    top = lod.top_nodes(tree.nodes, clip, 5).collect()
    sizes = sorted((-plain_size(root.node(n), clip), n) for n in nodes if nodes[n])[:5]
    assert np.allclose([r.screen_size for r in top], [-s for s, _ in sizes])
    assert lod.next_budget(100, 10) == 90 and lod.next_budget(100, 30) == 110 and lod.level_for_zoom(1000, 256, 5) == 2


@pytest.mark.parametrize("seed", range(3))
def test_walk_of_random_trees(spark, seed):
    """Deep, thin trees with empty nodes, seen from close by, where children are often larger on screen than parents."""
    r = np.random.default_rng(seed)
    nodes, open_ = {"r": 1}, ["r"]
    while len(nodes) < 600:
        node = open_[r.integers(len(open_))]
        if len(node) < 9 and (child := f"{node}{r.integers(8)}") not in nodes:
            nodes[child] = int(r.integers(3))
            open_.append(child)
    root = Cube((0.0, 0.0, 0.0), 64.0)
    eye = np.eye(4)
    eye[:3, 3] = r.uniform((20, 20, 40), (44, 44, 70))
    view = Frustum.of_pose(eye, perspective_fov(1.0, 1.4, 0.05, 80.0))
    table = build.node_table(spark.createDataFrame(list(nodes.items()), "node_id string, num_points long"), root, 0.01)
    got = [x["node_id"] for x in lod.visible_nodes(table, np.array(view.clip_from_query)).orderBy("rank").collect()]
    assert got == plain_walk(nodes, root, view) and len(got) > 20


def test_slabs():
    slab = lod.Slab()
    assert (slab.near, slab.far) == (2.0, 5.0) and slab.moved(-2.0) == slab and slab.moved(3.0) == lod.Slab(5.0, 8.0)
    assert slab.deepened(-4.0) == lod.Slab(2.0, 2.5) and slab.deepened(1.0) == lod.Slab(2.0, 6.0)
    seen = slab.frustum(np.eye(4)).hull().corners
    assert np.allclose(sorted(set(seen[:, 2].round(9))), [-5.0, -2.0])


def test_sampling(points):
    n = lod.random_prefix(points, ["id"], 0.25).count()
    assert 1300 < n < 1700 and n == lod.random_prefix(points, ["id"], 0.25).count()


# --- rasters and pyramids -------------------------------------------------------------------------


def test_discretise_borders(spark):
    box = Aabb((0.0, 0.0, 0.0), (1.0, 1.0, 0.0))
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 5.0), (0.5, 0.99, 0.0)], "x double, y double, z double")
    assert [(r.px, r.py, r.pz) for r in xray.discretised(df, box, 10, 10).collect()] == [(0, 10, 0), (10, 0, 0), (5, 0, 0)]


def test_intensity_default_range_is_black(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 0, -1.0)], "px int, py int, intensity double")
    assert tuple(xray.Intensity().pixels(df, ["px", "py"]).first())[2:] == (0, 0, 0, 255)


def test_png():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (9, 7, 4)).astype(np.uint8)
    assert (png.decode(png.encode(image)) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")


def test_pyramid(spark, points):
    box = build.bounding_box(points)
    raster = xray.Raster.over(box, 2.0, 32)
    pixels = xray.render(points, raster, box, xray.Coloured())
    leaves = pyramid.tile_images(pixels, raster.level, 32)
    every = pyramid.node_ids(pyramid.build_levels(leaves, raster.level, 0, 32)).collect()
    names = {r.node_id for r in every}
    assert "r" in names and all(n == "r" or n[:-1] in names for n in names)
    assert {png.decode(bytes(r.png)).shape for r in every} == {(32, 32, 4)}
    flat = np.full((8, 8, 4), 77, np.uint8)
    assert (pyramid.halved(flat) == 77).all()
    m = pyramid.mosaic({1: flat, 2: flat // 7}, 8, (1, 2, 3, 4))
    assert (m[:8, :8] == 77).all() and (m[8:, 8:] == 11).all() and (m[:8, 8:] == (1, 2, 3, 4)).all()
    with pytest.raises(ValueError):
        pyramid.mosaic({0: flat[:4]}, 8, (0, 0, 0, 0))
    with pytest.raises(ValueError):
        pyramid.merged([leaves, leaves], ["r0", "r0"], 32)
    back = pyramid.on_background(np.array([[[1, 2, 3, 100], [1, 2, 3, 200]]], np.uint8), (9, 9, 9, 255))
    assert back.tolist() == [[[9, 9, 9, 255], [1, 2, 3, 200]]]


def test_whole_pyramids_and_their_files(spark, points, tmp_path):
    box = build.bounding_box(points)
    size = max(box.diagonal[:2]) / 100
    whole = pyramids.build(points, box, size, xray.XRay(), 32)
    assert whole.raster.level == 2 and whole.image("r") and whole.image("r000000") is None
    images = lambda p: {(r.level, r.tile_x, r.tile_y): bytes(r.png) for r in p.tiles.collect()}
    want = images(whole)
    folder = str(tmp_path / "whole")
    assert pyramids.write(whole, folder) == len(want)
    back = pyramids.read(spark, folder)
    assert images(back) == want and back.raster == whole.raster
    assert images(Providers(pyramids.read).register("mem:", lambda s, p: None).open(spark, folder)) == want
    quarters = [pyramids.build(points, box, size, xray.XRay(), 32, root=f"r{k}") for k in range(4)]
    for q in quarters:
        pyramids.write(q, str(tmp_path / "parts"))
    parts = [pyramids.read(spark, str(tmp_path / "parts"), f"r{k}") for k in range(4)]
    assert images(parts[3]) == {k: v for k, v in want.items() if k[0] and (k[1] >> k[0] - 1, k[2] >> k[0] - 1) == (1, 1)}
    assert images(pyramids.merge(parts)) == want
    with pytest.raises(ValueError, match="deepest"):
        pyramids.merge([parts[0], pyramids.build(points, box, size * 2, xray.XRay(), 32, root="r1")])
    with pytest.raises(ValueError, match="tile sizes"):
        pyramids.merge([parts[0], pyramids.build(points, box, size, xray.XRay(), 16, root="r1")])
    with pytest.raises(ValueError):
        pyramids.build(points, box, size, xray.XRay(), 32, root="r0000")


def test_inpainting_sees_neighbouring_pyramids(spark):
    """A quarter inpainted with its neighbours equals the same quarter of the whole, upper levels too."""
    r = np.random.default_rng(3)
    image = r.integers(0, 255, (64, 64, 4)).astype(np.uint8)
    image[..., 3] = np.where(r.random((64, 64)) < 0.3, 0, 255)
    leaf = lambda x, y: png.encode(image[(3 - y) * 16 : (4 - y) * 16, x * 16 : (x + 1) * 16])
    made = lambda xs, ys: spark.createDataFrame([(2, x, y, leaf(x, y)) for x in xs for y in ys], pyramid.TILE_SCHEMA)
    raster = xray.Raster((0.0, 0.0), 64.0, 2, 16)
    whole = pyramids.inpaint(pyramids.Pyramid(made(range(4), range(4)), raster), 2)
    halves = [(range(0, 2), range(0, 2)), (range(0, 2), range(2, 4)), (range(2, 4), range(0, 2)), (range(2, 4), range(2, 4))]
    parts = [pyramids.Pyramid(made(*h), raster, f"r{k}") for k, h in enumerate(halves)]
    images = lambda p: {(t.level, t.tile_x, t.tile_y): bytes(t.png) for t in p.tiles.collect()}
    got = images(pyramids.inpaint(parts[1], 2, [parts[0], *parts[2:]]))
    assert len(got) == 5 and got == {k: v for k, v in images(whole).items() if k in got}


def test_inpaint(spark):
    image = np.zeros((16, 16, 4), np.uint8)
    image[2:14, 2:14] = (100, 50, 20, 255)
    image[6:9, 6:9] = 0
    out = pyramid.filled(image, 2)
    assert (out[6:9, 6:9] == (100, 50, 20, 255)).all() and (out[image[..., 3] > 0] == image[image[..., 3] > 0]).all() and not out[0].any()
    full = np.full((16, 16, 4), 200, np.uint8)
    left, right = full.copy(), full.copy()
    left[:, 15], right[:, 0] = 0, 0
    tiles = spark.createDataFrame([(1, 0, 0, png.encode(left)), (1, 1, 0, png.encode(right))], pyramid.TILE_SCHEMA)
    got = {r.tile_x: png.decode(bytes(r.png)) for r in pyramid.inpainted(tiles, 2, 16).collect()}
    assert (got[0][:, :, :3] == 200).all() and (got[1][:, :, :3] == 200).all()
    assert pyramid.inpainted(tiles, 0, 16) is tiles


def plain_matched(value, known, todo, guess, reach):
    """Pixel by pixel."""
    out = guess.copy()
    h, w = known.shape
    for y, x in np.argwhere(todo):
        best = np.inf
        for dy, dx in pyramid.offsets(reach):
            if not (0 <= y + dy < h and 0 <= x + dx < w and known[y + dy, x + dx]):
                continue
            total = apart = 0.0
            for ny in (-1, 0, 1):
                for nx in (-1, 0, 1):
                    ay, ax, by, bx = y + ny, x + nx, y + dy + ny, x + dx + nx
                    if 0 <= ay < h and 0 <= ax < w and 0 <= by < h and 0 <= bx < w and known[by, bx]:
                        weight = 1.0 if known[ay, ax] else pyramid.GUESSED if todo[ay, ax] else 0.0
                        shown = value[ay, ax] if known[ay, ax] else guess[ay, ax]
                        total += weight
                        apart += weight * ((shown - value[by, bx]) ** 2).sum()
            if total and apart / total < best - 1e-9:
                best, out[y, x] = apart / total, value[y + dy, x + dx]
    return out


def test_texture_equals_plain():
    r = np.random.default_rng(2)
    value = r.integers(0, 4, (14, 15, 4)).astype(float)
    known = r.random((14, 15)) < 0.6
    todo = ~known & (r.random((14, 15)) < 0.8)
    guess = r.integers(0, 4, (14, 15, 4)).astype(float)
    assert (pyramid.matched(value, known, todo, guess, 4) == plain_matched(value, known, todo, guess, 4)).all()
    assert len(pyramid.offsets(100)) <= pyramid.WINDOW**2 and pyramid.offsets(3)[0] == (0, 0)


def test_texture_goes_on_in_holes():
    """Stripes go on through a hole, where means would blur them; all filled pixels are copies."""
    image = np.zeros((40, 40, 4), np.uint8)
    image[..., 3] = 255
    image[:, :, 0] = np.where(np.arange(40) // 2 % 2, 240, 10)
    whole = image.copy()
    image[16:22, 14:20] = 0
    out = pyramid.synthesised(image, 3)
    known = image[..., 3] > 0
    assert (out[known] == image[known]).all() and set(np.unique(out[..., 0])) == {10, 240}
    assert (out == whole)[..., 0].mean() > 0.995 > (np.abs(pyramid.filled(image, 3).astype(int) - whole)[..., 0] < 20).mean()
    assert (pyramid.synthesised(image, 3) == out).all() and pyramid.synthesised(whole, 3) is whole


def test_mixed_views():
    full = np.full((4, 6, 4), 200, np.uint8)
    got = pyramid.mixed(full, full // 2, 1)
    assert got[0, :, 0].tolist() == [200, 180, 160, 140, 120, 100] and (pyramid.mixed(full, full, 0) == full).all()
    gone = full.copy()
    gone[1] = 0
    assert (pyramid.mixed(full, gone, 1)[1] == full[1]).all() and (pyramid.mixed(gone, full, 1)[1] == full[1]).all() and not pyramid.mixed(gone, gone, 0)[1].any()


@pytest.mark.parametrize("d", [2, 6])
def test_views_of_both_sides_agree(spark, d):
    """The tiles, filled and mixed in Spark, are those of a loop that mixes whole views: the right neighbour first."""
    r = np.random.default_rng(7)
    px, n = 16, 3
    whole = r.integers(0, 255, (n * px, n * px, 4)).astype(np.uint8)
    whole[..., 3] = np.where(r.random((n * px, n * px)) < 0.4, 0, 255)
    whole[20:26, 10:22] = 0
    margin = px // 2 if 4 * d <= px else 4 * d
    wide = np.pad(whole, ((margin + px, margin + px), (margin + px, margin + px), (0, 0)))
    views, cut = {}, slice(margin - px // 2, margin - px // 2 + 2 * px)
    for x in range(n):
        for y in range(n):
            top, left = (n - 1 - y) * px + px, x * px + px
            views[x, y] = pyramid.synthesised(wide[top : top + px + 2 * margin, left : left + px + 2 * margin], d)[cut, cut]
    for axis, (sx, sy) in ((1, (1, 0)), (0, (0, -1))):
        for (x, y), view in list(views.items()):
            if (x + sx, y + sy) in views:
                other = views[x + sx, y + sy]
                a, b = (view[:, px:], other[:, :px]) if axis else (view[px:], other[:px])
                both = pyramid.mixed(a, b, axis)
                a[:], b[:] = both, both
    rows_ = [(2, x, y, png.encode(whole[(n - 1 - y) * px : (n - y) * px, x * px : (x + 1) * px])) for x in range(n) for y in range(n)]
    got = {(t.tile_x, t.tile_y): png.decode(bytes(t.png)) for t in pyramid.inpainted(spark.createDataFrame(rows_, pyramid.TILE_SCHEMA), d, px).collect()}
    assert set(got) == set(views)
    for at, view in views.items():
        assert (got[at] == view[px // 2 : px // 2 + px, px // 2 : px // 2 + px]).all()
    known = whole[..., 3] > 0
    back = np.concatenate([np.concatenate([got[x, n - 1 - y] for x in range(n)], 1) for y in range(n)])
    assert (back[known] == whole[known]).all()


def test_octree_splits_below_level_20(spark):
    points = spark.createDataFrame([(x, 0.0, 0.0) for x in (0.0, 0.05, 0.1, 0.15, 0.2, 1e6)], "x double, y double, z double")
    cube = build.Cube.around(build.bounding_box(points))
    depth = build.depth_for(cube.edge, 0.001)
    split = build.split_nodes(points, cube, depth, 0.001, 4)
    assert depth == 30 and sorted(r[0] for r in build.names_of(split).collect()) == ["r" + "0" * k for k in range(23)]


# --- files, streams -------------------------------------------------------------------------------


def test_ply_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "a.ply")
    some = points.where("id < 500").select("x", "y", "z", "color", "intensity")
    assert ply.write(some, path) == 500
    ply.register(spark)
    got = ply.read(spark, path)
    assert attributes.attribute_types(got) == {"color": "U8Vec3", "intensity": "F32"}
    assert rows(got.select("x", "y", "z", "color.red", "intensity")) == rows(some.select("x", "y", "z", "color.red", "intensity"))
    assert ply.write(some.limit(20), path, append=True) == 520
    many = spark.read.format("ply").option("recordsPerPartition", 100).load(path)
    assert many.count() == 520 and many.rdd.getNumPartitions() == 6
    (tmp_path / "bad.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n")
    with pytest.raises(ValueError):
        ply.read_header(str(tmp_path / "bad.ply"))
    head = b"ply\nformat binary_little_endian 1.0\ncomment offset: 10 20 30\nelement vertex 1\nproperty float x\nproperty float y\nproperty double z\nproperty uint64 t\nproperty int8 s\nproperty uchar r\nproperty uchar g\nproperty uchar b\nend_header\n"
    (tmp_path / "o.ply").write_bytes(head + np.array([(1, 2, 3, 2**63 + 1, -5, 7, 8, 9)], "<f4,<f4,<f8,<u8,i1,u1,u1,u1").tobytes())
    r = ply.read(spark, str(tmp_path / "o.ply")).first()
    assert (r.x, r.y, r.z, int(r.t), r.s, r.color.blue) == (11.0, 22.0, 33.0, 2**63 + 1, -5, 9)


def test_ply_folders(spark, points, tmp_path):
    folder = str(tmp_path / "many")
    flat = points.select("x", "y", "z", "color", "intensity")
    ply.write_folder(flat.repartition(3), folder, records=700)
    listed = {f: ply.read_header(f).count for f in ply.files_of(folder)}
    assert sum(listed.values()) == 6000 and max(listed.values()) == 700 and len(listed) > 8
    want = rows(flat)
    assert rows(ply.read(spark, folder)) == want and attributes.attribute_types(ply.read(spark, folder)) == {"color": "U8Vec3", "intensity": "F32"}
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(f) for f in listed)  # nothing else is left
    assert rows(ply.read(spark, f"file://{folder}/part-*.ply")) == want
    one = next(iter(listed))
    assert ply.read(spark, one).count() == listed[one]
    # Appending in two steps gives the rows of one write; overwriting gives the last ones.
    twice = str(tmp_path / "twice")
    ply.write_folder(flat.limit(10), twice)
    half = points.where("id < 3000").select(*flat.columns)
    ply.write_folder(half, twice)
    ply.write_folder(points.where("id >= 3000").select(*flat.columns), twice, append=True)
    assert rows(ply.read(spark, twice)) == want
    # A job of which a task fails leaves the folder as it was.
    before = sorted(os.listdir(twice))
    broken = flat.repartition(4).withColumn("x", F.when(F.col("z") == flat.agg(F.max("z")).first()[0], F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    for append in (True, False):
        with pytest.raises(Exception, match="no"):
            ply.write_folder(broken, twice, append=append)
    assert sorted(os.listdir(twice)) == before and rows(ply.read(spark, twice)) == want
    empty = str(tmp_path / "empty")
    ply.write_folder(flat.limit(0), empty)
    assert ply.read(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        ply.files_of(f"{folder}/none*.ply")
    ply.write_folder(flat.select("x", "y", "z"), str(tmp_path / "other"))
    os.rename(ply.files_of(str(tmp_path / "other"))[0], tmp_path / "many" / "zz.ply")
    with pytest.raises(Exception, match="other properties"):
        ply.read(spark, folder).count()


def test_stored_s2_cloud(spark, globe, tmp_path):
    cloud = build.S2Cloud(globe.points, globe.nodes, globe.box)
    folder = str(tmp_path / "s2")
    rawnode.write_s2(cloud, folder)
    back = PointCloud.of_s2(rawnode.read_s2(spark, folder))
    assert back.num_points() == globe.num_points() and rows(back.nodes.select("token", "num_points")) == rows(globe.nodes.select("token", "num_points"))
    assert back.box == globe.box
    where = CellUnion((s2.from_token(globe.nodes.first().token),))
    ask = query.PointQuery([], where)
    assert rows(back.query(ask)) == rows(globe.query(ask)) and back.query(ask).count()


def test_raw_nodes_and_meta(spark, tree, tmp_path):
    folder = str(tmp_path / "octree")
    rawnode.write_octree(tree.points.select("node_id", "x", "y", "z", "color", "intensity"), tree.nodes, tree.box, 0.5, folder)
    back = rawnode.read_octree(spark, folder, {"color": "U8Vec3", "intensity": "F32"})
    assert back.count() == 6000 and back.agg(F.sum("color.blue")).first() == tree.points.agg(F.sum("color.blue")).first()
    kinds = {"color": "U8Vec3", "intensity": "F32"}
    counts = {r["node_id"]: r["num_points"] for r in tree.nodes.collect()}
    some = next(n for n, k in counts.items() if k > 1)
    assert {n: len(b) for n, b in rawnode.node_data(spark, folder, some, ["color", "intensity"]).items()} == {"color": 3 * counts[some], "intensity": 4 * counts[some]}
    with pytest.raises(rawnode.NodeNotFound):
        rawnode.node_data(spark, folder, "r7777777", ["color"])
    # By a path that only Spark's readers know.
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.nodes.link./in", f"file://{tmp_path}")
    assert rows(rawnode.read_octree(spark, "viewfs://nodes/in/octree", kinds)) == rows(back)
    os.rename(f"{folder}/{some}.rgb", f"{folder}/hidden")
    with pytest.raises(Exception, match="color"):
        rawnode.read_octree(spark, folder, kinds).count()
    os.rename(f"{folder}/hidden", f"{folder}/{some}.rgb")
    assert not [f for f in os.listdir(folder) if f.startswith(".r")]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "meta.json").write_text("{}")
    with pytest.raises(ValueError, match="version 3"):
        rawnode.read_octree(spark, str(tmp_path / "old"))
    m = meta.parse(open(f"{folder}/meta.pb", "rb").read())
    assert meta.parse(meta.upgrade(meta.serialise(m))) == m and sum(n for n, _ in m.nodes.values()) == 6000
    old = meta._classes()["Meta"](version=11, old_resolution=0.25)
    old.bounding_box.old_min.x, old.bounding_box.old_max.x = -1.0, 2.0
    old.old_nodes.add(position_encoding=2, num_points=9, id=meta._classes()["NodeId"](old_level=2, old_index=0o13))
    new = meta.parse(meta.upgrade(old.SerializeToString()))
    assert new.version == 13 and new.nodes == {"r13": (9, "U16")} and new.box.low[0] == -1.0 and new.resolution == 0.25
    with pytest.raises(ValueError):
        meta.parse(meta._classes()["Meta"](version=8).SerializeToString())
    p = meta.PyramidMeta((1.0, 2.0), 64.0, 3, 256, ["r", "r12"])
    assert meta.parse_pyramid(meta.serialise_pyramid(p)) == p and meta.pyramid_meta_name("r12") == "meta12.pb" and meta.pyramid_meta_name("r") == "meta.pb"
    s = meta.CloudMeta(tree.box, cells={2**63 + 5: 7}, attributes={"color": "U8Vec3"})
    assert meta.parse(meta.serialise(s)).cells == s.cells


def test_blobs(tree):
    got = blob.node_blobs(tree.points, tree.nodes).collect()
    assert sum(r.num_points for r in got) == 6000 and all(len(r.blob) % 8 == 0 for r in got)
    p, c = blob.unpack(bytes(next(r.blob for r in got if r.node_id == "r")))
    want = np.array(sorted((r.x, r.y, r.z) for r in tree.points.where("node_id = 'r'").collect()))
    assert np.abs(p - want).max() < 0.5 and c.shape == p.shape


def test_terrain(spark, tmp_path):
    data = np.arange(32, dtype="<f4").reshape(4, 4, 2)
    colours = np.arange(64, dtype=np.uint8).reshape(4, 4, 4)
    folder = f"file://{tmp_path}"
    (tmp_path / "x00000001_y00000000.height").write_bytes(data.tobytes())
    (tmp_path / "x00000001_y00000000.color").write_bytes(colours.tobytes())
    (tmp_path / "x-0000001_y-0000001.height").write_bytes((data * 3).tobytes())
    terrain.write_meta(spark, folder, {"tile_size": 4})
    assert terrain.read_meta(spark, folder) == {"tile_size": 4}

    def plain(x0, y0, width, height):
        """Cell by cell."""
        out = {}
        for x in range(x0, x0 + width):
            for y in range(y0, y0 + height):
                tile, j, i = (x // 4, y // 4), y % 4, x % 4
                scale = {(1, 0): 1.0, (-1, -1): 3.0}.get(tile, 0.0)
                rgba = tuple(int(v) for v in colours[j, i]) if tile == (1, 0) else (0, 0, 0, 0)
                out[x, y] = (data[j, i, 0] * scale, data[j, i, 1] * scale, rgba)
        return out

    for asked in ((3, 0, 3, 2), (-6, -5, 15, 9), (100, 100, 1, 1), (4, 0, 4, 4)):
        got = {(r.grid_x, r.grid_y): (r.height, r.quads, tuple(r.color)) for r in terrain.region(spark, folder, 4, *asked).collect()}
        assert got == plain(*asked)
    turn = np.array([[0, -1, 0, 10.0], [1, 0, 0, 20.0], [0, 0, 1, 30.0], [0, 0, 0, 1]])
    r = terrain.vertices(terrain.region(spark, folder, 4, 3, 0, 3, 2), (1.0, 1.0, 1.0), 0.5, turn).where("grid_x = 5 and grid_y = 1").first()
    assert (r.x, r.y, r.z, r.quads, tuple(r.color)) == (10 - 1.5, 20 + 3.5, 30 + 11.0, 11.0, (20, 21, 22, 255))


def test_sql_functions_and_clouds(spark, points, tree, tmp_path):
    PointCloud.of_octree(tree).write(f"file://{tmp_path}/cloud")
    cloud = PointCloud.open(spark, f"file://{tmp_path}/cloud")
    sql.register_cloud(spark, "scan", cloud)
    box = LOCATIONS[1]
    listed = ", ".join(f"{v}D" for v in (*box.low, *box.high))
    found = spark.sql(f"select id from scan_in_box({listed}) where vx_in_interval(intensity, 1, 4)")
    q = query.PointQuery(["id", "intensity"], box, {"intensity": (1.0, 4.0)})
    assert rows(found) == rows(cloud.query(q).select("id")) and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and f"GreaterThanOrEqual(x,{box.low[0]})" in plan and "green" not in plan.split("ReadSchema")[1].split("\n")[0]
    met = spark.sql(f"select node_id from scan_nodes_in_box({listed})")
    assert rows(met) == rows(cloud.related(box).select("node_id"))
    obb, frustum = LOCATIONS[2], LOCATIONS[3]
    array = lambda v: "array(" + ", ".join(f"{float(x)!r}D" for x in np.ravel(v)) + ")"
    xyz = [F.col(c) for c in "xyz"]
    assert rows(spark.sql(f"select id from scan where vx_in_obb(x, y, z, {array(obb.centre)}, {array(obb.rotation)}, {array(obb.half)})")) == rows(cloud.points.where(obb.contains(*xyz)).select("id"))
    assert rows(spark.sql(f"select id from scan where vx_in_frustum(x, y, z, {array(frustum.clip_from_query)})")) == rows(cloud.points.where(frustum.contains(*xyz)).select("id"))
    cube = cloud.root_cube()
    own = spark.sql(f"select id, vx_octree_node(x, y, z, {', '.join(f'{v!r}D' for v in cube.low)}, {cube.edge!r}D, 5) from scan")
    assert rows(own) == rows(build.with_path(cloud.points, cube, 5).select("id", "path"))
    one = spark.sql("select vx_node_parent('r12'), vx_node_parent('r'), vx_node_level('r123'), vx_node_below('r123', 'r1')").first()
    assert tuple(one) == ("r1", None, 3, True)
    cell = int(s2.parents(s2.leaf_cells([[1.0, 0.2, 0.1]]), 9)[0])
    leaves = [int(v) - (1 << 64) if int(v) >> 63 else int(v) for v in s2.leaf_range(cell)]
    signed = cell - (1 << 64) if cell >> 63 else cell
    assert tuple(spark.sql(f"select vx_in_cell({leaves[0]}L, {signed}L), vx_in_cell({leaves[1]}L, {signed}L), vx_in_cell({leaves[1] + 2}L, {signed}L)").first()) == (True, True, False)
    assert np.allclose(spark.sql("select vx_mercator_x(0.5D), vx_mercator_y(0.25D)").first(), spark.range(1).select(*geodesy.mercator(F.lit(0.25), F.lit(0.5))).first())


def test_commands(spark, points, tmp_path):
    """From a PLY file to clouds, pyramids, a merged and an inpainted one, as the commands do it."""
    run = lambda *a: commands.main([str(x) for x in a], spark)
    flat = points.select("x", "y", "z", "color", "intensity")
    ply.write(flat, str(tmp_path / "a.ply"))
    assert run("build-octree", tmp_path / "a.ply", "--output", tmp_path / "tree", "--resolution", 0.5).endswith("nodes")
    assert rows(commands.open_points(spark, str(tmp_path / "tree"))) == rows(flat)
    run("build-octree", tmp_path / "a.ply", "--output", tmp_path / "nodes", "--nodes", "--resolution", 0.5)
    assert commands.open_points(spark, str(tmp_path / "nodes")).count() == 6000
    run("upgrade", tmp_path / "nodes")
    assert commands.open_points(spark, str(tmp_path / "nodes")).count() == 6000
    size = ["--resolution", 2.0, "--tile-size", 32]
    run("xray", tmp_path / "a.ply", "--output", tmp_path / "whole", *size, "--coloring", "colored")
    for k in range(4):
        run("xray", tmp_path / "tree", "--output", tmp_path / "parts", *size, "--coloring", "colored", "--root", f"r{k}")
    run("merge-xray", *(f"{tmp_path}/parts:r{k}" for k in range(4)), "--output", tmp_path / "merged")
    images = lambda name: {(t.level, t.tile_x, t.tile_y): bytes(t.png) for t in pyramids.read(spark, str(tmp_path / name)).tiles.collect()}
    assert images("merged") == images("whole")
    run("inpaint-xray", tmp_path / "whole", "--distance", 2, "--output", tmp_path / "filled")
    run("upgrade", tmp_path / "filled", "--pyramid")
    assert set(images("filled")) == set(images("whole"))
    few = run("xray", tmp_path / "a.ply", "--output", tmp_path / "some", *size, "--coloring", "colored_with_intensity", "--max-intensity", 6, "--filter-interval", "intensity=2,4", "--background", "transparent")
    assert few.endswith("tiles")
    with pytest.raises(SystemExit):
        run("build-octree", tmp_path / "a.ply")


def test_delivery(points):
    sizes = [b.num_rows for b in delivery.arrow_batches(points.where("id < 1000"), 300)]
    assert sizes == [300, 300, 300, 100]
    assert [b.num_rows for b in delivery.rebatched(delivery.arrow_batches(points.limit(500), 120), 200)] == [200, 200, 100]
    calls = []

    def stop(batch):
        calls.append(batch)
        raise RuntimeError("enough")

    with pytest.raises(RuntimeError):
        delivery.for_each_batch(points, stop, 100)
    assert len(calls) == 1 and delivery.limited(points, 77).count() == 77


def test_delivery_in_order_and_ahead(spark):
    """Partitions come in their order, several are computed at a time, and stopping ends what runs."""
    df = spark.range(0, 200_000, numPartitions=23).select("id", (F.col("id") * 2).alias("twice"), F.struct(F.col("id").alias("a")).alias("s"))
    batches = list(delivery.arrow_batches(df, 30_000, ahead=5))
    assert [b.num_rows for b in batches] == [30_000] * 6 + [20_000]
    assert sum((b.column(0).to_pylist() for b in batches), []) == list(range(200_000)) and batches[-1].column(2)[-1].as_py() == {"a": 199_999}
    assert list(delivery.arrow_batches(df.limit(0))) == []
    small = delivery.partitions(df, ahead=5, held_bytes=1)  # never more than one waits where a byte is too much
    assert sum(len(p) > 0 for p in small) == 23
    began = time.time()
    first = next(delivery.arrow_batches(spark.range(0, 3_000_000, numPartitions=3000), 100))
    assert first.num_rows == 100 and time.time() - began < 60
    tracker = spark.sparkContext.statusTracker()
    assert not [i for i in tracker.getActiveJobsIds()]


def test_stream(spark, points, tmp_path):
    folder = str(tmp_path / "in")
    points.write.parquet(folder)
    q = query.PointQuery(["id"], Aabb((-40.0, -20.0, -5.0), (60.0, 50.0, 5.0)))
    schema = spark.read.parquet(folder).schema
    run = delivery.stream_query(spark, folder, schema, q).writeStream.format("memory").queryName("hits").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("hits").select("id")) == rows(q.run(points).select("id"))
