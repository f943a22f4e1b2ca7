"""Stored metadata of octrees, S2 clouds and image pyramids (protocol buffers), of all versions that are
read, and their upgrade to the current one. The message types are built at run time."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from voxelake.functions import codec, ids
from voxelake.functions.attributes import BY_WIRE, TYPES
from voxelake.operators.geometry import Aabb

# Versions of the stored formats.
CURRENT, OLDEST, OLDEST_S2 = 13, 9, 12
PYRAMID_CURRENT, PYRAMID_OLDEST = 3, 2
# Messages as name -> {field: (number, type)}; "*" repeats, capitals name messages.
MESSAGES = {
    "Vec2f": {"x": (1, "float"), "y": (2, "float")},
    "Vec2": {"x": (1, "double"), "y": (2, "double")},
    "Vec3f": {"x": (1, "float"), "y": (2, "float"), "z": (3, "float")},
    "Vec3": {"x": (1, "double"), "y": (2, "double"), "z": (3, "double")},
    "Box": {"min": (3, "Vec3"), "max": (4, "Vec3"), "old_min": (1, "Vec3f"), "old_max": (2, "Vec3f")},
    "NodeId": {"high": (3, "uint64"), "low": (4, "uint64"), "old_level": (1, "int32"), "old_index": (2, "int64")},
    "Node": {"position_encoding": (2, "int32"), "num_points": (3, "int64"), "id": (4, "NodeId")},
    "Attribute": {"name": (1, "string"), "data_type": (2, "int32")},
    "Cell": {"id": (1, "uint64"), "num_points": (2, "uint64")},
    "OctreeMeta": {"resolution": (2, "double"), "nodes": (3, "*Node"), "old_box": (1, "Box")},
    "CellMeta": {"cells": (1, "*Cell"), "attributes": (2, "*Attribute")},
    "Meta": {"version": (1, "int32"), "bounding_box": (4, "Box"), "octree": (6, "OctreeMeta"), "s2": (7, "CellMeta"), "old_resolution": (3, "double"), "old_nodes": (5, "*Node")},
    "Rect": {"min": (3, "Vec2"), "edge_length": (4, "double"), "old_min": (1, "Vec2f"), "old_edge_length": (2, "float")},
    "QuadId": {"level": (1, "uint32"), "index": (2, "uint64")},
    "PyramidMeta": {"version": (1, "int32"), "bounding_rect": (2, "Rect"), "deepest_level": (3, "uint32"), "tile_size": (4, "uint32"), "nodes": (5, "*QuadId")},
}


@lru_cache(maxsize=1)
def _classes() -> dict:
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    f = descriptor_pb2.FileDescriptorProto(name="voxelake_meta.proto", package="voxelake.meta", syntax="proto3")
    for name, fields in MESSAGES.items():
        m = f.message_type.add(name=name)
        for label, (number, kind) in fields.items():
            entry = m.field.add(name=label, number=number, label=kinds.LABEL_REPEATED if kind[0] == "*" else kinds.LABEL_OPTIONAL)
            kind = kind.lstrip("*")
            if kind[0].isupper():
                entry.type, entry.type_name = kinds.TYPE_MESSAGE, f".voxelake.meta.{kind}"
            else:
                entry.type = getattr(kinds, f"TYPE_{kind.upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"voxelake.meta.{n}")) for n in MESSAGES}


@dataclass
class CloudMeta:
    box: Aabb
    resolution: float = 0.0
    #: octree: id -> (points, encoding)
    nodes: dict[str, tuple[int, str]] = field(default_factory=dict)
    #: S2: cell -> points
    cells: dict[int, int] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    version: int = CURRENT


def _box(m) -> Aabb:
    low, high = (m.min, m.max) if m.HasField("min") else (m.old_min, m.old_max)
    return Aabb((low.x, low.y, low.z), (high.x, high.y, high.z))


def parse(data: bytes) -> CloudMeta:
    """Versions 9 to 13 of octrees, 12 and 13 of S2 clouds."""
    m = _classes()["Meta"].FromString(data)
    if not OLDEST <= m.version <= CURRENT:
        raise ValueError(f"version {m.version} is not read")
    names = {wire: k for k, (_, wire, _) in codec.ENCODINGS.items()}
    if m.HasField("s2"):
        if m.version < OLDEST_S2:
            raise ValueError(f"version {m.version} has no S2 clouds")
        return CloudMeta(_box(m.bounding_box), cells={c.id: c.num_points for c in m.s2.cells}, attributes={a.name: BY_WIRE[a.data_type].name for a in m.s2.attributes}, version=m.version)
    # Up to version 11 nodes and resolution lie outside; version 12 has the box inside.
    inner = m.version >= 12
    box = m.octree.old_box if m.version == 12 and not m.HasField("bounding_box") else m.bounding_box
    nodes = {ids.octree_unwire(n.id.high, n.id.low, n.id.old_level, n.id.old_index): (n.num_points, names.get(n.position_encoding, "F64")) for n in (m.octree.nodes if inner else m.old_nodes)}
    return CloudMeta(_box(box), m.octree.resolution if inner else m.old_resolution, nodes, attributes={"color": "U8Vec3", "intensity": "F32"}, version=m.version)


def serialise(meta: CloudMeta) -> bytes:
    """In the current version."""
    c = _classes()
    m = c["Meta"](version=CURRENT)
    for corner, v in (("min", meta.box.low), ("max", meta.box.high)):
        getattr(m.bounding_box, corner).CopyFrom(c["Vec3"](x=v[0], y=v[1], z=v[2]))
    if meta.cells:
        for cell, n in meta.cells.items():
            m.s2.cells.add(id=cell, num_points=n)
        for name, kind in meta.attributes.items():
            m.s2.attributes.add(name=name, data_type=TYPES[kind].wire)
    else:
        m.octree.resolution = meta.resolution
        for node, (n, encoding) in meta.nodes.items():
            high, low = ids.octree_wire(node)
            m.octree.nodes.add(position_encoding=codec.ENCODINGS[encoding][1], num_points=n, id=c["NodeId"](high=high, low=low))
    return m.SerializeToString()


def upgrade(data: bytes) -> bytes:
    """Any version that is read, in the current one."""
    return serialise(parse(data))


@dataclass
class PyramidMeta:
    low: tuple[float, float]
    edge: float
    deepest_level: int
    tile_size: int
    nodes: list[str]


def parse_pyramid(data: bytes) -> PyramidMeta:
    m = _classes()["PyramidMeta"].FromString(data)
    if not PYRAMID_OLDEST <= m.version <= PYRAMID_CURRENT:
        raise ValueError(f"version {m.version} is not read")
    r = m.bounding_rect
    low, edge = (r.min, r.edge_length) if m.version == PYRAMID_CURRENT else (r.old_min, r.old_edge_length)
    return PyramidMeta((low.x, low.y), edge, m.deepest_level, m.tile_size, [ids.quad_from_number(n.level, n.index) for n in m.nodes])


def serialise_pyramid(meta: PyramidMeta) -> bytes:
    c = _classes()
    m = c["PyramidMeta"](version=PYRAMID_CURRENT, deepest_level=meta.deepest_level, tile_size=meta.tile_size)
    m.bounding_rect.min.CopyFrom(c["Vec2"](x=meta.low[0], y=meta.low[1]))
    m.bounding_rect.edge_length = meta.edge
    for n in meta.nodes:
        m.nodes.add(level=ids.level(n), index=ids.quad_number(n))
    return m.SerializeToString()


def pyramid_meta_name(root: str) -> str:
    """``meta.pb`` for a whole pyramid, with the root's digits otherwise."""
    return f"meta{root[1:]}.pb"
