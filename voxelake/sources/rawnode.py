"""The stored layout of one file for each node and attribute: import as a DataFrame, and export.

``<node>.xyz`` holds encoded positions, ``<node>.rgb`` colours, ``<node>.<attribute>`` anything else, all
little-endian; ``meta.pb`` names the nodes. A node without points has no files.

Files are read by Spark's own reader, from any file system that it knows, each attribute of a node as one value (up to
two gigabytes), and put together by node. They are written in streams, a batch at a time, through the file systems that
Arrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import codec, s2
from voxelake.functions.attributes import POSITION, TYPES, attribute_types
from voxelake.operators.build import S2Cloud, s2_nodes
from voxelake.operators.geometry import Cube
from voxelake.shipping import ship
from voxelake.staging import staged

from . import meta
from .files import put, store_of

EXTENSIONS = {"position": "xyz", "color": "rgb"}
#: Points of one frame that a reader gives.
POINTS_PER_FRAME = 65_536
META, OLD_META = "meta.pb", "meta.json"


class NodeNotFound(FileNotFoundError):
    pass


def _extension(name: str) -> str:
    return EXTENSIONS.get(name, name)


def _files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """stem, extension, content of the files whose names fit; an empty table if none do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)\.([^./]+)$", k)
    return files.select(part(1).alias("stem"), part(2).alias("extension"), "content")


def node_data(spark: SparkSession, folder: str, node: str, attributes: list[str]) -> dict[str, bytes]:
    """The stored bytes of one node's attributes; an error if one isn't there."""
    wanted = {_extension(n): n for n in attributes}
    found = {wanted[r["extension"]]: bytes(r["content"]) for r in _files(spark, folder, [f"{node}.{e}" for e in wanted]).collect()}
    if missing := [n for n in attributes if n not in found]:
        raise NodeNotFound(f"{folder}/{node}: {', '.join(missing)}")
    return found


def decoded(contents: dict[str, bytes], attributes: dict[str, str], encoding: str, cube: Cube | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Positions and attributes of a node's bytes; all must have as many points. Without a cube positions are plain
    doubles."""

    def load(name: str, dtype: str, dims: int) -> np.ndarray:
        data = np.frombuffer(contents[name], dtype)
        return data.reshape(-1, dims) if dims > 1 else data

    if cube is None:
        p = load("position", "<f8", 3)
    else:
        size, _, top = codec.ENCODINGS[encoding]
        p = codec.decode_np(load("position", f"<u{size}" if top else f"<f{size}", 3), np.array(cube.low), cube.edge, encoding)
    out = {n: load(n, TYPES[k].dtype, TYPES[k].dims) for n, k in attributes.items()}
    if any(len(v) != len(p) for v in out.values()):
        raise ValueError("the files of a node have different numbers of points")
    return p, out


def _parsed(spark: SparkSession, folder: str) -> meta.CloudMeta:
    found = {f"{r['stem']}.{r['extension']}": bytes(r["content"]) for r in _files(spark, folder, [META, OLD_META]).collect()}
    if OLD_META in found:
        raise ValueError(f"{folder} has the layout of version 3, which is not read")
    if META not in found:
        raise FileNotFoundError(f"no {META} in {folder}")
    return meta.parse(found[META])


def _read(spark: SparkSession, folder: str, listed: list[tuple[str, str]], kinds: dict[str, str], root: Cube | None) -> DataFrame:
    """All points of the listed (node, encoding) with node_id. Without a root cube positions are plain doubles."""
    ship(spark)
    names = ["position", *kinds]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                node = row["node_id"]
                if missing := [n for k, n in enumerate(names) if row[f"c{k}"] is None]:
                    raise NodeNotFound(f"{folder}/{node}: {', '.join(missing)}")
                contents = {n: row[f"c{k}"] for k, n in enumerate(names)}
                p, found = decoded(contents, kinds, row["encoding"], root.node(node) if root else None)
                for at in range(0, len(p), POINTS_PER_FRAME):
                    cut = slice(at, at + POINTS_PER_FRAME)
                    out = {"node_id": node, **{c: p[cut, k] for k, c in enumerate(POSITION)}}
                    for name, data in found.items():
                        number = float if data.dtype.kind == "f" else np.int64
                        if data.ndim > 1:
                            out |= {f"{name}_{k}": data[cut, k].astype(number) for k in range(data.shape[1])}
                        else:
                            out[name] = data[cut].astype(number)
                    yield pd.DataFrame(out)

    fields = ["node_id string", *(f"{c} double" for c in POSITION)]
    for name, kind in kinds.items():
        number = "double" if kind[0] == "F" else "long"
        fields += [f"{name}_{k} {number}" for k in range(TYPES[kind].dims)] if TYPES[kind].dims > 1 else [f"{name} {number}"]
    nodes = spark.createDataFrame(listed, "node_id string, encoding string")
    files = _files(spark, folder, [f"*.{_extension(n)}" for n in names])
    wanted = nodes.join(files, F.col("node_id") == F.col("stem"), "left").groupBy("node_id", "encoding")
    whole = wanted.agg(*(F.first(F.when(F.col("extension") == _extension(n), F.col("content")), True).alias(f"c{k}") for k, n in enumerate(names)))
    df = whole.mapInPandas(load, ", ".join(fields))
    cols = [F.col("node_id"), *map(F.col, POSITION)]
    for name, kind in kinds.items():
        parts = ("red", "green", "blue") if kind == "U8Vec3" else ("x", "y", "z")
        col = F.struct(*(F.col(f"{name}_{k}").alias(p) for k, p in enumerate(parts))) if TYPES[kind].dims > 1 else F.col(name)
        cols.append(col.cast(TYPES[kind].spark).alias(name, metadata={"attr_type": kind}))
    return df.select(*cols)


def read_octree(spark: SparkSession, folder: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """All points of a stored octree with node_id."""
    m = _parsed(spark, folder)
    listed = [(n, e) for n, (k, e) in m.nodes.items() if k]
    return _read(spark, folder, listed, attributes if attributes is not None else {"color": "U8Vec3"}, Cube.around(m.box))


def read_s2(spark: SparkSession, folder: str, attributes: list[str] | None = None) -> S2Cloud:
    """A stored S2 cloud: files named by cell tokens, of which the metadata lists cells and attributes.
    Leaf cells are found again from the positions, so queries prune as on a cloud that was built."""
    m = _parsed(spark, folder)
    kinds = {n: k for n, k in m.attributes.items() if attributes is None or n in attributes}
    listed = [(s2.token(c), "F64") for c, n in m.cells.items() if n]
    points = _read(spark, folder, listed, kinds, None)
    tokens = spark.createDataFrame([(s2.token(c), c - (1 << 64) if c >> 63 else c) for c, n in m.cells.items() if n], "node_id string, cell long")
    leaf = s2.leaf_column(*map(F.col, POSITION))
    celled = staged(points.withColumn("leaf", leaf).join(tokens, "node_id").drop("node_id"), "cells")
    return S2Cloud(celled, s2_nodes(celled), m.box)


def _write_meta(folder: str, content: meta.CloudMeta) -> None:
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    put(store, root, META, meta.serialise(content))


def write_s2(cloud: S2Cloud, folder: str) -> None:
    """Export to a folder that all executors see: the cells, then the metadata."""
    kinds = attribute_types(cloud.points.drop("leaf", "cell"))
    named = cloud.points.withColumn("node_id", s2.token_column(F.col("cell"))).drop("leaf", "cell")
    _save(named.withColumn("position_encoding", F.lit("F64")), kinds, folder, None)
    cells = {r["cell"] % (1 << 64): r["num_points"] for r in cloud.nodes.select("cell", "num_points").collect()}  # which the metadata lists
    _write_meta(folder, meta.CloudMeta(cloud.box, cells=cells, attributes=kinds))


class NodeWriter:
    """The files of one node, written a batch at a time under names of their own and moved when whole."""

    def __init__(self, folder: str, node: str, names: list[str]):
        self.store, self.root = store_of(folder)
        self.own = {f"{node}.{_extension(n)}": f"{self.root}/.{node}.{_extension(n)}.{uuid.uuid4().hex}" for n in names}
        self.streams = [self.store.open_output_stream(path) for path in self.own.values()]
        self.bytes = 0

    def write(self, parts: list[np.ndarray]) -> None:
        """One array for each of the names."""
        for stream, part in zip(self.streams, parts, strict=True):
            data = np.ascontiguousarray(part).tobytes()
            stream.write(data)
            self.bytes += len(data)

    def close(self) -> None:
        for stream in self.streams:
            stream.close()
        for name, path in self.own.items():
            self.store.move(path, f"{self.root}/{name}")


def _save(points: DataFrame, kinds: dict[str, str], folder: str, root: Cube | None) -> None:
    """Each node's rows come to one task in a full order, as a stream, so nodes may be of any size and an attempt
    that is run again writes the same files."""
    store, where = store_of(folder)
    store.create_dir(where, recursive=True)
    ship(points.sparkSession)
    flat = [F.col("node_id"), *map(F.col, POSITION), F.col("position_encoding")]
    for name, kind in kinds.items():
        parts = ("red", "green", "blue") if kind == "U8Vec3" else ("x", "y", "z")
        flat += [F.col(f"{name}.{p}").alias(f"{name}_{k}") for k, p in enumerate(parts)] if TYPES[kind].dims > 1 else [F.col(name)]
    names = ["position", *sorted(kinds)]

    def arrays(batch: pa.RecordBatch, cube: Cube | None, encoding: str) -> list[np.ndarray]:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        p = np.stack([column(c) for c in POSITION], -1)
        out = [np.asarray(p, "<f8") if cube is None else codec.encode_np(p, np.array(cube.low), cube.edge, encoding)]
        for name in names[1:]:
            t = TYPES[kinds[name]]
            out.append(np.stack([column(f"{name}_{k}") for k in range(t.dims)], -1).astype(t.dtype) if t.dims > 1 else column(name).astype(t.dtype))
        return out

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, writer, done = None, None, []
        for batch in batches:
            ids = np.array(batch.column("node_id").to_pylist(), dtype=object)
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for at, end in zip(starts, starts[1:], strict=False):
                part = batch.slice(at, end - at)
                if ids[at] != node:
                    if writer is not None:
                        writer.close()
                        done.append((node, writer.bytes))
                    node = ids[at]
                    encoding, cube = part.column("position_encoding")[0].as_py(), root.node(node) if root else None
                    writer = NodeWriter(folder, node, names)
                writer.write(arrays(part, cube, encoding))
        if writer is not None:
            writer.close()
            done.append((node, writer.bytes))
        if done:
            yield pa.RecordBatch.from_pydict({"node_id": [n for n, _ in done], "bytes": [b for _, b in done]})

    rows = points.select(*flat)
    ordered = rows.repartition("node_id").sortWithinPartitions(*rows.columns)
    staged(ordered.mapInArrow(save, "node_id string, bytes long"), "written")


def write_octree(points: DataFrame, nodes: DataFrame, box, resolution: float, folder: str) -> None:
    """Export to a folder that all executors see: the nodes, then the metadata."""
    kinds = attribute_types(points.drop("node_id", "level"))
    encodings = nodes.select("node_id", "position_encoding")
    _save(points.join(encodings, "node_id"), kinds, folder, Cube.around(box))
    listed = {r["node_id"]: (r["num_points"], r["position_encoding"]) for r in nodes.select("node_id", "num_points", "position_encoding").collect()}
    _write_meta(folder, meta.CloudMeta(box, resolution, listed))
