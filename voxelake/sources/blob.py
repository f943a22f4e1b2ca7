"""Binary blobs of nodes: a header and packed positions and colours, padded to eight bytes.

Layout (little endian): lower corner and edge (four doubles), number of points (u32), bytes of a
coordinate (u8), padding; positions as encoded; padding; three colour bytes a point; padding."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.functions import codec
from voxelake.functions.attributes import POSITION
from voxelake.shipping import ship


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack(low, edge: float, encoding: str, positions: np.ndarray, colours: np.ndarray) -> bytes:
    size = codec.ENCODINGS[encoding][0]
    code = codec.encode_np(positions, np.asarray(low), edge, encoding)
    head = struct.pack("<4dIB", *low, edge, len(positions), size)
    return _padded(head) + _padded(code.tobytes()) + _padded(np.ascontiguousarray(colours, np.uint8).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and colours."""
    *low, edge, n, size = struct.unpack("<4dIB", data[:37])
    encoding = next(k for k, v in codec.ENCODINGS.items() if v[0] == size)
    at = 40
    kind = f"<u{size}" if codec.ENCODINGS[encoding][2] else f"<f{size}"
    code = np.frombuffer(data, kind, 3 * n, at).reshape(-1, 3)
    at += -(-3 * n * size // 8) * 8
    return codec.decode_np(code, np.array(low), edge, encoding), np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)


def node_blobs(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, num_points, blob; a node holds as many points as the build allows."""
    ship(points.sparkSession)
    wide = points.select("node_id", *POSITION, *(F.col(f"color.{c}").alias(c) for c in ("red", "green", "blue"))).join(nodes.select("node_id", "min_x", "min_y", "min_z", "edge", "position_encoding"), "node_id")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        rows = rows.sort_values(list(POSITION))
        data = pack((r.min_x, r.min_y, r.min_z), r.edge, r.position_encoding, rows[list(POSITION)].to_numpy(), rows[["red", "green", "blue"]].to_numpy())
        return pd.DataFrame([(r.node_id, len(rows), data)], columns=["node_id", "num_points", "blob"])

    return wide.groupBy("node_id").applyInPandas(build, "node_id string, num_points long, blob binary")
