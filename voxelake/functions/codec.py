"""Position encodings within a node's cube."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names with bytes per coordinate, wire number and largest integer (floats: None).
ENCODINGS = {"U8": (1, 1, 255), "U16": (2, 2, 65535), "F32": (4, 3, None), "F64": (8, 4, None)}


def choose(edge: float, resolution: float) -> str:
    """The smallest encoding that keeps the resolution over an edge."""
    ratio = edge / resolution
    bits = (int(math.log2(ratio)) if ratio > 1 else 0) + 1
    return "U8" if bits <= 8 else "U16" if bits <= 16 else "F32" if bits <= 24 else "F64"


def choose_column(edge: Column, resolution: float) -> Column:
    ratio = edge / F.lit(resolution)
    bits = F.when(ratio > 1, F.floor(F.log2(ratio))).otherwise(0) + 1
    return F.when(bits <= 8, "U8").when(bits <= 16, "U16").when(bits <= 24, "F32").otherwise("F64")


def encode(v: Column, low: Column, edge: Column, encoding: str) -> Column:
    """Integer for U8 and U16 (truncated), float or double in [0, 1] otherwise; a flat cube gives 0."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v - low, edge), F.lit(0.0))))
    top = ENCODINGS[encoding][2]
    if top:
        return F.floor(unit * top).cast("int")
    return unit.cast("float" if encoding == "F32" else "double")


def decode(code: Column, low: Column, edge: Column, encoding: str) -> Column:
    top = ENCODINGS[encoding][2]
    return (code / F.lit(float(top)) if top else code.cast("double")) * edge + low


def encode_np(v: np.ndarray, low: np.ndarray, edge: float, encoding: str) -> np.ndarray:
    unit = np.clip((v - low) / edge, 0, 1) if edge > 0 else np.zeros_like(v)
    size, _, top = ENCODINGS[encoding]
    return np.floor(unit * top).astype(f"<u{size}") if top else unit.astype(f"<f{size}")


def decode_np(code: np.ndarray, low: np.ndarray, edge: float, encoding: str) -> np.ndarray:
    top = ENCODINGS[encoding][2]
    return (code / top if top else code.astype(float)) * edge + low
