"""Attribute types of point clouds and their Spark and numpy forms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class AttributeType:
    name: str
    wire: int
    size: int
    dims: int
    spark: T.DataType
    dtype: str


def _vec(names: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names.split()])


# Names, wire numbers and sizes of the stored format.
TYPES: dict[str, AttributeType] = {
    t.name: t
    for t in (
        AttributeType("U8", 1, 1, 1, T.ShortType(), "<u1"),
        AttributeType("U16", 2, 2, 1, T.IntegerType(), "<u2"),
        AttributeType("U32", 3, 4, 1, T.LongType(), "<u4"),
        AttributeType("U64", 4, 8, 1, T.DecimalType(20, 0), "<u8"),
        AttributeType("I8", 6, 1, 1, T.ByteType(), "<i1"),
        AttributeType("I16", 7, 2, 1, T.ShortType(), "<i2"),
        AttributeType("I32", 8, 4, 1, T.IntegerType(), "<i4"),
        AttributeType("I64", 9, 8, 1, T.LongType(), "<i8"),
        AttributeType("F32", 11, 4, 1, T.FloatType(), "<f4"),
        AttributeType("F64", 12, 8, 1, T.DoubleType(), "<f8"),
        AttributeType("U8Vec3", 27, 3, 3, _vec("red green blue", T.ShortType()), "<u1"),
        AttributeType("F64Vec3", 38, 24, 3, _vec("x y z", T.DoubleType()), "<f8"),
    )
}
BY_WIRE = {t.wire: t for t in TYPES.values()}
POSITION = ("x", "y", "z")


def tagged(col: Column, name: str, kind: str) -> Column:
    """``col`` as ``name``, remembering its attribute type for writers."""
    if kind not in TYPES:
        raise ValueError(f"no attribute type {kind!r}")
    return col.cast(TYPES[kind].spark).alias(name, metadata={"attr_type": kind})


def type_of(field: T.StructField) -> str:
    """The attribute type of a column: as tagged, or the narrowest that its Spark type stands for."""
    if kind := (field.metadata or {}).get("attr_type"):
        return kind
    # Untagged columns are signed: unsigned ones are always tagged.
    for name in ("I8", "I16", "I32", "I64", "F32", "F64", "U64", "U8Vec3", "F64Vec3"):
        if TYPES[name].spark == field.dataType:
            return name
    raise ValueError(f"column {field.name!r} of type {field.dataType.simpleString()} is no attribute")


def attribute_types(df: DataFrame) -> dict[str, str]:
    """name -> type of the attributes of a cloud, sorted by name; position is not one of them."""
    return {f.name: type_of(f) for f in sorted(df.schema, key=lambda f: f.name) if f.name not in POSITION}


def schema_with_position(df: DataFrame) -> list[tuple[str, str]]:
    """The same, with position as ``xyz`` at the end."""
    return [*attribute_types(df).items(), ("xyz", "F64Vec3")]


def require(df: DataFrame, name: str, kind: str | None = None) -> None:
    """Raise unless ``df`` has the attribute, of that type if given."""
    found = attribute_types(df)
    if name not in found:
        raise KeyError(f"Data type for attribute '{name}' not found.")
    if kind is not None and found[name] != kind:
        raise TypeError(f"attribute '{name}' is {found[name]}, not {kind}")


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both; an empty schema adopts the other's, and the attributes must be the same."""
    if not first.columns:
        return second
    if attribute_types(first) != attribute_types(second):
        raise ValueError("the batches have different attributes")
    return first.unionByName(second)


def numpy_of(values, kind: str) -> np.ndarray:
    """A column's values as stored: little-endian, vectors as rows."""
    t = TYPES[kind]
    return np.asarray(values, t.dtype).reshape((-1, t.dims) if t.dims > 1 else -1)
