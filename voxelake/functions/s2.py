"""S2 cells: the published cube projection with quadratic scaling and the Hilbert curve over each face.

Cell ids are unsigned 64-bit numbers; Spark columns hold their bit pattern as BIGINT, so comparisons
shift the sign bit first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL, POS_BITS, LOOKUP_BITS = 30, 61, 4
# Fixed values of the curve: cell order within each orientation, and how it changes below.
_SWAP, _INVERT = 1, 2
_POS_TO_IJ = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
_POS_TO_ORIENTATION = (_SWAP, 0, 0, _SWAP | _INVERT)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(position, ij) lookups for four levels at once, made from the rules for one level."""
    pos, ij = np.zeros(1 << 2 * LOOKUP_BITS + 2, np.uint64), np.zeros(1 << 2 * LOOKUP_BITS + 2, np.uint64)

    def fill(level: int, i: int, j: int, first: int, at: int, turned: int) -> None:
        if level == LOOKUP_BITS:
            key = (i << LOOKUP_BITS) + j
            pos[(key << 2) + first] = (at << 2) + turned
            ij[(at << 2) + first] = (key << 2) + turned
            return
        for k, cell in enumerate(_POS_TO_IJ[turned]):
            fill(level + 1, (i << 1) + (cell >> 1), (j << 1) + (cell & 1), first, (at << 2) + k, turned ^ _POS_TO_ORIENTATION[k])

    for first in range(4):
        fill(0, 0, 0, first, 0, first)
    return pos, ij


def leaf_cells(p: np.ndarray) -> np.ndarray:
    """Leaf cell ids (uint64) of points (n, 3); only their direction matters."""
    p = np.asarray(p, float).reshape(-1, 3)
    axis = np.argmax(np.abs(p), axis=1)
    rows = np.arange(len(p))
    major = p[rows, axis]
    face = axis + np.where(major < 0, 3, 0)
    x, y, z = p.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [y / x, -x / y, -x / z, z / x, z / y], -y / z)
        v = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [z / x, z / y, -y / z, y / x, -x / y], -x / z)
    scale = lambda t: np.where(t >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(t)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(t)))
    top = (1 << MAX_LEVEL) - 1
    grid = lambda t: np.clip(np.nan_to_num(np.floor(scale(t) * (1 << MAX_LEVEL))), 0, top).astype(np.uint64)
    i, j = grid(u), grid(v)
    pos, _ = _tables()
    out = face.astype(np.uint64) << np.uint64(POS_BITS - 1)
    bits = face.astype(np.uint64) & np.uint64(_SWAP)
    mask = np.uint64((1 << LOOKUP_BITS) - 1)
    for k in range(7, -1, -1):
        shift = np.uint64(k * LOOKUP_BITS)
        key = bits + (((i >> shift) & mask) << np.uint64(LOOKUP_BITS + 2)) + (((j >> shift) & mask) << np.uint64(2))
        bits = pos[key.astype(np.int64)]
        out |= (bits >> np.uint64(2)) << np.uint64(k * 2 * LOOKUP_BITS)
        bits &= np.uint64(3)
    return out * np.uint64(2) + np.uint64(1)


def lsb(cells: np.ndarray) -> np.ndarray:
    c = np.asarray(cells, np.uint64)
    return c & (~c + np.uint64(1))


def level_of(cells: np.ndarray) -> np.ndarray:
    return MAX_LEVEL - (np.log2(lsb(cells).astype(float)) / 2).round().astype(int)


def parents(cells: np.ndarray, level: int) -> np.ndarray:
    low = np.uint64(1 << 2 * (MAX_LEVEL - level))
    c = np.asarray(cells, np.uint64)
    return (c & (~low + np.uint64(1))) | low


def leaf_range(cell: int) -> tuple[int, int]:
    """First and last leaf of a cell, as unsigned numbers."""
    low = cell & -cell
    return cell - (low - 1), cell + (low - 1)


def children(cell: int) -> list[int]:
    low = (cell & -cell) >> 2
    return [cell - 3 * low, cell - low, cell + low, cell + 3 * low] if low else []


def token(cell: int) -> str:
    return f"{cell:016x}".rstrip("0") or "X"


def from_token(text: str) -> int:
    return 0 if text == "X" else int(text.ljust(16, "0"), 16)


def normalised(cells: Sequence[int]) -> list[int]:
    """The smallest union of cells: none in another, and no four siblings."""
    out: list[int] = []
    for c in sorted(set(cells)):
        if out and leaf_range(out[-1])[0] <= c <= leaf_range(out[-1])[1]:
            continue
        while out and leaf_range(c)[0] <= out[-1] <= leaf_range(c)[1]:
            out.pop()
        out.append(c)
        while len(out) >= 4:
            low = out[-1] & -out[-1]
            up = (out[-1] & -(low << 2)) | (low << 2)
            if low << 2 > 1 << 60 or out[-4:] != children(up):
                break
            out[-4:] = [up]
    return out


def direction(cell: int) -> np.ndarray:
    """The unit vector at a cell's centre."""
    face, bits = cell >> POS_BITS, cell >> POS_BITS & _SWAP
    _, ij = _tables()
    i = j = 0
    for k in range(7, -1, -1):
        size = MAX_LEVEL - 7 * LOOKUP_BITS if k == 7 else LOOKUP_BITS
        bits += (cell >> (k * 2 * LOOKUP_BITS + 1) & (1 << 2 * size) - 1) << 2
        bits = int(ij[bits])
        i += bits >> LOOKUP_BITS + 2 << k * LOOKUP_BITS
        j += (bits >> 2 & (1 << LOOKUP_BITS) - 1) << k * LOOKUP_BITS
        bits &= 3
    low = cell & -cell
    size = 1 << (low.bit_length() - 1) // 2
    s, t = (((v & -size) + size / 2) / (1 << MAX_LEVEL) for v in (i, j))
    un = lambda a: (4 * a * a - 1) / 3 if a >= 0.5 else (1 - 4 * (1 - a) ** 2) / 3
    u, v = un(s), un(t)
    p = np.array([(1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1)][face], float)
    return p / np.linalg.norm(p)


# --- Columns ----------------------------------------------------------------------------------


def leaf_column(x: Column, y: Column, z: Column) -> Column:
    """Leaf cell of a point, as the bit pattern in a BIGINT: :func:`leaf_cells` as expressions; null for a NaN.

    The curve is a fold over eight steps of four levels, each a look-up in a literal table."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    major = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    face = (axis + F.when(major < 0, 3).otherwise(0)).cast("long")
    of_face = lambda *parts: F.try_divide(F.when(axis == 0, parts[0]).when(axis == 1, parts[1]).otherwise(parts[2]), major)
    # Faces 3 to 5 take the other two coordinates in the other order.
    front = major >= 0
    u = of_face(F.when(front, y).otherwise(z), F.when(front, -x).otherwise(z), F.when(front, -x).otherwise(-y))
    v = of_face(F.when(front, z).otherwise(y), F.when(front, z).otherwise(-x), F.when(front, -y).otherwise(-x))
    root = lambda t: F.sqrt(F.abs(t) * 3.0 + 1.0) * 0.5
    scale = lambda t: F.when(t >= 0, root(t)).otherwise(F.lit(1.0) - root(t))
    top = (1 << MAX_LEVEL) - 1
    grid = lambda t: F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(F.floor(scale(t) * float(1 << MAX_LEVEL)), F.lit(0)))).cast("long")
    steps = F.split(F.lit(",".join(map(str, _tables()[0]))), ",").cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("cell"), face.bitwiseAND(_SWAP).alias("turned"), grid(u).alias("i"), grid(v).alias("j"))

    def step(at: Column, shift: Column) -> Column:
        four = lambda c, by: F.shiftleft(F.call_function("shiftright", c, shift).bitwiseAND((1 << LOOKUP_BITS) - 1), by)
        found = F.get(steps, at["turned"].bitwiseOR(four(at["i"], LOOKUP_BITS + 2)).bitwiseOR(four(at["j"], 2)).cast("int"))
        cell = F.shiftleft(at["cell"], 2 * LOOKUP_BITS).bitwiseOR(F.shiftright(found, 2))
        return F.struct(cell.alias("cell"), found.bitwiseAND(3).alias("turned"), at["i"].alias("i"), at["j"].alias("j"))

    shifts = F.array(*(F.lit(k * LOOKUP_BITS) for k in range(7, -1, -1)))
    curve = F.aggregate(shifts, start, step, lambda at: at["cell"])
    leaf = F.shiftleft(F.shiftleft(face, POS_BITS - 1).bitwiseOR(curve), 1).bitwiseOR(F.lit(1).cast("long"))
    return F.when(F.isnan(x) | F.isnan(y) | F.isnan(z) | (x + y + z).isNull(), None).otherwise(leaf)


def parent_column(cell: Column, level: int) -> Column:
    """The cell's ancestor: bit arithmetic only."""
    low = 1 << 2 * (MAX_LEVEL - level)
    return cell.bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def in_union(leaf: Column, cells: Sequence[int]) -> Column:
    """Whether a leaf lies in one of the cells. Cells are of one sign each, so a range of bit patterns
    is a range of signed numbers."""
    out = F.lit(False)
    for c in normalised(cells):
        a, b = leaf_range(c)
        out = out | leaf.between(F.lit(_signed(a)), F.lit(_signed(b)))
    return out


def token_column(cell: Column) -> Column:
    """As :func:`token`: hexadecimal without the zeros at the end, X for no cell."""
    return F.when(cell == 0, F.lit("X")).otherwise(F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", ""))
