"""Node ids of octrees and quadtrees: paths like ``r0412`` (octree) and ``r301`` (quadtree).

Octree digits are ``x << 2 | y << 1 | z``, quadtree digits ``x << 1 | y``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that a node id's 120 bits of path hold.
MAX_LEVEL = 40
OCTREE, QUADTREE = re.compile(r"^r[0-7]*$"), re.compile(r"^r[0-3]*$")
#: (name, dx, dy); up is +y.
DIRECTIONS = (("left", -1, 0), ("top_left", -1, 1), ("top", 0, 1), ("top_right", 1, 1), ("right", 1, 0), ("bottom_right", 1, -1), ("bottom", 0, -1), ("bottom_left", -1, -1))


def checked(node: str, base: int) -> str:
    if not (OCTREE if base == 8 else QUADTREE).match(node):
        raise ValueError(f"{node!r} is no node id")
    return node


def level(node: str) -> int:
    return len(node) - 1


def parent(node: str) -> str | None:
    return node[:-1] if len(node) > 1 else None


def child(node: str, index: int) -> str:
    return f"{node}{index}"


def child_index(node: str) -> int | None:
    return int(node[-1]) if len(node) > 1 else None


def octree_index(node: str) -> tuple[int, int, int]:
    """Cell of the node in the grid of its level."""
    x = y = z = 0
    for d in checked(node, 8)[1:]:
        d = int(d)
        x, y, z = x << 1 | d >> 2, y << 1 | d >> 1 & 1, z << 1 | d & 1
    return x, y, z


def octree_node(lev: int, x: int, y: int, z: int) -> str:
    return "r" + "".join(str((x >> k & 1) << 2 | (y >> k & 1) << 1 | z >> k & 1) for k in range(lev - 1, -1, -1))


def octree_wire(node: str) -> tuple[int, int]:
    """High and low 64 bits: 8 bits of level, 120 bits of path."""
    value = level(node) << 120 | (int(node[1:], 8) if len(node) > 1 else 0)
    return value >> 64, value & (1 << 64) - 1


def octree_unwire(high: int, low: int, old_level: int = 0, old_index: int = 0) -> str:
    """From the wire form; ids of the old form have level and index instead."""
    if not high and not low:
        lev, path = old_level, old_index
    else:
        value = high << 64 | low
        lev, path = value >> 120, value & (1 << 120) - 1
    return "r" + (oct(path)[2:].zfill(lev) if lev else "")


def quad_index(node: str) -> tuple[int, int, int]:
    """(level, x, y)."""
    x = y = 0
    for d in checked(node, 4)[1:]:
        x, y = x << 1 | int(d) >> 1, y << 1 | int(d) & 1
    return level(node), x, y


def quad_node(lev: int, x: int, y: int) -> str:
    return "r" + "".join(str((x >> k & 1) << 1 | y >> k & 1) for k in range(lev - 1, -1, -1))


def quad_number(node: str) -> int:
    return int(node[1:], 4) if len(node) > 1 else 0


def quad_from_number(lev: int, number: int) -> str:
    return "r" + "".join(str(number >> 2 * k & 3) for k in range(lev - 1, -1, -1))


def quad_neighbour(node: str, direction: str) -> str | None:
    """The node next to it on its level; None beyond the border."""
    lev, x, y = quad_index(node)
    dx, dy = next((dx, dy) for n, dx, dy in DIRECTIONS if n == direction)
    x, y = x + dx, y + dy
    return quad_node(lev, x, y) if 0 <= x < 1 << lev and 0 <= y < 1 << lev else None


# --- Columns ----------------------------------------------------------------------------------


def cell_of(v: Column, low: float, edge: float, depth: int, half_open: bool = False) -> Column:
    """Grid cell of a coordinate at ``depth``. Octree cells are (low, high]: a point belongs to the
    upper half only if it is greater than the centre; ``half_open`` gives the quadtree's [low, high)."""
    n = float(1 << depth)
    if not edge > 0:
        return F.lit(0).cast("long")
    scaled = (v - F.lit(low)) / F.lit(edge) * F.lit(n)
    cell = F.floor(scaled) if half_open else F.ceil(scaled) - 1
    return F.greatest(F.lit(0), F.least(F.lit((1 << depth) - 1), cell)).cast("long")


def octree_path(ix: Column, iy: Column, iz: Column, depth: int) -> Column:
    """Path text of a grid cell."""
    digit = lambda k: (F.shiftright(ix, k).bitwiseAND(1) * 4 + F.shiftright(iy, k).bitwiseAND(1) * 2 + F.shiftright(iz, k).bitwiseAND(1)).cast("string")
    return F.concat(F.lit("r"), *(digit(k) for k in range(depth - 1, -1, -1)))


def quad_path(x: Column, y: Column, depth: int) -> Column:
    digit = lambda k: (F.shiftright(x, k).bitwiseAND(1) * 2 + F.shiftright(y, k).bitwiseAND(1)).cast("string")
    return F.concat(F.lit("r"), *(digit(k) for k in range(depth - 1, -1, -1)))


def neighbour_path(x: Column, y: Column, depth: int, dx: int, dy: int) -> Column:
    """The quadtree node so many cells away on the same level; null beyond the border."""
    nx, ny, last = x + dx, y + dy, (1 << depth) - 1
    return F.when(nx.between(0, last) & ny.between(0, last), quad_path(nx, ny, depth))


def parent_path(node: Column) -> Column:
    """Null for the root."""
    return F.when(F.length(node) > 1, F.substring(node, F.lit(1), F.length(node) - 1))


def path_level(node: Column) -> Column:
    return F.length(node) - 1


def interleave(x: Column, y: Column, depth: int) -> Column:
    """Quadkey number of a grid cell; y is the low bit of each pair."""
    out = F.lit(0).cast("long")
    for k in range(depth):
        bit = lambda v, k=k: F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit(x), 2 * k + 1)).bitwiseOR(F.shiftleft(bit(y), 2 * k))
    return out


def deinterleave(number: Column, depth: int) -> tuple[Column, Column]:
    one = F.lit(1).cast("long")
    x = y = F.lit(0).cast("long")
    for k in range(depth):
        x = x.bitwiseOR(F.shiftleft(F.shiftright(number, 2 * k + 1).bitwiseAND(one), k))
        y = y.bitwiseOR(F.shiftleft(F.shiftright(number, 2 * k).bitwiseAND(one), k))
    return x, y


def grid_cell(v: Column, origin: float, resolution: float, half_extent: int = 0) -> Column:
    """Cell of a position in a moving grid whose window is centred half an extent away."""
    return (F.floor((v - F.lit(origin)) / F.lit(resolution)) - half_extent).cast("long")
