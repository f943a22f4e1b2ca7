"""Image pyramids: tiles, background, roll-up to parents, merging of partial pyramids and inpainting.

Tiles are rows (level, tile_x, tile_y, png); y counts upwards as in quadtree ids, images downwards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.functions import ids
from voxelake.shipping import ship
from voxelake.sources import png
from voxelake.staging import staged

from .geometry import OUT, Location

#: Half the height of the plate that a tile is to a view volume; a fixed value.
PLATE = 0.1
#: Of texture: what guessed pixels count to known ones, and how many sources along a side are tried.
GUESSED, WINDOW = 0.25, 17
TILE_SCHEMA = "level int, tile_x int, tile_y int, png binary"


def tile_images(pixels: DataFrame, level: int, tile_px: int) -> DataFrame:
    """One image for each tile of (tile_x, tile_y, px, py, red, green, blue, alpha); a tile's pixels are
    at most tile_px squared, so a group is bounded."""
    ship(pixels.sparkSession)

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((tile_px, tile_px, 4), np.uint8)
        image[rows.py, rows.px] = rows[["red", "green", "blue", "alpha"]].to_numpy(np.uint8)
        return pd.DataFrame([(level, *key, png.encode(image))], columns=["level", "tile_x", "tile_y", "png"])

    return pixels.groupBy("tile_x", "tile_y").applyInPandas(draw, TILE_SCHEMA)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """level, tile_x, tile_y, px, py, red, green, blue, alpha of the pixels that aren't wholly transparent."""
    ship(tiles.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for level, x, y, data in zip(frame.level, frame.tile_x, frame.tile_y, frame.png, strict=True):
                image = png.decode(data)
                py, px = np.nonzero(image[..., 3])
                channels = dict(zip(("red", "green", "blue", "alpha"), image[py, px].T.astype(np.int32), strict=True))
                yield pd.DataFrame({"level": level, "tile_x": x, "tile_y": y, "px": px.astype(np.int32), "py": py.astype(np.int32), **channels})

    return tiles.select("level", "tile_x", "tile_y", "png").mapInPandas(read, "level int, tile_x int, tile_y int, px int, py int, red int, green int, blue int, alpha int")


def on_background(image: np.ndarray, rgba: Sequence[int]) -> np.ndarray:
    """Pixels of little alpha get the background colour."""
    out = image.copy()
    out[out[..., 3] < 128] = rgba
    return out


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


@lru_cache(maxsize=8)
def _weights(n: int) -> np.ndarray:
    """(n, 2 n): each output sample from the inputs within three samples, normalised."""
    centre = (np.arange(n) + 0.5) * 2
    w = _lanczos((np.arange(2 * n) + 0.5 - centre[:, None]) / 2)
    return w / w.sum(axis=1, keepdims=True)


def halved(image: np.ndarray) -> np.ndarray:
    """Lanczos-3 reduction by two on both axes; halves are rounded up, whatever the last digits of a sum are."""
    wy, wx = _weights(image.shape[0] // 2), _weights(image.shape[1] // 2)
    out = np.einsum("yi,ijc,xj->yxc", wy, image.astype(float), wx, optimize=True)
    return np.clip(np.floor(out.round(6) + 0.5), 0, 255).astype(np.uint8)


def mosaic(children: dict[int, np.ndarray], tile_px: int, background: Sequence[int]) -> np.ndarray:
    """Children by quadrant (x << 1 | y): 1 top left, 0 bottom left, 3 top right, 2 bottom right."""
    out = np.empty((2 * tile_px, 2 * tile_px, 4), np.uint8)
    out[:] = background
    for quadrant, image in children.items():
        if image.shape != (tile_px, tile_px, 4):
            raise ValueError(f"a child tile is {image.shape}, not {tile_px} pixels square")
        top, left = (0 if quadrant & 1 else tile_px), (tile_px if quadrant >> 1 else 0)
        out[top : top + tile_px, left : left + tile_px] = image
    return out


def with_background(tiles: DataFrame, rgba: Sequence[int]) -> DataFrame:
    ship(tiles.sparkSession)

    @F.pandas_udf("binary")
    def fill(images: pd.Series) -> pd.Series:
        return images.map(lambda b: png.encode(on_background(png.decode(b), rgba)))

    return tiles.withColumn("png", fill("png"))


def parents(tiles: DataFrame, tile_px: int, background: Sequence[int]) -> DataFrame:
    """The next level up: groups of four at most."""
    ship(tiles.sparkSession)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = {int(x % 2) * 2 + int(y % 2): png.decode(b) for x, y, b in zip(rows.tile_x, rows.tile_y, rows.png, strict=True)}
        image = halved(mosaic(found, tile_px, background))
        return pd.DataFrame([(int(rows.level.iloc[0]) - 1, *key, png.encode(image))], columns=["level", "tile_x", "tile_y", "png"])

    up = tiles.withColumns({"px": F.floor(F.col("tile_x") / 2).cast("int"), "py": F.floor(F.col("tile_y") / 2).cast("int")})
    return up.groupBy("px", "py").applyInPandas(join, TILE_SCHEMA)


def build_levels(leaves: DataFrame, deepest: int, root: int, tile_px: int, background: Sequence[int] = (255, 255, 255, 255)) -> DataFrame:
    """All levels from the leaves up to ``root``."""
    if root > deepest:
        raise ValueError("the root lies below the leaves")
    level = staged(leaves, "tiles")
    out = [level]
    for _ in range(deepest, root, -1):
        level = staged(parents(level, tile_px, background), "tiles")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def node_ids(tiles: DataFrame) -> DataFrame:
    """Adds the quadtree id of each tile; tiles of a level are named alike."""
    levels = [r["level"] for r in tiles.select("level").distinct().collect()]  # as many as the pyramid has
    node = F.lit(None).cast("string")
    for k in levels:
        node = F.when(F.col("level") == k, ids.quad_path(F.col("tile_x"), F.col("tile_y"), k)).otherwise(node)
    return tiles.withColumn("node_id", node)


def nodes_for_level(tiles: DataFrame, level: int, low: tuple[float, float], edge: float, view: tuple[float, float, float, float]) -> DataFrame:
    """Tiles of a level that a view (x0, y0, x1, y1) meets; touching counts."""
    side = edge / (1 << level)
    x, y = F.col("tile_x") * side + low[0], F.col("tile_y") * side + low[1]
    return tiles.where((F.col("level") == level) & (x <= view[2]) & (x + side >= view[0]) & (y <= view[3]) & (y + side >= view[1]))


def nodes_in_view(tiles: DataFrame, level: int, low: tuple[float, float], edge: float, location: Location) -> DataFrame:
    """Tiles of a level that a view volume meets, as thin plates on the plane of height 0. A plate below one that is
    outside is outside too, so the levels above aren't asked."""
    side = edge / (1 << level)
    x, y = F.col("tile_x") * side + low[0], F.col("tile_y") * side + low[1]
    how = location.relation([x, y, F.lit(-PLATE)], [x + side, y + side, F.lit(PLATE)])
    return tiles.where((F.col("level") == level) & (how != OUT))


def merged(parts: Sequence[DataFrame], roots: Sequence[str], tile_px: int, background: Sequence[int] = (255, 255, 255, 255)) -> DataFrame:
    """One pyramid of partial ones with different roots of one level: their tiles, and the levels above
    the roots built anew. Of a tile in several parts that of the last is taken."""
    if len(set(roots)) != len(roots):
        raise ValueError("two parts have the same root")
    if len({ids.level(r) for r in roots}) != 1:
        raise ValueError("the roots are of different levels")
    top = ids.level(roots[0])
    tagged = [p.where(F.col("level") >= top).withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    last = every.groupBy("level", "tile_x", "tile_y").agg(F.max_by("png", "_part").alias("png"))
    kept = staged(last.select("level", "tile_x", "tile_y", "png"), "merged")
    upper = build_levels(kept.where(F.col("level") == top), top, 0, tile_px, background).where(F.col("level") < top)
    return kept.unionByName(upper)


# --- inpainting -------------------------------------------------------------------------------


def _window_any(mask: np.ndarray, d: int) -> np.ndarray:
    """Whether any pixel within d on both axes is set; one axis after the other."""
    out = mask
    for axis in (0, 1):
        total = np.cumsum(np.pad(out.astype(int), [(d + 1, d) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        size = mask.shape[axis]
        high, low = np.take(total, range(2 * d + 1, 2 * d + 1 + size), axis), np.take(total, range(size), axis)
        out = high - low > 0
    return out


def closed(mask: np.ndarray, d: int) -> np.ndarray:
    """Dilated, then eroded: holes up to 2 d wide are filled."""
    wide = np.pad(mask, d)
    return ~_window_any(~_window_any(wide, d), d)[d:-d, d:-d] | mask if d else mask


def filled(image: np.ndarray, d: int) -> np.ndarray:
    """Holes of the alpha mask get the mean of the filled pixels around them, nearest first."""
    known = image[..., 3] > 0
    todo = closed(known, d) & ~known
    if not todo.any():
        return image
    value, weight = image.astype(float) * known[..., None], known.astype(float)
    while todo.any():
        v, w = np.zeros_like(value), np.zeros_like(weight)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v += np.roll(np.pad(value, ((1, 1), (1, 1), (0, 0))), (dy, dx), (0, 1))[1:-1, 1:-1]
                w += np.roll(np.pad(weight, 1), (dy, dx), (0, 1))[1:-1, 1:-1]
        now = todo & (w > 0)
        if not now.any():
            break
        value[now], weight[now] = v[now] / w[now][:, None], 1.0
        todo &= ~now
    out = np.rint(value).astype(np.uint8)
    out[known] = image[known]
    out[(weight > 0) & ~known, 3] = 255
    return out


def _halved_known(value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known pixels of each two by two, and where there are any."""
    rows, columns = known.shape[0] // 2, known.shape[1] // 2
    weight = known[: rows * 2, : columns * 2].reshape(rows, 2, columns, 2).astype(float)
    total = (value[: rows * 2, : columns * 2] * known[: rows * 2, : columns * 2, None]).reshape(rows, 2, columns, 2, -1).sum((1, 3))
    n = weight.sum((1, 3))
    return total / np.maximum(n, 1)[..., None], n > 0


def _patches(value: np.ndarray) -> np.ndarray:
    """The three by three pixels around each, row by row; nothing beyond the border."""
    wide = np.pad(value, ((1, 1), (1, 1), *[(0, 0)] * (value.ndim - 2)))
    h, w = value.shape[:2]
    return np.stack([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], 2)


def offsets(reach: int) -> list[tuple[int, int]]:
    """Steps to the pixels that may be copied, nearest first: of a window of ``reach`` every so many rows and columns
    that they are at most WINDOW ** 2."""
    step = max(1, -(-(2 * reach + 1) // WINDOW))
    line = range(-(reach // step) * step, reach + 1, step)
    return sorted(((dy, dx) for dy in line for dx in line), key=lambda o: (o[0] ** 2 + o[1] ** 2, o))


def matched(value: np.ndarray, known: np.ndarray, todo: np.ndarray, guess: np.ndarray, reach: int) -> np.ndarray:
    """``guess`` with each pixel of ``todo`` replaced by the known pixel whose surroundings are most like its own.

    Surroundings are three by three pixels; those of a hole count known pixels fully and guessed ones by GUESSED, those of
    a source only known ones. All pixels are told at once, so the result doesn't depend on an order."""
    at = np.argwhere(todo)
    trust = known + GUESSED * todo
    shown = np.where(known[..., None], value, guess)
    around, weights = _patches(shown)[todo], _patches(trust.astype(float))[todo]
    sources, held = _patches(value), _patches(known.astype(float))
    best, out = np.full(len(at), np.inf), guess[todo].copy()
    for dy, dx in offsets(reach):
        y, x = at[:, 0] + dy, at[:, 1] + dx
        fits = np.flatnonzero((y >= 0) & (y < known.shape[0]) & (x >= 0) & (x < known.shape[1]))
        fits = fits[known[y[fits], x[fits]]]
        y, x = y[fits], x[fits]
        w = weights[fits] * held[y, x]
        total = w.sum(1)
        apart = (w * ((around[fits] - sources[y, x]) ** 2).sum(2)).sum(1)
        score = np.where(total > 0, apart / np.maximum(total, 1e-9), np.inf)
        better = score < best[fits]
        best[fits[better]], out[fits[better]] = score[better], value[y[better], x[better]]
    found = guess.copy()
    found[todo] = out
    return found


def synthesised(image: np.ndarray, d: int) -> np.ndarray:
    """Holes of the alpha mask of up to ``2 d`` pixels, filled by texture: every filled pixel is a copy of a known one,
    found coarse to fine. The guess at half size starts from means, and that at full size from what the coarse one found."""
    known = image[..., 3] > 0
    todo = closed(known, d) & ~known
    if not todo.any():
        return image
    plain = filled(image, d)
    todo &= plain[..., 3] > 0
    value, guess = image.astype(float), plain.astype(float)
    rough, some = _halved_known(value, known)
    if d > 1 and some.size:
        start, there = _halved_known(guess, todo)
        holes = there & ~some
        coarse = matched(rough, some, holes, np.where(some[..., None], rough, start), d + 1)
        wide = coarse.repeat(2, 0).repeat(2, 1)
        inner = todo[: wide.shape[0], : wide.shape[1]] & holes.repeat(2, 0).repeat(2, 1)
        guess[: wide.shape[0], : wide.shape[1]][inner] = wide[inner]
    out = matched(value, known, todo, guess, 2 * d + 1).round().astype(np.uint8)
    out[known] = image[known]
    out[~known & ~todo] = image[~known & ~todo]
    return out


def mixed(first: np.ndarray, second: np.ndarray, axis: int) -> np.ndarray:
    """Two views of the same place: the share of the second grows evenly along the axis from none to all. A pixel that
    only one of them shows is that one's."""
    n = first.shape[axis]
    share = (np.arange(n) / max(n - 1, 1)).reshape([-1 if k == axis else 1 for k in range(first.ndim)])
    out = np.floor(first * (1 - share) + second * share + 0.5).astype(np.uint8)
    out = np.where(second[..., 3:] > 0, out, first)
    return np.where(first[..., 3:] > 0, out, second)


def inpainted(tiles: DataFrame, d: int, tile_px: int) -> DataFrame:
    """Leaf tiles with holes of up to ``2 d`` pixels filled across tile borders.

    Each tile is seen with what is around it (its neighbours' nearest halves, nine rows a tile at most; more of
    them where d is above a quarter tile) and filled. A tile and its neighbour then show the same place, as wide as a
    tile, each from its own side: the two views are mixed, first with the right neighbour, then with the one below, so
    both sides of a border come from one image. At last each tile is cut out."""
    if d == 0:
        return tiles
    ship(tiles.sparkSession)
    half = tile_px // 2
    margin = half if 4 * d <= tile_px else 4 * d
    reach = -(-margin // tile_px)
    near = range(-reach, reach + 1)
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in near for y in near]))
    seen = tiles.withColumn("to", spread).select("level", "tile_x", "tile_y", "png", (F.col("tile_x") + F.col("to.dx")).alias("tx"), (F.col("tile_y") + F.col("to.dy")).alias("ty"))
    own = tiles.select(F.col("tile_x").alias("tx"), F.col("tile_y").alias("ty"))
    wide = tile_px + 2 * half

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        big = np.zeros((len(near) * tile_px, len(near) * tile_px, 4), np.uint8)
        for x, y, b in zip(rows.tile_x, rows.tile_y, rows.png, strict=True):
            left, top = (x - key[0] + reach) * tile_px, (key[1] - y + reach) * tile_px
            big[top : top + tile_px, left : left + tile_px] = png.decode(b)
        cut = slice(reach * tile_px - margin, (reach + 1) * tile_px + margin)
        out = synthesised(big[cut, cut], d)[margin - half : margin - half + wide, margin - half : margin - half + wide]
        return pd.DataFrame([(int(rows.level.iloc[0]), *key, *_with_ends(out, 1))], columns=VIEW_COLUMNS)

    views = staged(seen.join(own, ["tx", "ty"], "left_semi").groupBy("tx", "ty").applyInPandas(fill, VIEW_SCHEMA), "views")
    views = staged(_exchanged(views, 1, tile_px), "views")
    return _exchanged(views, 0, tile_px, cut=half)


VIEW_COLUMNS = ["level", "tile_x", "tile_y", "png", "head", "tail"]
VIEW_SCHEMA = "level int, tile_x int, tile_y int, png binary, head binary, tail binary"


def _with_ends(view: np.ndarray, axis: int) -> tuple[bytes, bytes, bytes]:
    """A view, and the halves of it along an axis that its neighbours show too."""
    head, tail = np.split(view, 2, axis)
    return png.encode(view), png.encode(np.ascontiguousarray(head)), png.encode(np.ascontiguousarray(tail))


def _exchanged(views: DataFrame, axis: int, tile_px: int, cut: int | None = None) -> DataFrame:
    """Views mixed with those of both neighbours along an axis (1: left and right, 0: above and below), by joins on
    their places; only halves are moved. ``cut``: as tiles, without the margin."""
    along, step = ("tile_x", 1) if axis else ("tile_y", -1)  # images go downwards, places upwards

    def ends(name: str, half: str, shift: int) -> DataFrame:
        other = "tile_y" if axis else "tile_x"
        return views.select((F.col(along) + shift).alias(along), other, F.col(half).alias(name))

    near = views.join(ends("before", "tail", step), ["tile_x", "tile_y"], "left").join(ends("after", "head", -step), ["tile_x", "tile_y"], "left")

    def mix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for r in rows.itertuples():
                head, tail = np.split(png.decode(r.png), 2, axis)
                if r.before is not None:
                    head = mixed(png.decode(r.before), head, axis)
                if r.after is not None:
                    tail = mixed(tail, png.decode(r.after), axis)
                view = np.concatenate([head, tail], axis)
                if cut is None:
                    out.append((r.level, r.tile_x, r.tile_y, *_with_ends(view, 0)))
                else:
                    out.append((r.level, r.tile_x, r.tile_y, png.encode(np.ascontiguousarray(view[cut : cut + tile_px, cut : cut + tile_px]))))
            yield pd.DataFrame(out, columns=VIEW_COLUMNS if cut is None else VIEW_COLUMNS[:4])

    return near.mapInPandas(mix, VIEW_SCHEMA if cut is None else TILE_SCHEMA)
