"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected on ``PROJECTED`` Gaussian (2-stable) directions: the squared projected
distance over the squared distance is chi-square distributed with that many degrees of freedom. A
kd-tree over the projections gives a query's neighbours in order of projected distance; each is
verified on the original vectors. The search stops when, with r the projected distance reached and d
the distance of the k-th best so far, chi2(r^2 / d^2) >= ``CONFIDENCE``: a better row not yet seen
would have been projected nearer with that probability.

The tree's top splits at medians of a bounded sample of all rows' projections (``SAMPLE``), so that a cell
holds about ``BLOCK_ROWS``; every row goes to its cell, whose box is measured over all its rows. A query is
searched in its own cell first. The distance of its k-th best there bounds, by the same test, how far it
still has to look, and it is sent only to cells whose box is nearer than that; each search there starts with
the bound. So clustered queries meet few cells, while for vectors without neighbours much nearer than the
rest the test itself asks for most rows. Cells larger than a block are dealt to several by hashed id, cells
with many queries to several chunks. Of equal vectors the k + 1 smallest ids are kept, as a query can't
return more of them (one may be its own), so a vector that many rows share costs one.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither do null ids; rows that repeat an id and vector count once; candidates
never have the query's id; ties go to the smaller id; fewer candidates than k are all returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelake.shipping import ship

from .common import hash_sample, map_arrow, staged, table

PROJECTED, CONFIDENCE, LEAF = 8, 0.97, 48
BLOCK_ROWS, CHUNK_QUERIES = 16_384, 2_048
#: Rows whose projections choose the top splits, and the most levels of these (64 bytes a row and 128 a cell).
SAMPLE, MAX_DEPTH = 32_768, 12
#: Squared distances below this are rounding.
SLACK = 1e-9


def chi2_cdf(x: float) -> float:
    """For PROJECTED (even) degrees of freedom."""
    h, term, total = x / 2, 1.0, 0.0
    for i in range(PROJECTED // 2):
        total += term
        term *= h / (i + 1)
    return 1 - math.exp(-h) * total


def _chi2_quantile(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid) < p else (low, mid)
    return high


class Top:
    """The tree's top: ``depth`` levels of splits at the median of the widest dimension of a sample."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth - 1, np.int64)
        self.value = np.full(2**depth - 1, np.inf)
        own = [points]
        for node in range(2**depth - 1):
            p = own[node]
            if len(p) > 1:
                self.axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
                self.value[node] = np.median(p[:, self.axis[node]])
            right = p[:, self.axis[node]] > self.value[node]
            own += [p[~right], p[right]]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node, each = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[each, self.axis[node]] > self.value[node])
        return node - (2**self.depth - 1)


class Tree:
    """kd-tree: split at the median of the widest dimension down to leaves; leaves keep their boxes."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            p = points[own]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            half = len(own) // 2
            order = np.argpartition(p[:, axis], half)
            todo += [own[order[:half]], own[order[half:]]]
        self.order = np.concatenate(leaves)
        self.points = points[self.order]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.places = [np.arange(a, b) for a, b in zip(self.starts, self.ends, strict=True)]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in zip(self.starts, self.ends, strict=True)])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.starts, self.ends, strict=True)])

    def batches(self, q: np.ndarray, leaves: int = 4):
        """(positions, r^2): points in batches, and the squared distance below which all have been given.
        Each batch has twice the leaves of the one before, so a long search takes few steps."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        bound = (gap * gap).sum(axis=1)
        visit = np.argsort(bound, kind="stable")
        waiting, far, at = np.empty(0, np.int64), np.empty(0), 0
        while at < len(visit):
            rows = np.concatenate([self.places[v] for v in visit[at : at + leaves]])
            at, leaves = at + leaves, leaves * 2
            d = self.points[rows] - q
            waiting, far = np.concatenate([waiting, rows]), np.concatenate([far, np.einsum("ij,ij->i", d, d)])
            reach = bound[visit[at]] if at < len(visit) else np.inf
            now = far <= reach
            yield self.order[waiting[now]], reach
            waiting, far = waiting[~now], far[~now]


def _directions(width: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((width, PROJECTED))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, cosine): each query's k best in one block, of those within its squared distance."""
    if not len(ids) or not len(query_ids):
        return []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    members: list[list[int]] = [[] for _ in first]
    for i, g in zip(ids.tolist(), group.tolist(), strict=True):
        m = members[g]
        if len(m) <= k and (not m or m[-1] != i):  # k and one that may be the query itself
            m.append(i)
    points = vectors[first]
    norm = np.sqrt((points * points).sum(axis=1))
    unit = points / norm[:, None]
    rough = unit.astype(np.float32)  # halves what a long search reads; scores themselves are doubles
    directions = _directions(vectors.shape[1])
    tree = Tree(unit @ directions)
    stop, out = _chi2_quantile(CONFIDENCE), []
    need = k + 1
    for qid, q, limit in zip(query_ids.tolist(), queries, limits.tolist(), strict=True):
        qn = np.sqrt((q * q).sum())
        best, rows, near = np.full(need, np.inf), [], []
        asked = (q / qn).astype(np.float32)
        for found, reach in tree.batches(q / qn @ directions):
            if len(found):
                rows.append(found)
                near.append(rough[found] @ asked)
                best = np.sort(np.concatenate([best, 2 - 2 * near[-1]]))[:need]
            if reach > stop * max(min(best[-1], limit), 0.0) + SLACK:
                break
        rows, near = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (rows, near))
        within = 2 - 2 * near <= limit + 1e-5
        rows, near = rows[within], near[within]
        if len(rows) > need:  # the score itself, row by row alike, only for those that can be among the best
            rows = rows[near >= np.partition(near, -need)[-need] - 1e-5]
        cos = (points[rows] * q).sum(axis=1) / (norm[rows] * qn)
        top = np.lexsort((ids[first[rows]], -cos))
        got: list[tuple[float, int]] = []
        for t in top.tolist():
            if len(got) >= k and -cos[t] > got[k - 1][0]:
                break
            got += [(-float(cos[t]), m) for m in members[rows[t]] if m != qid]
            got.sort()
        out += [(qid, m, -c) for c, m in got[:k]]
    return out


def _lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _usable(df: DataFrame) -> DataFrame:
    """vec_id, v of the distinct rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine).distinct()


def _projected(df: DataFrame, width: int) -> DataFrame:
    """vec_id, v and p, the projections of the unit vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column(1), width)
        p = v / np.sqrt((v * v).sum(axis=1))[:, None] @ _directions(width)
        return pa.RecordBatch.from_arrays([*batch.columns, _lists(p)], ["vec_id", "v", "p"])

    return map_arrow(df.where(F.size("v") == width).select("vec_id", "v"), run, "vec_id long, v array<double>, p array<double>")


def _celled(df: DataFrame, top: Top) -> DataFrame:
    """``df`` with the cell of its ``p``."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = top.cell(_matrix(batch.column("p"), PROJECTED))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*names, "cell"])

    return map_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell long")


def _elsewhere(asked: DataFrame, cells: list, top: Top) -> DataFrame:
    """vec_id, v, lim, cell: each query of (vec_id, v, p, lim) with the cells besides its own that the stopping
    test doesn't rule out. ``cells``: (cell, low, high), at most 2^MAX_DEPTH."""
    numbers = np.array([c["cell"] for c in cells])
    low, high = (np.array([c[x] for c in cells], float) for x in ("low", "high"))
    stop = _chi2_quantile(CONFIDENCE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, limit = _matrix(batch.column("p"), PROJECTED), batch.column("lim").to_numpy(zero_copy_only=False)
        home, row, cell = top.cell(p), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(p)):
            gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
            to = numbers[((gap * gap).sum(axis=1) <= stop * max(limit[i], 0.0) + SLACK) & (numbers != home[i])]
            row.append(np.full(len(to), i))
            cell.append(to)
        sent = batch.select(["vec_id", "v", "lim"]).take(pa.array(np.concatenate(row)))
        return pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.concatenate(cell))], ["vec_id", "v", "lim", "cell"])

    return map_arrow(asked.select("vec_id", "v", "p", "lim"), run, "vec_id long, v array<double>, lim double, cell long")


def _searched(rows: DataFrame, visits: DataFrame, sizes: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each visit (vec_id, v, lim, cell) to a cell of ``rows``."""
    blocks, chunks = F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), F.ceil(F.col("asking") / CHUNK_QUERIES).alias("chunks")
    asking = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asking"))
    deals = F.broadcast(sizes.join(asking, "cell").select("cell", blocks, chunks))  # at most 2^MAX_DEPTH rows
    each = lambda count: F.explode(F.sequence(F.lit(1), F.col(count)))
    own = rows.join(deals, "cell").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")) + 1).withColumn("c", each("chunks"))
    asks = visits.join(deals, "cell").withColumn("c", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")) + 1).withColumn("b", each("blocks"))
    key = ["cell", "b", "c"]

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        queries = (asked["vec_id"].to_numpy(), _matrix(asked["v"], width), asked["lim"].to_numpy())
        found = search_block(block["vec_id"].to_numpy(), _matrix(block["v"], width), *queries, k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    ship(rows.sparkSession)
    left, right = own.select(*key, "vec_id", "v"), asks.select(*key, "vec_id", "v", "lim")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` and ``queries`` (vec_id, embedding)."""
    own = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = staged(_usable(vectors).withColumn("own", own).where(F.col("own") <= k + 1).select("vec_id", "v"), "distinct")
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = sizes["d"] if sizes else 1
    rows, asked = staged(_projected(kept, width), "vectors"), staged(_projected(_usable(queries), width), "queries")
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(rows.count(), 1) / BLOCK_ROWS))))
    sample = hash_sample(rows.select("vec_id", "p"), "vec_id", SAMPLE).toPandas().sort_values("vec_id") if depth else None
    top = Top(np.array(sample["p"].tolist()) if depth else np.empty((0, PROJECTED)), depth)
    placed = _celled(rows, top)
    box = [F.array(*(f(F.get("p", F.lit(i))) for i in range(PROJECTED))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    cells = staged(_celled(rows.select("p"), top).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *box), "cells")
    home = _celled(asked, top).select("vec_id", "v", F.lit(float("inf")).alias("lim"), "cell")
    first = staged(_searched(placed, home, cells, width, k), "home")
    found = first
    if depth:
        reached = _best(first, k).where(F.col("rank") == k).select("query_id", (2 - 2 * F.col("score")).alias("lim"))
        bounded = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").withColumn("lim", F.coalesce("lim", F.lit(float("inf"))))
        visits = staged(_elsewhere(bounded, cells.select("cell", "low", "high").collect(), top), "visits")
        found = first.union(_searched(placed, visits, cells, width, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def _sql(width: int = 64, k: int = 5) -> str:
    """The exact search in plain SQL over vectors of ``width``; it equals the query wherever that misses no neighbour.
    Products are summed in eight interleaved parts and those by pairs, as numpy sums a row."""

    def total(term: str) -> str:
        parts = ["(" + "+".join(term.format(i=i) for i in range(j + 1, width + 1, 8)) + ")" for j in range(8)]
        while len(parts) > 1:
            parts = [f"({a}+{b})" for a, b in zip(parts[::2], parts[1::2], strict=True)]
        return parts[0]

    return f"""with fine as (select vec_id, v from (select distinct vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id is not null and embedding is not null) a
 where len(v) = {width} and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
rows as (select vec_id, v, sqrt({total('v[{i}]*v[{i}]')}) as norm from fine),
pairs as (select q.vec_id as query_id, p.vec_id as vec_id, {total('p.v[{i}]*q.v[{i}]')}/(p.norm*q.norm) as score from rows q join rows p on q.vec_id % 50 = 0 and p.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) b where rank <= {k}"""


ORACLE_SQL = _sql()
