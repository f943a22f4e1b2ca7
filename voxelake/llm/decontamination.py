"""Benchmark decontamination: pairs of words that training passages and test items share are counted by
diagonal, then Smith-Waterman alignment scores copies, also edited and paraphrased ones.

Texts are lower-cased runs of word characters. An item is aligned with a document by words: +1 for equal
words, -1 for different ones, -1 for a gap. The score is the best alignment over the item's length; a
document is contaminated if an item scores ``THRESHOLD`` or more; an item of fewer than ``SHORT`` words, which a
few common ones would reach, must score ``SHORT_THRESHOLD``, and one of fewer than ``N`` words must be found whole.
What other items hold makes no difference to a score.

Only places that can't reach the threshold are left unaligned. An alignment of score s with e edits has at
most e + 1 runs of equal words, so it holds at least s - 1 pairs of neighbouring words of the item; and as
an item of m words has at most m - s edits then, their places in the document less those in the item
differ by m - s at most. Wherever that many hits lie so close, a window around them that the alignment can't
leave is aligned; windows of one item that meet are merged. Scores therefore are those of the whole text.

The items are broadcast up to 8 * ``BROADCAST_SEEDS`` characters; beyond it documents meet, by a shuffle, the
items of which they hold one of the rarest hits, so many that an alignment at the threshold can't miss them
all, and are then judged alike: both ways give the same rows.

Defined cases: null or empty texts and items match nothing; texts are read whole; equal items each
report; rows that repeat a doc_id, or have none, are judged each on its own text and reported once for an
item with the best score (:func:`keep_clean` drops only the rows that hold one); items without an id or text
match nothing; empty tables give an empty result; extra columns
are ignored; of equal scores the smallest item_id is named.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelake.shipping import ship

from .common import arrow_batches, map_arrow, staged, table

N = 3
#: Words of a hit.
GRAM = 2
THRESHOLD = 0.4
#: Items of fewer words than SHORT share a few common ones with many texts, so of them more must be found.
SHORT, SHORT_THRESHOLD = 8, 0.8
BROADCAST_SEEDS = 2_000_000
#: Words of a document that are looked up at a time.
CHUNK_WORDS = 8192
CACHE_WORDS = 300_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else ()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m]
    for k in range(1, n):
        out = (out * _MIX) ^ h[k : k + m]
        out = out ^ (out >> np.uint64(31))
    return out * _MIX


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment over the item's length, row by row; gaps along a row by a running maximum."""
    if not len(item) or not len(passage):
        return 0.0
    at = np.arange(len(passage) + 1)
    prev, best = np.zeros(len(passage) + 1), 0.0
    for w in item:
        cur = np.zeros_like(prev)
        cur[1:] = np.maximum(prev[:-1] + np.where(passage == w, 1.0, -1.0), prev[1:] - 1.0)
        np.maximum(cur, 0.0, out=cur)
        cur = np.maximum.accumulate(cur + at) - at
        best = max(best, float(cur.max()))
        prev = cur
    return best / len(item)


def threshold(size: int) -> float:
    """The share of its words at which an item of ``size`` words counts."""
    return 1.0 if size < N else SHORT_THRESHOLD if size < SHORT else THRESHOLD


def least_score(size: int) -> int:
    """The least score, in words, at which an item of ``size`` words counts."""
    return next(s for s in range(1, size + 1) if s / size >= threshold(size))


class Index:
    """The items' word hashes and the places of their pairs of words."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, h) for i, h in items if len(h)]
        self.single: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(self.items):
            if len(h) < GRAM:
                self.single[int(h[0])].append(k)
        self.size = np.array([len(h) for _, h in self.items], np.int64)
        least = np.array([least_score(m) for m in self.size.tolist()], np.int64)
        #: Hits that an alignment at the threshold holds at least, and how far apart their diagonals can be.
        self.need, self.slack = np.maximum(least - 1, 1), self.size - least
        grams = [ngrams(h, GRAM) for _, h in self.items]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def __len__(self) -> int:
        return len(self.items)

    def _close(self, grams: np.ndarray, start: int, wide: int) -> np.ndarray:
        """item * wide + diagonal of the hits that begin ``need`` close ones of their item."""
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[place] == grams)
        n = self.count[place[hit]]
        post = np.repeat(self.first[place[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[post]
        # Diagonals of a text are below wide / 2 either way.
        key = np.sort(item * wide + (np.repeat(hit, n) + start - self.at[post] + wide // 2))
        item = key // wide
        last = np.arange(len(key)) + self.need[item] - 1
        full = last < len(key)
        full[full] = key[last[full]] - key[full] <= self.slack[item[full]]
        return key[full]

    def windows(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to) to align for a document."""
        grams = ngrams(h, GRAM)
        if len(self.grams) and len(grams):
            longest = int(self.size.max())
            wide = 2 * (len(h) + 4 * longest)
            # A passage is no longer than twice its item, so each lies in one chunk.
            step = max(CHUNK_WORDS, longest)
            key = np.unique(np.concatenate([self._close(grams[s : s + step + 2 * longest], s, wide) for s in range(0, len(grams), step)]))
            item, at = key // wide, key % wide - wide // 2
            apart = (np.diff(item) != 0) | (np.diff(at) > (self.size + 2 * self.slack)[item[1:]])
            begin = np.flatnonzero(np.concatenate([[True], apart])) if len(key) else ()
            for x, y in zip(begin, [*begin[1:], len(key)], strict=True) if len(key) else ():
                k = int(item[x])
                yield k, max(0, int(at[x] - self.slack[k])), min(len(h), int(at[y - 1] + self.size[k] + self.slack[k]))
        if self.single:
            for x in self.single.keys() & set(h.tolist()):
                p = int(np.argmax(h == np.uint64(x)))
                for k in self.single[x]:
                    yield k, p, p + 1

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """(item_id, score) at the threshold or above."""
        h = word_hashes(text)
        best: dict[int, float] = {}
        for k, a, b in self.windows(h) if len(h) else ():
            item, words = self.items[k]
            score = align(words, h[a:b])
            if score >= threshold(len(words)) and score > best.get(item, 0.0):
                best[item] = score
        return sorted(best.items())


_INDEXES: dict[str, Index] = {}


def _index(sent) -> Index:
    """One for each worker process and benchmark."""
    name, rows = sent.value
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index([(i, word_hashes(t)) for i, t in rows])
    return _INDEXES[name]


def _sent(spark: SparkSession, items: DataFrame):
    """The items as a broadcast, or nothing if they have more than 8 * BROADCAST_SEEDS characters."""
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if words > 8 * BROADCAST_SEEDS:
        return None
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    return spark.sparkContext.broadcast((str(hash(tuple(rows))), rows))


def _usable(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score: the items that each document holds."""
    docs, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _usable(items)
    sent = _sent(docs.sparkSession, items)
    if sent is None:
        docs = staged(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        found = _row_leaks(docs, items).join(docs.select("row", "doc_id"), "row")
        return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, out = _index(sent), ([], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for item, score in index.matches(text):
                for column, value in zip(out, (doc, item, score), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score"])

    found = map_arrow(docs, run, "doc_id long, item_id long, score double")
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _row_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, item_id, score of ``docs`` (row, text), for benchmarks too large to send: hits of both sides meet in
    a join, and each candidate pair is aligned alone. Of an item's places an alignment at the threshold hits
    ``need``, so all but need - 1 of them, the commonest, are posted. Items of one word are posted by that
    word."""
    items = staged(items.withColumn("item_row", F.monotonically_increasing_id()), "items")

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out, keep, single = [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = word_hashes(t)
            g = ngrams(h, min(GRAM, len(h))) if len(h) else h
            ids.append(np.full(len(g), i, np.int64))
            out.append(g.view(np.int64))
            keep.append(np.full(len(g), len(g) - max(least_score(len(h)) - 1, 1) + 1 if len(h) else 0, np.int64))
            single.append(np.full(len(g), len(h) < GRAM))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, out, keep, single)], ["item_row", "gram", "keep", "single"]) if ids else None

    posts = staged(map_arrow(items.select("item_row", "text"), places, "item_row long, gram long, keep long, single boolean"), "places")
    common = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    rank = F.row_number().over(Window.partitionBy("item_row").orderBy("k", "gram"))
    seeds = posts.join(common, "gram").withColumn("rank", rank).where("rank <= keep").select("item_row", "gram").distinct()
    singles = posts.where("single").limit(1).count() > 0

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = word_hashes(t)
            g = np.unique(np.concatenate([ngrams(h, n) for n in ((1, GRAM) if singles else (GRAM,))]))
            ids.append(np.full(len(g), i, np.int64))
            out.append(g.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out))], ["row", "gram"]) if ids else None

    found = map_arrow(docs.select("row", "text"), grams, "row long, gram long")
    pairs = found.join(seeds, "gram").select("row", "item_row").distinct()
    wide = pairs.join(docs.select("row", "text"), "row").join(items.select("item_row", "item_id", F.col("text").alias("item")), "item_row")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for item, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                score.append(max((s for _, s in Index([(0, word_hashes(item))]).matches(text)), default=0.0))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["row", "item_id", "score"])
            yield out.filter(pa.array([s > 0 for s in score]))

    arrow_batches(docs.sparkSession)
    ship(docs.sparkSession)
    return wide.select("row", "item_id", "item", "text").mapInArrow(check, "row long, item_id long, score double")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, item_id of the best match, score: one row for each contaminated document."""
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id")))
    return leaks(docs, items).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), best.alias("b")).select("doc_id", "n_items", "b.item_id", "b.score")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item: each is judged on its own text, whatever its id."""
    items = _usable(items)
    sent = _sent(docs.sparkSession, items)
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    named = docs.toDF(*own)
    if sent is None:
        rows = staged(named.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        found = _row_leaks(rows.select("row", F.col(own[at]).alias("text")), items).select("row").distinct()
        return rows.join(found, "row", "left_anti").select(*own).toDF(*docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = _index(sent)
        return batch.filter(pa.array([not index.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))
    return map_arrow(named, run, kinds).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
