"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k) for k = 0 .. GRADES - 2 with one weight vector w over sparse
binary features and ordered thresholds theta; the score is the expected grade, the sum of those
probabilities. Features are words, and beginnings of words at levels of how many different words of the
text have them (languages that join words vary the rest). Labels say only toxic or not. Grades above 1
come from them: a toxic document's grade rises with the number of its telling features (1, 2, 4).

Labelled documents train the model up to ``SAMPLE`` by hashed id, with one text of an id that repeats
(the one of the largest hash); near copies count once. A G test
against the labels picks the features, so that chance words of few documents carry no weight. Where the sampled texts
have more than ``DRIVER_ENTRIES`` words and beginnings, Spark counts and picks them, and only what is picked comes to the
driver; both ways give the same model.

Defined cases: a null or empty text has expected severity 0; texts are read whole; rows that repeat an
id are scored each on its own; labels with null ids or grades, or without a document, are ignored; a
document labelled more than once is toxic if any label says so; without labels, or with labels of one
kind alone (none toxic, or all), nothing tells toxic texts from others and every score is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, staged, table

SAMPLE, GRADES = 4000, 4
#: Hashes of all sampled documents that may come to the driver (12 bytes each); above it Spark counts them.
DRIVER_ENTRIES = 4_000_000
BROADCAST_ROWS = 1_000_000
#: Expected severity from which a document is rejected.
REJECT_AT = 0.5
CACHE_WORDS = 200_000
#: Lengths of word beginnings, and the levels at which they count: words that have one, and their share.
BEGINNINGS = (5, 7)
COUNTS, SHARES = (1, 2, 3, 5, 8), (0.01, 0.02, 0.04)
LEVELS = len(COUNTS) + len(SHARES)
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_HASHES: dict[str, tuple[int, ...]] = {}


def _hashes(word: str) -> tuple[int, ...]:
    """Of the word, and of its beginnings; 40 bits, the highest of which tell words from beginnings."""
    if (found := _HASHES.get(word)) is None:
        if len(_HASHES) > CACHE_WORDS:
            _HASHES.clear()
        code = lambda k, x: (k << 32) | crc32(x.encode("utf-8", "surrogatepass"))
        found = _HASHES[word] = (code(0, word), *(code(n, word[:n]) for n in BEGINNINGS if len(word) > n))
    return found


def parts(text: str | None) -> tuple[list[int], list[int], int]:
    """(hashes, how many different words of the text have each, different words of the text)."""
    words = set(_WORD.findall(text.lower())) if text else ()
    counts = Counter(h for w in words for h in _hashes(w))
    return list(counts), list(counts.values()), len(words)


def keys(rare: np.ndarray) -> list[tuple[int, int, int]]:
    """Keys of a document with these rare hashes: pairs of MinHash values."""
    if not len(rare):
        return []
    x = rare.astype(np.uint64)
    low = [int((((x ^ (x >> np.uint64(15))) * np.uint64(m)) >> np.uint64(8)).min()) for m in _MARKS]
    return [(i, low[2 * i], low[2 * i + 1]) for i in range(len(_MARKS) // 2)]


def first_of_each(rows: list[tuple[int, list[tuple[int, int, int]]]]) -> list[int]:
    """Positions of (how many hashes, keys) that have hashes and share no key with an earlier one."""
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for k, (n, found) in enumerate(rows):
        if n and not seen.intersection(found):
            keep.append(k)
        seen.update(found)
    return keep


def common_from(rows: int) -> int:
    """Hashes of more documents than this aren't rare."""
    return 2 + rows // 100


def distinct_rows(rows: list[np.ndarray]) -> list[int]:
    """Positions of rows that share no key with an earlier one: copies count once. A key is a pair of
    MinHash values over the hashes that at most a hundredth of the rows have."""
    if not rows:
        return []
    known, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    rare = (n <= common_from(len(rows)))[at]
    ends = np.cumsum([len(r) for r in rows])
    return first_of_each([(len(row), keys(row[rare[end - len(row) : end]])) for row, end in zip(rows, ends.tolist(), strict=True)])


def telling(n: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    """Which features, each in ``n`` documents of which ``bad`` are toxic, toxic documents have more often than
    their share ``rate`` of all: a G test at one expected error over all features tested."""
    use = n >= 3
    with np.errstate(divide="ignore", invalid="ignore"):
        toxic = np.where(bad > 0, bad * np.log(bad / (n * rate)), 0)
        g = 2 * (toxic + np.where(n > bad, (n - bad) * np.log((n - bad) / (n * (1 - rate))), 0))
    return use & (bad > n * rate) & (g > 2 * math.log(max(use.sum(), 2)))


def chosen_entries(h: np.ndarray, k: np.ndarray, row: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(telling features, and each entry's position among them and row) of entries with hash ``h``, held by
    ``k`` words of document ``row``. A feature is hash * LEVELS + level; levels are gone through one by one,
    so memory is that of the entries and not of all their levels."""
    begins = h >> 32 > 0

    def held(level: int) -> np.ndarray:
        if level < len(COUNTS):
            c = COUNTS[level]
            return np.flatnonzero((k >= c) & (begins | (c == 1)))
        return np.flatnonzero((k >= SHARES[level - len(COUNTS)] * words[row]) & begins)

    tested = []
    for level in range(LEVELS):
        entries = held(level)
        known, at = np.unique(h[entries], return_inverse=True)
        n, bad = np.bincount(at), np.bincount(at, toxic[row[entries]])
        tested.append((known[n >= 3] * LEVELS + level, n[n >= 3], bad[n >= 3]))
    feature, n, bad = (np.concatenate(x) for x in zip(*tested, strict=True))
    chosen = np.sort(feature[telling(n, bad, toxic.mean())])
    places, rows = [], []
    for level in range(LEVELS) if len(chosen) else ():
        entries = held(level)
        wanted = h[entries] * LEVELS + level
        place = np.minimum(np.searchsorted(chosen, wanted), len(chosen) - 1)
        hit = chosen[place] == wanted
        places.append(place[hit])
        rows.append(row[entries[hit]])
    none = np.empty(0, np.int64)
    return chosen, np.concatenate(places or [none]), np.concatenate(rows or [none])


class Model:
    """Weights of words, weights by level of beginnings, and the ordered thresholds."""

    def __init__(self, weights: dict[int, list[float]], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def severity(self, text: str | None) -> float:
        """Expected grade."""
        words = set(_WORD.findall(text.lower())) if text else None
        if not words:
            return 0.0
        get, found = self.weights, Counter()
        for w in words:
            for h in _hashes(w):
                if h in get:
                    found[h] += 1
        z, n = 0.0, len(words)
        for h, k in found.items():
            w = get[h]
            z += sum(v for v, c in zip(w, COUNTS, strict=False) if k >= c)
            z += sum(v for v, c in zip(w[len(COUNTS) :], SHARES, strict=True) if k >= c * n)
        return sum(1 / (1 + math.exp(-min(max(z - t, -40.0), 40.0))) for t in self.thresholds)


def slopes(z: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each row's grade, derivatives of its logarithm by z - theta_k) of cumulative logits."""
    edges = np.arange(1, GRADES)
    c = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))  # P(grade > k)
    full = np.concatenate([np.ones((len(z), 1)), c, np.zeros((len(z), 1))], axis=1)
    p = np.take_along_axis(full, grade[:, None], 1) - np.take_along_axis(full, grade[:, None] + 1, 1)
    p = np.maximum(p, 1e-9)
    slope = c * (1 - c)
    # Plus at the lower edge of the grade, minus at its upper edge.
    return p[:, 0], (np.where(grade[:, None] == edges, slope, 0) - np.where(grade[:, None] == edges - 1, slope, 0)) / p


def _descend(at: np.ndarray, row: np.ndarray, grade: np.ndarray, width: int, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad on the negative log likelihood of the cumulative logits; thresholds are kept in order."""
    n = len(grade)
    w, theta = np.zeros(width), np.arange(1.0, GRADES)
    sq_w, sq_t = np.full(width, 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(rounds):
        _, part = slopes(np.bincount(row, w[at], n), theta, grade)
        gw = np.bincount(at, (-part.sum(axis=1) / n)[row], width) + l2 * w
        gt = part.sum(axis=0) / n
        sq_w += gw * gw
        sq_t += gt * gt
        w = w - 0.5 / np.sqrt(sq_w) * gw
        theta = np.maximum.accumulate(theta - 0.5 * gt / np.sqrt(sq_t)) + np.arange(GRADES - 1) * 1e-6
    return w, theta


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> Model:
    """``rows``: hashes, their counts and the number of words of each document."""
    keep = distinct_rows([r[0] for r in rows])
    rows, toxic = [rows[k] for k in keep], toxic[keep]
    if not toxic.any() or toxic.all():
        return Model({}, [40.0] * (GRADES - 1))
    h, k = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    return fitted(*chosen_entries(h, k, row, np.array([r[2] for r in rows]), toxic), toxic)


def fitted(chosen: np.ndarray, at: np.ndarray, at_row: np.ndarray, toxic: np.ndarray) -> Model:
    """The model of entries ``at`` among the telling features ``chosen``, held by documents ``at_row``."""
    words = (chosen // LEVELS) >> 32 == 0
    n = np.bincount(at_row, words[at], len(toxic))
    grade = np.where(toxic, 1 + (n >= 2) + (n >= 4), 0).astype(int)
    w, theta = _descend(at, at_row, grade, len(chosen), 1500, 1e-5)
    weights: dict[int, list[float]] = {}
    for f, v in zip(chosen.tolist(), w.tolist(), strict=True):
        weights.setdefault(f // LEVELS, [0.0] * LEVELS)[f % LEVELS] = v
    return Model(weights, theta.tolist())


def train_on_spark(found: DataFrame) -> Model:
    """:func:`train` of (doc_id, toxic, h, k, n) without the entries on the driver: it gets a line for each document, the
    telling features and the entries that hold these."""
    rows = found.select("doc_id", "toxic", "n", F.size("h").alias("size")).toArrow()
    entries = found.select("doc_id", "toxic", "n", F.explode(F.arrays_zip("h", "k")).alias("e")).select("doc_id", "toxic", "n", "e.h", "e.k")
    common = staged(entries.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > common_from(rows.num_rows)).select("h"), "common")
    rare = entries.select("doc_id", "h").join(_small(common), "h", "left_anti").groupBy("doc_id").agg(F.collect_list("h").alias("h"))

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        named = [[v for key in keys(h.values.to_numpy()) for v in key] for h in batch.column("h")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.list_(pa.int64()))], ["doc_id", "keys"])

    named = {r["doc_id"]: list(zip(*[iter(r["keys"])] * 3, strict=True)) for r in map_arrow(rare.select("doc_id", "h"), name, "doc_id long, keys array<long>").collect()}
    order = np.argsort(rows["doc_id"].to_numpy())
    ids, size = rows["doc_id"].to_numpy()[order], rows["size"].to_numpy()[order]
    keep = first_of_each([(n, named.get(i, [])) for i, n in zip(ids.tolist(), size.tolist(), strict=True)])
    ids, toxic = ids[keep], rows["toxic"].to_numpy()[order][keep] > 0
    if not toxic.any() or toxic.all():
        return Model({}, [40.0] * (GRADES - 1))
    kept = found.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids.tolist())], "doc_id long, row int")
    entries = entries.join(F.broadcast(kept), "doc_id")  # SAMPLE rows at most
    begins = F.shiftright("h", 32) > 0
    held = [(F.col("k") >= c) & (begins if c > 1 else F.lit(True)) for c in COUNTS] + [(F.col("k") >= F.lit(c) * F.col("n")) & begins for c in SHARES]
    counts = [f(F.when(on, x)).alias(f"{f.__name__}{k}") for k, on in enumerate(held) for f, x in ((F.count, F.lit(1)), (F.sum, F.col("toxic")))]
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"count{k}").alias("docs"), F.col(f"sum{k}").alias("bad")) for k in range(LEVELS)))
    tested = staged(entries.groupBy("h").agg(*counts).select("h", F.explode(levels).alias("f")).select("h", "f.*").where("docs >= 3"), "tested")
    rate, n, bad = F.lit(float(toxic.mean())), F.col("docs"), F.col("bad")
    g = F.when(bad > 0, bad * F.log(bad / (n * rate))).otherwise(0.0) + F.when(n > bad, (n - bad) * F.log((n - bad) / (n * (1 - rate)))).otherwise(0.0)
    limit = 2 * math.log(max(tested.count(), 2))
    telling_ = staged(tested.where((bad > n * rate) & (2 * g > limit)).select("h", "level"), "telling")
    levels = F.filter(F.array(*(F.when(on, k) for k, on in enumerate(held))), lambda x: x.isNotNull())
    entries = entries.join(_small(telling_.select("h").distinct()), "h", "left_semi").select("row", "h", F.explode(levels).alias("level"))
    pairs = entries.join(_small(telling_), ["h", "level"]).select("row", (F.col("h") * LEVELS + F.col("level")).alias("feature")).toArrow()
    feature, row = pairs["feature"].to_numpy(), pairs["row"].to_numpy()
    chosen, at = np.unique(feature, return_inverse=True)
    by_place = np.lexsort((row, at))  # so that sums are the same on every run
    return fitted(chosen, at[by_place], row[by_place], toxic)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast up to ``BROADCAST_ROWS``; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = hash_sample(known, "doc_id", SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # SAMPLE ids at most
    # One text of each id, the same on every run, however many rows have the id.
    texts = texts.groupBy("doc_id", "toxic").agg(F.max_by("text", F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), "text"))).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, k, n = [], [], []
        for t in batch.column("text").to_pylist():
            hashes, counts, words = parts(t)
            h.append(np.array(hashes, np.int64))
            k.append(np.array(counts, np.int32))
            n.append(words)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "h": pa.array(h, pa.list_(pa.int64())), "k": pa.array(k, pa.list_(pa.int32())), "n": pa.array(n, pa.int32())})

    found = staged(map_arrow(texts.select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, h array<long>, k array<int>, n int"), "labelled")
    if (found.agg(F.sum(F.size("h"))).first()[0] or 0) > DRIVER_ENTRIES:
        return train_on_spark(found)
    found = found.toArrow()
    ids, n = found["doc_id"].to_numpy(), found["n"].to_numpy()
    order = np.lexsort((n, ids))
    h, k = found["h"].combine_chunks(), found["k"].combine_chunks()
    rows = [(h[int(i)].values.to_numpy(), k[int(i)].values.to_numpy(), int(n[i])) for i in order]
    return train(rows, found["toxic"].to_numpy()[order] > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``expected_severity``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*sent.value)
        out = [m.severity(t) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*(f"c{i}" for i in range(batch.num_columns)), "severity"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return map_arrow(docs, run, f"{kinds}, severity double").toDF(*docs.columns, "expected_severity")


def keep_clean(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below REJECT_AT, with the same columns; ``labelled`` has the labels' texts."""
    model = fit(labelled, labels)
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")]))
    return score(named, model).where(F.col("expected_severity") < REJECT_AT).select(*own).toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, toxic for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_severity", (F.col("expected_severity") >= REJECT_AT).alias("toxic"))
