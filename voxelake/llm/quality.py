"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of all vote patterns (all documents; at most 3^labellers rows) estimates each
labeller's accuracy for good and for bad documents, and the share of good ones. Posterior labels of a
bounded, hashed sample train a logistic scorer over hashed token shapes and style measures, which then
scores every document.

Defined cases: a null or empty text is bad (score 0); texts are read whole; rows that repeat an id are
scored each on its own, and one of their texts may be in the sample; a null id is scored like any other; an empty table gives an empty result; extra
columns are ignored; without any vote that differs, or without any bad vote, every document is good.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, one_per_key, table

#: Documents that train the scorer, and its hashed width: the bounds of what comes to the driver.
SAMPLE, WIDTH = 4000, 4096
KEEP_AT = 0.5
LABELLERS = ("symbols", "repeats", "variety", "capitals", "bars", "shouting", "sentences", "word_length", "letters")
#: The largest share of good documents that a labeller may hold to be bad.
FALSE_ALARM = 0.001
GOOD, BAD, NONE = "g", "b", "n"

_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-–—’“”«»¿¡/@]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER_RUN = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
_UPPER_RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"\d+")
_ENDS = re.compile(r"[.!?…](?:\s|$)")


def measures(text: str) -> dict[str, float]:
    """Style measures, each a share of words or characters."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return {"n": 0}
    letters = sum(map(len, _LETTERS.findall(text)))
    return {
        "n": n,
        "symbols": len(_SYMBOLS.findall(text)) / size,
        "repeats": sum(map(str.__eq__, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "capitals": len(_UPPER.findall(text)) / max(letters, 1),
        "bars": (text.count("|") + text.count("\t")) / n,
        "shouting": text.count("!!") / n,
        "sentences": len(_ENDS.findall(text)) / n,
        "word_length": letters / n,
        "letters": letters / max(size - text.count(" "), 1),
    }


def votes(m: dict[str, float]) -> str:
    """One letter for each labeller; thresholds are those of running text in any alphabetic language."""
    if not m["n"]:
        return BAD * len(LABELLERS)
    long = m["n"] >= 20

    def cut(x: float, good: float, bad: float) -> str:
        """Good up to ``good``, bad from ``bad``."""
        return GOOD if x <= good else BAD if x >= bad else NONE

    return "".join((
        cut(m["symbols"], 0.01, 0.05),
        cut(m["repeats"], 0.02, 0.25),
        cut(-m["variety"], -0.45, -0.15) if long and m["n"] <= 400 else cut(-m["variety"], -0.3, -0.05) if long else NONE,
        cut(m["capitals"], 0.12, 0.5) if long else NONE,
        cut(m["bars"], 0.0, 0.15),
        cut(m["shouting"], 0.0, 0.15),
        (BAD if m["sentences"] < 0.004 else GOOD if 0.02 <= m["sentences"] <= 0.34 else NONE) if long else NONE,
        GOOD if 2.5 <= m["word_length"] <= 9 else BAD if m["word_length"] < 1.5 or m["word_length"] > 14 else NONE,
        cut(-m["letters"], -0.9, -0.35),
    ))


def features(text: str, m: dict[str, float]) -> tuple[list[int], list[float]]:
    """Hashed token shapes (square roots of their shares) and measures in bins."""
    if not m["n"]:
        return [], []
    shaped = _DIGITS.sub("0", _UPPER_RUN.sub("A", _LOWER_RUN.sub("a", text)))
    shapes = Counter(shaped.split())
    out: dict[int, float] = {}
    for shape, k in shapes.items():
        at = crc32(shape[:24].encode("utf-8", "surrogatepass")) % WIDTH
        out[at] = out.get(at, 0.0) + k / m["n"]
    out = {k: v**0.5 for k, v in out.items()}
    for name in LABELLERS:
        at = crc32(f"{name}={min(int(m[name] * 20), 400)}".encode()) % WIDTH
        out[at] = out.get(at, 0.0) + 1.0
    return list(out), list(out.values())


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of good, P(vote | class, it votes) as [labeller, class, vote], posterior of good by
    pattern). Not to vote says nothing, so short texts aren't held to be bad."""
    names = sorted(patterns)
    count = np.array([patterns[k] for k in names], float)
    vote = np.array([["gbn".index(v) for v in k] for k in names]).reshape(len(names), -1)
    labellers = vote.shape[1]
    # A labeller fires on few kinds of bad text, so a bad vote says more than a good one.
    table_ = np.tile(np.array([[[0.998, 0.002, 1.0], [0.8, 0.2, 1.0]]]), (labellers, 1, 1))
    good = 0.8
    post = np.full(len(names), good)
    for _ in range(rounds):
        logp = np.log(np.array([good, 1 - good]))[None, :] + sum(np.log(table_[k][:, vote[:, k]]).T for k in range(labellers))
        post = 1 / (1 + np.exp(np.clip(logp[:, 1] - logp[:, 0], -50, 50)))
        weight = np.stack([post * count, (1 - post) * count])
        good = float(np.clip(weight[0].sum() / count.sum(), 0.05, 0.999))
        for k in range(labellers):
            for v in range(2):
                table_[k, :, v] = weight[:, vote[:, k] == v].sum(axis=1) + (1.0, 0.5)[v]
            table_[k, :, :2] /= table_[k, :, :2].sum(axis=1, keepdims=True)
            # Bad votes need measures far off running text, so good documents seldom get one. Without
            # this bound, a kind of bad text that only one labeller knows is taken for its errors.
            table_[k, 0, 1] = min(table_[k, 0, 1], FALSE_ALARM)
            table_[k, 1, 1] = max(table_[k, 1, 1], table_[k, 0, 1])
            table_[k, :, 0] = 1 - table_[k, :, 1]
    return good, table_, dict(zip(names, post.tolist(), strict=True))


def train(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the constant."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    at = np.concatenate([np.append(r[0], WIDTH) for r in rows]).astype(int)
    x = np.concatenate([np.append(r[1], 1.0) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) + 1 for r in rows])
    y = np.array([r[2] for r in rows])
    # The two classes weigh the same up to a factor, so that few bad documents are learned.
    weight = np.where(y < 0.5, min(10.0, max(1.0, (y >= 0.5).sum() / max((y < 0.5).sum(), 1))) ** 0.5, 1.0)
    square = np.full(WIDTH + 1, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)), -40, 40)))
        g = np.bincount(at, ((p - y) * weight)[row] * x, WIDTH + 1) / len(rows) + l2 * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the scorer for these documents."""
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = Counter(votes(measures(t or "")) for t in batch.column(0).to_pylist())
        return pa.RecordBatch.from_pydict({"pattern": list(counted), "n": pa.array(counted.values(), pa.int64())})

    counts = {r["pattern"]: r["n"] for r in map_arrow(texts.select("text"), vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return np.zeros(WIDTH + 1)
    _, _, posterior = estimate(counts)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t in batch.column(0).to_pylist():
            m = measures(t or "")
            found.append((*features(t or "", m), votes(m)))
        return pa.RecordBatch.from_pydict({"at": pa.array([f[0] for f in found], pa.list_(pa.int32())), "x": pa.array([f[1] for f in found], pa.list_(pa.float32())), "pattern": [f[2] for f in found]})

    sample = map_arrow(one_per_key(texts, "doc_id", "text", SAMPLE).select("text"), describe, "at array<int>, x array<float>, pattern string").toArrow()
    at, x = sample["at"].combine_chunks(), sample["x"].combine_chunks()
    # In one order on every run, whatever tasks ended first.
    rows = [(at[k].values.to_numpy(), x[k].values.to_numpy(), posterior.get(p, 0.5)) for k, p in enumerate(sample["pattern"].to_pylist())]
    return train(sorted((r for r in rows if len(r[0])), key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes())))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``."""
    w = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, out = w.value, []
        for t in batch.column(text).to_pylist():
            m = measures(t or "")
            if not m["n"]:
                out.append(0.0)
                continue
            at, x = features(t, m)
            z = float(np.dot(v[at], x)) + v[WIDTH]
            out.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*(f"c{i}" for i in range(batch.num_columns)), "quality_score"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return map_arrow(docs, run, f"{kinds}, quality_score double").toDF(*docs.columns, "quality_score")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with the same columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*own).withColumns({"doc_id": F.col(own[docs.columns.index("doc_id")]), "text": F.col(own[docs.columns.index("text")])})
    scored = score(named.drop("doc_id"), fit(named))
    return scored.where(F.col("quality_score") >= KEEP_AT).select(*own).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality_score, kept for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= KEEP_AT).alias("kept"))
