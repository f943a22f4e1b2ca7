"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into blocks (see html_blocks). Each block has two labels, article or not; its features
are its element and ancestors, the words of their class, id and role attributes, and the shape of its
text (length, links, end, place in the page, words of short texts). Weights of features and of label
changes maximise the conditional likelihood of labelled pages (see html_pages) by forward-backward;
pages are decoded by Viterbi, and the text is that of the article blocks joined by two line ends.

Defined cases: a null or empty html has empty text; pages are read whole, of any length; equal pages
get equal texts; rows that repeat an id are extracted each; an empty table gives an empty result; extra
columns are ignored; markup without any text has empty text, and a text without markup is all of the text.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table
from .html_blocks import HEADINGS, Block, blocks
from .html_pages import MARK, labelled_pages

TRAIN_PAGES, TRAIN_SEED, ROUNDS = 600, 20240607, 250
SECTIONS = ("article", "main", "nav", "footer", "aside", "header", "form")
_WORD = re.compile(r"[^\W\d_]+|[©|»]")


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, before = [], None
    for k, b in enumerate(found):
        near = b.around.near
        words = b.text.split()
        n = len(words)
        size = 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 12 else 4 if n <= 25 else 5
        f = ["bias", f"near={near}", f"size={size}", f"link={0 if b.linked < 10 else 1 if b.linked < 50 else 2 if b.linked < 90 else 3}"]
        f += {f"in={t}" for t in b.around.tags}
        f += {f"mark={m}" for m in b.around.marks}
        inside = [t for t in SECTIONS if t in b.around.tags]
        f += [f"deep={inside[-1]}" if inside else "deep=none"]
        f += ["stop" if b.text[-1:] in ".!?…:\"”»" else "open", f"edge={'first' if k == 0 else 'last' if k == len(found) - 1 else 'mid'}", f"part={5 * k // len(found)}"]
        if near in HEADINGS:
            f.append("heading")
        if not b.around.marked:
            f.append(f"unmarked={near}")
        if n <= 12:
            f += {f"word={w.lower()}" for w in _WORD.findall(b.text)}
        if b.around.path == before:
            f.append("same")
        before = b.around.path
        out.append(f)
    return out


class Model:
    """Feature weights (article against not), and the score of each label change [from, to]."""

    def __init__(self, weights: dict[str, float], change: np.ndarray, start: np.ndarray):
        self.weights, self.change, self.start = weights, change.tolist(), start.tolist()
        told = lambda kind: frozenset(f.removeprefix(kind) for f in weights if f.startswith(kind))
        self.tags, self.marks = told("in=").union(SECTIONS), told("mark=")

    def decode(self, found: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        if not found:
            return []
        get, (c0, c1) = self.weights.get, self.change
        emit = [sum(get(f, 0.0) for f in fs) for fs in features(found)]
        a, b = self.start[0], self.start[1] + emit[0]
        back = []
        for e in emit[1:]:
            (x, i), (y, j) = max((a + c0[0], 0), (b + c1[0], 1)), max((a + c0[1], 0), (b + c1[1], 1))
            a, b = x, y + e
            back.append((i, j))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]

    def extract(self, html: str | None) -> str:
        """A page whose text has no element around it has nothing but its text."""
        found = blocks(html, self.tags, self.marks)
        kept = [True] * len(found) if all(b.bare for b in found) else self.decode(found)
        return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, l2: float = 1e-4) -> Model:
    """Gradient ascent (AdaGrad) on the mean conditional log likelihood of the labels."""
    pages = [p for p in pages if p[0]]
    named = [features(found) for found, _ in pages]
    seen: dict[str, int] = {}
    for page in named:
        for name in {f for fs in page for f in fs}:
            seen[name] = seen.get(name, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    longest, count = max(len(p) for p in named), len(named)
    cell, at = [], []
    mask, gold = np.zeros((count, longest)), np.zeros((count, longest), int)
    for p, page in enumerate(named):
        mask[p, : len(page)] = 1
        gold[p, : len(page)] = pages[p][1]
        for k, fs in enumerate(page):
            for f in fs:
                if f in index:
                    cell.append(p * longest + k)
                    at.append(index[f])
    cell, at = np.array(cell), np.array(at)
    w, change, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(w, 1e-8), np.full_like(change, 1e-8), np.full_like(start, 1e-8)]
    pair = np.zeros((2, 2))
    for k in range(1, longest):
        both = mask[:, k] > 0
        np.add.at(pair, (gold[both, k - 1], gold[both, k]), 1)
    first = np.bincount(gold[:, 0], minlength=2)
    lse = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    for _ in range(rounds):
        emit = np.zeros((count, longest, 2))
        emit[..., 1] = np.bincount(cell, w[at], count * longest).reshape(count, longest)
        fore = np.zeros_like(emit)
        fore[:, 0] = start + emit[:, 0]
        for k in range(1, longest):
            step = lse(np.swapaxes(fore[:, k - 1, :, None] + change, 1, 2)) + emit[:, k]
            fore[:, k] = np.where(mask[:, k, None] > 0, step, fore[:, k - 1])
        total = lse(fore[:, -1])
        rear = np.zeros_like(emit)
        expected = np.zeros((2, 2))
        for k in range(longest - 1, 0, -1):
            ahead = emit[:, k] + rear[:, k]
            live = mask[:, k] > 0
            joint = np.exp(fore[:, k - 1, :, None] + change + ahead[:, None, :] - total[:, None, None])
            expected += joint[live].sum(axis=0)
            rear[:, k - 1] = np.where(live[:, None], lse(change + ahead[:, None, :]), 0.0)
        prob = np.exp(fore + rear - total[:, None, None])
        gw = np.bincount(at, ((gold - prob[..., 1]) * mask).ravel()[cell], len(w)) / count - l2 * w
        grads = [gw, (pair - expected) / count, (first - prob[:, 0].sum(axis=0)) / count]
        for value, g, s in zip((w, change, start), grads, squares, strict=True):
            s += g * g
            value += 0.3 * g / np.sqrt(s)
    return Model({f: float(w[k]) for f, k in index.items()}, change, start)


def marked(html: str) -> tuple[list[Block], list[bool]]:
    """Blocks and labels of a labelled page; the marks are taken out."""
    found = blocks(html)
    labels = [MARK in b.text for b in found]
    return [replace(b, text=" ".join(b.text.replace(MARK, "").split()) or "-") for b in found], labels


@lru_cache(maxsize=2)
def default_model(count: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Model:
    return train([marked(p) for p in labelled_pages(count, seed)])


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or default_model()
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, np.array(model.change), np.array(model.start)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*sent.value)
        text = [m.extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
