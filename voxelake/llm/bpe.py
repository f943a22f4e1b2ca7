"""Byte-level BPE encoding and decoding by a given rank table.

Two forms fold the same ranked merges:

* :func:`encode_words_native` is the form with Spark's higher-order functions over the byte arrays of
  distinct words and a literal rank map (hashed into small buckets, so that a lookup doesn't walk
  50,000 entries). It is exact, but a fold step costs microseconds, and putting ids of distinct words
  back into documents needs a join on every (document, word) pair, which alone moves more bytes than
  the input. README has the figures.
* :class:`Encoder` folds the merges in Python workers, once for each distinct word a worker meets
  (its memory is bounded), and is what the query runs.

Defined cases: a null or empty text has no ids; texts are taken whole, of any length; equal texts get
equal ids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 300_000
#: White space as Unicode defines it, for cutting texts into pieces that can't share a token.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Buckets of the literal rank map.
BUCKETS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of lowest rank (the leftmost on ties) until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 96:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pair = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pair:
        best = min(pair)
        if best == 1 << 30:
            break
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], 1 << 30)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list: n log n for words of any length."""
    n = len(word)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop or end[i] == stop:
            continue
        alive[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Encoder(dict):
    """Pieces of text (white space and what follows it) to their ids as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        #: Words without what stands around them: pieces differ more than words do.
        self.words: dict[str, bytes] = {}
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        parts = []
        for w in self.find(piece):
            if (found := self.words.get(w)) is None:
                found = b"".join(i.to_bytes(4, "little") for i in fold_merges(w.encode("utf-8", "surrogatepass"), self.ranks))
                if len(w) <= 64:
                    self.words[w] = found
            parts.append(found)
        ids = b"".join(parts)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """No token spans the border before white space that follows other characters, so each piece
        stands alone and equal pieces have equal ids."""
        return b"".join(map(self.__getitem__, _PIECE.findall(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def worker_encoder(ranks_broadcast, pattern: str) -> Encoder:
    """One encoder for each worker process, whose words outlive a task."""
    key = (len(ranks_broadcast.value), hashlib.sha1(ranks_broadcast.value).hexdigest() + pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_broadcast.value.splitlines() if line.strip())}
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def broadcast_ranks(spark: SparkSession, path: str):
    """The vocabulary file's bytes: its size is that of a fixed vocabulary, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids (uint32, little-endian)."""
    path, default_pattern = default_vocabulary()
    ranks, pat = broadcast_ranks(docs.sparkSession, ranks_path or path), pattern or default_pattern
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = worker_encoder(ranks, pat)
        n, ids_sha, text_sha, all_ids = [], [], [], []
        for t in batch.column(1).to_pylist():
            ids = enc.encode_bytes(t)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(ids)
        cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}
        return pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(all_ids, pa.binary())} if with_ids else {}))

    return map_arrow(picked, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


# --- the form with higher-order functions -------------------------------------------------------


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>>: bucket crc32(hex) mod BUCKETS -> {hex piece: rank}; folded to a literal."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        buckets[zlib.crc32(h.encode()) % BUCKETS][h] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _rank(table_: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(table_, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece)


def encode_words_native(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """Adds ``ids`` (array<int>) to a table of pretokens, by higher-order functions only."""
    lit = rank_literal(ranks)
    hexed = F.hex(F.encode(F.col(word), "UTF-8"))
    size = F.length(hexed) / 2
    start = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts)),
            lambda i: F.struct(_rank(lit, F.concat(F.get(parts, i - 1), F.get(parts, i))).alias("r"), i.alias("i")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        at = best["i"]
        joined = F.concat(
            F.slice(parts, F.lit(1), at - 1),
            F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))),
            F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))),
        )
        return F.when(at.isNull(), parts).otherwise(joined)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size.cast("int") - 1, F.lit(1))), start, step)
    whole = _rank(lit, hexed)
    ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda p: _rank(lit, p)))
    return words.withColumn("ids", F.when(F.length(hexed) > 0, ids).otherwise(F.array().cast("array<int>")))


def decode_ids_native(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Binary text of an array of ids: the pieces, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.hex()
    lit = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(lit, i)), ""))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
