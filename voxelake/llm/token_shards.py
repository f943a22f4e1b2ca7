"""Training-order materialisation of token ids.

Documents are tokenised and packed, each closed by an end id, into one stream that is cut into
sequences of ``length`` ids (the last is padded with the end id). A keyed Feistel permutation with
cycle-walking gives every sequence one slot of the training order: it is a bijection on 0 .. n - 1, so
nothing is sorted by random numbers and any slot can be found again from the key. Sequences are range
partitioned by slot and written as shard files in which each sequence has the same stride, so slot s is
at byte ``(s mod shard_slots) * stride`` of shard ``s div shard_slots``: reading is sequential and can
resume anywhere.

Texts are tokenised once: compressed chunks of ids are staged, their lengths give the places in the
stream (per file first, then within each file), and only then are slots known. A shard is written under
a name of its own attempt and moved when whole, so a task that is run again, or twice at a time, leaves
the same bytes. All is written once, before the table of what was written is returned.

Defined cases: a null or empty text is only its end id; texts are taken whole, of any length; rows that
repeat a doc_id are packed and reported each; a null doc_id is packed and reported as null; an empty table gives no
shard and no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelake.shipping import ship

from . import bpe
from .common import arrow_batches, map_arrow, scratch, staged, table

LENGTH = 2048
SHARD_SLOTS = 8192
END = 50256
#: Documents of one staged chunk.
CHUNK_DOCS = 32
ROUNDS = 6
#: One task writes one shard, up to so many tasks; beyond it each writes several, one after the other.
MAX_TASKS = 100_000
#: Texts up to this length go to the library's encoder in one call.
WHOLE_CHARS = 100_000
#: Rows of chunk places that may be broadcast; above it they are joined by a shuffle.
BROADCAST_CHUNKS = 200_000
SCHEMA = "slot long, shard int, offset long, sequence long, n_tokens int, crc32 long, doc_ids array<long>"


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of positions ``x`` in a keyed permutation of 0 .. n - 1."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for r in range(ROUNDS):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return left << half | right

    out = once(np.asarray(x, np.uint64))
    while (far := out >= n).any():  # walk the cycle back into the domain
        out[far] = once(out[far])
    return out.astype(np.int64)


_TIKTOKEN: dict[int, object] = {}


def _encoders(ranks, pattern: str):
    """(the library's encoder, ours for texts of great length) of this worker."""
    own = bpe.worker_encoder(ranks, pattern)
    if id(own) not in _TIKTOKEN:
        import tiktoken

        _TIKTOKEN.clear()
        _TIKTOKEN[id(own)] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    return _TIKTOKEN[id(own)], own


def chunks(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_ids, lengths (with the end id), n, body: one row for each CHUNK_DOCS documents."""
    import zstandard

    ranks = bpe.broadcast_ranks(docs.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        whole, own = _encoders(ranks, pattern)
        ids = []
        for t in batch.column(1).to_pylist():
            if t and len(t) > WHOLE_CHARS:
                found = np.frombuffer(own.encode_bytes(t), "<u4").astype("<u2")
            else:
                found = np.array(whole.encode_ordinary(t) if t else [], "<u2")
            ids += [found, np.array([END], "<u2")]
        doc = batch.column(0).to_pylist()
        pack, out = zstandard.ZstdCompressor(level=9), ([], [], [], [])
        for at in range(0, len(doc), CHUNK_DOCS):
            part = ids[2 * at : 2 * (at + CHUNK_DOCS)]
            lengths = [len(x) + 1 for x in part[::2]]
            for column, value in zip(out, (doc[at : at + CHUNK_DOCS], lengths, sum(lengths), pack.compress(np.concatenate(part).tobytes())), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()), strict=True)], ["doc_ids", "lengths", "n", "body"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_ids array<long>, lengths array<int>, n long, body binary")


def placed(rows: DataFrame) -> DataFrame:
    """Staged ``rows`` with ``start``, each one's place in the stream: files in order, then rows."""
    keyed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    places = keyed.select("file", "at", "n")
    files = places.groupBy("file").agg(F.sum("n").alias("total"))  # as many rows as tasks wrote
    files = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(places.withColumn("inside", inside).join(files, "file").select("file", "at", (F.col("base") + F.col("inside")).alias("start")), "places")
    few = starts.count() <= BROADCAST_CHUNKS
    return keyed.join(F.broadcast(starts) if few else starts, ["file", "at"])


def write_shards(docs: DataFrame, path: str, key: int = 20240607, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Writes ``path``/shard-NNNNN.bin; one row (SCHEMA) for each sequence written."""
    import zstandard

    default = bpe.default_vocabulary()
    rows = staged(chunks(docs, ranks_path or default[0], pattern or default[1]), "tokens")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    spark = docs.sparkSession
    if not n:
        return spark.createDataFrame([], SCHEMA)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(zstandard.decompress(r["body"]), "<u2")
                start, ends = r["start"], np.cumsum(r["lengths"])
                doc = r["doc_ids"]
                first, last = start // length, (start + len(ids) - 1) // length
                sequence = np.arange(first, last + 1)
                low = np.maximum(sequence * length - start, 0)
                high = np.minimum((sequence + 1) * length - start, len(ids))
                a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
                pack = zstandard.ZstdCompressor(level=6)
                slot = feistel(sequence, n, key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot), pa.array((slot // shard_slots).astype(np.int32)), pa.array(sequence), pa.array((low + start - sequence * length).astype(np.int32)),
                        pa.array([pack.compress(ids[x:y].tobytes()) for x, y in zip(low, high, strict=True)], pa.binary()),
                        pa.array([doc[x : y + 1] for x, y in zip(a, b, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["slot", "shard", "sequence", "at", "body", "doc_ids"],
                )

    arrow_batches(spark)
    ship(spark)
    pieces = placed(rows).select("doc_ids", "lengths", "body", "start").mapInArrow(cut, "slot long, shard int, sequence long, at int, body binary, doc_ids array<long>")
    shards = -(-n // shard_slots)
    dealt = pieces.repartitionByRange(min(shards, MAX_TASKS), "shard").sortWithinPartitions("slot", "at")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, own = None, "", f"part-{uuid.uuid4().hex}"
        held: dict | None = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(f"{name}.{own}", name)
                out = None

        def done(x: dict) -> tuple:
            nonlocal out, name
            ids = np.full(length, END, "<u2")
            ids[: len(x["ids"])] = x["ids"]
            at = x["slot"] % shard_slots
            wanted = f"{root}/shard-{x['shard']:05d}.bin"
            if wanted != name:
                close()
                name = wanted
                out = store.open_output_stream(f"{name}.{own}")
            raw = ids.tobytes()
            out.write(raw)
            return x["slot"], x["shard"], at * length * 2, x["sequence"], len(x["ids"]), zlib.crc32(raw), x["doc_ids"]

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            names = ("slot", "shard", "offset", "sequence", "n_tokens", "crc32", "doc_ids")
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], list(names))

        for batch in batches:
            found = []
            for r in batch.to_pylist():
                ids = np.frombuffer(zstandard.decompress(r["body"]), "<u2")
                if held is not None and held["slot"] == r["slot"]:
                    held["ids"] = np.concatenate([held["ids"], ids])
                    held["doc_ids"] += r["doc_ids"]  # pieces are of different chunks, and so of different rows
                    continue
                if held is not None:
                    found.append(done(held))
                held = r | {"ids": ids}
            if found:
                yield rows_of(found)
        if held is not None:
            yield rows_of([done(held)])
        close()

    return staged(dealt.select("slot", "shard", "sequence", "body", "doc_ids").mapInArrow(write, SCHEMA), "written")


def read_slots(path: str, first: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> np.ndarray:
    """``count`` sequences from slot ``first`` on, read in order; fewer at the end."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    out: list[np.ndarray] = []
    while count > 0:
        shard, at = divmod(first, shard_slots)
        name = f"{root}/shard-{shard:05d}.bin"
        if store.get_file_info(name).type != fs.FileType.File:
            break
        with store.open_input_file(name) as f:
            f.seek(at * length * 2)
            got = np.frombuffer(f.read(min(count, shard_slots - at) * length * 2), "<u2").reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, count = first + len(got), count - len(got)
        if at + len(got) < shard_slots:
            break
    return np.concatenate(out) if out else np.empty((0, length), "<u2")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
