"""Results as batches on the driver, in memory-bounded steps, and queries over streams of files."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from voxelake.operators.query import PointQuery
from voxelake.shipping import ship

# Fixed value: points of a batch unless asked otherwise.
POINTS_PER_BATCH = 500_000
#: Partitions that are computed ahead of the caller, and the bytes beyond which no further one is begun.
AHEAD, HELD_BYTES = 4, 256 << 20


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as the bytes of an Arrow stream."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def partitions(df: DataFrame, ahead: int = AHEAD, held_bytes: int = HELD_BYTES) -> Iterator[list[bytes]]:
    """The partitions of a result in their order, each as Arrow streams. Up to ``ahead`` of them are computed at
    a time, and none is begun while more than ``held_bytes`` wait for the caller. Closing stops what runs."""
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    rdd = df.mapInArrow(_packed, "data binary").rdd
    group = f"delivery-{uuid.uuid4().hex}"

    def fetch(k: int) -> list[bytes]:
        context.setJobGroup(group, "delivery", interruptOnCancel=True)
        return context.runJob(rdd, lambda rows: [bytes(r[0]) for r in rows], [k])

    todo, waiting = deque(range(rdd.getNumPartitions())), deque()
    pool = ThreadPoolExecutor(max(1, ahead))
    try:
        while todo or waiting:
            ready = sum(sum(map(len, f.result())) for f in waiting if f.done() and not f.exception())
            while todo and len(waiting) < max(1, ahead) and (not waiting or ready < held_bytes):
                waiting.append(pool.submit(fetch, todo.popleft()))
            first: Future = waiting.popleft()
            yield first.result()
    finally:
        for f in waiting:
            f.cancel()
        context.cancelJobGroup(group)
        pool.shutdown(wait=True, cancel_futures=True)


def arrow_batches(df: DataFrame, size: int = POINTS_PER_BATCH, ahead: int = AHEAD) -> Iterator[pa.RecordBatch]:
    """Full batches of ``size`` rows and the rest at the end; never an empty one. The rows come as Arrow, in the order of
    the result's partitions, some of them ahead (:func:`partitions`)."""

    def read() -> Iterator[pa.RecordBatch]:
        found = partitions(df, ahead)
        try:
            for streams in found:
                for data in streams:
                    yield from pa.ipc.open_stream(data)
        finally:
            found.close()

    batches = read()
    try:
        yield from rebatched(batches, size)
    finally:
        batches.close()


def rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of any sizes as full ones, and the rest."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            take = min(size - n, b.num_rows)
            held.append(b.slice(0, take))
            n, b = n + take, b.slice(take)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def for_each_batch(df: DataFrame, callback: Callable[[pa.RecordBatch], object], size: int = POINTS_PER_BATCH) -> int:
    """Calls back on the caller's thread; what the callback raises stops the job and is raised. Gives the
    number of rows delivered."""
    n = 0
    batches = arrow_batches(df, size)
    try:
        for batch in batches:
            callback(batch)
            n += batch.num_rows
    finally:
        batches.close()
    return n


def for_each_partition(df: DataFrame, callback: Callable[[Iterator], None]) -> None:
    """The same on the executors, where results needn't come to the driver."""
    df.foreachPartition(callback)


def limited(df: DataFrame, num_points: int) -> DataFrame:
    return df.limit(num_points)


def stream_query(spark, path: str, schema, query: PointQuery) -> DataFrame:
    """A point query over files as they arrive: the same test and projection, row by row, without state."""
    points = spark.readStream.schema(schema).parquet(path)
    return query.run(points)
