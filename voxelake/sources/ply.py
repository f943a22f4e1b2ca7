"""PLY files as a Spark data source: ``spark.read.format("ply").load(path)`` over a file, a folder or a
pattern, ``df.write.format("ply").save(folder)`` by all tasks, and a writer of single files.

A reader task takes a range of the fixed-width vertex records, so one large file is read by many tasks.
Values are little-endian binary; positions are doubles with the header's offset added; red, green, blue
(or r, g, b) become ``color``; alpha is dropped; all other scalars stay, of every scalar type."""

from __future__ import annotations

import fnmatch
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelake.functions.attributes import TYPES, attribute_types, type_of
from voxelake.shipping import ship

from .files import put, store_of

# The format's names of scalar types.
SCALARS = {
    "char": "I8", "int8": "I8", "uchar": "U8", "uint8": "U8", "short": "I16", "int16": "I16", "ushort": "U16", "uint16": "U16",
    "int": "I32", "int32": "I32", "uint": "U32", "uint32": "U32", "longlong": "I64", "int64": "I64", "ulonglong": "U64", "uint64": "U64",
    "float": "F32", "float32": "F32", "double": "F64", "float64": "F64",
}
NAMES = {"I8": "char", "U8": "uchar", "I16": "short", "U16": "ushort", "I32": "int", "U32": "uint", "I64": "longlong", "U64": "ulonglong", "F32": "float", "F64": "double"}
COLOURS = ("red", "green", "blue"), ("r", "g", "b")
RECORDS_PER_PARTITION, RECORDS_PER_BATCH = 2_000_000, 65_536
#: Points of one file that is written into a folder; a task holds so many.
RECORDS_PER_FILE = 1_000_000
COUNT_DIGITS = 20


@dataclass
class Header:
    count: int = 0
    fields: list[tuple[str, str]] = field(default_factory=list)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    length: int = 0
    encoding: str = ""

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, TYPES[k].dtype) for n, k in self.fields])


def parse_header(stream: io.BufferedIOBase) -> Header:
    """Raises ValueError for anything but the known lines; the vertex element must come first."""
    h, element, first = Header(), None, True
    if stream.readline().strip() != b"ply":
        raise ValueError("not a PLY file")
    while True:
        raw = stream.readline()
        if not raw:
            raise ValueError("the header does not end")
        words = raw.decode("ascii", "replace").split()
        if not words:
            raise ValueError("an empty header line")
        if words[0] == "end_header":
            break
        if words[0] == "format" and len(words) == 3:
            h.encoding = words[1]
        elif words[0] == "comment":
            if len(words) == 5 and words[1] == "offset:":
                h.offset = tuple(map(float, words[2:5]))
        elif words[0] == "element" and len(words) == 3:
            element = words[1]
            if element == "vertex":
                if not first:
                    raise ValueError("the vertex element is not the first")
                h.count = int(words[2])
            first = False
        elif words[0] == "property" and element is not None:
            if element == "vertex":
                if words[1] == "list":
                    raise ValueError("vertices with list properties are not read")
                if len(words) != 3 or words[1] not in SCALARS:
                    raise ValueError(f"unknown property: {' '.join(words)}")
                h.fields.append((words[2], SCALARS[words[1]]))
        else:
            raise ValueError(f"unknown header line: {' '.join(words)}")
    if h.encoding != "binary_little_endian":
        raise ValueError(f"format {h.encoding!r} is not read, only binary_little_endian")
    if not {"x", "y", "z"} <= {n for n, _ in h.fields}:
        raise ValueError("vertices need x, y and z")
    h.length = stream.tell()
    return h


def _open(path: str):
    store, where = store_of(path)
    return store.open_input_file(where)


def files_of(path: str) -> list[str]:
    """The file itself, the ``.ply`` files of a folder, or those that fit a pattern in the last part."""
    from pyarrow import fs

    parent, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        folder, fits = parent or ".", last
    else:
        store, where = store_of(path)
        if store.get_file_info(where).type != fs.FileType.Directory:
            return [path]
        folder, fits = path.rstrip("/"), "*.ply"
    store, where = store_of(folder)
    names = (i.base_name for i in store.get_file_info(fs.FileSelector(where)) if i.type == fs.FileType.File)
    found = sorted(n for n in names if fnmatch.fnmatchcase(n, fits) and n[0] not in "._")
    if not found:
        raise FileNotFoundError(f"no PLY files in {path}")
    return [f"{folder}/{n}" for n in found]


def read_header(path: str) -> Header:
    with _open(path) as f:
        return parse_header(io.BufferedReader(f))


def schema_of(h: Header) -> T.StructType:
    names = dict(h.fields)
    out = [T.StructField(c, T.DoubleType()) for c in "xyz"]
    rgb = next((c for c in COLOURS if set(c) <= set(names)), None)
    if rgb:
        out.append(T.StructField("color", TYPES["U8Vec3"].spark, metadata={"attr_type": "U8Vec3"}))
    for n, k in h.fields:
        if n not in ("x", "y", "z", "alpha", "a", *(rgb or ())):
            out.append(T.StructField(n, TYPES[k].spark, metadata={"attr_type": k}))
    return T.StructType(out)


def batch_of(h: Header, records: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    """Arrow columns of decoded records."""
    rgb = next((c for c in COLOURS if set(c) <= set(records.dtype.names)), None)
    columns = []
    for f in schema:
        if f.name in ("x", "y", "z"):
            columns.append(pa.array(records[f.name].astype(float) + h.offset["xyz".index(f.name)]))
        elif f.name == "color" and rgb:
            columns.append(pa.StructArray.from_arrays([pa.array(records[c].astype(np.int16)) for c in rgb], ["red", "green", "blue"]))
        elif isinstance(f.dataType, T.DecimalType):
            columns.append(pa.array([int(v) for v in records[f.name]], pa.decimal128(20, 0)))
        else:
            kind = {T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.ByteType: pa.int8(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}[type(f.dataType)]
            columns.append(pa.array(records[f.name]).cast(kind))
    return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, records: int):
        self.path, self.schema, self.records = path, schema, records

    def partitions(self) -> list[_Range]:
        out = []
        for path in files_of(self.path):
            n = read_header(path).count
            out += [_Range(path, k, min(self.records, n - k)) for k in range(0, n, self.records)]
        return out or [_Range(files_of(self.path)[0], 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h = read_header(part.path)
        if schema_of(h).simpleString() != self.schema.simpleString():
            raise ValueError(f"{part.path} has other properties than the first file")
        with _open(part.path) as f:
            f.seek(h.length + part.first * h.dtype.itemsize)
            left = part.count
            while left > 0:
                want = min(left, RECORDS_PER_BATCH)
                raw = f.read(want * h.dtype.itemsize)
                if len(raw) < want * h.dtype.itemsize:
                    raise ValueError(f"{part.path} ends within its vertices")
                yield batch_of(h, np.frombuffer(raw, h.dtype), self.schema)
                left -= want


@dataclass
class _Written(WriterCommitMessage):
    """Files of one task, and their points."""

    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    """Tasks write under a folder of the job's own; the commit moves their files into place, so a job that fails leaves
    nothing, and files of attempts that don't count are left behind and removed. Appended files get names of their own."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, records: int, types: dict[str, str]):
        self.path, self.layout, self.overwrite, self.records = path, _layout(schema, types), overwrite, records
        self.job = uuid.uuid4().hex

    @property
    def _waiting(self) -> str:
        return f"_writing-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, root = store_of(self.path)
        store.create_dir(f"{root}/{self._waiting}", recursive=True)
        context = TaskContext.get()
        # Attempts of a task write apart; only the one whose message counts is moved.
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job[:8]}"
        written: list[tuple[str, int]] = []

        def close(held: list[np.ndarray], n: int) -> None:
            name = f"{stem}-{len(written):05d}.ply"
            put(store, f"{root}/{self._waiting}", name, _header(self.layout, n), *(part.tobytes() for part in held))
            written.append((name, n))

        for held, n in _chunks(map(lambda b: _records(self.layout, b), batches), self.records):
            close(held, n)
        if context.partitionId() == 0 and not written:  # an empty table is a file without points
            close([], 0)
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyspark.errors import PySparkRuntimeError

        store, root = store_of(self.path)
        if any(m is None for m in messages):
            self.abort(messages)
            raise PySparkRuntimeError("a task gave no files")
        files = [f for m in messages for f in m.files]
        # Of several tasks' files those without points are needed only if there is no other.
        kept = [f for f in files if f[1]] or files[:1]
        old = _listed(store, root) if self.overwrite else []
        for name, _ in kept:
            store.move(f"{root}/{self._waiting}/{name}", f"{root}/{name}")
        for name in old:
            store.delete_file(f"{root}/{name}")
        store.delete_dir(f"{root}/{self._waiting}")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self._waiting}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self._waiting}")


def _chunks(parts: Iterable[np.ndarray], records: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """Records as lists of up to so many, and their number."""
    held, n = [], 0
    for rows in parts:
        while len(rows):
            held.append(rows[: records - n])
            n, rows = n + len(held[-1]), rows[len(held[-1]) :]
            if n == records:
                yield held, n
                held, n = [], 0
    if n:
        yield held, n


def _listed(store, root: str) -> list[str]:
    """The PLY files of a folder."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return [i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(".ply") and i.base_name[0] not in "._"]


class PlyDataSource(DataSource):
    """Options: ``path``; ``recordsPerPartition``; ``recordsPerFile``; ``types``, attribute types by column as JSON, as a
    data source doesn't get column metadata. Saves in the modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        return schema_of(read_header(files_of(self.options["path"])[0]))

    def _number(self, name: str, default: int) -> int:
        return int(self.options.get(name.lower(), self.options.get(name, default)))

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, self._number("recordsPerPartition", RECORDS_PER_PARTITION))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite, self._number("recordsPerFile", RECORDS_PER_FILE), json.loads(self.options.get("types", "{}")))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PlyDataSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file, or all files of a folder or pattern, with their attribute types in column metadata (a data source's own are dropped)."""
    register(spark)
    own = {f.name: f for f in schema_of(read_header(files_of(path)[0]))}
    df = spark.read.format("ply").load(path)
    return df.select(*(df[c].alias(c, metadata=own[c].metadata) for c in df.columns))


def _layout(schema: T.StructType, types: dict[str, str] | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(column, scalar type, names in the file); ``types``: attribute types of columns that aren't tagged with them."""
    out = [(c, "F64", (c,)) for c in "xyz"]
    for f in sorted(schema, key=lambda f: f.name):
        if f.name in ("x", "y", "z"):
            continue
        kind = (types or {}).get(f.name) or type_of(f)
        if kind == "U8Vec3":
            names = ("red", "green", "blue") if f.name in ("color", "rgb", "rgba") else tuple(f"{f.name}{k}" for k in range(3))
            out.append((f.name, "U8", names))
        elif kind == "F64Vec3":
            out.append((f.name, "F64", tuple(f"{f.name}{k}" for k in range(3))))
        else:
            out.append((f.name, kind, (f.name,)))
    return out


def _header(layout: list[tuple[str, str, tuple[str, ...]]], n: int) -> bytes:
    props = "".join(f"property {NAMES[k]} {name}\n" for _, k, names in layout for name in names)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n:0{COUNT_DIGITS}d}\n{props}end_header\n".encode()


def _records(layout: list[tuple[str, str, tuple[str, ...]]], batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, np.dtype([(n, TYPES[k].dtype) for _, k, names in layout for n in names]))
    for column, kind, names in layout:
        values = batch.column(column)
        for k, name in enumerate(names):
            own = values if len(names) == 1 else values.field(k)
            out[name] = own.to_numpy(zero_copy_only=False).astype(TYPES[kind].dtype)
    return out


def write_folder(points: DataFrame, folder: str, records: int = RECORDS_PER_FILE, append: bool = False) -> None:
    """Files of up to ``records`` points in a folder that all executors see, written by all tasks at once."""
    register(points.sparkSession)
    writer = points.write.format("ply").mode("append" if append else "overwrite")
    writer.option("recordsPerFile", records).option("types", json.dumps(attribute_types(points))).save(folder)


def write(points: DataFrame, path: str, append: bool = False) -> int:
    """One local file, written batch by batch as the rows arrive (for folders, which all tasks write, see
    :func:`write_folder`); gives the number of points in it. The count in the header has a fixed width, so that
    appending can rewrite it in place."""
    from voxelake.streaming.delivery import arrow_batches

    layout = _layout(points.schema)
    dtype = np.dtype([(n, TYPES[k].dtype) for _, k, names in layout for n in names])

    n = 0
    if append:
        old = read_header(path)
        if old.dtype != dtype:
            raise ValueError("the file has other properties")
        n = old.count
    with open(path, "r+b" if append else "wb") as f:
        if append:
            f.seek(len(_header(layout, n)) + n * dtype.itemsize)
        else:
            f.write(_header(layout, 0))
        for batch in arrow_batches(points):
            f.write(_records(layout, batch).tobytes())
            n += batch.num_rows
        f.seek(0)
        f.write(_header(layout, n))
        f.seek(0, 2)
    return n
