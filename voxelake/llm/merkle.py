"""Merkle manifest of a table: a leaf for each row, a 16-ary tree for each source and one over the sources.

A leaf is the SHA-256 of the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value;
digests are lowercase hex and are concatenated as text. Leaves of a source ascend by key. While more than one
node remains, every ``ARITY`` consecutive ones become the digest of their concatenation; what remains is the
source's subroot, and the subroots, ordered by source, become the root in the same way.

Texts are hashed where they are read and never shuffled. Leaves get their rank in their source from a range
sort and the counts of its partitions, so a source may hold any share of the rows. Ranks cut a source into
aligned buckets of ``BUCKET`` leaves, whole subtrees of the source's tree. Executors feed Arrow blocks of whole
buckets to DuckDB, which runs one ordered ``string_agg`` with ``sha256`` for each level. Spark combines the
bucket roots, joins each bucket with the proof outside it, and a second pass over the buckets folds every leaf.

Defined cases: null fields are ``-``; an empty text is ``0:``; a null key stands before others, equal keys
stand by their leaves, and repeated rows are equal leaves side by side; a null source is a source of its own,
before others; a source of one row has its leaf as subroot, a table of one source its subroot as root; a row
without siblings has the digest of the empty text as its proof; long texts are hashed whole; an empty table
gives an empty result; extra columns are ignored, also such as are called ``leaf`` or ``root``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.ranking import ranked
from voxelake.shipping import ship

from .common import arrow_batches, staged, table

ARITY, HEX, LEVELS = 16, 64, 3
#: Leaves of a bucket: the largest subtree that a block holds whole.
BUCKET = ARITY**LEVELS
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, position long"


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _path(run: Column, at: Column) -> list[Column]:
    """Digests left and right of place ``at`` of a run."""
    return [F.concat_ws("", F.slice(run, 1, at)), F.concat_ws("", F.slice(run, at + 2, ARITY))]


def outer_tree(nodes: DataFrame, group: str, label: str) -> DataFrame:
    """Combine ``nodes`` (group, idx, h, n: nodes of the group) to a root for each group.

    Returns group, idx, h, top and the siblings' texts ``lefts`` and ``rights``, a level each from below."""
    nodes = staged(nodes.select(group, "idx", "h", "n"), label)
    most = nodes.agg(F.max("n")).first()[0] or 1
    tiers, now = [], nodes
    while most > 1:
        members = F.array_sort(F.collect_list(F.struct("idx", "h")))
        run = now.where("n > 1").groupBy(group, "n", F.expr(f"idx div {ARITY}").alias("up")).agg(F.transform(members, lambda m: m["h"]).alias("run"))
        tiers.append(staged(run, label))
        up = tiers[-1].select(group, F.col("up").alias("idx"), F.sha2(F.concat_ws("", "run"), 256).alias("h"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        now = up.unionByName(now.where("n = 1"))
        most = -(-most // ARITY)
    none = F.array().cast("array<string>")
    paths = now.select(group, "idx", "h", F.col("h").alias("top"), none.alias("lefts"), none.alias("rights"))
    for tier in reversed(tiers):
        over = paths.select(F.col(group).alias("_g"), F.col("idx").alias("_i"), "top", "lefts", "rights")
        below = tier.join(over, F.col(group).eqNullSafe(F.col("_g")) & (F.col("up") == F.col("_i")))
        left, right = _path(F.col("run"), F.col("at"))
        lefts, rights = F.concat(F.array(left), F.col("lefts")), F.concat(F.array(right), F.col("rights"))
        below = below.select("*", F.posexplode("run").alias("at", "h"))
        below = below.select(group, (F.col("up") * ARITY + F.col("at")).alias("idx"), "h", "top", lefts.alias("lefts"), rights.alias("rights"))
        # Groups that had a single node at this tier have nothing in it.
        done = tier.select(F.col(group).alias("_g")).distinct()
        alone = paths.join(done, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        paths = below.unionByName(alone)
    return staged(paths, label)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets, of ``BUCKET`` rows and more; ``b`` numbers the buckets of a table."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(t: pa.Table) -> np.ndarray:
        source = t["source"].chunk(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        bucket = t["bucket"].to_numpy()
        return np.cumsum(np.r_[False, (source[1:] != source[:-1]) | (bucket[1:] != bucket[:-1])])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * BUCKET:
            t = pa.Table.from_batches(held).combine_chunks()
            b = numbered(t)
            if cut := int(np.searchsorted(b, b[-1])):
                yield t.slice(0, cut).append_column("b", pa.array(b[:cut]))
                held = t.slice(cut).to_batches()
                rows -= cut
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.append_column("b", pa.array(numbered(t)))


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


#: Levels of a bucket's own tree: all of it where the source has a single bucket.
_DEPTH = f"case when n > {BUCKET} then {LEVELS} " + " ".join(f"when n > {ARITY**k} then {k + 1}" for k in reversed(range(LEVELS))) + " else 0 end"


def _load(con, block: pa.Table) -> None:
    """The block's leaves, and of each level its runs and its nodes."""
    con.register("block", block)
    con.execute(f"create or replace temp table leaf as select b, rank - bucket * {BUCKET} as i, {_DEPTH} as depth, * exclude (b) from block where rank >= 0")
    con.execute("create or replace temp table node0 as select b, i, depth, leaf as h from leaf")
    for k in range(1, LEVELS + 1):
        con.execute(f"""create or replace temp table run{k} as
            select b, i // {ARITY} as i, depth, string_agg(h, '' order by i) as s from node{k - 1} where depth >= {k} group by b, i // {ARITY}, depth""")
        con.execute(f"create or replace temp table node{k} as select b, i, depth, sha256(s) as h from run{k}")


def bucket_roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, idx (of the bucket), h and n (buckets of the source) of each bucket."""
    con = _engine()
    tops = " union all ".join(f"select b, h from node{k} where depth = {k}" for k in range(LEVELS + 1))
    for block in _blocks(batches):
        _load(con, block)
        found = con.sql(f"select source, bucket as idx, t.h, (n + {BUCKET - 1}) // {BUCKET} as n from ({tops}) t join leaf using (b) where leaf.i = 0")
        yield from _typed(found, "source string, idx long, h string, n long")


def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``RESULT`` of each leaf: each is folded with its siblings in the bucket, then with those outside.

    The row of rank -1 of each bucket brings the proof outside it."""
    con = _engine()
    for block in _blocks(batches):
        _load(con, block)
        con.execute("create or replace temp table outside as select b, lefts, rights, subroot, root from block where rank < 0")
        con.execute("create or replace temp table fold as select *, coalesce(told, leaf) as f, '' as proof from leaf")
        for k in range(1, LEVELS + 1):
            at = f"{HEX} * ((i // {ARITY ** (k - 1)}) % {ARITY})"
            con.execute(f"""create or replace temp table fold as
                select * exclude (f, proof, l, r), case when l is null then f else sha256(l || f || r) end as f, proof || coalesce(l || r, '') as proof
                from (select x.*, substr(s, 1, {at.replace("(i", "(x.i")}) as l, substr(s, {at.replace("(i", "(x.i")} + {HEX + 1}) as r
                      from fold x left join run{k} y on x.b = y.b and x.i // {ARITY**k} = y.i) z""")
        con.execute("create or replace temp table fold as select * exclude (lefts, rights, subroot, root), o.* exclude (b) from fold join outside o using (b)")
        deepest = con.execute("select coalesce(max(len(lefts)), 0) from outside").fetchall()[0][0]
        for j in range(1, deepest + 1):
            con.execute(f"""create or replace temp table fold as
                select * exclude (f, proof), case when len(lefts) < {j} then f else sha256(lefts[{j}] || f || rights[{j}]) end as f,
                       proof || coalesce(lefts[{j}] || rights[{j}], '') as proof from fold""")
        yield from _typed(con.sql("select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified, source, rank as position from fold"), RESULT)


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _typed(found, schema: str) -> Iterator[pa.RecordBatch]:
    fields = [(name, _TYPES[kind]) for name, kind in map(str.split, schema.split(", "))]
    yield from found.to_arrow_table().select([f[0] for f in fields]).cast(pa.schema(fields)).to_batches()


def _over_buckets(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Feed ``fn`` the rows bucket by bucket, in order; a bucket is whole in one task."""
    arrow_batches(rows.sparkSession)
    ship(rows.sparkSession)
    return rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "rank").mapInArrow(fn, schema)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), told: dict[str, Column] | None = None) -> DataFrame:
    """``RESULT`` for each row of ``docs``, keyed by ``doc_id`` within ``source``.

    ``told``: columns as another copy of the table has them. Each row's leaf of that copy is folded with the
    siblings of this one, and ``verified`` says whether it leads to the root."""
    copy = [(told or {}).get(name, F.col(name)) for name in fields]
    leaf = leaf_of([F.col(name) for name in fields])
    other = F.nullif(leaf_of(copy), leaf) if told else F.lit(None).cast("string")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), other.alias("told"))
    leaves = staged(ranked(leaves, ["doc_id", "leaf"], "source", "leaves").withColumn("bucket", F.expr(f"rank div {BUCKET}")), "leaves")
    roots = _over_buckets(leaves, bucket_roots, "source string, idx long, h string, n long")
    inside = outer_tree(roots, "source", "subroots").withColumnRenamed("top", "subroot")
    tops = ranked(inside.where("idx = 0").select(F.lit(0).alias("all"), "source", "subroot"), ["source"], "all", "sources")
    above = outer_tree(tops.select("all", F.col("rank").alias("idx"), F.col("subroot").alias("h"), "n"), "all", "root")
    names = tops.select(F.col("source").alias("_s"), F.col("rank").alias("_r"))
    above = names.join(above, F.col("_r") == F.col("idx")).select("_s", F.col("lefts").alias("_l"), F.col("rights").alias("_rr"), F.col("top").alias("root"))
    lefts, rights = F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_rr").alias("rights")
    outside = inside.join(above, F.col("source").eqNullSafe(F.col("_s"))).select("source", F.col("idx").alias("bucket"), lefts, rights, "subroot", "root", F.lit(-1).cast("long").alias("rank"))
    return _over_buckets(leaves.unionByName(outside, allowMissingColumns=True), folded, RESULT)


def source_roots(rows: DataFrame) -> DataFrame:
    """source, documents, subroot and root: the short form of a manifest."""
    return rows.groupBy("source", "subroot", "root").agg(F.count(F.lit(1)).alias("documents"))


def lowered(text: str = "text", key: str = "doc_id") -> Column:
    """``text`` with small letters for A-Z where 5 divides the CRC-32 of the decimal key."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), UPPER, SMALL)).otherwise(F.col(text))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), told={"text": lowered()})


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    bits = "list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, byte))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: cast(ord(ch) as bigint)), lambda crc, byte: {bits}, cast(4294967295 as bigint)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs over ``{name}0`` (g, i, h, n): runs ``{name}r{k}``, nodes ``{name}{k}`` and the tops ``{name}_top``."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"{name}r{k} as (select g, n, i // 16 as i, string_agg(h, '' order by i) as s from {name}{k - 1} where n > 1 group by g, n, i // 16)")
        out.append(f"{name}{k} as (select g, i, sha256(s) as h, (n + 15) // 16 as n from {name}r{k})")
    out.append(f"{name}_top as (" + " union all ".join(f"select g, h from {name}{k} where n = 1" for k in range(levels + 1)) + ")")
    return ",\n".join(out)


def _fold_sql(first: str, last: str, tree: str, levels: int) -> str:
    """CTEs that fold ``first`` (r, g, i, f, proof) level by level into ``last``."""
    out, now = [], first
    for k in range(1, levels + 1):
        name = last if k == levels else f"{last}{k}"
        cut = "substr(s, 1, 64 * (x.i % 16)) as l, substr(s, 64 * (x.i % 16) + 65) as rr"
        out.append(
            f"{name} as (select r, g, i // 16 as i, case when l is null then f else sha256(l || f || rr) end as f, proof || coalesce(l || rr, '') as proof "
            f"from (select x.*, {cut} from {now} x left join {tree}r{k} y on x.g = y.g and x.i // 16 = y.i) z)"
        )
        now = name
    return ",\n".join(out)


_LOW = f"case when {crc32_sql('cast(doc_id as varchar)')} % 5 = 0 then translate(text, '{UPPER}', '{SMALL}') else text end"

#: Five levels in a source and three over the sources: enough for 1,048,576 documents a source and 4,096 sources.
ORACLE_SQL = f"""
with d as (
  select doc_id, source, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} as head, {_field("text")} as body,
    {_LOW} as low, dense_rank() over (order by source nulls first) as g
  from documents
),
e as (select doc_id, source, g, sha256(head || body) as leaf, sha256(head || {_field("low")}) as told from d),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n, row_number() over () as r from e),
a0 as (select g, i, leaf as h, n from p),
{_tree_sql("a", 5)},
b0 as (select 1 as g, g - 1 as i, h, (select count(*) from a_top) as n from a_top),
{_tree_sql("b", 3)},
x0 as (select r, g, i, told as f, '' as proof from p),
{_fold_sql("x0", "x", "a", 5)},
y0 as (select r, 1 as g, g - 1 as i, f, proof from x),
{_fold_sql("y0", "y", "b", 3)}
select doc_id, leaf, a_top.h as subroot, b_top.h as root, sha256(y.proof) as proof_sha256, y.f as folded_root, y.f = b_top.h as verified, source, p.i as position
from p join a_top on p.g = a_top.g join y on p.r = y.r cross join b_top
"""
