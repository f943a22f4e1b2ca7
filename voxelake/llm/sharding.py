"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a score ``-weight / ln(u)`` with ``u`` a hash in (0, 1); the key goes to
the shard of the largest score. Adding a shard can only move a key into that shard, and changing one
weight moves keys only to or from that shard.

Defined cases: a null key hashes like any other value; a null text has size 1 and CRC 0; equal rows
go to one shard and get neighbouring slots, as slots ascend by key, digest and size; an empty table gives an empty result; extra columns are
ignored, also such as are called ``shard`` or ``slot``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.ranking import ranked

from .common import staged, table


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard for ``key``; JVM expressions only. The hash is 52 bits of an MD5 digest, which other
    engines have too."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    name = F.coalesce(key.cast("string"), F.lit("-"))

    def score(shard: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{shard}"))), 1, 13), 16, 10).cast("long")
        unit = (bits + F.lit(0.5)) / F.lit(float(2**52))
        return F.struct((F.lit(-float(weight)) / F.log(unit)).alias("s"), F.lit(-shard).alias("i"))

    scores = [score(k, w) for k, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["i"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless within its shard) and grown_shard, the shard
    with one more shard of weight 1."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    # Staged, so that sampling, sorting and the result read the texts once.
    found = ranked(staged(rows, "shards"), ["doc_id", "text_crc32", "size"], "shard", "slots")
    return found.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank").cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)


_NIBBLES = [0] * 16
for _n in range(16):
    _c = _n
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_n] = _c


def crc32_of_text_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, half a byte at a time."""
    table_ = "[" + ", ".join(map(str, _NIBBLES)) + "]"
    half = lambda c: f"xor(({c}) >> 4, {table_}[(({c}) & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: cast('0x' || p as bigint))"
    return f"xor(list_reduce({data}, lambda c, b: {half(half('xor(c, b)'))}, cast(4294967295 as bigint)), 4294967295)"


def _shard_sql(count: int) -> str:
    """The shard of the largest score; of equal ones the first."""
    bits = lambda k: f"cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '-') || '|{k}'), 1, 13) as bigint)"
    scores = ", ".join(f"-1.0/ln(({bits(k)}+0.5)/{float(2**52)!r})" for k in range(count))
    return f"cast(list_position([{scores}], list_max([{scores}]))-1 as int)"


ORACLE_SQL = f"""
with d as (
  select doc_id, cast(strlen(coalesce(text, ''))+1 as bigint) as size, {crc32_of_text_sql("coalesce(text, '')")} as text_crc32,
    {_shard_sql(8)} as shard, {_shard_sql(9)} as grown_shard from documents
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size)-1 as slot, grown_shard from d
"""
