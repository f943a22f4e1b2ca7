import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from voxelake.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, change=None):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    if change:
        values[4] = change(values[4])
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes):
    """The top, and each node's (siblings left, right) level by level."""
    paths = [[] for _ in hashes]
    now, below = list(hashes), [[i] for i in range(len(hashes))]
    while len(now) > 1:
        up, over = [], []
        for k in range(0, len(now), 16):
            run = now[k : k + 16]
            for j, leaves in enumerate(below[k : k + 16]):
                for leaf in leaves:
                    paths[leaf].append((run[:j], run[j + 1 :]))
            up.append(digest("".join(run)))
            over.append(sum(below[k : k + 16], []))
        now, below = up, over
    return now[0], paths


def plain_manifest(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r))) for s in sources}
    trees = {s: plain_tree([plain_leaf(r) for r in groups[s]]) for s in sources}
    root, outer = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, over in zip(sources, outer, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0
            low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            fold, proof = plain_leaf(r, low if hit else None), ""
            for left, right in path + over:
                fold = digest("".join([*left, fold, *right]))
                proof += "".join(left + right)
            out.append((r["doc_id"], plain_leaf(r), trees[s][0], root, digest(proof), fold, fold == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def held(docs):
    got = [tuple(r[c] for c in NAMES) for r in merkle.manifest(docs, told={"text": merkle.lowered()}).collect()]
    want = plain_manifest([r.asDict() for r in docs.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


def test_buckets_of_all_sizes(spark):
    """Sources of one leaf, of whole and partly filled runs, of one bucket, and of several with a last leaf alone."""
    sizes = {"a": 3 * merkle.BUCKET + 5, "b": merkle.BUCKET + 1, "c": merkle.BUCKET, "d": 257, "e": 1, "é": 16, "f": 17, None: 2} | {f"s{i}": 1 for i in range(12)}
    parts = [spark.range(1, n + 1, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit(s).cast("string").alias("source")) for s, n in sizes.items()]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    docs = docs.select("doc_id", F.concat(F.lit("Text É "), F.col("doc_id")).alias("text"), F.lit("en").alias("lang"), "source", F.lit(3).alias("n_chars"))
    got = held(docs)
    assert len(got) == sum(sizes.values()) and 0 < sum(not g[-1] for g in got) < len(got) / 2


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (None, "C", None, None, None), (None, None, None, "s", None), (7, "", "fr", "", 0), (7, None, "fr", "", 0), (9, "Ünï\nX" * 50_000, "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    held(docs)
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("leaf", "root", "rank", "bucket", "n", "told", "idx")))
    assert sorted(map(str, merkle.manifest(clash).collect())) == sorted(map(str, merkle.manifest(docs).collect()))
    assert all(r["verified"] for r in merkle.manifest(docs).collect())


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, make_docs, n):
    docs = make_docs([(4, "Some Text")][:n])
    got = held(docs) if n else merkle.manifest(docs).collect()
    assert len(got) == n
    if n:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")


def test_source_roots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = merkle.source_roots(merkle.manifest(docs))
    assert short.count() == docs.select("source").distinct().count() and short.agg(F.sum("documents")).first()[0] == docs.count()
