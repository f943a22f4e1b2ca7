import corpus_pipeline
import numpy as np

from voxelake.llm import bpe, decontamination, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    rows = docs.toPandas()
    # Quality and toxicity: each model's own decision, text by text.
    w = quality.fit(docs)

    def good(t):
        m = quality.measures(t)
        at, x = quality.features(t, m)
        return m["n"] and 1 / (1 + np.exp(-(np.dot(w[at], x) + w[quality.WIDTH]))) >= quality.KEEP_AT

    kept = rows[[bool(good(t)) for t in rows.text]]
    model = toxicity.fit(docs, labels)
    kept = kept[[model.severity(t) < toxicity.REJECT_AT for t in kept.text]]
    # Near copies: all pairs.
    from test_near_dedup import brute

    root = brute(list(zip(kept.doc_id.tolist(), kept.text, strict=True)), 5, 80, 100)
    kept = kept[[root[i] == i for i in kept.doc_id.tolist()]]
    # Benchmark items: each text against each item.
    index = decontamination.Index([(i, decontamination.word_hashes(t)) for i, t in zip(items.item_id.tolist(), items.text, strict=True)])
    kept = kept[[not index.matches(t) for t in kept.text]]
    path, pattern = bpe.default_vocabulary()
    encoder = bpe.Encoder(bpe.load_ranks(path), pattern)
    want = {i: len(encoder.encode_bytes(t)) // 4 for i, t in zip(kept.doc_id.tolist(), kept.text, strict=True)}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "decontamination", "tokenise"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_odd_rows_go_through_all_stages(spark):
    """Nulls, empty and very long texts, repeats, ties and columns called like those of the stages."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    clean = docs.where(F.col("doc_id").isin(sorted(good)) & (F.length("text") > 400)).orderBy("doc_id").limit(4).collect()
    long = " ".join(r["text"] for r in clean[1:]) * 40
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (None, clean[0]["text"]), (10, clean[0]["text"]), (10, clean[0]["text"]), (11, clean[0]["text"]),
        (12, clean[1]["text"]), (12, clean[2]["text"]), (13, long),
    ]
    clash = ["quality_score", "severity", "digest", "root", "component", "pivot", "n", "_id", "item_id", "n_tokens"]
    own = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    own = own.select(docs.columns).withColumns({c: F.lit(f"own {c}") for c in clash})
    now = own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == own.columns
        now = spark.createDataFrame(now.collect(), own.schema)
        assert all(r[c] == f"own {c}" for r in now.collect() for c in clash)
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert sorted(i for i, _ in left if i is not None) == [10, 12, 12, 13] and (None, clean[0]["text"]) in left and len(left) == 5
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert len(out) == 5 and {r["doc_id"] for r in out} == {None, 10, 12, 13}
