import hashlib
import random

import numpy as np
import pytest

from voxelake.llm import bpe, token_shards


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = bpe.default_vocabulary()
    return bpe.load_ranks(path), pattern


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})


def test_encoder_equals_the_library(vocabulary, reference):
    enc, r = bpe.Encoder(*vocabulary), random.Random(0)
    alphabet = "ab Z9 \n\t\r\u00a0\u3000\x1c\x1f\x85'sdt\u00e9\u00df\u6f22\U0001f642\u200b.,!? -_\u2028\u1680"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, "\u00e9" * 2000, " " * 1000, "the" * 4000, "x " * 3000, "", "I'll don't 12345 " * 20]
    for t in texts:
        ids = enc.encode_bytes(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t[:60])
        assert enc.decode(ids) == t.encode()


def test_higher_order_form(spark, vocabulary):
    ranks, pattern = vocabulary
    words = ["the", " and", " thntblere", "\u00e9\u00e9lle", "\U0001f642", "", "zzzzqqqq", " 2024", "\n\n", "don", "'t"]
    df = bpe.encode_words_native(spark.createDataFrame([(w,) for w in words], "word string"), ranks)
    for row in df.withColumn("back", bpe.decode_ids_native(df.ids, ranks)).collect():
        assert row.ids == (bpe.fold_merges(row.word.encode(), ranks) if row.word else [])
        assert bytes(row.back) == row.word.encode()


def test_documents_nulls_and_repeats(spark, make_docs, reference):
    rows = [(1, "Some text, twice."), (1, "Some text, twice."), (2, None), (3, ""), (None, "no id"), (4, "long " * 60_000)]
    got = bpe.encode_documents(make_docs(rows).withColumnRenamed("lang", "n_tokens"), with_ids=True).collect()
    assert len(got) == len(rows)
    for row, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(rows, key=lambda r: (str(r[0]), len(r[1] or ""))), strict=True):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert row.doc_id == i and bytes(row.ids) == ids and row.n_tokens == len(ids) // 4
        assert row.ids_sha256 == hashlib.sha256(ids).hexdigest() and row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(token_shards.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    if n > 60:
        assert (token_shards.feistel(np.arange(n), n, 5) != token_shards.feistel(np.arange(n), n, 6)).any()


def test_shards_round_trip(make_docs, reference, tmp_path):
    texts = [f"document {k} " * (k % 40) for k in range(150)] + [None, "", "same", "same"]
    path = f"file://{tmp_path}/shards"
    rows = token_shards.write_shards(make_docs(list(enumerate(texts))), path, length=64, shard_slots=10).toPandas().sort_values("slot")
    got = token_shards.read_slots(path, 0, 10**6, 64, 10)
    assert rows.slot.tolist() == list(range(len(got))) and (rows.offset == rows.slot % 10 * 128).all()
    stream = np.empty_like(got)
    stream[rows.sequence.to_numpy()] = got
    flat = stream.ravel()[: rows.n_tokens.sum()]
    docs = np.split(flat, np.flatnonzero(flat == token_shards.END) + 1)[:-1]
    assert sorted(reference.decode(d[:-1].tolist()) for d in docs) == sorted(t or "" for t in texts)
    assert (token_shards.read_slots(path, 23, 15, 64, 10) == got[23:38]).all()
    assert {i for ids in rows.doc_ids for i in ids} == set(range(len(texts)))


def test_no_documents_no_shards(make_docs, tmp_path):
    assert token_shards.write_shards(make_docs([]), f"file://{tmp_path}/none").count() == 0
