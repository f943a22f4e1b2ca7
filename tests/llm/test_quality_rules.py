from collections import Counter

import pytest

from voxelake.llm import quality_rules as q

PROSE = " ".join(f"word{i} and then{i} some more{i} here." for i in range(20))


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e b c d f", " ".join("abcab"[i % 5] for i in range(200))])
def test_repeats_equal_plain(text):
    assert q.measure(text)["n_repeat_words"] == plain_repeats(text.split())


def test_base_measures():
    m = q.measure("Hé #1.\n\nHé #1.\n \nHé #1. \nno break space\x0bend.")
    assert (m["n_words"], m["n_dup_lines"], m["n_symbols"]) == (8, 1, 3)
    assert m["word_chars"] == 15 + len("no break space") + len("end.")
    assert m["base_failed"] and not m["kept"]


@pytest.mark.parametrize("line, why", [
    ("Home | About | News | Contact", "navigation"),
    ("Skip to content", "navigation"),
    ("Copyright 2020 Firm, all rights reserved.", "boilerplate"),
    ("} }", "boilerplate"),
    ("BUY!! NOW!! IT!! IS!! CHEAP!!", "punctuation"),
    ("a label without an end", "punctuation"),
    ("It ends. But this is cut", None),
    ("He said \"so it is.\"", None),
    ("What is that?", None),
    ("这是一个句子。", None),
    ("A long line may say privacy policy " + "and more " * 40 + "words.", None),
])
def test_lines(line, why):
    assert q.fault(line, len(line.split())) == why


def test_documents_that_lose_too_much_go(spark, make_docs):
    menu = "\n".join(f"Go{i} | To{i} | There{i} | Now{i}" for i in range(4))
    rows = [(1, PROSE), (2, PROSE + "\n" + menu), (3, PROSE[:600] + "\n" + " ".join(f"label{i}" for i in range(200))), (4, None), (5, ""), (6, " \n\t"), (None, PROSE), (1, PROSE), (7, "so so so " * 100 + ".")]
    out = q.judge(make_docs(rows)).collect()
    kept = Counter((r["doc_id"], r["kept"]) for r in out)
    assert kept == Counter({(1, True): 2, (2, True): 1, (3, False): 1, (4, False): 1, (5, False): 1, (6, False): 1, (None, True): 1, (7, False): 1})
    two = next(r for r in out if r["doc_id"] == 2)
    assert two["clean_text"] == PROSE and two["n_navigation"] == 4
    assert {r["doc_id"] for r in out if r["base_failed"]} == {4, 5, 6, 7}


def test_kept_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, PROSE + "\nHome | News | Shop | Login", "en", "s", 3, 7, True)], "doc_id long, text string, lang string, source string, n_chars int, n_words int, kept boolean")
    out = q.keep_good(docs)
    assert out.schema.names == docs.schema.names
    assert out.collect()[0].asDict() | {"text": ""} == {"doc_id": 1, "text": "", "lang": "en", "source": "s", "n_chars": 3, "n_words": 7, "kept": True}
    assert out.collect()[0]["text"] == PROSE
    assert q.judge(docs.limit(0)).count() == 0 and "clean_text" not in q.judge(docs, texts=False).columns


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(20_000)) + ". " + "x" * 300_000 + "."
    whole = q.measure(text)
    monkeypatch.setattr(q, "PIECE", 1000)
    assert q.measure(text) == whole and whole["n_words"] == 20_001 and whole["n_repeat_words"] == plain_repeats(text.split())


def test_clean_labelled_documents_stay(spark, sf):
    """Of labelled documents with enough words the good ones stay and the bad ones go."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["kept"]) for r in q.op11_quality_rules(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(good == kept for good, kept in out) >= 0.98 * len(out) > 30
