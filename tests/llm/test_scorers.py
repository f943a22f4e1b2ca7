import numpy as np
import pytest

from voxelake.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_agrees_with_labels(spark, labelled):
    got = quality.op2_quality(spark, SF).join(labelled, "doc_id").toPandas()
    good = got[got.quality == 1]
    assert good.kept.mean() > 0.98
    assert (got[got.quality == 0].kept.mean()) < 0.1


def test_estimate_recovers_accuracies():
    r = np.random.default_rng(3)
    good = r.random(20_000) < 0.85
    rates = (0.6, 0.3, 0.5, 0.4)  # bad votes on bad documents
    counts: dict[str, int] = {}
    for g in good:
        p = "".join("b" if (not g and r.random() < x) else "g" for x in rates)
        counts[p] = counts.get(p, 0) + 1
    share, table, posterior = quality.estimate(counts)
    assert abs(share - 0.85) < 0.05
    assert all(abs(table[k, 1, 1] - x) < 0.12 for k, x in enumerate(rates))
    assert posterior["gggg"] > 0.8 and posterior["bbbb"] < 0.01


def test_quality_edge_rows(make_docs):
    clean = "This is a plain sentence with some words in it. Here is another one, as plain as the first."
    junk = "win### now*** at$$$ once%%% for&&& all### of*** us$$$ here%%% and&&& there### too***"
    rows = [(k, clean) for k in range(20)] + [(100 + k, junk) for k in range(6)] + [(200, None), (201, ""), (None, clean), (202, clean * 3000)]
    docs = make_docs(rows).withColumnRenamed("lang", "quality_score")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(20)) <= set(ids) and None in ids and not {200, 201, 100} & set(ids)
    assert quality.keep_good(make_docs([])).count() == 0


def test_toxicity_held_out(spark, labelled):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("text", "toxic").toPandas()
    found = np.array([model.severity(t) for t in held.text]) >= toxicity.REJECT_AT
    assert found[held.toxic == 1].mean() > 0.85
    assert found[held.toxic == 0].mean() < 0.01
    assert model.thresholds == sorted(model.thresholds)


def test_expected_severity_rises():
    model = toxicity.Model({toxicity._hashes(w)[0]: [2.0] + [0.0] * (toxicity.LEVELS - 1) for w in ("aaa", "bbb", "ccc")}, [1.0, 3.0, 5.0])
    s = [model.severity(t) for t in ("", "clean", "aaa", "aaa bbb", "aaa bbb ccc")]
    assert s == sorted(s) and s[0] == 0.0 and s[-1] < 3 and model.severity(None) == 0.0


def test_toxicity_edge_rows(spark, make_docs):
    rows = [(k, f"you friendly words number{k} there") for k in range(40)] + [(100 + k, f"you zork words number{k} there") for k in range(20)]
    rows += [(200, None), (201, ""), (202, "zork " * 50_000), (None, "friendly"), (203, "you ZORK!!")]
    docs = make_docs(rows).withColumnRenamed("source", "severity")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 1, 1) for k in range(20)] + [(None, 1, 1), (5, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(docs, docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {*range(40), 200, 201, None}
    assert toxicity.keep_clean(docs, docs, labels.limit(0)).count() == len(rows)
    assert toxicity.keep_clean(make_docs([]), docs, labels).count() == 0


def test_toxicity_trains_on_one_text_of_each_id(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic: seen.append((len(rows), int(toxic.sum()), sorted(r[0].tolist() for r in rows))))
    rows = [(0, f"hot text number{'abcdefghij'[k % 10]} {'xyz'[k % 3]}") for k in range(500)] + [(k, f"some words of {k} there") for k in range(1, 60)]
    labels = spark.createDataFrame([(k, 1, int(k > 40)) for k in range(60)], "doc_id long, quality int, toxic int")
    for given in (rows, rows[::-1]):
        toxicity.fit(make_docs(given), labels)
    assert seen[0] == seen[1] and seen[0][:2] == (60, 19)


def test_toxicity_counts_on_spark_as_on_the_driver(spark, make_docs, monkeypatch):
    """Features of long labelled texts don't come to the driver, and the model is the same."""
    r = np.random.default_rng(8)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = []
    for i in range(120):
        own = [word(x) for x in r.integers(100, 3000, 60)]
        rows.append((i, " ".join(own + (["zorkish", "gromblex"] + [f"blub{word(x)}" for x in r.integers(0, 50, 6)]) * (i % 4 == 0))))
    rows += [(200 + i, rows[i][1]) for i in range(12)] + [(300, None), (301, "12 34")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = make_docs(rows)
    plain = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "DRIVER_ENTRIES", 100)
    monkeypatch.setattr(toxicity, "train", None)
    for broadcast in (toxicity.BROADCAST_ROWS, 1):
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", broadcast)
        spark_ = toxicity.fit(docs, labels)
        assert spark_.weights.keys() == plain.weights.keys() and len(plain.weights) > 2
        assert all(np.allclose(spark_.weights[h], w) for h, w in plain.weights.items())
        assert np.allclose(spark_.thresholds, plain.thresholds)


def test_ordinal_slopes_equal_finite_differences():
    r = np.random.default_rng(3)
    z, theta, grade = r.normal(size=40), np.array([-0.5, 0.4, 1.3]), r.integers(0, toxicity.GRADES, 40)
    p, part = toxicity.slopes(z, theta, grade)
    # By enumeration: the grades' probabilities are differences of the cumulative ones and sum to one.
    every = np.stack([toxicity.slopes(z, theta, np.full(40, g))[0] for g in range(toxicity.GRADES)])
    assert np.allclose(every.sum(axis=0), 1) and np.allclose(p, every[grade, np.arange(40)])
    for k in range(len(theta)):
        step = np.zeros(3)
        step[k] = 1e-6
        slope = (np.log(toxicity.slopes(z, theta - step, grade)[0]) - np.log(toxicity.slopes(z, theta + step, grade)[0])) / 2e-6
        assert np.allclose(slope, part[:, k], atol=1e-5)


def test_chosen_entries_equal_a_plain_count():
    r = np.random.default_rng(5)
    rows = 80
    toxic = r.random(rows) < 0.4
    words = r.integers(20, 60, rows)
    entries = [(h, k, d) for d in range(rows) for h in r.choice(30, 8, replace=False) for k in [int(r.integers(1, 9))] if not (h < 4 and not toxic[d])]
    h = np.array([((int(e[0]) % 2 * 5) << 32) | int(e[0]) for e in entries])
    k, d = np.array([e[1] for e in entries]), np.array([e[2] for e in entries])
    chosen, at, at_row = toxicity.chosen_entries(h, k, d, words, toxic)
    held = {}
    for x, n, doc in zip(h.tolist(), k.tolist(), d.tolist(), strict=True):
        begins = x >> 32 > 0
        for level in range(toxicity.LEVELS):
            if level < len(toxicity.COUNTS):
                c = toxicity.COUNTS[level]
                on = n >= c and (begins or c == 1)
            else:
                on = begins and n >= toxicity.SHARES[level - len(toxicity.COUNTS)] * words[doc]
            if on:
                held.setdefault(x * toxicity.LEVELS + level, set()).add(doc)
    counts = {f: (len(docs), sum(bool(toxic[x]) for x in docs)) for f, docs in held.items()}
    names = sorted(counts)
    use = toxicity.telling(np.array([counts[f][0] for f in names]), np.array([counts[f][1] for f in names]), toxic.mean())
    assert chosen.tolist() == [f for f, u in zip(names, use, strict=True) if u] and len(chosen)
    assert sorted(zip(chosen[at].tolist(), at_row.tolist(), strict=True)) == sorted((f, x) for f in chosen.tolist() for x in held[f])


@pytest.mark.parametrize("grade", [0, 1])
def test_labels_of_one_kind_give_no_severity(make_docs, spark, grade):
    docs = make_docs([(k, f"word{k} stupid text") for k in range(12)])
    labels = spark.createDataFrame([(k, grade) for k in range(12)], "doc_id long, toxic int")
    assert max(r.expected_severity for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()) < 1e-9


def test_sample_counts_ids_not_rows(spark):
    """1,000 rows of which 900 share an id: the sample is the same however they come, with a text of each id."""
    from voxelake.llm import common

    rows = [(7 if k < 900 else k, f"text {k}") for k in range(1000)] + [(None, "none"), (None, None)]
    take = lambda r: sorted(map(tuple, common.one_per_key(spark.createDataFrame(r, "doc_id long, text string").repartition(5), "doc_id", "text", 60).collect()), key=str)
    got = take(rows)
    assert got == take(rows[::-1]) and len(got) == 60 == len({i for i, _ in got})
    assert len(take(rows[:3])) == 1 and take(rows[:0]) == []
