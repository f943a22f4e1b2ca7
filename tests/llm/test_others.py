import random
import time

import duckdb
import numpy as np
import pytest

from voxelake.llm import decontamination, html_blocks, html_crf, html_pages, neighbours, registry, sharding, token_shards, url_filter

# --- extraction -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model()


def test_held_out_pages(model):
    right = wrong = 0
    for page in html_pages.labelled_pages(150, 99):
        found, labels = html_crf.marked(page)
        for a, b in zip(labels, model.decode(found), strict=True):
            right, wrong = right + (a == b), wrong + (a != b)
    assert right / (right + wrong) > 0.98


def test_viterbi_is_the_best_labelling(model):
    from itertools import product

    found, _ = html_crf.marked(next(p for p in html_pages.labelled_pages(60, 5) if 3 <= len(html_crf.marked(p)[0]) <= 10))
    emit = [sum(model.weights.get(f, 0.0) for f in fs) for fs in html_crf.features(found)]
    score = lambda y: model.start[y[0]] + sum(e for e, k in zip(emit, y, strict=True) if k) + sum(model.change[a][b] for a, b in zip(y, y[1:], strict=False))
    best = max(product((0, 1), repeat=len(found)), key=score)
    assert abs(score(tuple(map(int, model.decode(found)))) - score(best)) < 1e-9


def test_blocks_of_broken_markup():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts("<p>a<p><b>b<br><p>c &amp d&eacute;&#x41;") == ["a", "b", "c & d\u00e9A"]
    assert texts("<ul><li>x<li>y</ul>z<!-- c") == ["x", "y", "z"]
    assert texts("<script>if (a<b) '</p>'</script>t<style>q") == ["t"]
    assert texts("1 < 2 <a title='x>y'>l</a>") == ["1 < 2 l"]
    assert texts(None) == texts("") == texts("<div><p></p></div>") == []
    assert texts("<div>" * 3000 + "deep")[0] == "deep"


def test_extract_query(spark):
    pages = [(1, "http://a/", "<nav><a href=/>Home</a></nav><article><h1>T</h1><p>Some  text\nhere, long enough.</p><p>Second one.</p></article><footer>&copy; us</footer>"), (1, None, None), (2, "u", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_crf.extract_pages(df).collect())
    text = "T\n\nSome text here, long enough.\n\nSecond one."
    assert got == [(1, "", 0), (1, text, len(text)), (2, "", 0)]
    assert html_crf.extract_pages(df.limit(0)).count() == 0


# --- sharding ---------------------------------------------------------------------------------


def test_sharding_law(spark, make_docs):
    rows = [(k, f"t{k}\u00e9") for k in range(900)] + [(7, "again")] * 60 + [(None, None), (901, "")]
    got = sharding.shard_documents(make_docs(rows).withColumnRenamed("lang", "slot"), [1.0] * 8).toPandas()
    assert len(got) == len(rows) and (got.law == "key").all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.groupby("doc_id").shard.nunique().max() == 1
    moved = got[got.grown_shard != got.shard]
    assert (moved.grown_shard == 8).all() and 0.04 < len(moved.drop_duplicates("doc_id")) / 900 < 0.2
    import zlib

    byte = {i: t.encode() for i, t in rows[:900]}
    first = got[(got.doc_id != 7) & (got.doc_id < 900)]
    assert all(r.size == len(byte[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(byte[r.doc_id]) for r in first.itertuples())
    assert sharding.shard_documents(make_docs([]), [1.0]).count() == 0


def test_weights(spark):
    n = spark.range(20_000).select(sharding.rendezvous(sharding.F.col("id"), [1.0, 3.0]).alias("s")).where("s = 1").count()
    assert 0.73 < n / 20_000 < 0.77


# --- decontamination --------------------------------------------------------------------------


def plain_alignment(item, passage):
    best, row = 0.0, [0.0] * (len(passage) + 1)
    for w in item:
        new = [0.0] * (len(passage) + 1)
        for j, p in enumerate(passage, 1):
            new[j] = max(0.0, row[j - 1] + (1 if p == w else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best / len(item)


def test_alignment_equals_plain_smith_waterman():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 25)).astype(np.uint64), r.integers(0, 5, r.integers(1, 40)).astype(np.uint64)
        assert abs(decontamination.align(a, b) - plain_alignment(list(a), list(b))) < 1e-9


@pytest.mark.parametrize("shuffled", [False, True])
def test_leaks(spark, make_docs, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(15, 50))) for _ in range(20)] + ["one two", None, ""]
    noise = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, want = [], set()
    for k in range(20):
        edited = [w if r.random() > 0.1 else "changed" for w in items[k].split()]
        rows += [(k, f"{noise(50)} {' '.join(edited)} {noise(30)}"), (100 + k, noise(120)), (200 + k, f"{noise(20)} {items[k].upper()}.")]
        want |= {k, 200 + k}
    rows += [(300, None), (301, ""), (302, noise(30_000)), (303, f"xx {items[3]}"), (303, f"yy {items[3]}")]
    want |= {303}
    table = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)], "item_id long, text string, score int")
    got = decontamination.contaminated(make_docs(rows).withColumnRenamed("lang", "score"), table).collect()
    assert {x.doc_id for x in got} == want and len(got) == len(want)
    assert all(x.item_id == x.doc_id % 100 for x in got if x.doc_id < 300)
    kept = decontamination.keep_clean(make_docs(rows), table)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - want
    assert decontamination.contaminated(make_docs([]), table).count() == 0
    assert decontamination.contaminated(make_docs(rows), table.limit(0)).count() == 0


CAPITALS = [f"what is the capital city of {x}" for x in ("france", "peru", "kenya", "japan", "chile", "ghana", "nepal")]


def test_templated_items_are_found():
    index = decontamination.Index([(k, decontamination.word_hashes(t)) for k, t in enumerate(CAPITALS)])
    for k, t in enumerate(CAPITALS):
        assert dict(index.matches(f"so we ask {t} and go on"))[k] == 1.0
        # The only words of its own are edited.
        assert dict(index.matches(f"so {t.rsplit(' ', 1)[0]} nowhere"))[k] == 6 / 7
    assert not index.matches("the city is of what capital")


@pytest.mark.parametrize(("text", "item", "leak"), [
    ("Tell me what is the time.", "What is the capital of France?", False),
    ("it was in the house", "in the year of grace", False),
    ("the man who is tall", "Who is he?", False),
    ("They asked: what is the capital of France? Paris.", "What is the capital of France?", True),
    ("and who is he? said one", "Who is he?", True),
    ("What was the capital of France, pray", "What is the capital of France?", False),
])
def test_short_items_need_more_of_their_words(make_docs, spark, text, item, leak):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontamination.keep_clean(make_docs([(1, text)]), items).count() == (0 if leak else 1)


def test_matches_equal_alignment_of_whole_texts():
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(40)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [words(r.randint(1, 30)) for _ in range(40)] + [words(12)[:9] + ["end", str(k)] for k in range(8)]
    items += [[*items[5][:-1], str(k)] for k in range(9)]
    texts = []
    for _ in range(120):
        t = words(r.randint(0, 60))
        for w in r.choice(items):
            t += r.choice([[w], [w], [w], [w], ["x"], [], [w, "y"]])
        texts.append(t + words(r.randint(0, 30)))
    texts += [[w for pair in zip(items[k][::2], items[k][1::2], strict=False) for w in (*pair, "z")] for k in range(40)]
    hashed = [decontamination.word_hashes(" ".join(t)) for t in items]
    index = decontamination.Index(list(enumerate(hashed)))
    for t in texts:
        h = decontamination.word_hashes(" ".join(t))
        scores = [(k, decontamination.align(x, h)) for k, x in enumerate(hashed)]
        assert index.matches(" ".join(t)) == [(k, s) for k, s in scores if s >= decontamination.threshold(len(hashed[k]))]


def test_shuffled_leaks_equal_broadcast(spark, make_docs, monkeypatch):
    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, t) for k, t in enumerate([*CAPITALS, "one two", "zebra", "v1", "a b c", "\u00e9t\u00e9", "", None])]
    items += [(100 + k, " ".join(words(r.randint(3, 25)))) for k in range(30)] + [(100, "quite another text of this id"), (None, "zebra")]
    rows = [(k, f"some words {t} and more of them") for k, t in enumerate(CAPITALS)] + [(k + 50, f"some {t.rsplit(' ', 1)[0]} nowhere") for k, t in enumerate(CAPITALS)]
    rows += [(20, "and one two three"), (21, "a zebra here"), (22, "zebra"), (23, "one, then two"), (24, "quite another text"), (25, None), (26, ""), (None, "l'\u00c9T\u00c9 vient"), (27, "a b x c")]
    for k in range(60):
        text = words(10) + [x for w in r.choice(items[14:44])[1].split() for x in r.choice([[w], [w], ["x"], [w, "y"], []])]
        rows.append((300 + k, " ".join(text)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = lambda: sorted((-1 if x.doc_id is None else x.doc_id, x.item_id, x.score) for x in decontamination.leaks(make_docs(rows), table).collect())
    sent = got()
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert got() == sent
    assert {(k, k, 1.0) for k in range(7)} | {(20, 7, 1.0), (21, 8, 1.0), (22, 8, 1.0), (-1, 11, 1.0)} <= set(sent)


# --- urls -------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?y#z", "http://example.net/de/", "x://y.example.com/de/1", "http://example.com/de", "http://my.org/fr/", "http://org/fr/a", "http://notnet/", "ftp://u@h.net:80/p", "http://a.net?b/c", "http://a://b.org/fr/", "http://x.org/fr/\nnew", "http://\u00c9.net/"] * 2
    df = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for rules in (url_filter.RULES, [*url_filter.RULES, *(("block", f"h{k}.example", "/") for k in range(80))]):
        got = {r.page_id: r for r in url_filter.judged(df, rules).collect()}
        for k, u in enumerate(urls):
            host, path, rule, verdict = plain_rule(u)
            assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
            assert got[k].verdict == verdict or verdict is None
    assert url_filter.judged(df.limit(0)).count() == 0


def test_propagation_equals_plain_iteration(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 1), ("d", "bad", 3), ("e", "d", 1)]
    hosts = sorted({x for e in links for x in e[:2]})
    t, d = {"a": 1.0}, {"bad": 1.0}
    x, y = {h: t.get(h, 0.0) for h in hosts}, {h: d.get(h, 0.0) for h in hosts}
    out = {h: sum(n for s, _, n in links if s == h) for h in hosts}
    back = {h: sum(n for _, e, n in links if e == h) for h in hosts}
    for _ in range(url_filter.ROUNDS):
        x, y = ({h: 0.15 * t.get(h, 0.0) + 0.85 * sum(x[s] * n / out[s] for s, e, n in links if e == h) for h in hosts}, {h: 0.15 * d.get(h, 0.0) + 0.85 * sum(y[e] * n / back[e] for s, e, n in links if s == h) for h in hosts})
    edges = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("bad", 0.0, 1.0)], "host string, t double, d double")
    for r in url_filter.propagate(edges, seeds).collect():
        assert abs(r.trust - x[r.host]) < 1e-5 and abs(r.distrust - y[r.host]) < 1e-5


@pytest.mark.parametrize(("name", "source"), [("op6_url_filter", "pages"), ("op9_neighbours", "embeddings")])
def test_query_equals_sql(spark, sf, name, source):
    con = duckdb.connect()
    con.execute(f"create view {source} as select * from '{sf}/{source}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_links_spread_distrust(spark):
    pages = [(1, "http://bad.net/x", ""), (2, "http://friend.example/1", '<a class="q" href="http://bad.net/x">l</a><A HREF=//bad.net/y>m</A>'), (3, "http://calm.example/", "<a href='/own'>o</a>")]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_propagation_goes_on_to_the_end(spark):
    hosts = ["bad", *(f"h{k}" for k in range(30))]
    edges = spark.createDataFrame([(b, a, 1) for a, b in zip(hosts, hosts[1:], strict=False)], "src string, dst string, n long")
    got = {r.host: r.distrust for r in url_filter.propagate(edges, spark.createDataFrame([("bad", 0.0, 1.0)], "host string, t double, d double")).collect()}
    assert set(got) == set(hosts) and all(abs(got[h] - 0.15 * 0.85**k) < 1e-5 and got[h] > 0 for k, h in enumerate(hosts))


def test_cycles_converge(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, spark.createDataFrame([("a", 1.0, 0.0)], "host string, t double, d double")).collect()}
    assert abs(got["a"][0] - 1 / 1.85) < 1e-5 and abs(got["b"][0] - 0.85 / 1.85) < 1e-5 and got["a"][1] == 0.0


# --- neighbours -------------------------------------------------------------------------------


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 700)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 20)
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 24)).astype(np.float32)
    x[500:900] = x[500]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [float("inf")] * 24), (5200, [None] * 24), (5250, [1.0]), (None, x[1].tolist()), (100, x[100].tolist())]
    df = spark.createDataFrame([(*q, 1) for q in rows + bad], "vec_id long, embedding array<float>, score int")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas()
    v = x.astype(float)
    n = np.linalg.norm(v, axis=1)
    hit = 0
    for q in range(0, 2000, 50):
        cos = (v * v[q]).sum(axis=1) / (n * n[q])
        cos[q] = -2
        top = np.lexsort((np.arange(2000), -np.round(cos, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        assert np.allclose(mine.score, cos[mine.vec_id], atol=1e-12) and (np.diff(mine.score) <= 0).all()
        hit += len(set(mine.vec_id) & set(top))
        if 500 <= q < 900:
            assert mine.vec_id.tolist() == [k for k in range(500, 506) if k != q][:5]
    assert hit / (5 * 40) >= 0.9 and set(got.query_id) == set(range(0, 2000, 50))


def _exact(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        cos = unit @ unit[q]
        cos[q] = -2
        out[q] = set(np.argsort(-cos)[:k].tolist())
    return out


@pytest.mark.parametrize(("depth", "block"), [(12, 250), (1, 250)])
def test_neighbours_of_clusters_meet_few_cells(spark, monkeypatch, depth, block):
    """Recall over several cells, and over cells of several blocks; queries skip the cells far from them."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "MAX_DEPTH", depth)
    visits = []
    whole = neighbours._elsewhere
    monkeypatch.setattr(neighbours, "_elsewhere", lambda *a: visits.append(whole(*a)) or visits[-1])
    r = np.random.default_rng(4)
    x = (r.standard_normal((40, 32))[r.integers(0, 40, 4000)] + 0.05 * r.standard_normal((4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas()
    want = _exact(x.astype(float), range(0, 4000, 50), 5)
    assert len(got) == 400
    assert sum(len(want[q] & set(g.vec_id)) for q, g in got.groupby("query_id")) / 400 >= 0.95
    assert visits[0].count() < 80 * (2 ** min(depth, 4) - 1) / 2


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in neighbours.nearest(df, df.where("vec_id = 0"), 5).collect())
    assert got == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_chi_square():
    assert abs(neighbours.chi2_cdf(15.507) - 0.95) < 1e-3


@pytest.mark.parametrize("tag", ["video src=x", "svg", "audio", "canvas", "object", "select", "title"])
def test_unclosed_elements_keep_the_page(tag):
    found = [b.text for b in html_blocks.blocks(f"<article><p>One.</p><{tag}><p>Two.</p><p>Three.</p></article>")]
    assert found == ["One.", "Two.", "Three."]
    assert [b.text for b in html_blocks.blocks("<p>One.<script>var x;<p>Two.")] == ["One."]


def test_deep_pages_are_read_in_linear_time(model):
    began = time.process_time()
    n = 40_000
    page = "".join(f"<div class=c{k}>t{k}" for k in range(n)) + "</section></i><svg><b>" * n
    found = html_blocks.blocks(page, model.tags, model.marks)
    assert len(found) == n and time.process_time() - began < 20
    assert model.extract(page) is not None and time.process_time() - began < 40


@pytest.mark.parametrize("deep", [0, 1, 63, 64, 65, 5000])
def test_all_ancestors_count(model, deep):
    """A footer and a menu are left out however deep their texts are."""
    nest = lambda text: "<div>" * deep + text + "</div>" * deep
    prose = "The first paragraph of the article is long enough to be told as one, and it ends well. " * 2
    page = f"<nav class=menu>{nest('<a href=/a>Home</a>')}{nest('<a href=/b>News</a>')}</nav><article><h1>Heading</h1><p>{prose}</p><p>{prose}</p></article><footer class=footer>{nest('<p>Copyright 2020, all rights reserved.</p>')}</footer>"
    text = model.extract(page)
    assert "first paragraph" in text and "Copyright" not in text and "Home" not in text
    block = next(b for b in html_blocks.blocks(page) if "Copyright" in b.text)
    assert "footer" in block.around.tags and "footer" in block.around.marks


def test_pages_without_markup_are_their_text(model):
    assert model.extract("plain text with no markup\n at all in it.") == "plain text with no markup at all in it."
    assert model.extract("one &amp; two<br>three") == "one & two three" and model.extract(" \n ") == "" and model.extract("<!-- x -->") == ""


def test_long_pages_are_read_whole(model):
    prose = "Sentences of an article go on and on until the page is long, which it is in the end. "
    page = "<body><article>" + "".join(f"<p>{k} {prose * 20}</p>" for k in range(700)) + "</article></body>"
    assert len(page) > 1_000_000
    text = model.extract(page)
    assert text.count("\n\n") >= 690 and text.endswith("in the end.")


def test_nested_lists_and_cells_end_where_the_next_begins():
    page = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td><p>g<p>h</table><h2>i</h3>j"
    assert [b.text for b in html_blocks.blocks(page)] == list("abcdefghij")


def test_shards_report_every_row(make_docs, tmp_path):
    rows = [(7, "a b c")] * 100 + [(None, "d e"), (-1, "f")]
    docs = make_docs(rows).withColumnRenamed("source", "slot")
    found = token_shards.write_shards(docs, f"file://{tmp_path}/shards").collect()
    ids = [i for r in found for i in r.doc_ids]
    assert ids.count(7) == 100 and ids.count(None) == 1 and ids.count(-1) == 1
    assert not list((tmp_path / "shards").glob("*.part-*"))
    assert sum(r.n_tokens for r in found) >= 102


def test_only_rows_that_hold_an_item_go(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta"
    kinds = "doc_id long, text string, item_id int"
    docs = spark.createDataFrame([(*r, 1) for r in [(None, f"x {item} y"), (None, "clean"), (4, item), (4, "clean too"), (5, None)]], kinds)
    items = spark.createDataFrame([(1, item), (None, "clean too"), (2, None)], "item_id long, text string")
    want = ["None", "clean", "clean too"]
    assert sorted(str(r.text) for r in decontamination.keep_clean(docs, items).collect()) == want
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert sorted(str(r.text) for r in decontamination.keep_clean(docs, items).collect()) == want
    assert decontamination.keep_clean(docs, items).columns == ["doc_id", "text", "item_id"]


def test_sharding_query_equals_a_plain_version(spark, sf):
    import hashlib
    import math
    import zlib
    from collections import defaultdict

    def shard(key, count):
        def score(k):
            bits = int(hashlib.md5(f"{key}|{k}".encode()).hexdigest()[:13], 16)
            return -1 / math.log((bits + 0.5) / 2**52)

        return max(range(count), key=lambda k: (score(k), -k))

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots, moved = defaultdict(list), 0
    for r in sharding.op8_sharding(spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (shard(r.doc_id, 8), shard(r.doc_id, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
        moved += r.grown_shard == 8
    assert 0 < moved < len(texts) / 4 and sum(map(len, slots.values())) == len(texts)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_sharding_of_very_long_texts(make_docs):
    found = {r.doc_id: r.size for r in sharding.shard_documents(make_docs([(1, "ä" * 500_000), (2, None)]), [1.0] * 8).collect()}
    assert found == {1: 1_000_001, 2: 1}
