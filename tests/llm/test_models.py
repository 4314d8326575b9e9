"""Extraction, URL filter and the classifiers: exact parts against plain loops, learned parts by held-out accuracy."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import TABLES, rows_of
from staylens.llm import common, html_extract, langid, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")


# ---- HTML

@pytest.fixture(scope="module")
def trees():
    pages = list(html_extract._grammar_examples(500))
    return html_extract.Trees().fit(np.vstack([html_extract.features(p, hide=i % 4 == 3) for i, (p, _) in enumerate(pages)]), np.concatenate([y for _, y in pages]))


def test_tree_of_broken_html():
    page = html_extract.Page("<DIV class='a B'><p>one<p>two <b>bold<br>x</p> tail</div><ul><li>a<li>b<ul><li>c</ul></ul><script>var a='</p>'</script>&lt;end &amp")
    assert page.tag == ["#page", "div", "p", "p", "ul", "li", "li", "ul", "li"]
    assert page.parent == [-1, 0, 1, 1, 0, 4, 4, 6, 7]
    assert html_extract.blocks(page, np.ones(9, bool)) == "one\n\ntwo bold x\n\ntail\n\na\n\nb\n\nc\n\n<end &"


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>T</title><body><p>one</p>two</body></html>", "one\n\ntwo"),
    ("<html><head><meta charset=x><title>T</title><noscript><p>no</p></noscript><style>s</style><div>one</div></html>", "one"),
    ("<html><head><template><div>no</div></template><title>T</title></head><body>one</body></html>", "one"),
    ("<body><div><button>no</div><p>one</p><div><select><option>no</div><p>two</p></body>", "one\n\ntwo")])
def test_page_text_after_unclosed_elements(source, want):
    page = html_extract.Page(source)
    assert html_extract.blocks(page, np.ones(len(page.tag), bool)) == want


@pytest.mark.parametrize("source", [None, "", "plain text only", "<", "<p", "<!-- never closed", "<script>x", "<p>" * 3000, "</p></div>", "<a href='x>y'>t</a>", "\x00<p>\x00"])
def test_odd_pages(trees, source):
    assert isinstance(html_extract.extract_texts([source], trees)[0], str)


def test_decode_by_enumeration():
    parent = [-1, 0, 0, 1, 1, 2, 5]
    rng = np.random.default_rng(1)
    for _ in range(50):
        odds, weight = rng.normal(size=7), rng.random(7)
        best = max((sum(odds[i] * weight[i] for i in range(1, 7) if m >> i & 1), m) for m in range(1, 128, 2)
                   if all(m >> parent[i] & 1 for i in range(1, 7) if m >> i & 1))
        kept = html_extract.decode(parent, odds, weight)
        assert sum(int(k) << i for i, k in enumerate(kept)) == best[1]


def test_article_of_a_new_layout(trees):
    box = "<div class='sidebar'><h3>More</h3><ul><li><a href=x>one link</a></li><li><a href=x>other link</a></li></ul></div>"
    article = "<div class='entry-content'><h1>The title of it</h1><p>First words, and then more of them.</p><p>Second part &amp; its\n  end of the text.</p></div>"
    comments = "<div id='comments'><div class='comment'><p>I disagree with all of this, sorry.</p></div></div>"
    source = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='wrap'>{article}{box}{comments}</div><footer>c 2020</footer></body></html>"
    assert html_extract.extract_texts([source], trees) == ["The title of it\n\nFirst words, and then more of them.\n\nSecond part & its end of the text."]


def test_grammar_pages_held_out(trees):
    wrong = total = 0
    for page, y in html_extract._grammar_examples(150, seed=77):
        kept = html_extract.decode(page.parent, trees.log_odds(html_extract.features(page)), html_extract._weights(page))
        size = np.zeros(len(y))
        for node, _, text in page.pieces:
            size[node] += len(text.strip())
        total, wrong = total + size.sum(), wrong + size[kept != (y > 0)].sum()
    assert wrong < 0.02 * total


def test_extract_frame(spark, trees):
    rows = [(1, "u", "<article><p>Hello there, reader of pages.</p></article>", "old"), (1, None, None, "old"), (None, "u", "", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert [(r["page_id"], r["n_chars"]) for r in got.collect()] == [(1, 29), (1, 0), (None, 0)]
    empty = spark.createDataFrame([], "page_id long, html string")
    assert html_extract.extract(empty, html_extract.fit(empty, grammar_pages=60)).count() == 0


# ---- URLs

def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:k], rest[k:]
        j = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
        host, path = "".join(c.lower() if c.isascii() else c for c in host), tail[:j]
    fits = [r for r, _ in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "abc", "http://", "://x", "HTTP://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com", "http://x.net/fr/", "http://net/es/a", "http://mynet/es/",
        "http://notexample.com/en/", "http://a.b?x=/en/", "http://a.b#://c/d", "ftp://u:p@h.com:80/a/../b", "http://É.com/é\nline/x?q", "http://a.example.com/EN/", "x://y://z.com/"]


def test_judge(spark):
    frame = spark.createDataFrame([(i, u, "z", "w") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string")
    got = url_filter.judge(frame, url_filter.fit(frame)).collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [plain_judge(u) for u in URLS + URLS[:3]]
    says = dict(url_filter.RULES)
    assert all(r["verdict"] == says[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in got)
    assert url_filter.judge(frame.limit(0), url_filter.fit(frame.limit(0))).count() == 0


def test_segment():
    costs = {"free": 2.0, "bets": 2.0, "freeb": 3.0, "ets": 5.0}
    assert url_filter.segment("freebets", costs, 9.0) == ["free", "bets"]
    assert url_filter.segment("xyfreeq", costs, 9.0) == ["xy", "free", "q"]
    assert url_filter.segment("", costs, 9.0) == []


def test_learned_words(spark):
    rows = [f"http://casino-luck{i}.example.org/win/a" for i in range(30)] + [f"http://news{i}.example.org/story/a" for i in range(200)]
    model = url_filter.fit(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"))
    assert model.block_probability("bestcasino.example.org", "/x") > 0.5 > model.block_probability("news7.example.org", "/story/b")
    assert model.host_words("casinoluck.example.org")[0] == "casino"


# ---- language

def test_language_edge_cases(spark):
    rows = [(1, "der die das und nicht", "de", 0), (2, "the and of with from", "en", 0), (3, None, "en", 0), (4, "12 ... !", "de", 0), (5, "the the of", None, 0), (2, "the and of with from", "en", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[1][0] == "de" and got[2][0] == got[5][0] == "en" and got[3] == got[4] == ("und", 0.0)
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"} and langid.predict(docs.limit(0), model).count() == 0


def test_backoff_by_hand():
    model = langid.Model(["a", "b"], {"wort": 0}, np.array([[1.0, 2.0]]), {" x": 0, "x": 1, "y ": 2}, np.array([[1.0, 0], [3.0, 0], [5.0, 0], [9.0, 9.0]]), 3)
    assert model.backoff("xzy") == [0, 1, 3, 2]
    assert model.word_scores(["wort", "xzy"]).tolist() == [[1.0, 2.0], [18 / 4, 9 / 4]]


@needs_data
def test_language_held_out(spark):
    got = queries.op8_language(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


# ---- toxicity and quality

def test_sentences():
    words, spans = toxicity.sentences("One two. Three!\nFour")
    assert words == [["one", "two"], ["three"], ["four"]] and spans == [(0, 8), (9, 16), (16, 20)]
    assert toxicity.sentences(None) == toxicity.sentences("...") == ([], [])


def test_noisy_or():
    model = toxicity.Model({b: 1.5 for b in toxicity.buckets("bad")[:1]}, -1.0)
    p = 1 / (1 + np.exp(-0.5)), 1 / (1 + np.exp(1.0))
    score, where = model.score("A bad bad thing. Fine.")
    assert score == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))
    assert [(a, b) for a, b, _ in where] == [(0, 16)]
    assert model.score(None) == model.score("") == (0.0, [])


def labelled(spark):
    rng = np.random.default_rng(4)
    words = [a + b for a in ("ba", "ce", "di", "fo") for b in ("n", "r", "s", "l")]
    docs, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choice(words, 8)) for _ in range(4)]
        if i % 3 == 0:
            parts[int(rng.integers(4))] += " vile" + str(rng.choice(words))
        docs.append((i, ". ".join(parts) + ".", "x"))
        labels.append((i, 1, i % 3 == 0))
    docs += [(1000, None, "x"), (1001, "", "x"), (0, docs[0][1], "x"), (None, "no id", "x")]
    labels += [labels[0], (None, 1, True), (5000, 0, True), (1000, None, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int"))


def test_toxic_sentences_are_found(spark):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 404
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    for r in held:
        if r["predicted"]:
            assert any("vile" in r["text"][o["start"]:o["end"]] for o in r["offending"])
    one = labels.withColumn("toxic", F.lit(0))
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_training_rows_are_the_right_ones(spark):
    docs, labels = labelled(spark)
    got = common.labelled_sample(docs, labels, "toxic", 5, 0, 10_000).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert common.labelled_sample(docs, labels, "toxic", 5, 0, 7).count() == 7


def test_contexts_by_loops():
    places = quality.index_places(16, 8)
    v = np.zeros((16, 8), int)
    for i, p in enumerate(places):
        v[i, p] = [1, 1, -1, -1]
    ids = np.array([3, 5, 3, -1, -1, 7, 3])
    sums = np.zeros((16, 8), np.int64)
    quality._contexts(ids, places, sums)
    want = np.zeros_like(sums)
    for i, x in enumerate(ids):
        for j in range(max(0, i - 2), min(len(ids), i + 3)):
            if x >= 0 and ids[j] >= 0 and i != j:
                want[x] += v[ids[j]]
    assert (sums == want).all() and (np.abs(v).sum(axis=1) == 4).all()


def test_quality_edge_cases(spark):
    docs, labels = labelled(spark)
    labels = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    noisy = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" $$$ ### !!!"))).otherwise(F.col("text")))
    got = quality.score(noisy, quality.fit(noisy, labels)).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == (r["doc_id"] % 2 == 0) for r in held]) > 0.95
    none = quality.score(noisy, quality.fit(noisy, labels.limit(0))).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5] and quality.score(noisy.limit(0), quality.fit(noisy.limit(0), labels)).count() == 0


@needs_data
def test_quality_held_out(spark):
    got = queries.op7_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


# ---- registered queries and the pipeline

@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df, cur = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_over_all_rows(spark, name):
    table = "pages" if name.startswith(("op1_", "op2_")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = queries.QUERIES[name](spark, SF).select(key).distinct().count()
    assert got == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, SF), name)
        assert now.columns == columns and 0 < now.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == now.count()


def test_pipeline_on_hard_rows(spark, tmp_path):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    tails = ["".join(f" {x}{chr(97 + i % 26)}{chr(99 + i // 26)}" for i in range(90)) for x in ("tail", "other")]
    rows = [(1, words + tails[0], "en"), (2, words + tails[1], "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (None, "a text of its own without id", "en"),
            (6, "an exact copy that is here twice", "en"), (7, "an exact copy that is here twice", "en"), (6, "an exact copy that is here twice", "en"), (8, "start secret test item words end", "en")]
    own = ("extra", "own", "old", "mine")
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), *own) for i, t, g in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, kept string, n_removed string")
    spark.createDataFrame([(1, "Secret test item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, str(tmp_path)), name)
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(got) == {1, 2, None, 6} and now.columns == docs.columns
    assert {tuple(r)[5:] for r in now.collect()} == {own} and all(r["n_chars"] == len(r["text"]) for r in now.collect())
    assert "wordaa" not in got[1] and got[1].endswith(tails[0][-40:]) and got[6] == rows[6][1]
    assert corpus_pipeline.pack(spark, now, str(tmp_path)).select("doc_id").distinct().count() == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_toxicity_words_and_hashes_as_by_single_matches():
    import random
    import re
    import zlib

    from staylens.llm import toxicity as T
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aB cİΣσςé_.!?\n'-\u03079 Ǆ.. ") for _ in range(rng.randrange(30)))
        words, spans, current = [], [], []
        for m in re.finditer(r"[^\W_]+|[.!?\n]+", text):
            if m[0][0] in ".!?\n":
                if current:
                    words.append(current)
                    spans.append((start, m.end()))
                    current = []
            else:
                start = start if current else m.start()
                current.append(m[0].lower())
        if current:
            words.append(current)
            spans.append((start, len(text)))
        assert T.sentences(text) == (words, spans)
    for w in ("é", "ñandú", "日本語テキスト長い", "abc", "abcd", "abcdefghij", "straße"):
        assert T.buckets(w) == [zlib.crc32(x.encode()) % T.BUCKETS for x in ("=" + w, *("^" + w[:n] for n in T.STEMS if n < len(w)))]


def test_toxicity_looks_at_a_word_by_one_hash_of_its_letters(monkeypatch):
    from staylens.llm import toxicity as T
    seen = []
    monkeypatch.setattr(T, "crc32", lambda raw, start: seen.append(len(raw)) or 0)
    T.buckets("extraordinarily")
    assert sum(seen) == 15 + 7  # the whole word, and its first seven letters once
