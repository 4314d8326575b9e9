"""Suffix dedup, decontamination and packing against plain loops and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from staylens.llm import decontam, packing, suffix_dedup

SCHEMA = "doc_id long, text string, kept string, start long, trigger string"
FILE = tokenizer_path("word_bpe_49k.json")


def rows_of(pairs):
    return [(i, t, "x", 1, "z") for i, t in pairs]


def plain_dedup(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for (i, _), t in zip(docs, raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), "x", 1, "z"))
    return sorted(out, key=str)


def passages(seed, n=40):
    rng = random.Random(seed)
    words = [a + b for a in "bad cej dü fog".split() for b in "ner rt säm lmo".split()]
    shared = [" ".join(rng.choice(words) for _ in range(k)) for k in (20, 45, 60, 90)]
    docs = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(3)]
        docs.append((len(docs), (" " + rng.choice(shared) + " ").join(parts)))
    docs += [(100, docs[1][1]), (101, docs[1][1][:-30]), (102, None), (103, ""), (104, "a" * 700), (105, "ab" * 300), (106, "a" * 199), (107, "xy" * 100)]
    return docs + [docs[2], (2, docs[3][1] + "!"), (None, docs[4][1]), (None, "short")]


@pytest.mark.parametrize("length, gram, shard", [(200, 64, 10_000), (200, 64, 1), (80, 32, 2), (200, 16, 3)])
def test_dedup(spark, length, gram, shard):
    docs = passages(length + shard)
    got = suffix_dedup.dedup(spark.createDataFrame(rows_of(docs), SCHEMA), length, gram, shard)
    assert set(got.columns) == {"doc_id", "start", "trigger", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], "x", r["start"], r["trigger"]) for r in got.collect()), key=str)
    assert found == plain_dedup(docs, length)


def test_dedup_long_text_in_chunks(spark, monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    text = text + text[1000:1400] + text[:300]
    whole = suffix_dedup.parse(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    parts = suffix_dedup.parse(np.frombuffer(text, np.uint8))
    assert whole[3].sum() == parts[3].sum() == len(text) - 199
    trigger_of = lambda p: np.repeat(p[0], p[3]).tolist()
    assert trigger_of(whole) == trigger_of(parts)


def test_window_ranks():
    data = np.frombuffer(b"banana bandana banana bandana!" * 4, np.uint8)
    rank = suffix_dedup.window_ranks(data, 20)
    cut = [bytes(data[i:i + 20]) for i in range(len(data) - 19)]
    order = sorted(set(cut))
    assert np.argsort(np.argsort([order.index(c) for c in cut], kind="stable")).tolist() == np.argsort(np.argsort(rank[:len(cut)], kind="stable")).tolist()
    assert all((cut[i] == cut[j]) == (rank[i] == rank[j]) for i in range(len(cut)) for j in range(0, len(cut), 7))


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if not c.isascii() or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_decontam(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            grams.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k:k + n])] - {None}
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def decontam_case():
    rng = random.Random(2)
    words = "Alpha beta GAMMA déjà the of and 42 zeta".split()
    say = lambda n: rng.choice([", ", " ", "\n", "-"]).join(rng.choice(words) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (3, "only four words, here"), (4, None), (5, "..."), (6, ""), (None, say(11))]
    items += [items[0], (7, items[1][1]), (7, "another text of the same id")]
    docs = [(i, say(20) + " " + rng.choice([t or "" for _, t in items]) + " " + say(9)) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "ONLY four (words) here only four words here"), (53, "only four"), docs[0], (None, items[0][1]), (54, " the " * 4000 + items[1][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes, segment", [(32_000_000, 4_000_000), (100, 300)])
def test_decontaminate(spark, monkeypatch, block_bytes, segment):
    docs, items = decontam_case()
    build = decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda d, t: build(d, t, segment))
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, spans string, term string")
    got = decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in got), key=str) == plain_decontam(docs, items)


def test_proximity_and_full_index(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue z z z z red green"), (3, "red green"), (4, "blue")], "doc_id long, text string")
    index = decontam.build_index(docs)
    assert {bytes(r["term"]) for r in index.filter("term IS NOT NULL").collect()} == {b"red", b"green", b"blue", b"x", b"y", b"z"}
    got = decontam.search(index, {(b"red", b"green", b"blue"): [9], (b"red", b"green"): [8]}, slop=2).collect()
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in got} == {1: ([], [8, 9]), 2: ([8], [8]), 3: ([8], [8]), 4: ([], [])}


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(none, items).count() == 0
    assert [r["n_hit"] for r in decontam.decontaminate(some, items).collect()] == [0]


TEXTS = ["", "Plain words, don't they're!", "Ünïcode straße ÀÉÎ Ÿ ß", "tabs\tand\nlines\r\n\v\f", "numbers 12345 x9 $$$ ... !!!", "漢字 and emoji 😀 mixed",
         "é combining", "<|endoftext|> inside", "no break", "\u001c odd control", "'s 'S it's", "a" * 3000, "word " * 5000, "ªº µ ÷×", "İstanbul ﬁ"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_equals_tokenizer(text):
    with open(FILE, encoding="utf-8") as f:
        enc = packing.Encoder(f.read())
    want = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 2)
    with open(FILE, encoding="utf-8") as f:
        enc = packing.Encoder(f.read())
    t = Tokenizer.from_file(FILE)
    for text in ("one two three", "four five six", "one five nine"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity, classes, parts", [(2048, 64, 3), (64, 8, 1), (2048, 64, 1)])
def test_pack_round_trip(spark, capacity, classes, parts):
    rng = random.Random(capacity)
    docs = list(enumerate(TEXTS)) + [(100 + i, "tok " * rng.randrange(0, 900)) for i in range(60)] + [(500, None), (None, "no id"), (3, "same id")]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, offset long, length string").repartition(parts)
    got = packing.pack(frame, FILE, capacity=capacity, classes=classes, with_ids=True).collect()
    t = Tokenizer.from_file(FILE)
    want = sorted((t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in docs if i not in (3, None)))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] not in (3, None):
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
    whole = []
    for pieces in by_doc.values():
        ids = []
        for start, part, total in sorted(pieces):
            assert start == len(ids)
            ids += part
        assert total == len(ids)
        whole.append(ids)
    assert sorted(whole) == want
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0  # no padding at all


def test_pack_harmonic_counts():
    p = packing.Packer(100, 10)
    closed = {}
    for doc in range(400):
        n = random.Random(doc).randrange(1, 101)
        for d, start, ids, total, seq, at in p.add(doc, bytes(4 * n)):
            closed.setdefault(seq, []).append(len(ids) // 4)
    for d, start, ids, total, seq, at in p.finish():
        closed.setdefault(seq, []).append(len(ids) // 4)
    assert all(sum(v) == 100 for v in list(closed.values())[:150])


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_dedup_tells_rows_without_ids_apart(spark):
    """Thousands of rows without an id, and one id with many texts: unique texts stay whole, repeats go, nothing fails."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz "
    own = ["".join(rng.choices(letters, k=rng.randint(200, 260))) for _ in range(5000)]
    shared = "".join(rng.choices(letters, k=250))
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(own)] + [(None, shared), (7, shared + own[0][:50]), (None, own[1])]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "kept").collect()
    assert len(got) == len(rows)
    left = sorted(((r.doc_id is None, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got))
    want = [(i is None, len(t), 0, t.encode()) for i, t in rows[:5000] if t != own[1]]
    want += [(True, 250, 250, b""), (False, 300, 250, own[0][:50].encode())] + [(True, len(own[1]), len(own[1]), b"")] * 2
    assert left == sorted(want)


@pytest.mark.parametrize("extra", [False, True])
def test_dedup_exchanges_texts_once(spark, tmp_path, extra):
    """With and without other columns, the joins of phrases and of spans with texts share one exchange of the documents."""
    docs = passages(9)
    spark.createDataFrame(rows_of(docs), SCHEMA).select("doc_id", "text", *(["start", "trigger"] if extra else [])).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffix_dedup.dedup(spark.read.parquet(str(tmp_path / "docs")))
        found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], "x", 1, "z") for r in got.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == plain_dedup(docs, 200)
    plan = got._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
