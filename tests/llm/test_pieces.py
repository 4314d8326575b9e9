"""Encoding and decoding against the library, on hard texts, on a document table and on odd tables."""

import hashlib
import random

import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path

from staylens.llm import piece_prefix
from staylens.llm.queries import op12_piece_prefix

MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", "▁", "▁▁ a▁", "<s></s><0x41><unk>", "⁇ ⁇", "﻿x", "é", "\U0001F468‍\U0001F469", "\x00a\x00", "\r\n x",
       " " * 1000, "a" * 1000, "ab" * 700, "漢字" * 300, "x" * 20_000, "   \t", "Ünïcödé Straße ÿÿÿ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(text, library):
    own = piece_prefix.codec(MODEL)
    ids = library.encode(text) + [library.eos_id()]
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)
    raw, decoded = own.encode_raw(text)
    assert decoded.decode() == library.decode(ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, library):
    same(text, library)


def test_random_texts(library):
    rnd = random.Random(5)
    own = piece_prefix.codec(MODEL)
    letters = "aaabcdeé ▁ \n\t漢字🎉\x00ñ  12.,'xtheandin"
    for _ in range(2000):
        same("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))), library)
        same("".join(rnd.choice(own.symbols) for _ in range(rnd.randint(1, 6))), library)
        same("".join(chr(rnd.choice([rnd.randint(1, 0x250), rnd.randint(0x3000, 0x9FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(20)), library)


def test_decode_of_any_ids(library):
    rnd = random.Random(6)
    own = piece_prefix.codec(MODEL)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(0, 31_999), rnd.randint(3, 258), 2]) for _ in range(rnd.randint(0, 12))]
        ids = [i for i in ids if i != own.unknown]
        assert own.decode(ids) == library.decode(ids), ids


def test_pair_test_is_merging():
    own, rnd = piece_prefix.codec(MODEL), random.Random(7)
    for _ in range(20_000):
        a, b = rnd.randrange(len(own.symbols)), rnd.randrange(len(own.symbols))
        x, y = own.symbols[a], own.symbols[b]
        assert own.compatible(a, b) == (own.merge(x + y) == [x, y]), (x, y)


def test_cache_forgets(library):
    own = piece_prefix._Cache(lambda k: k.upper(), 3, 4)
    assert [own[k] for k in ["a", "b", "a", "c", "d", "longer", "a", "e", "f", "g"]] == ["A", "B", "A", "C", "D", "LONGER", "A", "E", "F", "G"]
    assert len(own) <= 3 and len(own.old) <= 3 and "longer" not in own


def test_documents(spark, library, tmp_path):
    rows = [(None, None), (1, ""), (1, "x y"), (1, "x y"), (2, None), (3, " " * 3000 + "end"), *[(10 + i, t) for i, t in enumerate(ODD)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_piece_prefix(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 5, True)], "doc_id int, text string, decoded string, `row` int, `x.y` boolean")
    out = piece_prefix.encode(docs, MODEL)
    assert out.columns == ["doc_id", "row", "x.y", "ids", "decoded"]
    assert out.first().decoded == "a b"
    assert [tuple(r) for r in piece_prefix.decode(out.select("doc_id", "ids"), MODEL).select("doc_id", "decoded").collect()] == [(1, "a b")]
    assert piece_prefix.encode(docs.filter("false"), MODEL).collect() == []
