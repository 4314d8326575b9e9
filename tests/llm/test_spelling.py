"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

from staylens.llm import spelling
from staylens.llm.queries import op13_spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_neighbours(words):
    ws = sorted(words)
    return {(a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if near(a, b)}


def plain_counts(rows, least=7, every=31):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def plain_variants(counts, factor=10):
    pairs, out = plain_neighbours(counts), {}
    for w, n in counts.items():
        around = [b if a == w else a for a, b in pairs if w in (a, b)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        out[w] = best if best and counts[best] >= factor * n else None, len(around)
    rows = set()
    for w, (form, many) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, counts[w], many, counts[form] if form else None))
    return rows


def some_words(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(2, 9))) for _ in range(350)}
    words |= {"a" * k for k in range(2, 12)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "x" * 40 + "y" + "x" * 259,
                                               "y" + "x" * 299, "x" * 299 + "y", "x" * 20_000, "x" * 9_000 + "é" + "x" * 11_000, "x" * 10_999 + "z" + "x" * 9_000}
    return sorted(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours(spark, seed):
    words = some_words(seed)
    got = [tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).select("a", "b").collect()]
    short = [w for w in words if len(w) < 1000]
    long = {("x" * 20_000, "x" * 10_999 + "z" + "x" * 9_000), ("x" * 20_000, "x" * 9_000 + "é" + "x" * 11_000)}
    assert len(got) == len(set(got))
    assert set(got) == plain_neighbours(short) | long


def test_common_beginning(spark):
    """A third of all words begin alike and differ in one place only."""
    rng = random.Random(4)
    words = sorted({"commonbeginning" + rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefgh") for _ in range(150)} | {"w" + str(i).translate({48 + k: 97 + k for k in range(10)}) for i in range(300)})
    got = {tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).select("a", "b").collect()}
    assert got == plain_neighbours(words)


def test_variants_follow_forms(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 2001, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "lonelyword": 3}
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(counts)
    assert ("aaaaaaa", "aaaaaab", "aaaabbb", 2, 1, 20) in got


def test_query(spark, tmp_path):
    rng = random.Random(8)
    stock = [w.upper() if rng.random() < 0.2 else w for w in ("kitchenette riverside mountains apartment balconies generously übersicht straßenbahn café×haus naïveté".split())]
    rows = [(None, None), (None, ""), (7, None), (None, " ".join(stock)), (None, " ".join(stock))]
    rows += [(i % 90, "\n".join(rng.choice(stock) + rng.choice([",", ".", "1", "漢", "'s"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, "riverside " * 3000), (501, "q" * 5000), (502, "q" * 5000)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    counts = {w: n for w, n in plain_counts(rows).items() if n >= 2}
    assert len(got) == len(set(got)) and set(got) == plain_variants(counts)
    assert any(r[1] for r in got)


def test_empty_tables(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).collect() == []
