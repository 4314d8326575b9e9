"""SimHash, components and order MinHash against plain loops."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from staylens.llm import common, order_minhash, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string, node string"
WORDS = [a + b for a in "ba ce di fo gu".split() for b in "n rt s lm x".split()]


def rows_of(pairs):
    """Extra columns have the names that the operators use themselves."""
    return [(i, t, "x", "y", "z") for i, t in pairs]


def texts(n, seed=1):
    rng, out = random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 120))))
    return out


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for chunk in words for w in chunk.replace("\t", "\n").replace("\r", "\n").replace("\v", "\n").replace("\f", "\n").split("\n") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one two three", "A b\tC\vd e  f É  x", "la " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def plain_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    docs = list(enumerate(texts(150))) + [(900, None), (901, ""), (902, " "), (5, texts(150)[5]), (None, "lone words here now"), (None, texts(150)[7])]
    got = simhash.near_duplicates(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()
    comp = plain_components([plain_fingerprint(t) for _, t in docs])
    low = {}
    for (i, _), c in zip(docs, comp):
        low[c] = i if low.get(c) is None else low[c] if i is None else min(low[c], i)
    want = sorted(((i, plain_fingerprint(t), low[c]) for (i, t), c in zip(docs, comp)), key=str)
    assert sorted(((r[0], r[1] % 2 ** 64, r[2]) for r in got), key=str) == want
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()
    assert sorted([r["doc_id"] for r in kept], key=str) == sorted(set(low.values()), key=str)


def test_rows_without_an_id_and_shared_ids_stay_apart(spark):
    rng = random.Random(8)
    alone = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(6)]
    docs = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (None, alone[2]), (7, alone[3]), (7, alone[4]), (None, alone[3]), (9, alone[3]), (9, alone[5])]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()
    want = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (7, alone[3]), (7, alone[4]), (9, alone[5])]
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted(want, key=str)


def test_benchmark_stage_drops_rows_not_ids(spark, tmp_path):
    leak = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, leak), (None, "clean words"), (None, None), (3, "so " + leak), (3, "also clean")]
    kept = corpus_pipeline.benchmark_passages(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([docs[1], docs[2], docs[4]], key=str)


def plain_similarity(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(WORDS) + "q"
    return " ".join(out)


def test_candidates_against_brute_force():
    rng, found, all_pairs = random.Random(11), 0, 0
    for _ in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(60, 400))]
        other = edited(words, rng.randrange(0, len(words) // 30), rng)
        if 0.8 <= plain_similarity(" ".join(words), other) < 0.95:
            a, b = (simhash.minima(simhash.shingle_set(t.encode())) for t in (" ".join(words), other))
            unlike = (a.astype(np.uint8) != b.astype(np.uint8)).sum()
            all_pairs, found = all_pairs + 1, found + bool((simhash.band_keys(a) == simhash.band_keys(b)).any() and unlike <= simhash.most_unlike(0.8))
    assert all_pairs > 100 and found / all_pairs > 0.99


def test_sketches_count_unlike_minima(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, (40, 256)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < 0.4, a, a ^ rng.integers(0, 1 << 63, a.shape).astype(np.uint64))
    rows = [(simhash.sketch(x).tolist(), simhash.sketch(y).tolist()) for x, y in zip(a, b)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<long>, y array<long>").select(simhash._unlike("x", "y")).collect()]
    assert got == (a.astype(np.uint8) != b.astype(np.uint8)).sum(axis=1).tolist()


def test_stage_keeps_one_of_texts_at_four_fifths(spark):
    rng, docs = random.Random(12), []
    for _ in range(25):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(80, 300))]
        docs += [" ".join(words).upper()] + [edited(words, rng.randrange(0, len(words) // 18), rng) for _ in range(5)]
    docs += ["", " ", None, "one two", "One  two", "one two three"]
    root = list(range(len(docs)))
    for i, j in ((i, j) for i in range(len(docs)) for j in range(i)):
        if root[i] != root[j] and plain_similarity(docs[i] or "", docs[j] or "") >= 0.8:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    kept = simhash.keep_one_of_similar(spark.createDataFrame(rows_of(enumerate(docs)), SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    assert 25 < len(kept) < 100


def test_sketches_hold_one_shingle_set_at_a_time(monkeypatch):
    held, most, whole = [0], [0], simhash.shingle_set

    class Counted(np.ndarray):
        def __del__(self):
            held[0] -= 1

    def counted(text):
        held[0] += 1
        most[0] = max(most[0], held[0])
        return np.ndarray.__new__(Counted, 3)

    monkeypatch.setattr(simhash, "shingle_set", counted)
    monkeypatch.setattr(simhash, "minima", lambda s: np.zeros(256, np.uint64))
    simhash.sketches(pd.Series([b"a b c"] * 50))
    assert most[0] <= 2
    monkeypatch.undo()
    texts = [b"one two three four five six", b"", None, b"One"]
    got = simhash.sketches(pd.Series(texts))
    for text, (n, keys, sketch) in zip(texts, got.itertuples(index=False)):
        least = simhash.minima(whole(text))
        assert n == len(whole(text)) and (keys == simhash.band_keys(least)).all() and (sketch == simhash.sketch(least)).all()


def test_stored_bounds_the_rows_in_a_worker(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    rows = spark.range(0, 2500, 1, 1)
    assert max(r["n"] for r in common.stored(rows.mapInPandas(sizes, "n long"), "sizes", 1000).collect()) == 1000
    assert spark.conf.get(key) == before
    docs = spark.createDataFrame(rows_of(enumerate(["one two three"] * 3)), SCHEMA)
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "stored", lambda df, name, batch=None: seen.append((name, batch)) or common.stored(df, name, batch))
        simhash.keep_one_of_similar(docs).count()
    assert {n for n, b in seen if b} == {"similar-rows", "similar-sets"}


@pytest.mark.parametrize("settings", [(4, 5), (4, 7), (2, 4), (0, 1)])
def test_dense_groups_and_chains(spark, settings):
    distance, blocks = settings
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(60)} | {0, 2 ** 64 - 1}
    signed = [x - 2 ** 64 if x >> 63 else x for x in sorted(fps)]
    got = dict(simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, blocks).collect())
    comp = plain_components([x % 2 ** 64 for x in signed], distance)
    least = {}
    for x, c in zip(signed, comp):
        least[c] = min(x, least.get(c, x))
    assert got == {x: least[c] for x, c in zip(signed, comp)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_per_group(empty).count() == 0
    assert order_minhash.fingerprint_neighbours(empty).count() == 0


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (2000, 1999), (1999, 2000)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}, 1999: 1999, 2000: 1999}


def whole_hash_order_minhash(text, k=8, slots=64, size=2):
    """By lists, with places on the ring from the whole 64-bit hash and the occurrence number alone."""
    m = 2 ** 64

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m
        return x ^ (x >> 31)
    mult, k = int(order_minhash._MULT), min(k, len(text))
    h, seen, ring, out = [], {}, [], []
    for i in range(len(text) - k + 1):
        x = 0
        for c in text[i:i + k]:
            x = (x * mult + mix(ord(c) + 1)) % m
        h.append(mix((x + k) % m))
    for p, x in enumerate(h):
        seen[x] = seen.get(x, -1) + 1
        ring.append((mix((x + seen[x] * mult) % m), p))
    ring.sort()
    for s in range(slots):
        start = next((i for i, (v, _) in enumerate(ring) if v >= s * (m // slots)), 0)
        x = 0
        for p in sorted(ring[(start + j) % len(ring)][1] for j in range(min(size, len(ring)))):
            x = mix((x * mult + h[p]) % m)
        out.append(x >> 32)
    return out


@pytest.mark.parametrize("text", ["a", "abcdefghi", "aaaaaaaaaaaaaaaaaaaa", "the cat and the cat and the dog saw " * 3, "é漢字 mixed ✓ text with marks", "la le lu " * 400])
def test_order_minhash_by_whole_hashes(text):
    assert order_minhash.fingerprint(text).tolist() == whole_hash_order_minhash(text)


@pytest.mark.parametrize("grams", [1015, 2040, 4090, 2000])
def test_near_copies_across_a_power_of_two(grams):
    rng, like = random.Random(grams), []
    for _ in range(10):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(grams + 27))
        a, b = (order_minhash.fingerprint(text[:n + 7]) for n in (grams, grams + 20))
        like.append(order_minhash.likeness(a, b))
    assert sum(like) / len(like) > 0.9


def test_order_matters():
    words = [w + str(i) for i, w in enumerate(WORDS * 8)]
    a, moved = " ".join(words), " ".join(words[100:] + words[:100])
    shuffled = " ".join(random.Random(1).sample(words, len(words)))
    f = order_minhash.fingerprint
    assert order_minhash.likeness(f(a), f(a + " tail")) > 0.85
    assert order_minhash.likeness(f(a), f(moved)) > order_minhash.likeness(f(a), f(shuffled))
    assert f("").tolist() == f(None).tolist() == [0] * 64


@pytest.mark.parametrize("ids", [list(range(40)), [0], [5, 5, 5, 9], [None, None, 3, 1, None], [10 ** 15, -4, 7, 2 ** 62]])
def test_neighbours(spark, ids):
    docs = list(zip(ids, texts(len(ids), 4)))
    if len(ids) > 20:
        docs[3] = (3, None)
    got = order_minhash.fingerprint_neighbours(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()
    h = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t)").collect()}
    ordered = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1] or ""], r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        f = [order_minhash.fingerprint(x) for x in (t, e, n)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0].astype(">u4").tobytes().hex(), f[1].astype(">u4").tobytes().hex(),
                     order_minhash.likeness(f[0], f[1]), order_minhash.likeness(f[0], f[2])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    plans, components = [], simhash.components

    def seen(edges, name):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, name)
    monkeypatch.setattr(simhash, "components", seen)
    fps = common.stored(spark.createDataFrame([(i, i ^ 1 if i % 3 else i << 20) for i in range(200)], "low long, fp long"), "given")
    got = {r.fp: r.root for r in simhash.link_fingerprints(fps.groupBy("fp").agg({"low": "min"})).collect()}
    assert len(got) == fps.select("fp").distinct().count()
    assert [p.count("SortMergeJoin") for p in plans] == [1, 3] and not any("Broadcast" in p for p in plans)
