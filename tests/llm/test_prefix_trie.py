"""The conversation trie against plain loops, with blocks, levels and shards of a few rows and of the usual size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from staylens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, `p1` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def some_turns(seed, convs=150, deep=90):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), convs):
        start = rng.choice(["hello", "grüße", "", None])
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", start if t == 0 else rng.choice(["yes", "no", "é漢", None])))
    for c in (1000, 1001, 1003, 1007, 1015):  # long copies, some with another end
        rows += [(c, t, "user", f"line {t}" if t < deep - c % 5 else f"own {c}") for t in range(deep)]
    rows += [(None, 1, "user", "nobody's"), (2000, None, "user", "first"), (2000, 0, "user", "second"), (2000, 0, "user", "second"), (2001, None, None, None)]
    rows += [(c, 0, "user", "same") for c in range(3000, 3040)] + [(-7, 0, "user", "below zero")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"run_block": 4, "depth_block": 7, "level_bits": 1, "shard_rows": 10}])
def test_trie(spark, sizes):
    rows = [r for r in some_turns(3) if r[0] != -7]
    assert got(prefix_trie.trie(table(spark, rows), **sizes)) == plain_trie(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(700)] + [(6, 0, "user", "0"), (7, 1, "user", "x"), (11, 0, "user", "y")]
    want = plain_trie(rows)
    assert got(prefix_trie.trie(table(spark, rows), run_block=50, depth_block=64)) == want
    copies = rows + [(c, t, "user", str(t % 7)) for c in (20, 25) for t in range(700)]
    assert got(prefix_trie.trie(table(spark, copies), depth_block=100)) == plain_trie(copies)


def test_small_tables(spark):
    assert got(prefix_trie.trie(table(spark, []))) == []
    assert got(prefix_trie.trie(table(spark, [(None, 1, "user", "a")]))) == []
    for rows in ([(3, 0, "user", "only")], [(5, 0, None, None)], [(1, 0, "a", "b"), (2, 0, "ab", "")]):
        assert got(prefix_trie.trie(table(spark, rows))) == plain_trie(rows)


def test_ties_and_order(spark):
    """Equal turns have one order whatever the order of the rows."""
    rows = [(10, 1, "user", t) for t in ("b", "a", "c")] + [(12, 1, "user", t) for t in ("c", "b", "a")]
    assert got(prefix_trie.trie(table(spark, rows))) == got(prefix_trie.trie(table(spark, rows[::-1])))


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        k1, k2 = rng.integers(-1 << 62, 1 << 62, n), rng.integers(-1 << 62, 1 << 62, n)
        k1[: n // 2] = 7  # digests that agree in one half
        slots = prefix_trie.Slots(k1, k2)
        assert sorted(slots[k1, k2].tolist()) == list(range(n))
        assert (slots[rng.integers(-1 << 62, 1 << 62, 100), rng.integers(-1 << 62, 1 << 62, 100)] == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.array([1, 1]), np.array([2, 2]))
