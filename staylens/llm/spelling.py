"""Spelling variants: words that differ by one edit, found by walking a trie of all words as tables.

Counting.  Words are maximal runs of letters, counted in one pass with small tables per task before the exchange.

Trie.  A node is a prefix; its key is the exclusive or of a 64-bit mix of each (position, character), so the key after a
changed or missing character follows from the keys of the word's own prefixes.  The edge table has one row
(node, char, child) with a mask of the characters that may follow and whether a word ends at the child.

Frontier.  A state is (word, position, node, edits).  A word's states without an edit lie on its own path.  They meet the edge
table once: a larger character than the word's own is a replacement, the character after the word's own is a deletion (of
the longer word, so insertions are found from the other side).  The one-edit states then follow the word's remaining characters
level by level, by 2, 4, 8 ... characters at a time, each level a join with the edge table on the node reached; a state at
the word's end is a neighbour if its node is a word.  Long words so take a logarithmic number of joins.

The first half of a word is edited in a second trie, of the reversed words, so an edit is only tried below half of the word,
where nodes have few children.  No step pairs words with each other: the rows are bounded by letters times children.
Keys may collide, which only adds states; neighbours are verified on the words.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST_LENGTH, LEAST_COUNT, TYPO_EVERY, FORM_FACTOR = 7, 2, 31, 10
_WORDS_HELD = 100_000
_STEPS = [2 ** k - 2 for k in range(2, 40)]  # characters behind the edit at which a level ends: 2, 6, 14, 30 ...
_LETTERS_PER_BATCH = 1 << 18
_PATH = "id long, forward boolean, p int, node long, c0 int, c1 int, c2 int, child long, mask long, ends boolean, try boolean, replaced array<long>, deleted array<long>"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z lower-cased, of ``least_length`` characters or more.

    A run whose crc32 with its document's id is divisible by ``typo_every`` first loses a character, as the hash says (none
    where it is 0).  A null id counts as empty, a null text has no words; repeated rows count again.
    """
    run_of = re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % least_length)

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        crc = zlib.crc32
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text")):
                text = text.as_py()
                if not text:
                    continue
                seed, own = crc(key.encode() + b":"), {}
                for w in run_of.findall(text.encode("latin-1", "replace").lower()):  # one byte for each character
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    if typo_every:
                        h = crc(w if w.isascii() else w.decode("latin-1").encode(), seed)
                        if h % typo_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < least_length:
                                continue
                    held[w] = held.get(w, 0) + n
                if len(held) >= _WORDS_HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _at(position: np.ndarray, code: np.ndarray, forward: bool) -> np.ndarray:
    """The part of a node's key that a character at a position makes."""
    return _mix(_mix(position.astype(np.uint64) * np.uint64(2) + np.uint64(forward)) + (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _before(parts: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exclusive or of the parts before each position, for words that lie behind each other; one more entry at the end."""
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(parts)]) if len(parts) else np.zeros(1, np.uint64)
    return total ^ np.concatenate([np.repeat(total[start], n), np.zeros(1, np.uint64)])


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of whole words in the trie and in the trie of reversed words, as signed longs."""
    out = []
    for forward in (True, False):
        n = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(w if forward else w[::-1] for w in words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(n) - n
        p = np.arange(len(code)) - np.repeat(start, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_at(p, code, forward))]) if len(code) else np.zeros(1, np.uint64)
        out.append((total[start + n] ^ total[start]).view(np.int64))
    return out[0], out[1]


def _paths(words: list[str], ids: np.ndarray, forward: bool) -> pa.RecordBatch:
    """Rows of ``_PATH`` for words of two characters or more: the edge that leaves each prefix, and the state there."""
    n = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(w if forward else w[::-1] for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(n) - n
    size, owner = np.repeat(n, n), np.repeat(np.arange(len(words)), n)
    p = np.arange(len(code)) - start[owner]
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_at(p, code, forward))])
    # the same with each character one place to the left, as after a deletion before it
    moved = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_at(np.maximum(p - 1, 0), code, forward))])
    base = total[start][owner]

    def ahead(k):
        return np.where(p + k < size, code[np.minimum(np.arange(len(code)) + k, len(code) - 1)], -1)

    c1, c2 = ahead(1), ahead(2)
    least = np.minimum(n // 2, n - 1) if forward else n - n // 2
    tried = p >= least[owner]
    keep = p >= np.minimum(n // 2, 3)[owner]
    rows = np.flatnonzero(keep)
    g, left = rows, (size - p - 1)[rows]  # characters behind the edit

    def levels(sums, skip):
        """Keys from the child on to each level's end, the word's end last; none where the child is the end."""
        first = g + 1 + skip  # of the running table: characters before it are in the child
        rest = left - skip
        count = np.where(tried[rows], np.where(rest > 0, 1 + np.searchsorted(_STEPS, rest, side="left"), 0), 0)
        ends = np.cumsum(count)
        of = np.repeat(np.arange(len(rows)), count)
        k = np.arange(len(of)) - (ends - count)[of]
        stop = np.where(k == count[of] - 1, rest[of], np.array(_STEPS)[k])
        value = (sums[first[of] + stop] ^ sums[first[of]]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(value))

    here, there = base ^ total[:-1], base ^ total[1:]
    mask = np.where(c1 >= 0, np.int64(1) << (c1 & 63), 0)
    return pa.RecordBatch.from_arrays([
        pa.array(ids[owner[rows]]), pa.array(np.full(len(rows), forward)), pa.array(p[rows].astype(np.int32)), pa.array(here[rows].view(np.int64)),
        pa.array(code[rows].astype(np.int32)), pa.array(c1[rows].astype(np.int32)), pa.array(c2[rows].astype(np.int32)), pa.array(there[rows].view(np.int64)),
        pa.array(mask[rows]), pa.array(c1[rows] < 0), pa.array(tried[rows]), levels(total, 0), levels(moved, 1)],
        names=["id", "forward", "p", "node", "c0", "c1", "c2", "child", "mask", "ends", "try", "replaced", "deleted"])


def _path_table(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            word, ids, held, size = b.column("word").to_pylist(), b.column("id").to_numpy(), [], 0
            for k, w in enumerate(word):
                held.append(k)
                size += len(w)
                if size >= _LETTERS_PER_BATCH or k == len(word) - 1:
                    for forward in (True, False):
                        yield _paths([word[i] for i in held], ids[held], forward)
                    held, size = [], 0

    return words.select("word", "id").mapInArrow(run, _PATH)


def _keyed(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with the word's keys in both tries, ``id`` and ``back``."""
    def run(batches):
        for b in batches:
            ids, back = word_keys(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids), pa.array(back)], names=["word", "n", "id", "back"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, id long, back long")


def _may_follow(mask: Column, code: Column) -> Column:
    return F.getbit(mask, code.bitwiseAND(F.lit(63))) == 1


def neighbours(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each two of the distinct ``words`` (word, n; two characters or more) that differ by one character, once, a < b."""
    words = stored(_keyed(words), "spelling-words")
    paths = _path_table(words)
    edges = stored(paths.groupBy("node", "c0", "child").agg(F.bit_or("mask").alias("mask"), F.bool_or("ends").alias("ends"))
                   .select("node", F.col("c0").alias("char"), "child", "mask", "ends"), "spelling-edges")
    states = paths.filter("try").select("id", "forward", "node", "c0", "c1", "c2", "replaced", "deleted")
    met = states.join(edges, "node")
    replaced = (F.col("char") > F.col("c0")) & F.when(F.col("c1") < 0, F.col("ends")).otherwise(_may_follow(F.col("mask"), F.col("c1")))
    deleted = ((F.col("c1") >= 0) & (F.col("char") == F.col("c1")) & (F.col("c0") != F.col("c1"))
               & F.when(F.col("c2") < 0, F.col("ends")).otherwise(_may_follow(F.col("mask"), F.col("c2"))))
    steps = F.array_compact(F.array(F.when(replaced, F.col("replaced")), F.when(deleted, F.col("deleted"))))
    level = stored(met.filter(replaced | deleted).select("id", "forward", "child", F.explode(steps).alias("steps")), "spelling-level")
    # a last character may also just go: the state's own node is then the end
    ended = [level.filter(F.size("steps") == 0).select("id", "forward", F.col("child").alias("node")),
             paths.filter("try AND c1 < 0").select("id", "forward", "node")]
    k = 1
    while True:
        on = level.filter(F.size("steps") >= k).select("*", F.col("child").bitwiseXOR(F.element_at("steps", k)).alias("node"))
        ended.append(on.filter(F.size("steps") == k).select("id", "forward", "node"))
        going = on.filter(F.size("steps") > k)
        if going.isEmpty():
            break
        level = stored(going.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_semi").drop("node"), "spelling-level")
        k += 1
    found = ended[0]
    for more in ended[1:]:
        found = found.union(more)
    by_key = words.select(F.lit(True).alias("forward"), F.col("id").alias("node"), F.col("word").alias("w2"), F.col("n").alias("n2")).union(
        words.select(F.lit(False), "back", "word", "n"))
    pairs = found.join(by_key, ["node", "forward"]).select("id", "w2", "n2").join(words.select("id", "word", "n"), "id")
    near = pairs.filter(F.levenshtein("word", "w2", 1) == 1)
    first = F.col("word") < F.col("w2")
    return near.select(F.least("word", "w2").alias("a"), F.when(first, F.col("n")).otherwise(F.col("n2")).alias("na"),
                       F.greatest("word", "w2").alias("b"), F.when(first, F.col("n2")).otherwise(F.col("n")).alias("nb")).distinct()


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    ``form`` is the near word of largest count, the smallest of equals, if its count is ``factor`` times the word's or more.
    ``root`` follows forms to the last, by doubling the steps of stored tables.
    """
    words = stored(words, "spelling-counts")
    pairs = stored(neighbours(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("near").alias("w"))).alias("best"))
    rows = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.w").alias("near"), (-F.col("best.o")).alias("m"))
        .withColumn("fits", F.coalesce(F.col("m") >= F.col("n") * factor, F.lit(False))), "spelling-rows")
    step = stored(rows.filter("fits").select("word", F.col("near").alias("root")), "spelling-roots")
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = step.join(after, "root", "left")
        if step.join(after, "root", "left_semi").isEmpty():
            break
        step = stored(longer.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return (rows.join(step, "word", "left").select("word", F.when(F.col("fits"), F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"),
                                                   "n", "n_near", F.when(F.col("fits"), F.col("m")).alias("form_n")))


def group_variants(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text) with ``least_count`` occurrences or more; an empty table gives no rows."""
    return variants(word_counts(docs).filter(F.col("n") >= least_count))
