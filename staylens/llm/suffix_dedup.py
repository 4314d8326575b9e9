"""Removal of every byte inside a 200-byte string that starts more than once, by prefix-free parsing.

Parsing.  Every window of ``length`` bytes has a trigger: the ``GRAM``-byte string inside it with the smallest rolling
hash, the leftmost of equals.  The windows of a text that share one trigger occurrence form a phrase, the bytes from the
first such window's start to the last one's end; neighbouring phrases overlap by ``length`` - 1 bytes, so each window
lies in exactly one phrase, and equal windows lie in phrases of equal triggers at equal distances from them.

Parse.  Phrases are counted by (trigger, phrase hash).  A trigger that occurs once cannot hold a repeated window; that
settles most of a corpus.  A phrase that occurs twice is repeated as a whole; that settles most copies.

Dictionary.  What remains are distinct phrases with a common trigger.  Their texts, cut natively from the documents, are
gathered by trigger; a suffix array over each shard (prefix doubling up to ``length`` bytes) puts their suffixes in corpus
order, and neighbours that agree in ``length`` bytes are repeated windows.  A trigger with more than ``shard_phrases``
phrases is spread over several shards, which also hand out hashes of their windows to be compared across shards.

So the work per row is on phrases, one for about 60 bytes of text, nothing is grouped that may be unbounded, and repeats
are exact up to collisions of 128-bit hashes.  The two joins with texts use one exchange of the documents, also where these
have other columns: the first join then hands whole rows on, as the second does (see ``_cuts``).
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

LENGTH = 200
GRAM = 64
SHARD_PHRASES = 10_000
_BASE, _OTHER_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_POSITION_BITS = 23
_CHUNK = 1 << 22
_SHARD_BYTES = 200_000


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_LETTERS, _OTHER_LETTERS = _table(7), _table(11)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every ``size`` bytes (a power of two), by doubling."""
    h, k, b = _LETTERS[data], 1, _BASE
    while k < size:
        h = h[:-k] * np.uint64(b) + h[k:]
        b, k = b * b % (1 << 64), 2 * k
    return _mix(h)


def _span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int, letters: np.ndarray) -> np.ndarray:
    """Hash of data[lo:hi] for arrays of bounds, from prefix sums."""
    n = len(data) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * _powers(base, n)[:n - 1], dtype=np.uint64)])
    back = _powers(pow(base, -1, 1 << 64), n)
    return _mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def parse(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(trigger hash, phrase hash, first window, windows) of each phrase of one text, as arrays."""
    out = []
    for a in range(0, max(len(data) - length + 1, 0), _CHUNK):
        part = data[a:a + _CHUNK + length - 1]
        h = _gram_hashes(part, gram)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        best, k, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
        while 2 * k <= span:
            best, k = np.minimum(best[:-k], best[k:]), 2 * k
        if k < span:
            best = np.minimum(best[:len(best) - (span - k)], best[span - k:])
        at = (best & low).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        hi = np.concatenate([lo[1:], [len(at)]])
        out.append((h[at[lo]], _span_hashes(part, lo, hi - 1 + length, _OTHER_BASE, _OTHER_LETTERS), lo + a, hi - lo))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _phrases(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(trigger, phrase, n, windows, doc_key, tag, first): ``first`` is the first window's place in the document.

    A phrase is one row for each document, with its ``n`` occurrences there.  If there are several, they are repeats
    already: their windows, joined into runs, are rows of n = 0, dealt by a hash of the document.  So text that repeats
    itself, however often, gives a few rows and no common key.
    """
    def run(batches):
        for b in batches:
            rows = []
            for key, tag, text in zip(b.column("doc_key").to_pylist(), b.column("tag").to_pylist(), b.column("text")):
                raw = text.as_buffer()
                if raw is None or len(raw) < length:
                    continue
                trigger, phrase, first, count = parse(np.frombuffer(raw, np.uint8), length, gram)
                order = np.lexsort((first, phrase, trigger))
                t, p = trigger[order], phrase[order]
                head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])]))
                n = np.diff(np.concatenate([head, [len(order)]]))
                at = order[head]
                again = np.sort(order[np.repeat(n > 1, n)])
                runs = np.flatnonzero(np.concatenate([[True], first[again][1:] != (first + count)[again][:-1]])) if len(again) else again
                lo = first[again][runs]
                size = np.add.reduceat(count[again], runs) if len(again) else lo
                own = _mix(np.arange(len(lo), dtype=np.uint64) + trigger[:1] + np.uint64(tag % (1 << 64))).view(np.int64)
                rows.append((np.concatenate([trigger[at].view(np.int64), own]), np.concatenate([phrase[at].view(np.int64), np.zeros(len(lo), np.int64)]),
                             np.concatenate([n, np.zeros(len(lo), np.int64)]), np.concatenate([count[at], size]), np.full(len(at) + len(lo), key),
                             np.full(len(at) + len(lo), tag), np.concatenate([first[at], lo])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["trigger", "phrase", "n", "windows", "doc_key", "tag", "first"])

    return docs.mapInArrow(run, "trigger long, phrase long, n long, windows long, doc_key long, tag long, first long")


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position's first ``length`` bytes in suffix order (equal rank: equal bytes), by prefix doubling."""
    def ranks(keys):
        order = np.argsort(keys)
        s = keys[order]
        out = np.empty(len(keys), np.uint64)
        out[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]).astype(np.uint64)
        return out

    def ahead(r, k):
        return np.concatenate([r[k:], np.zeros(min(k, len(r)), np.uint64)])

    r, k = data.astype(np.uint64), 1
    while k < 8:
        r, k = (r << np.uint64(8 * k)) | ahead(r, k), 2 * k
    r = ranks(r)
    while k < length:
        step = min(k, length - k)
        r, k = ranks((r << np.uint64(32)) | ahead(r, step)), k + step
    return r


def _shard_spans(rows: pd.DataFrame, length: int):
    """Repeated windows among the phrases of one shard, and the windows that other shards must see."""
    data = np.frombuffer(b"".join(rows["text"]), np.uint8)
    size = rows["text"].str.len().to_numpy()
    base = np.cumsum(size) - size
    n_windows = size - length + 1
    owner = np.repeat(np.arange(len(rows)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    rank = window_ranks(data, length)[base[owner] + offset].astype(np.int64)
    twice = np.bincount(rank)[rank] > 1
    key, tag, first, n = (rows[c].to_numpy() for c in ("doc_key", "tag", "first", "n"))
    single = n[owner] == 1  # phrases that occur twice are repeated anyway
    start = first[owner] + offset
    hit = np.flatnonzero(twice & single)
    if len(hit):
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
        heads, tails = hit[new], hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]
        yield pd.DataFrame({"doc_key": key[owner[heads]], "tag": tag[owner[heads]], "start": start[heads], "end": start[tails] + length,
                            "h1": None, "h2": None, "open": False})
    out = np.flatnonzero(rows["shards"].to_numpy()[owner] > 1)
    if len(out):
        lo = base[owner[out]] + offset[out]
        hashes = [_span_hashes(data, lo, lo + length, b, t).view(np.int64) for b, t in ((_BASE, _LETTERS), (_OTHER_BASE, _OTHER_LETTERS))]
        yield pd.DataFrame({"doc_key": key[owner[out]], "tag": tag[owner[out]], "start": start[out], "end": start[out] + length,
                            "h1": hashes[0], "h2": hashes[1], "open": (single & ~twice)[out]})


def _shards(length: int):
    def run(batches):
        held, size = [], 0
        for b in batches:
            b["text"] = [bytes(t) for t in b["text"]]
            edges = np.flatnonzero((b["trigger"].diff() != 0) | (b["salt"].diff() != 0))
            for i, j in zip(edges, [*edges[1:], len(b)]):
                part = b.iloc[i:j]
                same = held and held[-1]["trigger"].iloc[-1] == part["trigger"].iloc[0] and held[-1]["salt"].iloc[-1] == part["salt"].iloc[0]
                if size > _SHARD_BYTES and not same:
                    yield from _shard_spans(pd.concat(held, ignore_index=True), length)
                    held, size = [], 0
                held.append(part)
                size += part["text"].str.len().sum()
        if held:
            yield from _shard_spans(pd.concat(held, ignore_index=True), length)
    return run


def _cuts(length: int):
    """The entries of each document with their texts, cut from its whole row.

    The other columns of the row are not used here.  Without them Spark would exchange the texts once more, as the columns
    of an exchange must be the same for it to be used twice.
    """
    def run(batches):
        for b in batches:
            entries = b.column("entries")
            flat, doc = entries.flatten(), pa.array(np.repeat(np.arange(len(b)), entries.value_lengths().to_numpy()))
            whole = b.column("text").to_pylist()
            first, windows = flat.field("first").to_numpy(), flat.field("windows").to_numpy()
            text = [whole[i][lo:hi] for i, lo, hi in zip(doc.to_pylist(), first.tolist(), (first + windows + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in ("trigger", "salt", "shards", "n")], b.column("doc_key").take(doc), b.column("tag").take(doc),
                                              flat.field("first"), pa.array(text, pa.binary())], names=["trigger", "salt", "shards", "n", "doc_key", "tag", "first", "text"])
    return run


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Documents with ``doc_key`` and ``tag``, which tell rows apart by id and text.

    ``tag`` is 63 bits of the text's hash, and in the lowest bit whether the id is null; ``doc_key`` is the id, or where it is
    null other 64 bits of the text's hash.  So rows without an id are spread like others.
    """
    raw = docs.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))
    tag = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return raw.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("doc_key"), tag.alias("tag"), "text", *more)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(doc_key, tag, start, end): byte ranges of ``docs`` (see ``_keyed``) made of repeated windows; they may overlap."""
    texts_only = ["doc_key", "tag", "text"]
    phrases = _phrases(docs.select(*texts_only), length, gram)
    # stored, so that both sides of the join are plain exchanges and the rows of a very common trigger can be split
    again = stored(phrases.groupBy("trigger").agg(F.sum("n").alias("all")).filter("all > 1").select("trigger", F.lit(True).alias("known")), "triggers")
    parsed = stored(phrases.join(again, "trigger", "left").filter("known OR n = 0").drop("known"), "phrases")
    words = (parsed.filter("n > 0").groupBy("trigger", "phrase")
             .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_key", "tag", "first", "windows")).alias("at")))
    span = ["doc_key", "tag", "first", "windows"]
    across = parsed.filter("n = 1").join(words.filter("docs > 1").select("trigger", "phrase"), ["trigger", "phrase"])
    copies = (across.select(*span).union(parsed.filter("n = 0").select(*span))
              .select("doc_key", "tag", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (length - 1)).alias("end")))
    shared = words.groupBy("trigger").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    entries = stored(words.join(shared, "trigger").select(
        "trigger", "n", F.ceil(F.col("k") / shard_phrases).cast("int").alias("shards"),
        F.pmod(F.col("phrase"), F.ceil(F.col("k") / shard_phrases)).cast("int").alias("salt"), F.col("at.doc_key").alias("doc_key"),
        F.col("at.tag").alias("tag"), F.col("at.first").alias("first"), F.col("at.windows").alias("windows")), "dictionary")
    if docs.columns == texts_only:
        cut = F.expr(f"substring(text, CAST(first AS INT) + 1, CAST(windows AS INT) + {length - 1})")
        texts = docs.join(entries, ["doc_key", "tag"]).select("trigger", "salt", "shards", "n", "doc_key", "tag", "first", cut.alias("text"))
    else:
        held = entries.groupBy("doc_key", "tag").agg(F.collect_list(F.struct("trigger", "salt", "shards", "n", "first", "windows")).alias("entries"))
        kind = "trigger long, salt int, shards int, n long, doc_key long, tag long, first long, text binary"
        texts = docs.join(held, ["doc_key", "tag"]).mapInArrow(_cuts(length), kind)
    found = (texts.repartition("trigger", "salt").sortWithinPartitions("trigger", "salt")
             .mapInPandas(_shards(length), "doc_key long, tag long, start long, end long, h1 long, h2 long, open boolean"))
    spans = ["doc_key", "tag", "start", "end"]
    if entries.filter("shards > 1").isEmpty():
        return copies.union(found.select(*spans))
    found = stored(found, "windows")
    across = found.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    return copies.union(found.filter("h1 IS NULL").select(*spans)).union(found.filter("open").join(across, ["h1", "h2"]).select(*spans))


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and removed runs; touching ranges are one run."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s, e in spans:
        if s > end:
            runs += 1
            kept.append(text[at:s])
        if e > at:
            removed += e - max(s, at)
            at = e
        end = max(end, e)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with what repeats removed.

    Added columns: ``kept`` (remaining bytes as binary), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.  A null
    text counts as empty.  Texts shorter than ``length`` bytes never lose anything.  Rows that repeat a whole text of that
    length lose all of it, each of them.  Columns of the same names are replaced.
    """
    added = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    others = [c for c in docs.columns if c not in added and c != "text"]
    base = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")) if others != ["doc_id"] else _keyed(docs)
    spans = (repeated_spans(base, length, gram, shard_phrases).groupBy("doc_key", "tag")
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    joined = base.join(spans, ["doc_key", "tag"], "left")
    if others == ["doc_id"]:
        joined = joined.withColumn("row", F.struct(F.when(F.col("tag").bitwiseAND(F.lit(1)) == 0, F.col("doc_key")).cast(docs.schema["doc_id"].dataType).alias("doc_id")))
    ready = joined.select("row", "text", "spans")

    def run(batches):
        for b in batches:
            cuts = [_cut(t.as_py(), [(x["start"], x["end"]) for x in s.as_py() or ()]) for t, s in zip(b.column("text"), b.column("spans"))]
            size = [len(t.as_buffer()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([c[0] for c in cuts], pa.binary()), pa.array(size, pa.int64()), pa.array([c[1] for c in cuts], pa.int64()),
                 pa.array([c[2] for c in cuts], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts], pa.string())],
                names=["row", *added])

    kind = ready.schema["row"].dataType.simpleString()
    done = ready.mapInArrow(run, f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select("row.*", *added)
