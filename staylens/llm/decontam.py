"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

Words are the runs of bytes other than ASCII controls, punctuation and space, after lower-casing A-Z.  The index is cut
by document: a segment is a few megabytes of whole documents of one input split, and each row is one posting list, the
positions of one term in one segment.  So no list grows with the corpus, a word that fills a third of all text is
spread over all segments, and the intersection of lists needs no rows of other segments.  Positions count through the
segment's documents; a segment's row without a term holds its document ids and lengths.

A phrase is looked up from its rarest term in the segment: that list, moved by the term's offset in the phrase, is
intersected with the next rarer one, and so on.  A phrase with a term that the segment lacks costs nothing.
"""

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

WINDOW = 10
#: upper-case letters to lower-case, other ASCII that is no digit or letter to a space, the rest as it is
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
INDEX_SCHEMA = "segment long, term binary, positions array<int>, doc_ids array<long>"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(words: list[bytes], length: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``length`` words; a shorter text that has words is one window."""
    return [tuple(words[i:i + length]) for i in range(max(len(words) - length + 1, 1))] if words else []


class _Numbered(dict):
    """Term to number; -1 for other words, or the next number while ``open``."""

    def __init__(self, terms, is_open: bool):
        super().__init__((t, i) for i, t in enumerate(terms))
        self.open = is_open

    def __missing__(self, word):
        if not self.open:
            return -1
        self[word] = n = len(self)
        return n


def _segment_rows(segment: int, ids: list, texts: list, terms):
    known = _Numbered(terms or (), terms is None)
    words = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    codes = np.concatenate([np.fromiter(map(known.__getitem__, w), np.int32, len(w)) for w in words] or [np.zeros(0, np.int32)])
    at = np.flatnonzero(codes >= 0).astype(np.int32)
    order = np.argsort(codes[at], kind="stable")
    at, codes = at[order], codes[at[order]]
    cuts = np.flatnonzero(np.diff(codes)) + 1
    names = list(known)
    lists = np.split(at, cuts) if len(at) else []
    heads = codes[np.concatenate([[0], cuts])] if len(at) else []
    return pd.DataFrame({"segment": segment, "term": [None] + [names[c] for c in heads], "positions": [sizes, *lists],
                         "doc_ids": [pd.array(ids, dtype="Int64").to_numpy(object, na_value=None)] + [None] * len(lists)})


def build_index(docs: DataFrame, terms: frozenset[bytes] | None = None, segment_bytes: int = 4_000_000) -> DataFrame:
    """Posting lists of ``docs`` (doc_id, text), for all words or for ``terms`` only; a null text has no words."""
    wanted = None if terms is None else sorted(terms)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        base, n, ids, texts, size = TaskContext.get().partitionId() << 24, 0, [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                size += len(t or b"")
                if size >= segment_bytes:
                    yield _segment_rows(base + n, ids, texts, shared.value)
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield _segment_rows(base + n, ids, texts, shared.value)

    return pick(docs, doc_id="long", text="binary").mapInPandas(run, INDEX_SCHEMA)


def _phrase_starts(phrase: tuple[bytes, ...], lists: dict, base: np.ndarray) -> np.ndarray:
    """Segment positions where ``phrase`` starts inside one document."""
    if any(t not in lists for t in phrase):
        return np.zeros(0, np.int64)
    order = sorted(range(len(phrase)), key=lambda k: len(lists[phrase[k]]))
    at = lists[phrase[order[0]]].astype(np.int64) - order[0]
    for k in order[1:]:
        p = lists[phrase[k]]
        i = np.searchsorted(p, at + k)
        at = at[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] == at + k)]
        if not len(at):
            return at
    at = at[at >= 0]
    doc = np.searchsorted(base, at, "right") - 1
    return at[at + len(phrase) <= base[doc + 1]]


def _near_docs(phrase: tuple[bytes, ...], lists: dict, base: np.ndarray, span: int) -> np.ndarray:
    """Documents where all words of ``phrase`` occur within ``span`` consecutive words, in any order."""
    words = sorted(set(phrase), key=lambda t: len(lists.get(t, ())))
    if any(t not in lists for t in words):
        return np.zeros(0, np.int64)
    rare = lists[words[0]].astype(np.int64)
    start = np.unique(rare[:, None] - np.arange(span)[None, :])
    last = start.copy()
    for t in words:
        p = lists[t]
        i = np.searchsorted(p, start)
        nxt = p[np.minimum(i, len(p) - 1)]
        keep = (i < len(p)) & (nxt < start + span)
        start, last = start[keep], np.maximum(last[keep], nxt[keep])
    start = np.maximum(start, 0)
    # the words' own first position decides the document: the run from ``start`` may begin in the document before
    first = np.minimum.reduce([lists[t][np.searchsorted(lists[t], start)] for t in words]) if len(start) else start
    doc = np.searchsorted(base, first, "right") - 1
    return np.unique(doc[last < base[doc + 1]])


def _search_segment(pdf: pd.DataFrame, phrases: list, slop: int | None) -> pd.DataFrame:
    head = pdf["term"].isna().to_numpy()
    sizes, ids = pdf["positions"][head].iloc[0], pdf["doc_ids"][head].iloc[0]
    lists = dict(zip(pdf["term"][~head], pdf["positions"][~head]))
    base = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    change, pairs, near = np.zeros(base[-1] + 1, np.int64), set(), set()
    for phrase, items in phrases:
        at = _phrase_starts(phrase, lists, base)
        if len(at):
            np.add.at(change, at, 1)
            np.add.at(change, at + len(phrase), -1)
            pairs.update((d, i) for d in np.unique(np.searchsorted(base, at, "right") - 1).tolist() for i in items)
        if slop is not None:
            near.update((d, i) for d in _near_docs(phrase, lists, base, len(phrase) + slop).tolist() for i in items)
    hit = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)
    total = np.concatenate([[0], np.cumsum(hit[1:-1])])
    n_hit = total[base[1:]] - total[base[:-1]]
    spans = [[] for _ in ids]
    for d in np.flatnonzero(n_hit):
        own = np.concatenate([[0], hit[base[d] + 1:base[d + 1] + 1], [0]])
        turn = np.flatnonzero(np.diff(own))
        spans[d] = [[int(a), int(b)] for a, b in zip(turn[::2], turn[1::2])]
    found = {"items": [[] for _ in ids], "near_items": [[] for _ in ids]}
    for name, got in (("items", pairs), ("near_items", near)):
        for d, i in sorted(got):
            found[name][d].append(i)
    return pd.DataFrame({"segment": pdf["segment"].iloc[0], "ord": np.arange(len(ids)), "doc_id": pd.array(list(ids), "Int64"),
                         "n_words": sizes.astype(np.int64), "spans": spans, **found})


def search(index: DataFrame, phrases: dict[tuple[bytes, ...], list[int]], slop: int | None = None) -> DataFrame:
    """One row per document of ``index``: (segment, ord, doc_id, n_words, spans, items, near_items).

    ``spans`` are the [start, end) word runs covered by phrases, ``items`` the numbers of the phrases found.  With
    ``slop``, ``near_items`` are the numbers of phrases whose words all lie within that many more words than the phrase has.
    """
    shared = index.sparkSession.sparkContext.broadcast(sorted(phrases.items()))
    return index.groupBy("segment").applyInPandas(
        lambda pdf: _search_segment(pdf, shared.value, slop),
        "segment long, ord int, doc_id long, n_words long, spans array<array<long>>, items array<long>, near_items array<long>")


def _hit_words(spans):
    """Words covered by the union of sorted [start, end) spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s[1]).alias("end"),
                                   (acc["n"] + F.greatest(s[1] - F.greatest(acc["end"], s[0]), F.lit(0).cast("long"))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None,
                  block_bytes: int = 32_000_000) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, item_ids, spans, near_item_ids, contaminated).

    Test items are taken in blocks of about ``block_bytes`` of text, each with one pass over the documents, so what the
    driver holds and sends is bounded however long the benchmark is.  Items with the same text or the same id count
    once per id; an item without an id marks words but is in no list of ids; items without words match nothing.
    Repeated document rows stay apart; null and empty texts have no words.
    """
    items = pick(benchmark, item_id="long", text="binary").filter(F.octet_length("text") > 0)
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        phrases: dict[tuple[bytes, ...], list[int]] = {}
        for r in rows:
            for w in windows_of(tokens(bytes(r["text"])), window):
                ids = phrases.setdefault(w, [])
                if r["item_id"] is not None and r["item_id"] not in ids:
                    ids.append(r["item_id"])
        index = stored(build_index(docs, frozenset(t for w in phrases for t in w)), "positions")
        got = search(index, phrases, slop)
        found = got if found is None else found.unionByName(got)
    if blocks > 1:
        merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("segment", "ord").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                                    merge("spans"), merge("items"), merge("near_items"))
    return found.select("doc_id", "n_words", _hit_words(F.col("spans")).alias("n_hit"), F.col("items").alias("item_ids"), "spans",
                        F.col("near_items").alias("near_item_ids"), (F.size("spans") > 0).alias("contaminated"))
