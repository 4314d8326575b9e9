"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A length of over C / (i + 1) and up to C / i tokens belongs to class i; a sequence of class i takes exactly i such pieces,
so it is more than i / (i + 1) full, and its rest is topped up with the first tokens of the next document, which is cut
there.  The last class takes everything at or below C / ``classes``.  Documents of C tokens or more give whole sequences
first.  Every worker fills the sequences of its own input split: there is no shuffle and nothing to agree on, and a lost
task is simply done again.  At the end of a split the pieces of unfinished sequences are laid end to end and cut at C, and
the last cut into powers of two, which need no padding.  So nothing is padded at all, and a document is cut only
where it tops up a sequence, fills whole ones, or ends its split.
"""

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick

CAPACITY = 2048
END_ID = 1
CLASSES = 64
CACHED_WORDS = 200_000

#: fixed values: the text handling of the vocabulary files for which words can be encoded one by one
_WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: the same pattern over Latin-1 bytes that hold only ASCII and lower-case letters
_LATIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9\t\n\v\f\r ]+")
_LATIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LATIN_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Text to little-endian 32-bit token ids, equal to the tokenizer's own ``encode(text, add_special_tokens=False)``.

    The tokenizer spends most of its time on normalizing and splitting.  Where its rules are those of a lower-casing word
    vocabulary and a text has only ASCII and Latin-1 letters, words are split here and only unseen words meet the merge
    model; the ids of seen words are kept, up to ``CACHED_WORDS``.  All other texts go through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        rules = json.loads(definition)
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = norm == _WORD_NORMALIZER and pre[0].get("pattern") == {"Regex": _WORD_PATTERN} and len(pre) == 2
        self.added = [a["content"] for a in rules.get("added_tokens", [])]
        self.model, self.letters, self.seen = self.tokenizer.model, _byte_letters(), {}

    def _word(self, word: bytes) -> bytes:
        letters = word.decode("latin-1").encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.by_word and not any(a in text for a in self.added):
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is not None and not raw.translate(None, _LATIN):
                words = _LATIN_WORDS.findall(raw.translate(_LATIN_LOWER))
                seen = self.seen
                try:
                    return b"".join(map(seen.__getitem__, words))
                except KeyError:
                    if len(seen) > CACHED_WORDS:
                        seen.clear()
                    for w in set(words):
                        if w not in seen:
                            seen[w] = self._word(w)
                    return b"".join(map(seen.__getitem__, words))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder in each worker process."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


class Packer:
    """Fills the sequences of one worker; a piece is (doc, start, ids, doc_tokens) with ``ids`` as bytes, 4 for a token."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.sequences = capacity, classes, 0
        self.open: dict[int, list] = {}
        self.waiting: list[tuple[list, int]] = []  # sequences of full count, and the tokens they still lack

    def _close(self, pieces: list):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.sequences, at
            at += len(ids) // 4
        self.sequences += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None):
        total, at, n, cap = len(ids) // 4 if total is None else total, 0, len(ids) // 4, self.capacity
        cut = lambda a, b: (doc, start + a, ids[4 * a:4 * b], total)
        while self.waiting and at < n:
            pieces, lack = self.waiting.pop()
            take = min(lack, n - at)
            pieces.append(cut(at, at + take))
            at += take
            if take == lack:
                yield from self._close(pieces)
            else:
                self.waiting.append((pieces, lack - take))
        while n - at >= cap:
            yield from self._close([cut(at, at + cap)])
            at += cap
        if at < n:
            k = min(cap // (n - at), self.classes)
            pieces = self.open.setdefault(k, [])
            pieces.append(cut(at, n))
            if len(pieces) == k:
                del self.open[k]
                lack = cap - sum(len(p[2]) // 4 for p in pieces)
                if lack:
                    self.waiting.append((pieces, lack))
                else:
                    yield from self._close(pieces)

    def finish(self):
        left = [p for k in sorted(self.open) for p in self.open[k]] + [p for w, _ in self.waiting for p in w]
        self.open, self.waiting = {}, []
        tokens = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (tokens // self.capacity)
        sizes += [1 << b for b in reversed(range(64)) if tokens % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, total = left.pop()
                n = min(size, len(ids) // 4)
                pieces.append((doc, start, ids[:4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n:], total))
                size -= n
            yield from self._close(pieces)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, classes: int = CLASSES,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    A null or empty text is the end id alone.  Repeated rows and absent ids are packed like any other row.  An empty
    table gives no rows.  ``tokenizer_file`` is read on the driver and sent to the workers (a vocabulary, about 2 MB).
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = np.array([end_id], "<u4").tobytes()
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<long>" * with_ids)

    def table(pieces, base):
        rows = [(doc, start, len(ids) // 4, zlib.crc32(ids), total, base + seq, at) + ((np.frombuffer(ids, "<u4").astype(np.int64),) * with_ids)
                for doc, start, ids, total, seq, at in pieces]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def run(batches):
        enc, packer, base = encoder(definition.value), Packer(capacity, classes), TaskContext.get().partitionId() << 33
        for b in batches:
            ids = [None if pd.isna(i) else int(i) for i in b["doc_id"]]
            yield table((p for i, t in zip(ids, b["text"]) for p in packer.add(i, enc.encode(t or "") + tail)), base)
        yield table(packer.finish(), base)
        enc.seen.clear()  # a worker process lives on and may serve other stages

    return pick(docs, doc_id="long", text="string").mapInPandas(run, schema)
