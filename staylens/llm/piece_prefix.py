"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

Merging by score is a greedy rule, so a sequence of pieces is the encoding of its text exactly if every two neighbours
are: merging the text of the two alone must give these two back.  Therefore the encoding of a prefix ends in one token
only, the token ``t`` ending there for which the last token of the prefix before ``t`` and ``t`` are such a compatible
pair.  An automaton lists all tokens ending at each position, the pair test picks the one, and the table of last tokens
is read backwards from the end.  The work is linear in the text, whatever the length of a word.

White space is a piece's first character or all of it, so the table is made for each run of marks with the characters up
to the next mark, and the ids of short runs are remembered (a bounded cache of each worker).  Characters without a piece
are written as byte pieces.  Decoding goes from ids to pieces to text; it does not look at the source text.
"""

import codecs
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
CACHED_RUNS, CACHED_LENGTH, CACHED_PAIRS = 250_000, 64, 500_000
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PROBE = "  A Ｆ éé  b\t\n "
_IDS_PER_BATCH = 1 << 20
_LOADED: dict[str, "PieceCodec"] = {}
codecs.register_error("mark_each_byte", lambda e: ("\ufffd", e.start + 1))


class _Cache(dict):
    """Remembers what ``make`` gives for short keys, in two generations of at most ``limit`` keys each."""

    def __init__(self, make, limit: int, length: int):
        super().__init__()
        self.make, self.limit, self.length, self.old = make, limit, length, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.length:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one model file with BPE pieces, byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("only models that add a first mark and change nothing else are supported")
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if model.is_byte(i)}
        if len(self.byte_of) != 256:
            raise ValueError("only models with byte pieces are supported")
        other = self.silent | {self.unknown} | self.byte_of.keys()
        plain = [i for i in range(n) if i not in other and not model.is_unused(i)]
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.id_of = {self.names[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("only models whose marks lead their pieces are supported")
        # single characters are symbols even where only longer pieces hold them; longer ones must be reached by merging
        symbols = {c for p in self.score for c in p} | {p for p in self.score if len(p) > 1 and self.merge(p) == [p]}
        self.symbols = sorted(symbols)
        self.steps = [self.history(p)[1] for p in self.symbols]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.symbols):
            self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.symbols]
        self.known = [self._known(p) for p in self.symbols]
        self.pairs: dict[int, bool] = {}
        self.runs = _Cache(self._run, CACHED_RUNS, CACHED_LENGTH)

    def history(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Merging a short text by the defining rule, the best-scored neighbours first, leftmost of equals.

        Gives the pieces left and, for each merge in turn, its score and the first and last piece after it.
        """
        parts, steps = list(text), []
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def merge(self, text: str) -> list[str]:
        return self.history(text)[0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether symbols ``a`` and ``b`` stay apart when their text is merged alone.

        Until pieces meet across the border, the merges on its two sides are those of either symbol alone, taken in the
        order of their scores; the border gives way if the pieces at it would merge before the next one of both sides.
        """
        left, right, score = self.steps[a], self.steps[b], self.score
        x, y = self.symbols[a][-1], self.symbols[b][0]
        i = j = 0
        while True:
            across = score.get(x + y)
            next_left = left[i] if i < len(left) else None
            next_right = right[j] if j < len(right) else None
            if across is not None and (next_left is None or across > next_left[0]) and (next_right is None or across >= next_right[0]):
                return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or next_left is not None and next_left[0] >= next_right[0]:
                x, i = next_left[2], i + 1
            else:
                y, j = next_right[1], j + 1

    def last_symbols(self, text: str) -> list[int]:
        """The last symbol of each prefix of one to all characters; -1 where it is a character that no piece holds."""
        last, pairs, many = [-1] * len(text), self.pairs, len(self.symbols)
        for end, (symbol, length) in self.automaton.iter(text):
            if last[end] < 0:
                if end < length or last[end - length] < 0:
                    last[end] = symbol
                    continue
                key = last[end - length] * many + symbol
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(last[end - length], symbol)
                if fits:
                    last[end] = symbol
        return last

    def _back(self, text: str) -> list:
        """The symbols of a run (those that no piece holds as characters), read backwards from the table of last symbols."""
        last, at, sizes, out = self.last_symbols(text), len(text), self.sizes, []
        while at:
            k = last[at - 1]
            if k < 0:
                out.append(text[at - 1])
                at -= 1
            else:
                out.append(k)
                at -= sizes[k]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without white space but leading marks."""
        return [self.symbols[k] if isinstance(k, int) else k for k in self._back(text)]

    def _ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [self.byte_ids[b] for b in piece.encode()] if i is None else [i]

    def _run(self, text: str) -> tuple[bytes, bytes]:
        known, back = self.known, self._back(text)
        got = [known[k] if isinstance(k, int) else self._known(k) for k in back]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def _known(self, piece: str) -> tuple[bytes, bytes]:
        ids = self._ids(piece)
        return np.array(ids, np.int32).tobytes(), self._surface(ids)

    def encode_raw(self, text: str) -> tuple[bytes, bytes]:
        """int32 ids and the UTF-8 of what they decode to, of one text; the end id is not among them."""
        if not text:
            return b"", b""
        got = list(map(self.runs.__getitem__, _RUN.findall(MARK + text.replace(" ", MARK))))
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])[1:]

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """Ids of one text; null counts as empty."""
        return np.frombuffer(self.encode_raw(text or "")[0], np.int32).tolist() + [self.end] * end

    def _surface(self, ids) -> bytes:
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "mark_each_byte"))
                pending = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.names[i].replace(MARK, " "))
        return "".join([*out, pending.decode("utf-8", "mark_each_byte")]).encode()

    def decode(self, ids) -> str:
        """The text of ids: control ids are silent, bytes are joined to characters, the mark of the first piece goes."""
        text = self._surface(ids).decode()
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.names[first].startswith(MARK) else text


def codec(path: str) -> PieceCodec:
    """The codec of a model file, built once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """The rows of ``docs`` (text and any others) with ``ids`` (array of int) and ``decoded`` (string) in place of ``text``.

    ``ids`` are those of the library, with the end id last; ``decoded`` is their decoding.  A null text counts as empty: the end
    id alone, decoded to the empty text.  Repeated rows stay, an empty table gives an empty result, and other columns
    pass unread; columns called ids or decoded are replaced.  The model file is read by every executor.
    """
    others = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    ready = docs.select(F.struct(F.lit(True).alias("_row"), *[F.col(f"`{c}`") for c in others]).alias("row"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        own = codec(path)
        tail = np.array([own.end] * end, np.int32).tobytes()
        for b in batches:
            rows, texts, done, held, size = b.column("row"), b.column("text"), 0, [], 0
            for k, text in enumerate(texts, 1):
                raw, decoded = own.encode_raw(text.as_py())
                held.append((raw + tail, decoded))
                size += len(raw) // 4 + 1
                if size >= _IDS_PER_BATCH or k == len(texts):
                    ids = pa.array(np.frombuffer(b"".join([h[0] for h in held]), np.int32))
                    ends = np.cumsum([0, *[len(h[0]) // 4 for h in held]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([rows.slice(done, len(held)), pa.ListArray.from_arrays(pa.array(ends), ids),
                                                      pa.array([h[1] for h in held], pa.binary()).cast(pa.string())], names=["row", "ids", "decoded"])
                    done, held, size = k, [], 0

    kind = StructType([ready.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    done = ready.mapInArrow(run, kind)
    return done.select(*[F.col(f"row.`{c}`") for c in others], "ids", "decoded")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """The rows of ``ids`` (ids: array of int, and any others) with ``decoded``; null ids give the empty text."""
    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        own = codec(path)
        return values.map(lambda v: own.decode([] if v is None else [int(i) for i in v]))

    return ids.withColumn("decoded", text("ids"))
