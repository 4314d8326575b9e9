"""Quality: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated probabilities.

A token gives two items: its word (lower-cased, without edge punctuation) and its shape (runs of upper, lower, digit and
other signs, and whether it repeats the token before).  Items are hashed to ``SLOTS``.  Every slot has a fixed sparse
ternary index vector; a slot's context vector is the sum of the index vectors of the items up to two places away, over
all documents.  These sums are whole numbers, added by Spark, so they do not depend on task order.  A document is the
mean and spread of its items' normalized context vectors.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

SLOTS, WIDTH, REACH = 1 << 14, 32, 2
TRAIN_ROWS = 8_000
_BATCH = 1 << 17
_KEEP = 300_000
_RUNS = re.compile(r"([A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+)")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def index_places(slots: int = SLOTS, width: int = WIDTH) -> np.ndarray:
    """The places of each slot's index vector: +1 at the first two, -1 at the other two, drawn once from a fixed seed."""
    return np.random.default_rng(5).permuted(np.tile(np.arange(width), (slots, 1)), axis=1)[:, :4]


def _shape(token: str) -> str:
    if token.isalpha():
        return "Aa" if token.istitle() and len(token) > 1 else "A" if token.isupper() else "a" if token.islower() else "Aaa"
    return "".join(m[0] if m.isascii() and not m.isalnum() else "A" if m.isupper() else "0" if m.isdigit() else "a"
                   for m in _RUNS.findall(token))[:12]


class Slots:
    """Tokens to (word slot, shape slot, shape slot if repeated), remembered up to a bound."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.seen, self.shapes = slots, {}, {}

    def of(self, token: str) -> int:
        plain = token.isalpha() and token.islower()  # most tokens: their shape is one run of lower-case letters
        word, shape = (token, "a") if plain else (token.strip(_EDGE).lower() or token, _shape(token))
        at = self.shapes.get(shape)
        if at is None:
            at = self.shapes[shape] = (zlib.crc32(("s" + shape).encode()) % self.slots) * self.slots + zlib.crc32(("r" + shape).encode()) % self.slots
        return zlib.crc32(word.encode()) % self.slots * self.slots * self.slots + at

    def items(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word slots and shape slots of a text's tokens."""
        tokens = (text or "").split()
        if len(self.seen) > _KEEP:
            self.seen.clear()
            self.shapes.clear()
        try:
            codes = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in self.seen:
                    self.seen[t] = self.of(t)
            codes = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]
        return codes // (self.slots * self.slots), np.where(same, codes % self.slots, codes // self.slots % self.slots)


def _contexts(ids: np.ndarray, places: np.ndarray, sums: np.ndarray) -> None:
    """Add each item's neighbours' index vectors to ``sums``; -1 marks a gap that no context crosses."""
    slots, width = sums.shape
    size = (slots + 1) * width  # the last row takes what has no item or no neighbour
    added = np.zeros(size, np.int64)
    for k in range(1, REACH + 1):
        a, b = ids[:-k], ids[k:]
        known = (a >= 0) & (b >= 0)
        for item, near in ((a, b), (b, a)):
            codes = np.where(known, item, slots)[:, None] * width + places[near]
            added += np.bincount(codes[:, :2].ravel(), minlength=size) - np.bincount(codes[:, 2:].ravel(), minlength=size)
    sums += added[:-width].reshape(slots, width)


def word_vectors(docs: DataFrame, slots: int = SLOTS, width: int = WIDTH) -> np.ndarray:
    """Normalized context vectors over all of ``docs``: a bounded table of ``slots`` rows."""
    def run(batches):
        table, places = Slots(slots), index_places(slots, width)
        sums, gap, held, n = np.zeros((slots, width), np.int64), np.full(REACH, -1), [], 0
        for b in batches:
            for t in b["text"]:
                w, s = table.items(t)
                held += [w, gap, s, gap]
                n += 2 * len(w)
                if n > _BATCH:
                    _contexts(np.concatenate(held), places, sums)
                    held, n = [], 0
        if held:
            _contexts(np.concatenate(held), places, sums)
        used = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame({"slot": used} | {f"v{i}": sums[used, i] for i in range(width)})

    names = [f"v{i}" for i in range(width)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "slot int, " + ", ".join(f"{c} long" for c in names))
    total = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((slots, width))
    out[total["slot"].to_numpy(int)] = total[names].to_numpy(float)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(norm > 0, out / np.maximum(norm, 1), 0)
    return out.astype(np.float32)


class Model:
    """Vectors, input scaling, network and temperature."""

    def __init__(self, vectors, shift, scale, layers, temperature):
        self.vectors, self.shift, self.scale, self.layers, self.temperature = vectors, shift, scale, layers, temperature
        self.table = Slots(len(vectors))

    def __getstate__(self):
        return self.vectors, self.shift, self.scale, self.layers, self.temperature

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str | None) -> np.ndarray:
        """Mean and spread of word and shape vectors, likeness of neighbours, and log size; zeros for no token."""
        parts, width = [], self.vectors.shape[1]
        for ids in self.table.items(text):
            if not len(ids):
                return np.zeros(4 * width + 3, np.float32)
            v = self.vectors[ids]
            mean = v.mean(axis=0)
            spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, v) / len(v) - mean * mean, 0))
            parts += [mean, spread, [np.einsum("ij,ij->", v[1:], v[:-1]) / max(len(v) - 1, 1)]]
        return np.concatenate([*parts, [np.log1p(len(ids))]]).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray, hidden: int, rounds: int, rate: float, decay: float):
    rng = np.random.default_rng(3)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden),
         np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            t += 1
            h = np.tanh(x[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            for k, g in enumerate([x[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], e.sum()]):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return p


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS, hidden: int = 24,
        rounds: int = 40, rate: float = 3e-3, decay: float = 1e-3) -> Model:
    """Vectors over all documents; the network on at most ``train_rows`` labelled ones, a fifth of them for the temperature.

    Without both labels every score is the one label there is (0.5 without any).
    """
    vectors = word_vectors(docs)
    empty = Model(vectors, 0, 1, None, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(empty)

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(t) for t in texts])

    rows = labelled_sample(docs, labels, "quality", mod, held, train_rows).select("doc_id", "label", of("text").alias("x")).toPandas().sort_values("doc_id")
    width = 4 * WIDTH + 3
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, width), rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        only = 0.0 if not len(y) else 30.0 if y[0] else -30.0
        return Model(vectors, np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(only)], 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    part = np.arange(len(y)) % 5 == 4
    if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        part[:] = False
    layers = _train((x[~part] - shift) / scale, y[~part], hidden, rounds, rate, decay)
    model = Model(vectors, shift, scale, layers, 1.0)
    if part.any():
        z = model.logits(x[part])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[part] == 1, z, -z) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted added (or replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.probabilities(np.array([m.features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn("score", of(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
