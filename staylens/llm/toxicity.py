"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of its distinct words, each by itself and by its first letters (hashed to
``BUCKETS``), so unseen forms of a known stem count; a document's is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels are known: the likelihood of the noisy-or passes the
blame for a toxic document to the sentences that best explain it, and that is what locates them afterwards.
"""

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, stored

BUCKETS = 1 << 18
TRAIN_ROWS = 6_000
LEAST_DOCS = 6
FEATURES = 10_000
STEMS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_KEEP = 300_000
_WHOLE, _STEM = crc32(b"="), crc32(b"^")


def sentences(text: str | None):
    """(words, start, end) arrays: lower-cased words, and the character range of each sentence that has words."""
    words, spans = [], []
    for m in _SENTENCE.finditer(text or ""):
        start, end = m.span()
        found = _WORD.findall(text, start, end)
        if found:
            words.append(" ".join(found).lower().split(" "))  # a space is no letter: each word is lower-cased by itself
            spans.append((_WORD.search(text, start).start(), end))
    return words, spans


def buckets(word: str) -> list[int]:
    """Hashes of the word and of its shorter beginnings, each beginning's from the one before."""
    raw = word.encode()
    out = [crc32(raw, _WHOLE) % BUCKETS]
    if len(raw) == len(word):
        last, c = 0, _STEM
        for n in STEMS:
            if n >= len(raw):
                break
            c = crc32(raw[last:n], c)
            out.append(c % BUCKETS)
            last = n
        return out
    return out + [crc32(word[:n].encode(), _STEM) % BUCKETS for n in STEMS if n < len(word)]


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self._seen = weights, bias, {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _weight(self, word: str) -> float:
        if len(self._seen) > _KEEP:
            self._seen.clear()
        return self._seen.setdefault(word, sum([x for x in map(self.weights.get, buckets(word)) if x]))

    def sentence_scores(self, words: list[list[str]]) -> np.ndarray:
        look, s = self._seen.__getitem__, []
        for w in words:
            w = dict.fromkeys(w)
            try:
                s.append(sum(map(look, w)))
            except KeyError:
                s.append(sum(map(self._weight, w)))
        return 1 / (1 + np.exp(-(np.array(s, dtype=float) + self.bias)))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of the sentences, and (start, end, score) of those at 0.5 or more; no sentence: 0."""
        words, spans = sentences(text)
        p = self.sentence_scores(words)
        total = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()) if len(p) else 0.0
        return float(total), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def _chosen_buckets(sample: DataFrame, least_docs: int, features: int) -> np.ndarray:
    """The ``features`` buckets whose presence in a document depends most on its label (chi-squared), in a fixed order."""
    def run(batches):
        for b in batches:
            seen = np.zeros((2, BUCKETS), np.int32)
            for label, text in zip(b["label"], b["text"]):
                seen[label, list({x for s in sentences(text)[0] for w in set(s) for x in buckets(w)})] += 1
            used = np.flatnonzero(seen.any(axis=0))
            yield pd.DataFrame({"bucket": used, "clean": seen[0, used], "toxic": seen[1, used]})

    n = dict(sample.groupBy("label").count().collect())
    counts = (sample.select("label", "text").mapInPandas(run, "bucket int, clean long, toxic long").groupBy("bucket")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= least_docs).toPandas())
    c, t = counts["clean"].to_numpy(float), counts["toxic"].to_numpy(float)
    rest = (n[0] - c, n[1] - t)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((t * rest[0] - c * rest[1]) ** 2 / ((c + t) * (rest[0] + rest[1])))
    return counts["bucket"].to_numpy()[np.lexsort((counts["bucket"], -chi))[:features]]


def _bags(sample: DataFrame, chosen: np.ndarray) -> pd.DataFrame:
    """label, chosen buckets (flat) and their number in each sentence of each sampled document; bounded by the sample."""
    def run(batches):
        keep = frozenset(chosen.tolist())
        for b in batches:
            rows = []
            for label, text in zip(b["label"], b["text"]):
                bags = [[x for w in dict.fromkeys(s) for x in buckets(w) if x in keep] for s in sentences(text)[0]]
                rows.append((label, [x for s in bags for x in s], [len(s) for s in bags]))
            yield pd.DataFrame(rows, columns=["label", "items", "sizes"])

    return sample.select("label", "text").mapInPandas(run, "label int, items array<int>, sizes array<int>").toPandas()


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS, least_docs: int = LEAST_DOCS,
        features: int = FEATURES, rounds: int = 150, rate: float = 0.05, ridge: float = 0.4) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam, on at most ``train_rows`` labelled documents.

    Only the ``features`` words and stems that depend most on the label, of ``least_docs`` sampled documents or more, have
    a weight; what reaches the driver is bounded by them and by the sample.  Without both labels there is nothing to learn:
    the score of every sentence is then 0 (or 1 where all labels are 1).
    """
    sample = stored(labelled_sample(docs, labels, "toxic", mod, held, train_rows), "toxicity-sample")
    known = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(known) < 2:
        return Model({}, 30.0 if known == {1} else -30.0)
    chosen = _chosen_buckets(sample, least_docs, features)
    bags = _bags(sample, chosen)
    y = bags["label"].to_numpy(float)
    flat = np.concatenate([np.asarray(x, np.int32) for x in bags["items"]])
    sizes = np.concatenate([np.asarray(x, np.int32) for x in bags["sizes"]])
    doc_of = np.repeat(np.arange(len(y)), bags["sizes"].map(len))
    code = np.zeros(BUCKETS, np.int32)
    code[chosen] = np.arange(len(chosen))
    item, owner = code[flat], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n, m = len(sizes), len(chosen)
    w, b = np.zeros(m), np.log(max(y.mean(), 1e-3) * len(y) / n)
    moments = [np.zeros(m + 1), np.zeros(m + 1)]
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[item], n) + b, -30, 30)))
        safe = np.bincount(doc_of, np.log1p(-p), len(y))  # log of the chance that no sentence is toxic
        blame = np.where(y == 1, np.exp(safe) / -np.expm1(np.minimum(safe, -1e-12)), -1.0)
        d = blame[doc_of] * p
        g = np.append(np.bincount(item, d[owner], m), d.sum()) / len(y) - ridge / len(y) * np.append(w, 0.0)
        moments = [0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g]
        step = rate * (moments[0] / (1 - 0.9 ** t)) / (np.sqrt(moments[1] / (1 - 0.999 ** t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return Model({int(k): float(x) for k, x in zip(chosen, w) if abs(x) > 1e-4}, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, predicted and offending (start, end, score of each toxic sentence, in characters) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, score: double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = [shared.value.score(t) for t in texts]
        return pd.DataFrame({"score": [g[0] for g in got], "offending": [[{"start": a, "end": e, "score": p} for a, e, p in g[1]] for g in got]})

    done = docs.withColumn("_toxic", of(F.col("text").cast("string")))
    return done.withColumns({"score": F.col("_toxic.score"), "offending": F.col("_toxic.offending"),
                             "predicted": (F.col("_toxic.score") >= 0.5).cast("int")}).drop("_toxic")
