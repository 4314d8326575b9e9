"""Language identification, word first: known words score by their log frequency in each language, unseen words fall
back to ever shorter character n-grams.

Words are runs of letters, lower-cased.  The fit counts words and character n-grams (of the word between two spaces) in a
bounded sample of training documents, about ``rows_per_language`` for each language, and keeps the ``words`` and
``grams`` most frequent.  A known word adds log frequencies; an unseen one is read from left to right, at each letter with
the longest known n-gram that starts there, and adds the mean of these.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, batches_of, pick

UNDETERMINED = "und"
ROWS_PER_LANGUAGE = 3_000
WORDS, GRAMS, LONGEST = 60_000, 60_000, 5
_WORD = re.compile(r"[^\W\d_]+")
_KEEP, _FLUSH = 200_000, 30_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str, longest: int = LONGEST) -> list[str]:
    w = f" {word} "
    return [w[i:i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language of words and n-grams (number in a table of rows); small enough for every worker.

    The last row of ``gram_logs`` is the floor for a letter that no n-gram knows.
    """

    def __init__(self, languages: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray,
                 longest: int = LONGEST):
        self.languages, self.words, self.word_logs, self.grams, self.gram_logs, self.longest = languages, words, word_logs, grams, gram_logs, longest
        self._index: dict[str, int] = {}
        self._rows = np.empty((1024, len(languages)))

    def __getstate__(self):
        return self.languages, self.words, self.word_logs, self.grams, self.gram_logs, self.longest

    def __setstate__(self, state):
        self.__init__(*state)

    def backoff(self, word: str) -> list[int]:
        """For each letter, the row of the longest known n-gram that starts there."""
        w, get, floor, out = f" {word} ", self.grams.get, len(self.grams), []
        sizes = range(self.longest, 0, -1)
        for i in range(len(w) - 1):
            for n in sizes:
                g = get(w[i:i + n])
                if g is not None:
                    break
            out.append(floor if g is None else g)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log frequencies if known, else the mean over its n-grams."""
        out = np.empty((len(words), len(self.languages)))
        known = [self.words.get(w, -1) for w in words]
        at = np.array(known, np.int64)
        out[at >= 0] = self.word_logs[at[at >= 0]]
        grams = [self.backoff(w) for w, k in zip(words, known) if k < 0]
        if grams:
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            sums = np.add.reduceat(self.gram_logs[np.fromiter((g for gs in grams for g in gs), np.int64, size.sum())], np.cumsum(size) - size, axis=0)
            out[at < 0] = sums / size[:, None]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); the evidence of n words counts as that of sqrt(n) independent ones."""
        words = words_of(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        if len(self._index) > _KEEP:
            self._index = {}
        index = self._index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            n = len(index)
            if n + len(new) > len(self._rows):
                self._rows = np.concatenate([self._rows[:n], np.empty((n + 2 * len(new), len(self.languages)))])
            self._rows[n:n + len(new)] = self.word_scores(new)
            index.update(zip(new, range(n, n + len(new))))
        z = self._rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(axis=0) / np.sqrt(len(words))
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """Counts over a hash-chosen share of each language's documents; rows without text or language teach nothing.

    The share is ``rows_per_language`` over the language's rows, so the sample is bounded however large the corpus is.
    Languages that only have empty texts are not learned; without any training row no language is.
    """
    rows = pick(docs, text="string", lang="string").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((1, 0)), longest)
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def table(lang, found):
        g = Counter()
        for word, n in found.items():
            for x in grams_of(word, longest):
                g[x] += n
        return pd.DataFrame([(kind, x, lang, n) for kind, c in enumerate((found, g)) for x, n in c.items()], columns=["kind", "item", "lang", "n"])

    def count(batches):
        got: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                w = got.setdefault(lang, Counter())
                w.update(words_of(text))
                if len(w) > _FLUSH:
                    yield table(lang, got.pop(lang))
        for lang, w in got.items():
            yield table(lang, w)

    counts = sample.mapInPandas(count, "kind int, item string, lang string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    by_item = counts.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    tables = []
    for kind, keep in ((0, words), (1, grams)):
        best = by_item.filter((F.col("kind") == kind) & (F.col("total") > 1)).orderBy(F.desc("total"), "item").limit(keep)
        with batches_of(docs.sparkSession, TEXTS_PER_BATCH):
            tables.append({r["item"]: r["by"] for r in best.toLocalIterator()})
    languages = sorted({k for by in tables[1].values() for k in by})
    parts = []
    for t in tables:
        c = np.array([[by.get(k, 0) for k in languages] for by in t.values()], float).reshape(len(t), len(languages)) + 0.5
        parts += [{x: i for i, x in enumerate(t)}, np.log(c / c.sum(axis=0))]
    parts[3] = np.vstack([parts[3], np.full(len(languages), np.log(1e-9))])
    return Model(languages, *parts, longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score added (or replaced); null texts and texts without a letter are ``und``, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    done = docs.withColumn("_language", of(F.col("text").cast("string")))
    return done.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")
