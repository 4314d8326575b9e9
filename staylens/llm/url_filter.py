"""URL filter: prefix rules first, else a naive Bayes verdict over segmented host words and path words.

Rules name a host and the start of a path; the longest that fits decides.  For the other URLs the host's labels are cut
into words by the most probable segmentation under unigram frequencies (Viterbi), so "freebets" reads as "free bets"; the
frequencies are those of the words that the corpus itself writes apart (by dots, hyphens, slashes).  The classifier's
classes come from seed words: a host that contains one after segmentation teaches "block", all others teach "allow", over
all rows.  Words that keep company with the seeds, in hosts or in paths, then count against a URL as well.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values of the contract: (rule, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: fixed values: words of gambling, pill, adult and tracking sites
SEEDS = frozenset("casino poker slots betting bets bet jackpot roulette pills pill viagra cialis pharma porn xxx adult escort "
                  "ads adserver tracker track tracking clickbait banner popup warez torrent crack loan payday replica".split())
WORDS = 50_000
LONGEST = 24
_SPLIT = re.compile(r"[^a-z0-9]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.  ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segment(text: str, costs: dict[str, float], unknown: float, longest: int = LONGEST) -> list[str]:
    """The cheapest cut of ``text`` into known words; a letter outside them costs ``unknown``, and such letters run together."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        cost, at = best[end - 1] + unknown, end - 1
        for start in range(max(0, end - longest), end):
            c = costs.get(text[start:end])
            if c is not None and best[start] + c < cost:
                cost, at = best[start] + c, start
        best.append(cost)
        back.append(at)
    out, end = [], len(text)
    while end:
        out.append(text[back[end]:end])
        end = back[end]
    words, run = [], ""
    for w in reversed(out):
        if w in costs:
            words += [run] * bool(run) + [w]
            run = ""
        else:
            run += w
    return words + [run] * bool(run)


class Model:
    """Unigram costs, token log odds (block over allow) and the prior's log odds."""

    def __init__(self, costs: dict[str, float], unknown: float, odds: dict[str, float] | None = None, prior: float = 0.0):
        self.costs, self.unknown, self.odds, self.prior = costs, unknown, odds or {}, prior

    def host_words(self, host: str) -> list[str]:
        return [w for part in _SPLIT.split(host) if part for w in segment(part, self.costs, self.unknown)]

    def tokens(self, host: str, path: str) -> list[str]:
        words = ["h:" + w for w in self.host_words(host)[:-1]]  # the last host word is the top-level domain
        return words + ["p:" + w for w in _SPLIT.split(path.lower()) if w and not w.isdigit()]

    def block_probability(self, host: str, path: str) -> float:
        z = self.prior + sum(self.odds.get(t, 0.0) for t in self.tokens(host, path))
        return 1 / (1 + np.exp(-min(max(z, -50), 50)))


def fit(pages: DataFrame, seeds: frozenset[str] = SEEDS, words: int = WORDS) -> Model:
    """Counts over all URLs; the ``words`` most frequent words and tokens are kept, which bounds the model.

    Seed words are known from the start.  Without any blocked host the prior is low and no token speaks against a URL.
    """
    parts = pages.select(host_of(F.col("url")).alias("host"), F.lower(path_of(F.col("url"))).alias("path")).filter("host <> ''")
    apart = parts.select(F.explode(F.split(F.concat_ws("/", "host", "path"), "[^a-z0-9]+")).alias("w"))
    best = (apart.filter((F.length("w") > 1) & (F.length("w") <= LONGEST) & ~F.col("w").rlike("[0-9]"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(words).toPandas())
    counts = dict(zip(best["w"], best["n"].astype(float)))
    for s in seeds:
        counts[s] = counts.get(s, 0.0) + 1.0
    total = sum(counts.values()) + 1
    costs = {w: float(-np.log(n / total)) for w, n in counts.items()}
    model = Model(costs, float(np.log(total)) + 1.0)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def tokens(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(shared.value.tokens(h, p))) for h, p in zip(hosts, paths)])

    seen = parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("t", tokens("host", "path"))
    bad = F.exists("t", lambda t: t.isin(["h:" + s for s in sorted(seeds)]))
    by_token = seen.select("n", bad.alias("bad"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("t"))
    table = (by_token.groupBy("t").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"),
                                       F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a"))
             .orderBy(F.desc(F.col("a") + F.col("b")), "t").limit(words).toPandas())
    rows = {t: (float(b), float(a)) for t, b, a in zip(table["t"], table["b"], table["a"])}
    block, allow = rows.pop("", (0.0, 0.0))
    mass = [sum(r[i] for r in rows.values()) + len(rows) for i in (0, 1)]
    odds = {t: float(np.log((b + 1) / mass[0]) - np.log((a + 1) / mass[1])) for t, (b, a) in rows.items()} if block else {}
    return Model(costs, model.unknown, odds, float(np.log((block + 1) / (allow + 1))))


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and ``host_words`` and ``block_probability`` of the classifier.

    A null URL or one without ``://`` has an empty host and path, no rule, and the classifier's verdict on no words.
    Repeated rows are judged one by one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("host_words array<string>, p double")
    def of(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame({"host_words": [m.host_words(h) for h in hosts], "p": [m.block_probability(h, p) for h, p in zip(hosts, paths)]})

    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, "nb": of("host", "path")})
    by_model = F.when(F.col("nb.p") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"),
                       F.col("nb.host_words").alias("host_words"), F.col("nb.p").alias("block_probability"))
