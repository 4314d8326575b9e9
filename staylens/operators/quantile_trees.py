"""Boosted trees with the pinball loss: interval bounds that may bend, grown from histograms on the cluster.

A round grows several trees for every quantile at once, each on its own draw of rows and features, and adds their mean, so
the number of scans follows the rounds and the depth, not the number of trees.  Per level each task counts, for every
(tree, node), the rows and the rows below the current fit by feature and bin; the counts are added where they stream by,
the best split of a node is chosen there, and only the splits reach the driver.  A leaf holds the quantile of its residuals.

Row draws come from a hash of the key, so a repeated task counts the same rows.  Scores are written every
``WRITE_EVERY`` rounds; between, a task adds the few trees grown since.
"""

import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from .ordering import checkpointed

BINS = 32
WRITE_EVERY = 10
ACCURACY = 10_000  # rank error of an edge: one in this many
EDGE_COLUMNS = 100  # features whose edges are found in one aggregate
POINTS = 200_000  # residuals of a leaf that one level holds
ROWS_HELD = 100_000  # rows of a task whose residuals are handed on together
PACKED_CELLS = 128  # features of few bins are counted together in up to so many joint bins


class QuantileTrees:
    """Complete binary trees of one depth; ``transform`` adds ``yhat``."""

    def __init__(self, tau: float, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, rows: np.ndarray, width: int):
        self.tau, self.base, self.width = tau, base, width
        self.feature, self.threshold, self.value, self.rows = feature, threshold, value, rows  # feature -1: no split, all go left

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(x), self.base), np.ascontiguousarray(np.transpose(x))
        for t in range(len(self.feature)):
            out += self.value[t][_leaf(columns, self.feature[t], self.threshold[t])]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in x:
                yield pd.Series(model.predict(np.stack(part.to_numpy())) if len(part) else [], dtype="float64")
        return df.withColumn("yhat", score(vector_to_array("features")))

    def nodes(self) -> list[tuple]:
        """(tree, node, left, right, feature, threshold, value, rows) with -1 for no child."""
        out, inner = [], self.feature.shape[1]
        for t in range(len(self.feature)):
            below = np.zeros(2 * inner + 1)
            below[inner:] = self.rows[t]
            for n in range(inner - 1, -1, -1):
                below[n] = below[2 * n + 1] + below[2 * n + 2]
            for n in range(2 * inner + 1):
                split = n < inner
                f = int(self.feature[t][n]) if split else -1
                out.append((t, n, 2 * n + 1 if split else -1, 2 * n + 2 if split else -1, f,
                            float(self.threshold[t][n]) if f >= 0 else float("inf"), 0.0 if split else float(self.value[t][n - inner]), float(below[n])))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per tree."""
        rows = [(t, self.feature[t].tolist(), self.threshold[t].tolist(), self.value[t].tolist(), self.rows[t].tolist(),
                 json.dumps([self.tau, self.base, self.width])) for t in range(len(self.feature))]
        spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, value array<double>, leaf_rows array<double>, "
                                    "settings string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileTrees":
        rows = spark.read.parquet(path).orderBy("tree").collect()  # one row per tree
        tau, base, width = json.loads(rows[0].settings)
        return cls(tau, base, *[np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value", "leaf_rows")], width)


def _routed(n: int, feature: np.ndarray, levels: int, right_of) -> np.ndarray:
    """Node of each of ``n`` rows after some levels, counted from the level's first node.

    ``right_of(node)`` says of all rows whether they would go right there: whole columns are compared, one per node, which
    is much cheaper than looking up another feature for each row.
    """
    at, here = np.zeros(n, dtype=np.uint8 if levels <= 8 else np.int64), [np.ones(n, dtype=bool)]
    for level in range(levels):
        at, below = at << 1, []
        for k, rows in enumerate(here, 2 ** level - 1):
            right = rows & right_of(k) if feature[k] >= 0 else np.zeros(n, dtype=bool)
            at |= right
            below += [rows & ~right, right]
        here = below
    return at


def _leaf(columns: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Leaf number of each row; a missing value goes right, as every comparison with it fails."""
    return _routed(columns.shape[1], feature, int(np.log2(len(feature) + 1)), lambda k: ~(columns[feature[k]] <= threshold[k]))


def _node(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Node of each row at a level, counted from the level's first node; ``columns`` holds the bins of each feature."""
    return _routed(columns.shape[1], feature, level, lambda k: columns[feature[k]] > cut[k])


def packs_of(sizes: list[int]) -> list[list[int]]:
    """Features with the given numbers of bins, in groups of at most ``PACKED_CELLS`` joint bins."""
    out, cells = [], PACKED_CELLS + 1
    for f in sorted(range(len(sizes)), key=lambda f: sizes[f]):
        if cells * sizes[f] > PACKED_CELLS:
            out.append([])
            cells = 1
        out[-1].append(f)
        cells *= sizes[f]
    return out


class Packed:
    """Counts of rows by feature and bin, taken over joint bins of the features of a pack and summed to each feature's at the end."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.packs = sizes, packs_of(sizes)
        self.start = np.cumsum([0] + [int(np.prod([sizes[f] for f in p])) for p in self.packs])
        self.cells = int(self.start[-1])

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """The joint bin of each row (first axis) in each pack."""
        out = np.empty((columns.shape[1], len(self.packs)), dtype=np.int64)
        for k, pack in enumerate(self.packs):
            code = np.zeros(columns.shape[1], dtype=np.int64)
            for f in pack:
                code = code * self.sizes[f] + columns[f]
            out[:, k] = code + self.start[k]
        return out

    def by_feature(self, joint: np.ndarray, bins: int = BINS) -> np.ndarray:
        """(row, feature, bin) counts of the rows of joint counts."""
        out = np.zeros((len(joint), len(self.sizes), bins), dtype=np.int64)
        for k, pack in enumerate(self.packs):
            box = joint[:, self.start[k]:self.start[k + 1]].reshape([len(joint), *(self.sizes[f] for f in pack)])
            for i, f in enumerate(pack, 1):
                out[:, f, :self.sizes[f]] = box.sum(axis=tuple(j for j in range(1, len(pack) + 1) if j != i))
        return out


class Residuals:
    """Values of one leaf for its quantiles: all of them up to ``POINTS``.

    Above it a level that is full hands every second value of its order to the next one, where each counts twice: a rank is off by at
    most levels / ``POINTS`` of the values.
    """

    def __init__(self):
        self.levels, self.turns, self.n = [[]], [0], 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        if level == 0:
            self.n += len(values)
        if level == len(self.levels):
            self.levels.append([])
            self.turns.append(0)
        held = self.levels[level]
        held.append(values)
        if sum(map(len, held)) > POINTS:
            full = np.sort(np.concatenate(held))
            even = len(full) // 2 * 2
            self.levels[level] = [full[even:]]
            self.turns[level] += 1
            self.add(full[self.turns[level] % 2:even:2], level + 1)

    def quantile(self, p: float) -> float:
        """The value of rank ceil(p n), as ``percentile_approx`` defines it."""
        value = np.concatenate([v for held in self.levels for v in held])
        weight = np.concatenate([np.full(len(v), 1 << k) for k, held in enumerate(self.levels) for v in held])
        order = np.argsort(value, kind="stable")
        rank = 1 if p <= 1 / ACCURACY else self.n if p >= 1 - 1 / ACCURACY else int(np.ceil(p * self.n))
        return float(value[order[min(np.searchsorted(np.cumsum(weight[order]), rank), len(value) - 1)]])


def _drawn(hashes: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Rows of a tree: a mix of the row's hash and the tree's number below the share."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < share


def bin_edges(data: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper edges per feature: its smallest value and its quantiles; values above the last edge form the last bin."""
    probs = [i / (bins - 1) for i in range(bins)]
    src = data.select(vector_to_array("features").alias("x"))
    out = []
    for start in range(0, width, EDGE_COLUMNS):
        mine = range(start, min(start + EDGE_COLUMNS, width))
        row = src.agg(*[F.percentile_approx(F.col("x")[i], probs, ACCURACY).alias(f"e{i}") for i in mine]).first()
        out += [np.unique([v for v in row[f"e{i}"] or [] if v == v])[:bins - 1] for i in mine]
    return out


def best_split(counts: np.ndarray, tau: float, allowed: np.ndarray, min_rows: int) -> tuple[int, int, float]:
    """Feature, bin and gain of the best cut of one node from counts[feature, bin, below]; feature -1 if none gains.

    The slope of the loss is tau for a row above the fit and tau - 1 for one below; the gain is the drop in its squared sums.
    """
    n = counts.sum(axis=2).cumsum(axis=1).astype(float)
    slope = tau * n - counts[:, :, 1].cumsum(axis=1)
    rows, total = n[:, -1:], slope[:, -1:]
    rest = rows - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = slope ** 2 / n + (total - slope) ** 2 / rest - total ** 2 / rows
    ok = (n >= min_rows) & (rest >= min_rows) & allowed[:, None]
    gain = np.where(ok, gain, -1.0)
    at = int(gain.argmax())  # ties: the first feature, then the lowest bin
    f, b = divmod(at, counts.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 1e-9 else (-1, 0, 0.0)


def fit_quantile_trees(data: DataFrame, taus: tuple = settings.QUANTILES, rounds: int = settings.QUANTILE_TREES["rounds"],
                       trees: int = settings.QUANTILE_TREES["trees"], depth: int = settings.QUANTILE_TREES["depth"],
                       step: float = settings.QUANTILE_TREES["step"], row_share: float = settings.QUANTILE_TREES["row_share"],
                       feature_share: float = settings.QUANTILE_TREES["feature_share"], min_rows: int = settings.QUANTILE_TREES["min_rows"],
                       key: str = "listing_id", seed: int = settings.SPLIT_SEED) -> dict[float, QuantileTrees]:
    """One ensemble per quantile from the rows of ``data`` with a target, all grown in the same scans."""
    src = data.filter(F.col("target").isNotNull())
    one = src.select(F.size(vector_to_array("features")).alias("p")).first()
    if one is None:
        raise ValueError("no rows with a target")
    width, q = one.p, len(taus)
    edges = bin_edges(src, width)
    start = src.agg(F.percentile_approx("target", [float(t) for t in taus], ACCURACY).alias("b")).first().b

    scores = [f"s{i}" for i in range(q)]
    names = ["h", "y", "bins", *scores]

    def binned(batches):
        for b in batches:
            x = np.ascontiguousarray(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width).T)
            codes = np.stack([np.searchsorted(edges[f], x[f], side="left") for f in range(width)], axis=1).astype(np.uint8)
            ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), packed, *[pa.array(np.full(b.num_rows, float(v))) for v in start]], names)
    schema = "h long, y double, bins binary, " + ", ".join(f"{c} double" for c in scores)
    state = checkpointed(src.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col("target").cast("double").alias("y"),
                                    vector_to_array("features").alias("x")).mapInArrow(binned, schema))
    packed = Packed([len(e) + 1 for e in edges])
    inner, leaves, jobs = 2 ** depth - 1, 2 ** depth, trees * q
    grown: list[tuple] = []  # (feature, cut, value, rows) of each finished round, trees of quantile 0 first
    recent: list[tuple] = []

    def loaded(batches, past):
        """Each batch with its hashes, targets, bins by feature and current scores by quantile."""
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(b.num_rows, width).T)
                h, y, *s = (np.array(b.column(c)) for c in ["h", "y", *scores])
                for feature, cut, value, _ in past:
                    for j in range(jobs):
                        s[j // trees] += value[j][_node(x, feature[j], cut[j], depth)]
                yield b, h, y, x, s

    def draw(r: int, j: int) -> np.ndarray:
        chosen = random.Random(f"{seed}|{r}|{j}").sample(range(width), max(1, round(width * feature_share)))
        mask = np.zeros(width, dtype=bool)
        mask[chosen] = True
        return mask

    def splits_of_level(r: int, level: int, feature: np.ndarray, cut: np.ndarray, past: list) -> list:
        nodes = 2 ** level

        def count(batches):
            total = np.zeros((jobs, nodes * 2, packed.cells), dtype=np.int64)
            for _, h, y, x, s in loaded(batches, past):
                codes = packed.codes(x)
                for j in range(jobs):
                    mine = np.flatnonzero(_drawn(h, r * jobs + j, row_share))
                    slot = (_node(x, feature[j], cut[j], level).astype(np.uint16 if level < 15 else np.int64) * 2 + (y < s[j // trees]))[mine]
                    rows, ends = codes[mine[np.argsort(slot, kind="stable")]], np.cumsum(np.bincount(slot, minlength=nodes * 2))
                    for k, (first, last) in enumerate(zip([0, *ends], ends)):
                        if last > first:
                            total[j, k] += np.bincount(rows[first:last].ravel(), minlength=packed.cells)
            for j in range(jobs):
                used = [n for n in range(nodes) if total[j, 2 * n:2 * n + 2].any()]
                if used:
                    sides = packed.by_feature(total[j]).reshape(nodes, 2, width, BINS)
                    counts = [np.ascontiguousarray(sides[n].transpose(1, 2, 0)).tobytes() for n in used]
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(counts, pa.binary())], ["tree", "node", "counts"])

        def choose(batches):
            total: dict = {}
            for b in batches:
                for j, n, c in zip(b["tree"], b["node"], b["counts"]):
                    c = np.frombuffer(c, dtype=np.int64)
                    total[j, n] = total[j, n] + c if (j, n) in total else c
            for (j, n), c in total.items():
                f, k, _ = best_split(c.reshape(width, BINS, 2), taus[j // trees], draw(r, j), min_rows)
                if f >= 0:
                    yield pd.DataFrame({"tree": [j], "node": [n], "feature": [f], "cut": [k]})
        return (state.mapInArrow(count, "tree int, node int, counts binary").repartition("tree", "node")
                .mapInPandas(choose, "tree int, node int, feature int, cut int").collect())  # at most one row per tree and node

    def leaf_values(r: int, feature: np.ndarray, cut: np.ndarray, past: list) -> tuple[np.ndarray, np.ndarray]:
        def residuals(batches):
            """Each leaf's residuals of some rows, as one row."""
            held: dict = {}
            n = 0

            def handed_on():
                for slot, parts in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["slot", "e"])
            for _, h, y, x, s in loaded(batches, past):
                for j in range(jobs):
                    mine = _drawn(h, r * jobs + j, row_share) & ~np.isnan(y)
                    leaf, e = _node(x, feature[j], cut[j], depth)[mine], (y - s[j // trees])[mine]
                    e, ends = e[np.argsort(leaf, kind="stable")], np.cumsum(np.bincount(leaf, minlength=leaves))
                    for k, (first, last) in enumerate(zip([0, *ends], ends)):
                        if last > first:
                            held.setdefault(j * leaves + k, []).append(e[first:last])
                n += len(h)
                if n >= ROWS_HELD:
                    yield from handed_on()
                    held, n = {}, 0
            yield from handed_on()

        def quantiles(batches):
            found: dict = {}
            for b in batches:
                for slot, e in zip(b.column("slot").to_pylist(), b.column("e").to_pylist()):
                    found.setdefault(slot, Residuals()).add(np.frombuffer(e))
            for slot, of in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([of.quantile(float(taus[slot // leaves // trees]))]), pa.array([of.n], pa.int64())], ["slot", "v", "n"])
        got = state.mapInArrow(residuals, "slot long, e binary").repartition("slot").mapInArrow(quantiles, "slot long, v double, n long").collect()  # one row per leaf
        value, rows = np.zeros((jobs, leaves)), np.zeros((jobs, leaves))
        for g in got:
            j, leaf = divmod(g.slot, leaves)
            value[j, leaf], rows[j, leaf] = g.v * step / trees, g.n
        return value, rows

    for r in range(rounds):
        feature, cut = np.full((jobs, inner), -1), np.zeros((jobs, inner), dtype=np.int64)
        for level in range(depth):
            for s in splits_of_level(r, level, feature.copy(), cut.copy(), list(recent)):
                at = 2 ** level - 1 + s.node
                feature[s.tree, at], cut[s.tree, at] = s.feature, s.cut
        value, rows = leaf_values(r, feature, cut, list(recent))
        grown.append((feature, cut, value, rows))
        recent.append(grown[-1])
        if len(recent) == WRITE_EVERY and r + 1 < rounds:
            past = list(recent)

            def scored(batches):
                for b, *_, s in loaded(batches, past):
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:3]] + [pa.array(v) for v in s], names)
            state, recent = checkpointed(state.mapInArrow(scored, schema)), []

    def model(i: int) -> QuantileTrees:
        mine = slice(i * trees, (i + 1) * trees)
        feature, cut, value, rows = (np.concatenate([g[k][mine] for g in grown]) for k in range(4))
        threshold = np.array([[edges[f][c] if f >= 0 else np.inf for f, c in zip(fs, cs)] for fs, cs in zip(feature, cut)])
        return QuantileTrees(float(taus[i]), float(start[i]), feature, threshold, value, rows, width)
    return {t: model(i) for i, t in enumerate(taus)}
