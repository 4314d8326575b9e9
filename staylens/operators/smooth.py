"""Smooth trend: local linear regression with tricube weights and robust passes, over all rows.

The trend is fitted at a bounded number of places and is linear between them.  A place's fit needs only five weighted sums, which
every task adds up for all places over its own rows, so a pass is one scan whose shuffle is one row per task and place: rows are
neither sorted, nor copied into overlapping ranges, nor sampled.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import checkpointed, exact_quantiles

PLACES = 100
ACCURACY = 10_000  # rank error of a place or a window's reach beyond this many rows: one in this many
CHUNK = 4_096


def _windows(src: DataFrame, share: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and the reach of their windows: all values of x and exact distances if there are few, else quantiles."""
    counts = src.groupBy("x").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(counts) <= most:
        at, n = (np.array(v) for v in zip(*sorted((r.x, r.n) for r in counts))) if counts else (np.array([]), np.array([]))
        k, reach = max(1, int(share * n.sum() + 1e-10)), []
        for p in at:
            near = np.argsort(np.abs(at - p), kind="stable")
            reach.append(np.abs(at - p)[near][np.searchsorted(n[near].cumsum(), k)])
        return at, np.array(reach)
    total = src.count()
    k = max(1, int(share * total + 1e-10))
    at = np.unique(src.agg(F.percentile_approx("x", [i / (most - 1) for i in range(most)], ACCURACY).alias("p")).first().p)
    reach = src.agg(*[F.percentile_approx(F.abs(F.col("x") - float(p)), (k - 0.5) / total, ACCURACY).alias(f"r{i}") for i, p in enumerate(at)]).first()
    return at, np.array(reach, dtype=float)


def fitted(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Value of each place's weighted line, from sums (w, w dx, w dx dx, w y, w dx y) with dx counted from the place.

    Without spread in x it is the weighted mean, without weight the fit of the pass before.
    """
    s0, s1, s2, t0, t1 = sums.T
    with np.errstate(divide="ignore", invalid="ignore"):
        det = s0 * s2 - s1 * s1
        line, mean = (s2 * t0 - s1 * t1) / det, t0 / s0
    return np.where(s0 <= 0, before, np.where(det > 1e-12 * s0 * s2, line, mean))


def window_weights(x: np.ndarray, places: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Tricube weight of each row for each place; with reach 0 only equal values count."""
    away = np.abs(x[:, None] - places[None, :])
    u = np.where(reach > 0, away / np.where(reach > 0, reach, 1.0), np.where(away > 0, 1.0, 0.0))
    return np.clip(1 - np.clip(u, 0, 1) ** 3, 0, None) ** 3


def smooth_trend(df: DataFrame, x: str, y: str, share: float = 0.3, passes: int = 3, places: int = PLACES) -> DataFrame:
    """Trend of ``y`` over ``x``, one row per place: ``x``, ``trend``, ``reach`` (distance to the last row of its window).

    A window holds the nearest ``share`` of all rows.  After the first fit each of ``passes`` passes lowers the weight of rows
    far from the trend by the bisquare of their residual over six times the median residual.  Rows without x or y, or with a
    NaN there, are left out; no rows give no places.
    """
    src = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    schema = "x double, trend double, reach double"
    src = checkpointed(src)
    at, reach = _windows(src, share, places)
    if not len(at):
        return df.sparkSession.createDataFrame([], schema)

    def residuals(x: np.ndarray, y: np.ndarray, trend: np.ndarray) -> np.ndarray:
        return np.abs(y - np.interp(x, at, trend))

    def pass_over(trend: np.ndarray, scale: float | None) -> np.ndarray:
        """Fits of all places; rows are weighted by the residuals of ``trend`` if a scale is given."""
        def add(batches):
            total = np.zeros((len(at), 5))
            for b in batches:
                for start in range(0, len(b), CHUNK):
                    xs, ys = (b[c].to_numpy()[start:start + CHUNK] for c in ("x", "y"))
                    w = window_weights(xs, at, reach)
                    if scale is not None:
                        u = np.clip(residuals(xs, ys, trend) / scale, 0, 1)
                        w = w * ((1 - u * u) ** 2)[:, None]
                    dx = xs[:, None] - at[None, :]
                    wx, wy = w * dx, w * ys[:, None]
                    total += np.stack([w.sum(0), wx.sum(0), (wx * dx).sum(0), wy.sum(0), (wx * ys[:, None]).sum(0)], axis=1)
            yield pd.DataFrame(total, columns=list("abcde")).assign(place=np.arange(len(at)))
        sums = src.mapInPandas(add, "a double, b double, c double, d double, e double, place int").groupBy("place").agg(
            *[F.sum(c).alias(c) for c in "abcde"]).orderBy("place").collect()  # one row per place
        return fitted(np.array([[r[c] for c in "abcde"] for r in sums]), trend)

    trend = pass_over(np.zeros(len(at)), None)
    for _ in range(passes):
        now = trend

        def sizes(batches):
            for b in batches:
                yield pd.DataFrame({"e": residuals(b["x"].to_numpy(), b["y"].to_numpy(), now)})
        middle = exact_quantiles(src.mapInPandas(sizes, "e double"), [], {"m": ("e", 0.5)}).first().m
        if not middle:  # half of the rows lie on the trend
            break
        trend = pass_over(now, 6 * middle)
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in zip(at, trend, reach)], schema)
