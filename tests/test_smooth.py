"""Smooth trend against a plain numpy version."""

import numpy as np
import pytest

from staylens.operators.smooth import smooth_trend


def plain_trend(x, y, places, share=0.3, passes=3):
    """Row by row: the nearest rows by sorting, one weighted least-squares line per place."""
    k, weights, trend = max(1, int(share * len(x) + 1e-10)), np.ones(len(x)), None
    for _ in range(passes + 1):
        out = []
        for p in places:
            away = np.abs(x - p)
            reach = np.sort(away)[k - 1]
            w = (1 - np.minimum(away / reach, 1) ** 3) ** 3 if reach > 0 else (away == 0).astype(float)
            w = w * weights
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            var = np.average((x - mx) ** 2, weights=w)
            slope = np.average((x - mx) * (y - my), weights=w) / var if var > 1e-12 else 0.0
            out.append(my + slope * (p - mx))
        trend = np.array(out)
        size = np.abs(y - np.interp(x, places, trend))
        weights = (1 - np.minimum(size / (6 * np.median(size)), 1) ** 2) ** 2
    return trend


def rows_of(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)


@pytest.mark.parametrize("passes", [0, 3])
@pytest.mark.parametrize("kind", ["spread", "whole", "hot"])
def test_smooth_trend_equals_numpy(spark, kind, passes):
    rng = np.random.default_rng(5)
    x = rng.random(500) * 10
    if kind != "spread":
        x = np.floor(x)
    if kind == "hot":
        x[:260] = 4.0  # one value holds more than a window
    y = np.sin(x) + rng.normal(0, 0.2, 500)
    y[::50] += 8  # outliers that the robust passes set aside
    got = smooth_trend(rows_of(spark, x, y), "x", "y", passes=passes).orderBy("x").collect()
    places = np.array([r.x for r in got])
    assert places.min() == x.min() and places.max() == x.max() and (kind == "spread" or set(places) == set(x))
    assert np.allclose([r.trend for r in got], plain_trend(x, y, places, passes=passes), atol=1e-8)


def test_smooth_trend_edge_cases(spark):
    schema = "x double, y double"
    assert smooth_trend(spark.createDataFrame([], schema), "x", "y").count() == 0
    odd = spark.createDataFrame([(1.0, 5.0), (None, 2.0), (1.0, None), (float("nan"), 1.0)], schema)
    assert [tuple(r) for r in smooth_trend(odd, "x", "y").collect()] == [(1.0, 5.0, 0.0)]
    line = smooth_trend(rows_of(spark, range(400), [3 * v + 1 for v in range(400)]), "x", "y").collect()
    assert all(abs(r.trend - 3 * r.x - 1) < 1e-6 for r in line)
