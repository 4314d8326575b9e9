"""Tie-averaged ranks of many columns at once, by place in one global sort, and rank correlation from them.

All columns are sorted together as rows of (measure, value, row id).  The row id in the order spreads equal values over
several ranges, so a value that holds a third of the rows is no hot task, and nothing is ever joined on a value: each
range finds the runs of equal values inside itself, only the runs at its two ends can reach into other ranges, and
these are put together from one row per range and measure.  Ranks go back to their rows by row id, which is unique.
A column with few different values is not sorted at all: its ranks are a short list that every task looks up.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import ratio, rows
from .ordering import ONE_TASK_ROWS, checkpointed, spread_sort

FEW_VALUES = 100_000  # different values of a column whose ranks are broadcast, as counted by a sketch
FIRST_RUN, LAST_RUN = 1, 2
_RUNS = "id long, measure int, value double, _part int, _start long, _n long, _edge int"


def _local_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal values inside one sorted range, which ``spread_sort`` keeps to a few million rows."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    measure, value = pdf["measure"].to_numpy(), pdf["value"].to_numpy()
    same_value = (value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1]))
    new_measure = np.r_[True, measure[1:] != measure[:-1]]
    new_run = new_measure | np.r_[True, ~same_value]
    run = np.cumsum(new_run) - 1
    starts = np.flatnonzero(new_run)
    sizes = np.diff(np.r_[starts, len(pdf)])
    opens = np.maximum.accumulate(np.where(new_measure, np.arange(len(pdf)), 0))[starts]
    edge = np.where(new_measure[starts], FIRST_RUN, 0) | np.where(np.r_[new_measure[starts[1:]], True], LAST_RUN, 0)
    yield pd.DataFrame({"id": pdf["id"], "measure": measure, "value": value, "_part": pdf["_part"].astype("int32"),
                        "_start": (starts - opens)[run], "_n": sizes[run], "_edge": edge[run].astype("int32")})


def average_ranks(long: DataFrame, total_rows: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(id, measure, rank) of rows (id, measure, value); equal values of a measure share their mean rank.

    ``value`` must not be NULL; NaN is the largest value.  Up to ``one_task_rows`` rows a plain window does.
    """
    if total_rows <= one_task_rows:
        order, ties = Window.partitionBy("measure").orderBy("value"), Window.partitionBy("measure", "value")
        return long.select("id", "measure", (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)).alias("rank"))
    ordered = spread_sort(long.select("measure", "value", "id"), ["measure", "value", "id"], total_rows)
    placed = checkpointed(ordered.select("id", "measure", "value", "_part").mapInPandas(_local_runs, _RUNS))
    placed = placed.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # pandas hands NaN back as NULL
    opening, closing = F.col("_edge").bitwiseAND(F.lit(FIRST_RUN)) > 0, F.col("_edge").bitwiseAND(F.lit(LAST_RUN)) > 0
    # one row per range and measure: at most ranges + measures rows, so windows, joins and broadcast below are bounded
    ranges = checkpointed(placed.groupBy("_part", "measure").agg(
        rows().alias("_rows"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.max(F.when(opening, F.col("_n"))).alias("_n_lo"), F.max(F.when(closing, F.col("_n"))).alias("_n_hi")))
    before = Window.partitionBy("measure").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    ends = ranges.select("measure", F.inline(F.array(
        F.struct(F.col("_lo").alias("value"), F.col("_base").alias("_s"), F.col("_n_lo").alias("_c")),
        F.struct(F.col("_hi").alias("value"), (F.col("_base") + F.col("_rows") - F.col("_n_hi")).alias("_s"), F.col("_n_hi").alias("_c"))))
    ).distinct()  # a range that one run fills names it twice
    mean = F.min("_s") + (F.sum("_c") + 1) / F.lit(2.0)
    whole = ends.groupBy("measure", "value").agg(mean.alias("_mean"))
    sides = ranges.select("_part", "measure", "_base", "_lo", "_hi")
    for side in ("_lo", "_hi"):
        sides = sides.join(whole.select("measure", F.col("value").alias(side), F.col("_mean").alias(f"_mean{side}")), ["measure", side])
    out = placed.join(F.broadcast(sides.select("_part", "measure", "_base", "_mean_lo", "_mean_hi")), ["_part", "measure"])
    inner = F.col("_base") + F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)
    return out.select("id", "measure", F.when(opening, F.col("_mean_lo")).when(closing, F.col("_mean_hi")).otherwise(inner).alias("rank"))


def _listed_ranks(base: DataFrame, values: dict[int, Column]) -> DataFrame:
    """``base`` with a rank column ``r<measure>`` for columns of few values, whose counts fit in a broadcast."""
    items = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in values.items()])
    cells = base.select(F.inline(items)).filter("value IS NOT NULL").groupBy("measure", "value").agg(rows().alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("measure").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = checkpointed(cells.select("measure", "value", (upto - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)).alias("rank")))
    for m, v in values.items():
        mine = listed.filter(F.col("measure") == m).select(F.col("value").alias(f"v{m}"), F.col("rank").alias(f"r{m}"))
        base = base.join(F.broadcast(mine), v == F.col(f"v{m}"), "left")
    return base.select("id", *[f"r{m}" for m in values])


def rank_correlations(df: DataFrame, pairs: list[tuple[str, str]], few_values: int = FEW_VALUES,
                      one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Spearman's rho of each pair of columns over the rows where both are known.

    A column without gaps is ranked once for all its pairs; a pair with a gap has two measures of its own.  A pair
    without spread in a column has no rho.
    """
    names = sorted({c for p in pairs for c in p})
    at = {c: f"c{i}" for i, c in enumerate(names)}
    base = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(at[c]) for c in names], F.monotonically_increasing_id().alias("id"))
    both = [F.col(at[x]).isNotNull() & F.col(at[y]).isNotNull() for x, y in pairs]
    seen = base.agg(rows().alias("rows"), *[F.count(c).alias(c) for c in at.values()],
                    *[F.approx_count_distinct(c).alias(f"d{c}") for c in at.values()],
                    *[F.count_if(b).alias(f"p{i}") for i, b in enumerate(both)]).first()
    full = {c for c in names if seen[at[c]] == seen["rows"]}
    measures: dict[tuple, int] = {}
    few, many, sides, total = {}, {}, [], 0
    for i, (x, y) in enumerate(pairs):
        place = []
        for c in (x, y):
            key = (c,) if x in full and y in full else (c, i)
            if key not in measures:
                m = measures[key] = len(measures)
                short = seen[f"d{at[c]}"] <= few_values
                (few if short else many)[m] = F.when(both[i], F.col(at[c]))
                total += 0 if short else seen[f"p{i}"]
            place.append(measures[key])
        sides.append(tuple(place))
    base = checkpointed(base) if many else base  # row ids must not change between two readings
    wide = _listed_ranks(base, few) if few else None
    if many:
        long = base.select("id", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in many.items()])))
        ranked = average_ranks(long.filter("value IS NOT NULL"), total, one_task_rows)
        found = ranked.select("id", *[F.when(F.col("measure") == m, F.col("rank")).alias(f"r{m}") for m in many])
        found = found if wide is None else found.unionByName(wide, allowMissingColumns=True)
        wide = found.groupBy("id").agg(*[F.max(f"r{m}").alias(f"r{m}") for m in [*few, *many]])
    sums = []
    for i, (a, b) in enumerate(sides):
        middle = (seen[f"p{i}"] + 1) / 2  # the mean rank is known, so products are centred before they are summed
        da, db = F.col(f"r{a}") - F.lit(middle), F.col(f"r{b}") - F.lit(middle)
        sums += [F.sum(da * db).alias(f"xy{i}"), F.sum(da * da).alias(f"xx{i}"), F.sum(db * db).alias(f"yy{i}")]
    return wide.agg(*sums).select(F.inline(F.array(*[F.struct(
        F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.lit(seen[f"p{i}"]).cast("long").alias("n"),
        ratio(f"xy{i}", F.sqrt(F.col(f"xx{i}") * F.col(f"yy{i}"))).alias("rho")) for i, (x, y) in enumerate(pairs)])))
