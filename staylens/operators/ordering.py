"""Ordered work on groups of any size: keys, positions, running totals, ranks, exact quantiles.

A window or a percentile over one group puts the whole group into one task, which fails when one key holds
a third of the rows.  So the largest group is measured first.  Up to ``ONE_TASK_ROWS`` rows the plain form
is used; beyond it the work is spread by range: rows are range-partitioned on (group, order), each partition is
numbered on its own, and the totals of earlier partitions are added as offsets.  The sorted rows are
checkpointed, because range boundaries come from sampling: a second evaluation of the same plan, or a retry
after a lost executor, could otherwise cut the rows elsewhere.  Both forms give the same results.
"""

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
ALL = "_all"
ONE_TASK_ROWS = 1_000_000
ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 100_000


def ensure_checkpoint_dir(spark) -> str:
    """Folder named by ``spark.checkpoint.dir``, which all executors must share; without it only a local master can work."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark, *parts: str) -> str:
    """A folder for written tables below the cluster's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(root, "staylens", spark.sparkContext.applicationId, *parts)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _sort_keys(order_by: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def group_sizes(df: DataFrame, group: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups, counted with partial sums over the key columns only."""
    if not group:
        n = df.count()
        return n, n
    top = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return top[0] or 0, top[1] or 0


def spread_sort(df: DataFrame, order_by: list, total_rows: int = 0) -> DataFrame:
    """``df`` in global order, with ``_part`` (range number) and ``_pos`` (0-based row in the range).

    The number of ranges follows the number of rows, so a range stays small enough for one task.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(session, total_rows // ROWS_PER_RANGE), MAX_RANGES)
    keys = _sort_keys(order_by)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_row_tag", F.monotonically_increasing_id()))
    return (checkpointed(tagged)
            .withColumn("_part", F.shiftright("_row_tag", _LOCAL_BITS))
            .withColumn("_pos", F.col("_row_tag").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_row_tag"))


def dense_keys(df: DataFrame, order_by: list, name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Surrogate keys 1..n in the order of ``order_by``; a single-task window only for small tables."""
    total, _ = group_sizes(df, [])
    if total <= one_task_rows:
        at = F.row_number().over(Window.orderBy(*_sort_keys(order_by))).cast("long")
        return df.select(at.alias(name), *[F.col(c) for c in df.columns])
    ordered = spread_sort(df, order_by, total)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so both this window and the broadcast are bounded by their number
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    keyed = ordered.join(F.broadcast(starts), "_part")
    return keyed.select((F.col("_base") + F.col("_pos") + 1).alias(name), *[F.col(c) for c in df.columns])


def running_totals(df: DataFrame, group: list[str], order_by: list, sums: dict[str, Column | str],
                   one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Adds inclusive running sums per group; ``sums`` maps new column name to the summed expression."""
    base = df.columns
    largest, total = group_sizes(df, group)
    if largest <= one_task_rows:
        w = (Window.partitionBy(*group).orderBy(*_sort_keys(order_by))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in sums.items()])
    group_cols = group or [ALL]
    src = df if group else df.withColumn(ALL, F.lit(1))
    for name, expr in sums.items():
        src = src.withColumn(f"_in_{name}", F.col(expr) if isinstance(expr, str) else expr)
    ordered = spread_sort(src, [*group_cols, *order_by], total)
    per_part = ordered.groupBy("_part", *group_cols).agg(
        *[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a group reaches into a partition from an earlier one at most once per partition
    carried = (per_part.select("_part", *group_cols,
                               F.row_number().over(Window.partitionBy(*group_cols).orderBy("_part")).alias("_nth"),
                               *[F.sum(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
               .filter("_nth > 1").drop("_nth"))
    carried = carried.select(F.col("_part").alias("_cp"), *[F.col(g).alias(f"_cg_{g}") for g in group_cols],
                             *[f"_b_{n}" for n in sums])
    inside = (Window.partitionBy("_part", *group_cols).orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ordered.select(*base, *([] if group else [ALL]), "_part",
                           *[F.sum(f"_in_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    on = F.col("_part") == F.col("_cp")
    for g in group_cols:
        on = on & F.col(g).eqNullSafe(F.col(f"_cg_{g}"))
    joined = local.join(F.broadcast(carried), on, "left")
    # either part may have seen no value yet; the total is NULL only while neither has
    return joined.select(*base, *[F.coalesce(F.col(f"_l_{n}") + F.col(f"_b_{n}"), f"_l_{n}", f"_b_{n}").alias(n) for n in sums])


def positions(df: DataFrame, group: list[str], order_by: list, name: str = "position",
              one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """1-based position of every row inside its group (``row_number`` for groups of any size)."""
    return running_totals(df, group, order_by, {name: F.lit(1).cast("long")}, one_task_rows)


def tie_ranks(df: DataFrame, group: list[str], value: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """One row per (group, value): ``n`` equal rows and their common average ``rank``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, group, [value], {"_upto": "n"}, one_task_rows)
    return run.select(*group, value, "n",
                      (F.col("_upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def exact_quantiles(df: DataFrame, group: list[str], specs: dict[str, tuple], with_count: bool = False,
                    one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    ``specs`` maps output name to ``(value expression, probability)``; ``with_count`` adds ``n_<name>``, the
    number of values.
    """
    largest, total = group_sizes(df, group)
    if largest <= one_task_rows:
        return _plain_quantiles(df, group, specs, with_count)
    return _spread_quantiles(df, group, specs, with_count, total)


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def _plain_quantiles(df: DataFrame, group: list[str], specs: dict[str, tuple], with_count: bool) -> DataFrame:
    """All quantiles of one value share a single table of its counts."""
    by_value: dict[str, list] = {}
    for out, (value, prob) in specs.items():
        by_value.setdefault(value if isinstance(value, str) else str(value), []).append((out, value, float(prob)))
    aggs, picks = [], {}
    for i, wanted in enumerate(by_value.values()):
        aggs.append(F.percentile(_double(wanted[0][1]), [p for _, _, p in wanted]).alias(f"_q{i}"))
        picks.update({out: F.element_at(f"_q{i}", j).alias(out) for j, (out, _, _) in enumerate(wanted, 1)})
        if with_count:
            aggs.append(F.count(_double(wanted[0][1])).alias(f"_n{i}"))
            picks.update({f"n_{out}": F.col(f"_n{i}").alias(f"n_{out}") for out, _, _ in wanted})
    names = [*specs, *([f"n_{out}" for out in specs] if with_count else [])]
    return df.groupBy(*group).agg(*aggs).select(*group, *[picks[n] for n in names])


def _spread_quantiles(df: DataFrame, group: list[str], specs: dict[str, tuple], with_count: bool, total_rows: int) -> DataFrame:
    """Quantiles of groups too large for one task.

    Rows are first reduced to distinct values with counts; then only the ranges that hold a wanted rank are
    looked at again.
    """
    keys = group or [ALL]
    measures: dict[str, Column] = {}
    wanted: dict[str, tuple[str, float]] = {}
    labels: dict[str, str] = {}
    for out, (value, prob) in specs.items():
        ident = value if isinstance(value, str) else str(value)
        label = labels.setdefault(ident, f"m{len(labels)}")
        measures[label] = _double(value)
        wanted[out] = (label, float(prob))
    src = df if group else df.withColumn(ALL, F.lit(1))
    rows = F.array(*[F.struct(F.lit(m).alias("_m"), v.alias("_v")) for m, v in measures.items()])
    counts = (src.select(*keys, F.inline(rows)).filter("_v IS NOT NULL")
              .groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ordered = spread_sort(counts, [*keys, "_m", "_v"], total_rows * len(measures))
    cells = ordered.groupBy("_part", *keys, "_m").agg(F.sum("_n").alias("_cell"))
    whole = Window.partitionBy(*keys, "_m")
    cells = cells.select(
        F.col("_part").alias("_cp"), *[F.col(k).alias(f"_ck_{k}") for k in keys], F.col("_m").alias("_cm"), "_cell",
        F.sum("_cell").over(whole).alias("_total"),
        F.coalesce(F.sum("_cell").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))

    def ranks(prob):
        h = (F.col("_total") - 1) * F.lit(prob)
        return F.floor(h), F.ceil(h), h

    touched = F.lit(False)
    for label, prob in set(wanted.values()):
        lo, hi, _ = ranks(prob)
        touched = touched | ((F.col("_cm") == label) & (F.col("_before") <= hi)
                             & (F.col("_before") + F.col("_cell") > lo))
    on = (F.col("_part") == F.col("_cp")) & (F.col("_m") == F.col("_cm"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    near = ordered.join(cells.filter(touched), on)
    inside = (Window.partitionBy("_part", *keys, "_m").orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("_end", F.sum("_n").over(inside) + F.col("_before"))
    near = near.withColumn("_start", F.col("_end") - F.col("_n"))
    aggs = []
    for i, (out, (label, prob)) in enumerate(wanted.items()):
        lo, hi, h = ranks(prob)
        mine = F.col("_m") == label
        aggs += [F.max(F.when(mine & (F.col("_start") <= lo) & (F.col("_end") > lo), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(mine & (F.col("_start") <= hi) & (F.col("_end") > hi), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(F.when(mine, h - lo)).alias(f"_w{i}")]
    if with_count:
        aggs += [F.max(F.when(F.col("_m") == label, F.col("_total"))).alias(f"n_{out}")
                 for out, (label, _) in wanted.items()]
    found = near.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(out)
            for i, out in enumerate(wanted)]
    if with_count:
        cols += [F.coalesce(f"n_{out}", F.lit(0)).alias(f"n_{out}") for out in wanted]
    # a group without any value has a row too, and so has a table without groups
    every = src.select(*keys).distinct() if group else df.sparkSession.range(1).select(F.lit(1).alias(ALL))
    return join_groups(every, found, keys).select(*group, *cols)


def medians(df: DataFrame, group: list[str], values: dict[str, str | Column]) -> DataFrame:
    return exact_quantiles(df, group, {out: (v, 0.5) for out, v in values.items()})


def aggregate_with_medians(df: DataFrame, group: list[str], aggregates: list[Column], values: dict[str, str | Column],
                           at_most: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Aggregates and exact medians per group, in one aggregate where no group can be too large for a task.

    ``at_most`` is an upper bound of the rows of ``df``, known without evaluating it (the row count of the fact table
    that lookups have widened).  Only above ``one_task_rows`` are the groups measured, which reads ``df`` again.
    """
    if at_most <= one_task_rows:
        return df.groupBy(*group).agg(*aggregates, *[F.percentile(_double(v), 0.5).alias(n) for n, v in values.items()])
    meds = exact_quantiles(df, group, {n: (v, 0.5) for n, v in values.items()}, one_task_rows=one_task_rows)
    return join_groups(df.groupBy(*group).agg(*aggregates), meds, group) if aggregates else meds


def join_groups(left: DataFrame, right: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """Join two per-group results; groups may hold NULL, and an empty group list means one row each."""
    if not group:  # both sides are single rows
        one = F.lit(1).alias(ALL)
        return left.select("*", one).join(right.select("*", one), ALL).drop(ALL)
    renamed = right.select(*[F.col(g).alias(f"_r_{g}") for g in group],
                           *[c for c in right.columns if c not in group])
    on = F.lit(True)
    for i, g in enumerate(group):
        cond = F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        on = cond if i == 0 else on & cond
    return left.join(renamed, on, how).drop(*[f"_r_{g}" for g in group])
