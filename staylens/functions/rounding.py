"""Rounding that does not depend on the order in which a cluster added the numbers up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of doubles differ in the last bits from run to run, so a value sitting on a rounding tie would
# flip between two results.  The guard moves the tie point by a millionth of the last kept digit, well above
# that noise and below any difference that a kept digit could show.
GUARD = 0.500001
WHOLE = 2.0 ** 53  # doubles from here on have no fraction


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_round(c, digits: int = 0) -> Column:
    """Half-away-from-zero rounding to ``digits`` places, repeatable under retries.

    ``floor`` gives a long, which ends near 9.2e18: a scaled value beyond ``WHOLE`` is whole already and stays as it is.
    """
    x = as_col(c).cast("double")
    scale = F.lit(float(10 ** digits))
    up = F.abs(x) * scale + F.lit(GUARD)
    whole = F.when(up < F.lit(WHOLE), F.floor(up).cast("double")).otherwise(up)
    return F.signum(x) * whole / scale + F.lit(0.0)


def rows() -> Column:
    """Aggregate: number of rows."""
    return F.count(F.lit(1))


def ratio(a, b, factor: float = 1.0) -> Column:
    """``a / b * factor`` as double, NULL when ``b`` is 0 or NULL."""
    return F.try_divide(as_col(a).cast("double") * F.lit(factor), as_col(b).cast("double"))


def share(condition: Column, factor: float = 100.0) -> Column:
    """Aggregate: rows meeting ``condition`` per hundred rows (NULL counts as not meeting it)."""
    return ratio(F.count_if(condition), F.count(F.lit(1)), factor)
