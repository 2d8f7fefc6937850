"""NULL/NaN-safe arithmetic (rules D6, D19, D23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def safe_div(a, b) -> Column:
    """ANSI mode raises on ``x / 0``; division by zero gives NULL instead."""
    return F.try_divide(_c(a), _c(b))


def nan_to_null(col) -> Column:
    """pandas ``mean`` skips NaN; Spark ``avg`` would return NaN.  Map NaN to NULL on ingest."""
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def null_or_nan(col) -> Column:
    c = _c(col)
    return c.isNull() | F.isnan(c)


# Measures are summed as DECIMAL(28,10) (sum type DECIMAL(38,10)): the total is then
# independent of partitioning and task order, so a retried or re-planned job gives
# bit-identical means.  Values need |x| < 1e18, sums |x| < 1e28; digits past the tenth
# are rounded.  Squares are never summed this way (see ``profiles.spread``).
EXACT = "decimal(28,10)"


def exact_sum(col) -> Column:
    """Order-independent sum (a DECIMAL); cast to double where a double is wanted."""
    return F.sum(_c(col).cast(EXACT))


def exact_mean(sum_col, count_col) -> Column:
    return F.try_divide(_c(sum_col).cast("double"), _c(count_col))
