"""Missing-value rules: strict aggregates, set membership and ratios.

Spark aggregates skip NULL. The survey rules are strict: one missing value makes the
result missing, unless a skipping form is asked for (then use the plain Spark aggregate).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strict(agg, c: ColumnLike) -> Column:
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_avg(c: ColumnLike) -> Column:
    return _strict(F.avg, c)


def strict_sum(c: ColumnLike) -> Column:
    return _strict(F.sum, c)


def strict_sd(c: ColumnLike) -> Column:
    return _strict(F.stddev_samp, c)


def strict_var(c: ColumnLike) -> Column:
    return _strict(F.var_samp, c)


def strict_min(c: ColumnLike) -> Column:
    return _strict(F.min, c)


def strict_max(c: ColumnLike) -> Column:
    return _strict(F.max, c)


def strict_over(agg, c: ColumnLike, window: WindowSpec) -> Column:
    """``agg`` over a window frame, NULL once the frame holds a missing value."""
    c = _col(c)
    complete = F.count(c).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, agg(c).over(window))


def is_member(c: ColumnLike, values: Iterable) -> Column:
    """Membership that is never missing: a NULL is simply not in the set."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def ratio(x: ColumnLike, base: ColumnLike) -> Column:
    """x / base with 0/0 missing and x/0 infinite, keeping the sign of x."""
    x, base = _col(x), _col(base)
    infinite = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(base == 0, infinite).otherwise(x / base)


def share(x: ColumnLike, total: ColumnLike) -> Column:
    """x as a part of total, missing for a zero total."""
    return _col(x) / F.nullif(_col(total), F.lit(0.0))


def positive_log(c: ColumnLike) -> Column:
    """Natural logarithm; zero and negative values are missing."""
    c = _col(c)
    return F.when(c > 0, F.ln(c))


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is missing (NaN counts as missing).

    The plain NULL tests come first because only they are pushed down to a scan.
    """
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.dropna(subset=list(columns))


def checked(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; the query fails with ``message`` where it does not."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def only_value(c: ColumnLike, what: str = "a group") -> Column:
    """The one value that a group has, missing ones aside; the query fails if there are two. A map-side aggregate."""
    c = _col(c)
    nothing = F.count(c) == 0
    return checked(nothing | F.min(c).eqNullSafe(F.max(c)), F.max(c), f"more than one value: {what}")
