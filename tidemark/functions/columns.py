"""Small column builders: rolling windows with a minimum of values, null-safe comparisons, row-wise statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: Sequence[str] = (), order: str = "day") -> WindowSpec:
    """Rows of one series in order.  A series without keys is one calendar: some thousands of rows."""
    return Window.partitionBy(*by).orderBy(order)


def rolling(x: Column, how: str, start: int, end: int, least: int, by: Sequence[str] = (), order: str = "day") -> Column:
    """sum, avg, min, max or median of x over rows start..end, null unless at least `least` of them have a value."""
    w = series(by, order).rowsBetween(start, end)
    made = F.percentile(x, F.lit(0.5)) if how == "median" else getattr(F, how)(x)
    return F.when(F.count(x).over(w) >= least, made.over(w))


def yes(condition: Column) -> Column:
    """The condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def finite(x: Column) -> Column:
    """x with NaN as null."""
    return F.when(~F.isnan(x), x)


def row_mean(*columns: str) -> Column:
    """Mean of the columns that have a value; null if none has."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)), n + F.col(c).isNotNull().cast("int")
    return F.when(n > 0, total / n)


def row_max(*columns: str) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def all_present(*columns: str) -> Column:
    """True where every column has a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def nulled(columns: Sequence[str], prefixes: tuple[str, ...], where: Column) -> dict[str, Column]:
    """Columns with one of the prefixes, null where the condition holds; for withColumns."""
    return {c: F.when(~yes(where), F.col(c)) for c in columns if c.startswith(prefixes)}


def local_day(ts: Column, hours: int = 8) -> Column:
    """Calendar day of a UTC time in a zone `hours` ahead."""
    return F.to_date(ts + F.expr(f"INTERVAL {hours} HOURS"))
