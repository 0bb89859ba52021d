"""Column-level helpers. All of them are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi] keeping NULL as NULL (greatest/least alone would skip NULL)."""
    x = col(c)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(y)


def clip01(c: str | Column) -> Column:
    return clip(c, 0.0, 1.0)


def nan_to_null(c: str | Column) -> Column:
    """NaN compares as the largest double in Spark; turn it into NULL on read."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL instead of raising on a zero divisor (ANSI mode)."""
    return F.try_divide(col(num), col(den))


def dround(c: str | Column, digits: int) -> Column:
    """Round half-up on the value's decimal expansion to 12 places, as a double.

    The 12-place decimal step makes the result independent of how an engine
    prints or scales the binary value, so near-ties round the same everywhere.
    """
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def round6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def row_mean(cols: Iterable[str | Column]) -> Column:
    """Mean of the non-null values of several columns; NULL if all are NULL."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(n > 0, total / n)


def fixed(c: str | Column, digits: int) -> Column:
    """Number → text with ``digits`` decimals (decimal half-up, same in the SQL oracle)."""
    return F.round(col(c).cast("decimal(38,9)"), digits).cast("string")
