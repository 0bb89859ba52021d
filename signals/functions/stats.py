"""Scalar statistics over whole frames, written so no step holds a whole column.

* ``min_max`` uses a scalar subquery: the one-row aggregate is
  planned by Catalyst (partial + final aggregation) and inlined, no join.
* ``mode_values`` counts the values of all columns at once (a distributed shuffle)
  and compares the counts; the driver receives one row per column.
* ``exact_medians`` brackets the middle ranks of all columns by a mergeable sketch
  and counts only the values inside the brackets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import nan_to_null, safe_div


def scaled(x: Column, lo: Column, hi: Column, neutral: float = 0.5) -> Column:
    """(x − lo)/(hi − lo); ``neutral`` where lo = hi, NULL where there are no bounds."""
    return F.when(hi == lo, F.lit(neutral)).otherwise(safe_div(x - lo, hi - lo))


def min_max(df: DataFrame, c: str, neutral: float = 0.5) -> Column:
    """(x − min)/(max − min) over all rows of ``df``; every row gets ``neutral``
    when min = max (also rows whose x is NULL); all-NULL input stays NULL."""
    b = df.select(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar()
    return scaled(F.col(c), b.getField("lo"), b.getField("hi"), neutral)


def null_counts(df: DataFrame, cols: list[str], with_rows: bool = False):
    """Number of NULLs per column in one pass (one row comes back); with
    ``with_rows`` also the row count."""
    if not cols and not with_rows:
        return {}
    row = df.select(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    counts = {c: int(row[c]) for c in cols}
    return (counts, int(row["__rows"])) if with_rows else counts


def value_counts(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """(column, value, n): the non-null values of several columns, cast to one type, with their counts.

    One pass over the table and one shuffle of (column, value) with a map-side partial count.
    """
    wide = df.select(*[F.col(c).cast(kind).alias(c) for c in cols])
    return (wide.unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value of each column as text, the smallest one among ties; None if all NULL."""
    if not cols:
        return {}
    best = value_counts(df, cols, "string").groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("b"))
    found = {r["column"]: r["b"]["v"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in cols}


#: accuracy of a quantile sketch: its rank error is rows / ACCURACY
ACCURACY = 1_000
#: quantiles that one pass brings to the driver, closest around the middle
PROBES = (0.0, 0.1, 0.25, 0.4, 0.45, 0.475, 0.49, 0.495, 0.4975, 0.5025, 0.505, 0.51, 0.525, 0.55, 0.6, 0.75, 0.9, 1.0)
#: rows of one column that may be left inside its bracket when the values themselves are counted
FINAL_ROWS = 1_000_000


def quantile_probes(value: Column) -> Column:
    """Mergeable aggregate: approximate quantiles at PROBES (NULLs are skipped; NULL without values)."""
    return F.percentile_approx(value, list(PROBES), ACCURACY)


@dataclass(frozen=True)
class Bracket:
    """Values [lo, hi] of a column (None: unbounded) that hold both middle ranks of its ``n`` values; about ``inside`` rows lie in it."""

    n: int
    lo: float | None = None
    hi: float | None = None
    inside: float = math.inf

    def holds(self, value: Column) -> Column:
        above = F.lit(True) if self.lo is None else value >= F.lit(self.lo)
        return above if self.hi is None else above & (value <= F.lit(self.hi))

    def narrowed(self, below: int, inside: int, probes: list[float]) -> Bracket:
        """The closest probes around the middle ranks that the sketch's error cannot carry across them."""
        error = 2 / ACCURACY
        lowest = ((self.n - 1) // 2 - below) / max(1, inside) - error
        highest = (self.n // 2 + 1 - below) / max(1, inside) + error
        under = [i for i, p in enumerate(PROBES) if p <= lowest]
        over = [i for i, p in enumerate(PROBES) if p >= highest]
        share = (PROBES[over[0]] if over else 1.0) - (PROBES[under[-1]] if under else 0.0) + 2 * error
        return Bracket(self.n, probes[under[-1]] if under else self.lo, probes[over[0]] if over else self.hi, inside * min(1.0, share))


def narrow(df: DataFrame, brackets: dict[str, Bracket]) -> dict[str, Bracket]:
    """One pass: rows below and inside every bracket and a sketch of what lies inside, for all columns at once."""
    parts = []
    for c, b in brackets.items():
        inside = b.holds(F.col(c))
        parts.append(F.struct(F.count(F.when(F.col(c) < F.lit(b.lo), 1)).alias("below") if b.lo is not None else F.lit(0).alias("below"),
                              F.count(F.when(inside, F.col(c))).alias("inside"),
                              quantile_probes(F.when(inside, F.col(c))).alias("probes")).alias(c))
    row = df.agg(*parts).first()
    return {c: b.narrowed(row[c]["below"], row[c]["inside"], row[c]["probes"]) for c, b in brackets.items()}


def medians_inside(df: DataFrame, brackets: dict[str, Bracket]) -> dict[str, float]:
    """Exact medians from the values inside the brackets; the values below only count.

    All values below a bracket count as −∞ (which a bracket only holds if it has no lower end), those above go. What is shuffled is one
    row per task for the values below and one per distinct value inside.
    """
    def kept(c, b):
        value = F.col(c) if b.lo is None else F.when(F.col(c) < F.lit(b.lo), F.lit(-math.inf)).otherwise(F.col(c))
        return value if b.hi is None else F.when(F.col(c) <= F.lit(b.hi), value)

    counts = value_counts(df.select(*[kept(c, b).alias(c) for c, b in brackets.items()]), list(brackets), "double")
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for c, b in brackets.items():
        low = F.when(F.col("column") == c, F.lit((b.n - 1) // 2)).otherwise(low)
        high = F.when(F.col("column") == c, F.lit(b.n // 2)).otherwise(high)

    def holds(rank):
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))

    # at most FINAL_ROWS values of a column are ranked in one task
    middle = counts.withColumn("upto", upto).groupBy("column").agg(holds(low).alias("a"), holds(high).alias("b"))
    return {r["column"]: (r["a"] + r["b"]) / 2.0 for r in middle.collect()}  # one row per column


def exact_medians(df: DataFrame, cols: list[str], first: dict[str, Bracket] | None = None) -> dict[str, float | None]:
    """Exact medians of the non-null, non-NaN values (mean of the two middle values); None without any.

    A mergeable sketch of every column brackets its two middle ranks in one pass over the table. While more than ``FINAL_ROWS``
    rows can lie inside a bracket, another pass sketches what lies inside, which leaves about a hundredth of it; then the values inside are
    counted and ranked exactly. No column's values are shuffled but those. Passes grow with the logarithm of the rows to base
    100; the driver receives one row a pass.

    ``first``: brackets of a pass made before (``profile``).
    """
    if not cols:
        return {}
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    brackets = {c: first[c] for c in cols if c in first} if first else profile(df, cols)[2]
    brackets = {c: b for c, b in brackets.items() if b.n}
    while wide := {c: b for c, b in brackets.items() if b.inside > FINAL_ROWS and (b.lo is None or b.hi is None or b.lo < b.hi)}:
        finer = narrow(df, wide)
        brackets |= finer
        if all(finer[c].inside >= 0.9 * wide[c].inside for c in wide):
            break  # no sketch can part them: few distinct values
    found = medians_inside(df, brackets) if brackets else {}
    return {c: found.get(c) for c in cols}


def profile(df: DataFrame, numeric: list[str], other: tuple | list = ()) -> tuple[dict[str, int], int, dict[str, Bracket]]:
    """One pass over a table: NULLs of every column, rows, and brackets of the medians of the numeric columns."""
    value = {c: nan_to_null(F.col(c).cast("double")) for c in numeric}
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.struct(F.count(value[c]).alias("n"), quantile_probes(value[c]).alias("probes")).alias(c) for c in numeric],
                 *[F.count(c).alias(c) for c in other]).first()
    rows = int(row["__rows"])
    counts = {**{c: int(row[c]["n"]) for c in numeric}, **{c: int(row[c]) for c in other}}
    brackets = {c: Bracket(counts[c]).narrowed(0, counts[c], row[c]["probes"]) if counts[c] else Bracket(0) for c in numeric}
    return {c: rows - n for c, n in counts.items()}, rows, brackets
