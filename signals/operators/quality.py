"""Data-quality checks standing in for the declared constraints (PK, FK, NOT NULL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count (one shuffle, partial counts)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, and a NULL key however often it occurs, with their count."""
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | no_key)


def orphans(child: DataFrame, parent: DataFrame, key: str, table: str = "") -> DataFrame:
    """(table_name, key, n_rows) for child keys missing from the parent (left anti join)."""
    missing = child.join(parent.select(key), key, "left_anti")
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(table).alias("table_name"), key, "n_rows")


def null_counts(df: DataFrame, table: str = "", cols: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, n_null) for every column, one pass over the table."""
    cols = cols or df.columns
    wide = df.select(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null").select(
        F.lit(table).alias("table_name"), "column_name", "n_null")


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of ``a``, rows missing in ``b`` and rows that ``b`` has beyond ``a``; equal rows count as often as they occur (like
    ``exceptAll`` both ways, but each frame is read and moved once)."""
    both = a.withColumn("__in_a", F.lit(1)).unionByName(b.withColumn("__in_a", F.lit(0)))
    per = both.groupBy(*a.columns).agg(F.sum("__in_a").alias("__a"), F.sum(1 - F.col("__in_a")).alias("__b"))
    more = F.col("__a") - F.col("__b")
    return per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(name) for n, name in [
        (F.col("__a"), "n_rows"), (F.greatest(more, F.lit(0)), "n_missing"), (F.greatest(-more, F.lit(0)), "n_extra")]])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
