"""Table cleaning: impute → clip to valid range → coerce declared booleans.

NaN counts as NULL. Imputation statistics are exact and computed without holding
a column in one place: one pass counts the NULLs of every column and brackets the
medians by a sketch, a second counts the values inside the brackets, and one count of
their values gives the modes (see ``functions.stats``). Only columns that contain
NULLs are imputed.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.columns import clip, nan_to_null
from ..functions.stats import exact_medians, mode_values, null_counts, profile
from ..session import stored

log = logging.getLogger(__name__)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def imputation_values(df: DataFrame, exclude: tuple = ()) -> dict:
    """Fill value per column that has NULLs: median for numbers, smallest most
    frequent value otherwise; an all-NULL text column gets 'UNKNOWN', an all-NULL
    numeric column has no median and stays NULL."""
    return _profiled(without_nan(df), exclude)[1]


def _profiled(df: DataFrame, exclude: tuple = ()) -> tuple[DataFrame, dict]:
    """A frame without NaN and its fill values. If columns have to be read again, the rows are stored and the frame returned reads those, so
    the plan they come from (joins, say) does not run for every pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c not in exclude]
    numeric = [c for c in cols if isinstance(types[c], _NUMERIC)]
    nulls, n_rows, brackets = profile(df, numeric, [c for c in cols if c not in numeric])
    some = [c for c in cols if 0 < nulls[c] < n_rows]  # an all-NULL column has neither median nor mode
    if some:
        df = stored(df, "cleaning")
    fills: dict = {c: m for c, m in exact_medians(df, [c for c in some if c in numeric], brackets).items() if m is not None}
    for c, m in mode_values(df, [c for c in some if not isinstance(types[c], _NUMERIC)]).items():
        fills[c] = m if isinstance(types[c], T.StringType) else F.lit(m).cast(types[c])
    for c in cols:
        if n_rows and nulls[c] == n_rows and isinstance(types[c], T.StringType):
            fills[c] = "UNKNOWN"
    log.debug("impute %s", fills)
    return df, fills


def without_nan(df: DataFrame) -> DataFrame:
    """NaN → NULL in every float column (NaN would be neither imputed nor clipped, as it compares as the largest value)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[nan_to_null(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def impute(df: DataFrame, exclude: tuple = (), fills: dict | None = None) -> DataFrame:
    df = without_nan(df)
    if fills is None:
        df, fills = _profiled(df, exclude)
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                       for c in df.columns])


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs of the numeric ``cols`` → exact column median (mean of the two middle values)."""
    nulls, _, brackets = profile(df, cols)
    medians = exact_medians(df, [c for c in cols if nulls[c] > 0], brackets)
    return impute(df, fills={c: m for c, m in medians.items() if m is not None})


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs of ``cols`` → the smallest most frequent value ('UNKNOWN' when all NULL)."""
    nulls = null_counts(without_nan(df), cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    modes = mode_values(without_nan(df), [c for c in cols if nulls[c] > 0])
    return impute(df, fills={c: "UNKNOWN" if m is None else F.lit(m).cast(types[c]) for c, m in modes.items()})


def clip_to_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip ranged columns to [lo, hi] (NULL stays NULL; integer columns stay integer)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in ranges:
            lo, hi = ranges[c]
            e = clip(c, lo, hi)
            if isinstance(types[c], _INTEGRAL):
                e = e.cast(types[c])
            out.append(e.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def clip_report(df: DataFrame, ranges: dict[str, tuple[float, float]], table: str = "") -> DataFrame:
    """(table_name, column_name, n_clipped): values outside their range, one pass."""
    present = [c for c in ranges if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, n_clipped bigint")
    counts = df.select(*[F.count(F.when((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]), 1)).alias(c)
                         for c in present])
    long = counts.unpivot([], present, "column_name", "n_clipped")
    return long.select(F.lit(table).alias("table_name"), "column_name", "n_clipped")


def coerce_boolean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Declared BOOLEAN columns: numbers become (x != 0), so an imputed 0.5 is True."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[((F.col(c) != 0) if isinstance(types[c], _NUMERIC) else F.col(c).cast("boolean")).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def clean_table(name: str, df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """impute → clip (ranges of ``name``) → coerce the columns declared BOOLEAN."""
    out = impute(df, exclude)
    out = clip_to_range(out, schemas.NUMERIC_RANGES.get(name, {}))
    decl = schemas.TABLES.get(name)
    bools = schemas.boolean_columns(decl) if decl is not None else []
    return coerce_boolean(out, [c for c in bools if c in out.columns])


def load_and_clean(tables: dict[str, DataFrame], exclude: tuple = ()) -> dict[str, DataFrame]:
    """Clean every table; the tables' passes are independent jobs, submitted together so that small ones do not queue."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        cleaned = pool.map(lambda item: clean_table(*item, exclude), tables.items())
        return dict(zip(tables, cleaned))
