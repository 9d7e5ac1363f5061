"""Row and column selection."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import missing_counts, nunique, value_counts
from .roles import FLOATS, categorical_columns, col, is_numeric, nan_to_null
from .skew import beside

FILTER_FIRST = 10_000_000
_COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def comparison(column: str, dtype: T.DataType, op: str, value) -> Column:
    """The condition of ``filter_compare``, with a literal of the column's own kind so that it reaches the scan."""
    c = col(column)
    if is_numeric(dtype):
        number = float(value)
        whole = isinstance(dtype, T.IntegralType) and number.is_integer() and abs(number) < 2 ** 53
        given = F.lit(int(number)) if whole else F.lit(number)
    else:
        given = F.lit(value)
    if op == "==":
        return c == given
    if op == "!=":
        return ~c.eqNullSafe(given)
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return _COMPARE[op](c, given)


def filter_compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows that satisfy the comparison; ``!=`` keeps rows with a null.

    On a table just read, the comparison is made on the stored columns, so it reaches the
    scan for float columns too; NaN counts as missing there as well.
    """
    stored = df.__dict__.get("_with_nan")
    if stored is not None and column in stored.columns:
        return nan_to_null(stored.filter(stored_comparison(column, stored.schema[column].dataType, op, value)))
    return df.filter(comparison(column, df.schema[column].dataType, op, value))


def stored_comparison(column: str, dtype: T.DataType, op: str, value) -> Column:
    """``comparison`` for a column that may hold NaN for missing values."""
    keep = comparison(column, dtype, op, value)
    if isinstance(dtype, FLOATS):
        keep = (keep | F.isnan(col(column))) if op == "!=" else (keep & ~F.isnan(col(column)))
    return keep


def filter_summary(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Row counts before and after the filter."""
    kept = filter_compare(df, column, op, value).agg(F.count("*").alias("filtered_rows"))
    return beside(df.agg(F.count("*").alias("original_rows")), kept)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def high_missing(df: DataFrame, percent: float = 70.0) -> list[str]:
    return [r["column"] for r in missing_counts(df).filter(F.col("missing_pct") > percent).collect()]


def drop_high_missing(df: DataFrame, percent: float = 70.0) -> DataFrame:
    return df.drop(*high_missing(df, percent))


def high_cardinality_columns(df: DataFrame, limit: int = 50, exact: bool = True) -> DataFrame:
    text = categorical_columns(df)
    return nunique(df, text, exact=exact).filter(F.col("unique") > limit)


def dropna_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", list(subset) if subset else None)


def top_category_filter(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Rows whose category is among the ``n`` most frequent (all, if no more than n)."""
    keep = value_counts(df, column, n).select(F.col("value").alias(column))
    return df.join(F.broadcast(keep), column, "left_semi").select(*[col(c) for c in df.columns])


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 2000, seed: str = "42") -> DataFrame:
    """The ``n`` rows with the smallest hash of key and seed: repeatable everywhere."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in key], F.lit(seed))
    ordered = df.withColumn("_md5", F.md5(text))
    rows = df.count()
    if rows > FILTER_FIRST:
        # hashes are even, so the smallest are below a known share of their range;
        # this keeps the candidates of many tasks from meeting in one
        edge = f"{int((4 * n + 1000) / rows * 16 ** 12):012x}"
        likely = ordered.filter(F.col("_md5") < edge)
        if likely.count() >= n:
            ordered = likely
    return ordered.orderBy("_md5", *[col(k) for k in key]).limit(n).drop("_md5")


def sort_rows(df: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*[col(b).desc() if descending else col(b).asc() for b in by])


def preview_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(b) for b in order_by]).limit(n)
