"""Column roles, taken from the schema of the frame at hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FLOATS = (T.DoubleType, T.FloatType)


def col(name: str) -> Column:
    """Column by exact name, also where the name holds spaces, dots or hats."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def role_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def melt(df: DataFrame, names: Sequence[str], variable: str = "column", value: str = "value",
         ids: Sequence[str] = ()) -> DataFrame:
    """One row per column of ``names``, which may hold dots and spaces."""
    return df.unpivot([col(i) for i in ids], [col(n) for n in names], variable, value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of a missing value: NaN becomes null in every float column.

    The result knows the frame it was made from, so a comparison can be placed below
    the change, where the scan takes it (see ``filters.filter_compare``).
    """
    out = df.select(*[
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
        if isinstance(f.dataType, FLOATS) else col(f.name)
        for f in df.schema.fields
    ])
    out._with_nan = df
    return out


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Same columns in the same order, with some of them computed anew."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def find_column(df: DataFrame, wanted: str | int) -> str:
    """Resolve a column by position, exact name, or part of its name."""
    text = str(wanted)
    if text.isdigit():
        return df.columns[int(text)]
    if text in df.columns:
        return text
    for name in df.columns:
        if text.lower() in name.lower():
            return name
    raise ValueError(f"column {wanted!r} not found in {df.columns}")
