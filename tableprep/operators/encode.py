"""Encoding of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import BROADCAST_ROWS, lookup
from .ordered import with_position
from .profile import nunique
from .roles import categorical_columns, col, replace_columns
from .skew import beside

# a table cannot have more columns than this of one category each; the vector form takes any number
MOST_COLUMNS = 20_000
BELOW_LIMIT = ("onehot", "ordinal", "binary")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    return {r["column"]: r["unique"] for r in nunique(df, cols).collect()} if cols else {}


def _levels(df: DataFrame, column: str) -> list[str]:
    """The sorted values, which become names of columns."""
    rows = (df.select(col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
            .orderBy("v").limit(MOST_COLUMNS + 1).collect())
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{column!r} has more than {MOST_COLUMNS} categories: use form='vector', or max_categories")
    return [r["v"] for r in rows]


def encode_onehot(df: DataFrame, column: str, drop_first: bool = False, form: str = "columns") -> DataFrame:
    """0/1 columns ``<column>_<value>`` in value order at the end; null is all zero.

    With ``form="vector"`` there is one column ``<column>_onehot`` instead: the
    size of the 0/1 vector and the place of its one (null if it is all zero). The
    form is the caller's choice and never follows the number of categories.
    """
    if form not in ("columns", "vector"):
        raise ValueError(f"unknown form {form!r}")
    text = col(column).cast("string")
    kept = [col(c) for c in df.columns if c != column]
    if form == "vector":
        size = df.agg(F.count_distinct(text).alias("n")).first()["n"]
        coded = _coded(df, column, text, BROADCAST_ROWS)
        first = 1 if drop_first else 0
        place = F.when(F.col("_code") >= first, F.col("_code") - first)
        return coded.select(*kept, F.struct(F.lit(size - first).alias("size"), place.alias("one")).alias(f"{column}_onehot"))
    levels = _levels(df, column)[1 if drop_first else 0:]
    return df.select(*kept, *[F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels])


def _coded(df: DataFrame, column: str, keyed, broadcast_rows: int) -> DataFrame:
    """Add ``_code``, the sorted position of the key among the distinct keys."""
    data = df.withColumn("_k", keyed)
    keys = data.filter("_k IS NOT NULL").groupBy("_k").agg(F.count("*").alias("_n"))
    if keys.count() <= min(broadcast_rows, BROADCAST_ROWS):
        codes = keys.select(F.col("_k").alias("_key"), "_n",
                            (F.row_number().over(W.orderBy("_k")) - 1).cast("long").alias("_code"))
    else:
        codes = with_position(keys, ["_k"], "_code").withColumnRenamed("_k", "_key")
    return lookup(data, "_k", codes, "_code", broadcast_rows)


def encode_label(df: DataFrame, column: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Sorted index of the text of the value; null counts as the text ``nan``."""
    text = F.coalesce(col(column).cast("string"), F.lit("nan"))
    return replace_columns(_coded(df, column, text, broadcast_rows), {column: F.col("_code")}).drop("_k", "_code")


def encode_ordinal(df: DataFrame, column: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Sorted index as a float; null stays null."""
    coded = _coded(df, column, col(column).cast("string"), broadcast_rows)
    return replace_columns(coded, {column: F.col("_code").cast("double")}).drop("_k", "_code")


def encode_binary(df: DataFrame, column: str) -> DataFrame:
    """0/1 for a column with exactly two values, the larger one being 1; other columns raise."""
    text = col(column).cast("string")
    found = df.agg(F.min(text), F.max(text)).first()
    if found[0] is None or found[0] == found[1] or not df.filter(~text.isin(found[0], found[1])).isEmpty():
        raise ValueError(f"{column} does not have exactly two values")
    return replace_columns(df, {column: F.coalesce((text == found[1]).cast("int"), F.lit(0))})


def encode_frequency(df: DataFrame, column: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Share of the non-null rows that have the value."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("_key")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    table = beside(counts, total).select("_key", "_n", (F.col("_n") / F.col("_t")).alias("_share"))
    return replace_columns(lookup(df, column, table, "_share", broadcast_rows),
                           {column: F.col("_share")}).drop("_share")


def encode_target(df: DataFrame, column: str, target: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mean of the target per value."""
    table = (df.filter(col(column).isNotNull()).groupBy(col(column).alias("_key"))
             .agg(F.count("*").alias("_n"), F.avg(col(target).cast("double")).alias("_mean")))
    return replace_columns(lookup(df, column, table, "_mean", broadcast_rows),
                           {column: F.col("_mean")}).drop("_mean")


def encode(df: DataFrame, method: str = "onehot", cols: Sequence[str] | None = None,
           max_categories: int | None = None, drop_first: bool = False, target: str | None = None,
           log: list[str] | None = None, form: str = "columns") -> DataFrame:
    """Encode the categorical columns; ``form`` is that of one-hot.

    With ``max_categories`` one-hot, ordinal and binary apply to columns with at
    most that many values, and label, frequency and target to columns with more;
    None applies the method to all. Columns left as they are are named in ``log``.
    """
    cols = categorical_columns(df) if cols is None else list(cols)
    cols = [c for c in cols if c != target]
    counts = distinct_counts(df, cols) if max_categories is not None or method == "binary" else {}
    for c in cols:
        if max_categories is not None and (counts.get(c, 0) <= max_categories) != (method in BELOW_LIMIT):
            if log is not None:
                log.append(f"{c} not encoded: {counts.get(c, 0)} categories")
            continue
        if method == "binary" and counts.get(c) != 2:
            if log is not None:
                log.append(f"{c} not encoded: {counts.get(c, 0)} categories")
            continue
        if method == "onehot":
            df = encode_onehot(df, c, drop_first, form)
        elif method == "label":
            df = encode_label(df, c)
        elif method == "ordinal":
            df = encode_ordinal(df, c)
        elif method == "binary":
            df = encode_binary(df, c)
        elif method == "frequency":
            df = encode_frequency(df, c)
        elif method == "target" and target:
            df = encode_target(df, c, target)
        else:
            raise ValueError(f"cannot encode with {method!r}")
        if log is not None:
            log.append(f"{method} encoded {c}")
    return df
