"""Profiles as one table, and reports over several datasets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import human_bytes
from ..operators import profile
from ..operators.quality import WEIGHTS_A, WEIGHTS_B, quality_score
from ..operators.roles import numeric_columns
from ..operators.skew import beside
from ..sources.history import history_recent


def _part(df: DataFrame, section: str, column, metric, value) -> DataFrame:
    as_text = lambda c: F.lit(c) if isinstance(c, str) or c is None else c
    return df.select(F.lit(section).alias("section"), as_text(column).cast("string").alias("column"),
                     as_text(metric).cast("string").alias("metric"), value.cast("double").alias("value"))


def data_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """section, column, metric, value: shape, types, nulls, duplicates, bytes, moments, correlations."""
    c = F.col
    # one scan for rows, nulls, bytes and moments
    facts = profile.Facts(df).ask_missing().ask_bytes().ask_moments(numeric_columns(df))
    shape = profile.shape(df, facts).withColumn("columns", F.col("columns").cast("long")).unpivot([], ["rows", "columns"], "metric", "value")
    types = df.sparkSession.createDataFrame(list(profile.type_counts(df).items()), "metric string, value long")
    missing = profile.missing_counts(df, 2, facts)
    described = profile.describe_numeric(df, stats=profile.numeric_stats(df, exact=exact, facts=facts))
    named = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    long = described.select("column", *[c(f).cast("double").alias(f) for f in named]).unpivot(["column"], named, "metric", "value")
    parts = [
        _part(shape, "shape", None, c("metric"), c("value")),
        _part(types, "types", None, c("metric"), c("value")),
        _part(missing, "missing", c("column"), "count", c("missing")),
        _part(missing, "missing", c("column"), "percent", c("missing_pct")),
        _part(profile.duplicate_rows(df), "duplicates", None, "rows", c("duplicates")),
        _part(profile.memory_estimate(df, facts), "memory", c("column"), "bytes", c("bytes")),
        _part(long, "numeric", c("column"), c("metric"), c("value")),
        _part(profile.correlation_matrix(df, facts=facts), "correlation", c("x"), c("y"), c("r")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_health(df: DataFrame) -> DataFrame:
    """How good is this table: per numeric column its summary, nulls and outliers beside the table's score."""
    facts = profile.Facts(df).ask_missing().ask_moments(numeric_columns(df))
    stats = profile.numeric_stats(df, facts=facts)
    described = profile.describe_numeric(df, stats=stats)
    missing = profile.missing_counts(df, facts=facts).select("column", "missing")
    out = profile.iqr_outlier_counts(df, stats=stats)
    score = quality_score(df, WEIGHTS_B, 2, facts).select("rows", "duplicates", F.col("score").alias("table_score"))
    return beside(described.join(F.broadcast(missing), "column").join(F.broadcast(out), "column"), score)


def report_table(tables: Mapping[str, DataFrame], sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Per dataset: shape, size, types, score, nulls, duplicates, first five columns with nulls."""
    parts = []
    for name, df in tables.items():
        facts = profile.Facts(df).ask_missing()
        note = ", ".join([f"{c}={facts['missing', c]}" for c in df.columns if facts["missing", c]][:5])
        parts.append(quality_score(df, WEIGHTS_A, facts=facts).select(
            F.lit(name).alias("name"), "rows", "columns", F.lit((sizes or {}).get(name)).cast("long").alias("bytes"),
            F.lit(len(profile.type_counts(df))).alias("types"), F.round("score", 1).alias("score"),
            "missing", "duplicates", F.lit(note).alias("missing_columns")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_lines(report: DataFrame, history: DataFrame | None = None, made: str | None = None) -> DataFrame:
    """The report as Markdown, one row per paragraph with a sort key: title, datasets, history entries.

    The title counts the datasets and carries the date ``made``, if one is given; a dataset
    whose size is not known has no size in its paragraph.
    """
    num = lambda c: F.format_number(c, 0)
    title = F.concat(F.lit("# "), num(F.count("*")), F.lit(" dataset(s)"), F.lit(f", {made}" if made else ""))
    head = report.agg(title.alias("text")).select(F.lit(0).alias("part"), F.lit("").alias("key"), "text")
    holes = F.when(F.col("missing_columns") != "", F.concat(F.lit(" ("), "missing_columns", F.lit(")"))).otherwise("")
    text = F.concat_ws(
        "\n", F.concat(F.lit("## "), "name", F.lit(", score "), F.format_number("score", 1)),
        F.concat(num("rows"), F.lit(" rows in "), num("columns"), F.lit(" columns of "), num("types"), F.lit(" type(s)"),
                 F.when(F.col("bytes").isNotNull(), F.concat(F.lit(", "), human_bytes(F.col("bytes")))).otherwise("")),
        F.concat(num("duplicates"), F.lit(" repeated rows, "), num("missing"), F.lit(" empty cells"), holes))
    lines = head.unionByName(report.select(F.lit(1).alias("part"), F.col("name").alias("key"), text.alias("text")))
    if history is None:
        return lines
    recent = history_recent(history)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    entry = F.concat(stamp, F.lit(" "), "action", F.when(F.col("success"), ": ").otherwise(" failed: "), "message",
                     F.lit(", left "), num("rows"), F.lit(" rows in "), num("columns"), F.lit(" columns"))
    return lines.unionByName(recent.select(F.lit(2).alias("part"), stamp.alias("key"), entry.alias("text")))
