"""Quality checks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import Facts, duplicate_rows, missing_counts, nunique
from .roles import categorical_columns, col, melt
from .skew import beside

# weights of completeness, uniqueness, volume and number of columns
WEIGHTS_A = (30, 20, 25, 25)
WEIGHTS_B = (40, 30, 15, 15)


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one distinct non-null value: smallest equals largest."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    one = df.agg(*[F.coalesce((F.min(col(c)) == F.max(col(c))).cast("int"), F.lit(0)).alias(c) for c in plain])
    return melt(one, plain, "column", "_same").filter("_same = 1").select("column")


def high_cardinality_ratio(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Text columns whose distinct values exceed ``ratio`` of the rows."""
    text = categorical_columns(df, booleans=False)
    rows = df.agg(F.count("*").alias("_n"))
    return (beside(nunique(df, text), rows).filter(F.col("unique") > ratio * F.col("_n"))
            .select("column", "unique"))


def quality_issues(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """issue, column, value: missing, duplicates, constant, high cardinality."""
    missing = missing_counts(df).filter("missing > 0").select(
        F.lit("missing").alias("issue"), "column", F.col("missing").alias("value"))
    repeats = duplicate_rows(df).filter("duplicates > 0").select(
        F.lit("duplicates").alias("issue"), F.lit(None).cast("string").alias("column"),
        F.col("duplicates").alias("value"))
    constant = constant_columns(df).select(
        F.lit("constant").alias("issue"), "column", F.lit(1).cast("long").alias("value"))
    many = high_cardinality_ratio(df, ratio).select(
        F.lit("high_cardinality").alias("issue"), "column", F.col("unique").alias("value"))
    return missing.unionByName(repeats).unionByName(constant).unionByName(many)


def quality_score(df: DataFrame, weights: tuple = WEIGHTS_A, digits: int | None = None, facts: Facts | None = None) -> DataFrame:
    """One row: rows, columns, missing, duplicates and the weighted score out of 100."""
    facts = (Facts(df) if facts is None else facts).ask_missing()
    n, width, missing = facts.rows, len(df.columns), sum(facts["missing", c] for c in df.columns)
    a, b, c, d = weights
    certain = max(1 - missing / max(n * width, 1), 0.0) * a + min(n / 1000, 1.0) * c + min(width / 10, 1) * d
    score = F.greatest(1 - F.col("duplicates") / max(n, 1), F.lit(0.0)) * b + F.lit(certain)
    if digits is not None:
        score = F.round(score, digits)
    return duplicate_rows(df).select(F.lit(n).cast("long").alias("rows"), F.lit(width).alias("columns"), F.lit(missing).cast("long").alias("missing"),
                                     "duplicates", score.alias("score"))
