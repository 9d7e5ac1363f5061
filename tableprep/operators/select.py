"""Feature selection; columns that are not numeric always stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import moments
from .roles import col, melt, numeric_columns


def _keep(df: DataFrame, numeric: Sequence[str], kept: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in numeric or c in kept])


def variances(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    cols = numeric_columns(df) if cols is None else list(cols)
    return {c: (s["pstd"] or 0.0) ** 2 for c, s in moments(df, cols).items()}


def select_variance(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    found = variances(df)
    return _keep(df, list(found), [c for c, v in found.items() if v > threshold])


def chi2_scores(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, score: observed against expected sums of each feature per class."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != target]
    lows = df.agg(*[F.min(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if any(v is not None and v < 0 for v in lows):
        raise ValueError("chi-squared needs features that are not negative")
    per = df.groupBy(col(target).alias("_t")).agg(
        F.count("*").alias("_n"), *[F.sum(col(c).cast("double")).alias(c) for c in cols])
    long = melt(per, cols, "feature", "observed", ["_t", "_n"])
    totals = long.groupBy("feature").agg(F.sum("observed").alias("_sum"), F.sum("_n").alias("_all"))
    expected = F.col("_sum") * F.col("_n") / F.col("_all")
    gap = F.col("observed") - expected
    return (long.join(totals, "feature").groupBy("feature")
            .agg(F.sum(gap * gap / expected).alias("score")))


def select_kbest(df: DataFrame, target: str, k: int | str = "all") -> DataFrame:
    numeric = [c for c in numeric_columns(df) if c != target]
    if k == "all":
        return df
    best = chi2_scores(df, target).orderBy(F.desc_nulls_last("score"), "feature").limit(int(k)).collect()
    return _keep(df, numeric, [r["feature"] for r in best])


def importances(df: DataFrame, target: str, trees: int = 100, depth: int = 5, seed: int = 42) -> dict[str, float]:
    cols = [c for c in numeric_columns(df) if c != target]
    data = df.select(col(target).cast("string").alias("_t"),
                     *[col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(cols)]).na.drop()
    data = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(cols))], outputCol="_x").transform(data)
    data = StringIndexer(inputCol="_t", outputCol="_y").fit(data).transform(data)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
    return dict(zip(cols, (float(v) for v in forest.fit(data).featureImportances.toArray())))


def select_importance(df: DataFrame, target: str, threshold: float = 0.01, trees: int = 100, seed: int = 42) -> DataFrame:
    found = importances(df, target, trees=trees, seed=seed)
    return _keep(df, list(found), [c for c, v in found.items() if v >= threshold])
