"""Treatment of missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import nearest_rows
from .ordered import fill_along
from .profile import modes, moments
from .quantiles import quantile_table
from .reduce import cross_products
from .roles import categorical_columns, col, numeric_columns, replace_columns


def null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return dict(zip(cols, row))


def fill_numbers(df: DataFrame, strategy: str = "mean", cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls to the column's mean, median or mode; columns without nulls stay as they are."""
    cols = numeric_columns(df) if cols is None else list(cols)
    stats = moments(df, cols)
    holed = [c for c in cols if 0 < stats[c]["count"] < stats[c]["rows"]]
    if not holed:
        return df
    if strategy == "mean":
        fill = {c: stats[c]["mean"] for c in holed}
    elif strategy == "median":
        rows = stats[holed[0]]["rows"]
        fill = {c: q[0] for c, q in quantile_table(df, holed, [0.5], rows=rows).items()}
    elif strategy == "mode":
        fill = modes(df, holed, "double")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return replace_columns(df, {c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


def fill_categories(df: DataFrame, strategy: str = "mode", constant: str = "Unknown",
                    cols: Sequence[str] | None = None) -> DataFrame:
    cols = categorical_columns(df) if cols is None else list(cols)
    if not cols:
        return df
    if strategy == "constant":
        fill = {c: constant for c in cols}
    elif strategy == "mode":
        found = modes(df, cols)
        fill = {c: found.get(c, constant) for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    kinds = dict(df.dtypes)
    return replace_columns(df, {
        c: F.coalesce(col(c), F.lit(v) if kinds[c] == "string" else F.lit(v).try_cast("boolean"))
        for c, v in fill.items()})


def _split_incomplete(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in ``cols``, and the stored other rows with an id."""
    holed = reduce(lambda a, b: a | b, [col(c).isNull() for c in cols])
    rest = df.filter(holed).withColumn("_rid", F.monotonically_increasing_id())
    return df.filter(~holed), cut_lineage(rest)


def impute_knn(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Mean of the k nearest rows that have the value, by distance over shared columns."""
    cols = numeric_columns(df) if cols is None else list(cols)
    stats = moments(df, cols)
    targets = [c for c in cols if 0 < stats[c]["count"] < stats[c]["rows"]]
    if not targets:
        return df
    done, rest = _split_incomplete(df, targets)
    # all columns in one search: a column is a group of its own, in which no row asks for its values
    asked = [rest.filter(col(t).isNull()).select(F.lit(i).alias("_col"), F.concat_ws(":", "_rid", F.lit(i)).alias("_ask"),
                                                 *[col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)]) for i, t in enumerate(targets)]
    known = [df.filter(col(t).isNotNull()).select(F.lit(i).alias("_col"), col(t).cast("double").alias("_pay"),
                                                  *[(F.lit(None) if c == t else col(c)).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)]) for i, t in enumerate(targets)]
    asked, known = (reduce(DataFrame.unionByName, part) for part in (asked, known))
    near = nearest_rows(asked, known, [f"_x{j}" for j in range(len(cols))], k, "_ask", "_pay", group="_col")
    total = F.aggregate("near", F.lit(0.0), lambda s, n: s + n["pay"])
    key = F.split("_ask", ":")
    fills = near.select(key[0].cast("long").alias("_id"), key[1].cast("int").alias("_of"), (total / F.size("near")).alias("_v")) \
        .groupBy("_id").agg(*[F.max(F.when(F.col("_of") == i, F.col("_v"))).alias(f"_v{i}") for i in range(len(targets))])
    filled = rest.join(fills, F.col("_rid") == F.col("_id"), "left").drop("_id")
    new = {t: F.coalesce(col(t).cast("double"), F.col(f"_v{i}"), F.lit(stats[t]["mean"]))
           for i, t in enumerate(targets)}
    names = df.columns
    filled = filled.select(*[new[c].alias(c) if c in new else col(c) for c in names])
    return replace_columns(done, {t: col(t).cast("double") for t in targets}).unionByName(filled)


def impute_iterative(df: DataFrame, cols: Sequence[str] | None = None, max_iter: int = 10,
                     tol: float = 1e-3, ridge: float = 1e-3) -> DataFrame:
    """Chained ridge regressions from a mean start, columns with fewest nulls first.

    Rows without nulls never change, so their share of the normal equations is
    summed once; each round reads only the incomplete rows, which are stored
    again after it.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    stats = moments(df, cols)
    cols = [c for c in cols if stats[c]["count"]]
    targets = sorted((c for c in cols if stats[c]["count"] < stats[c]["rows"]),
                     key=lambda c: (stats[c]["rows"] - stats[c]["count"], c))
    if not targets:
        return df
    spread = {c: stats[c]["pstd"] or 1.0 for c in cols}
    done, rest = _split_incomplete(df, targets)
    z = [f"_z{i}" for i in range(len(cols))]

    def scaled(c: str):
        return (col(c).cast("double") - stats[c]["mean"]) / spread[c]

    state = cut_lineage(rest.select("*", *[F.coalesce(scaled(c), F.lit(0.0)).alias(n) for c, n in zip(cols, z)]))
    fixed = _normal_sums(done.select(*[scaled(c).alias(n) for c, n in zip(cols, z)]), z)
    p = len(cols)
    for _ in range(max_iter):
        old = state
        for t in targets:
            j = cols.index(t)
            sums = fixed + _normal_sums(state.filter(col(t).isNotNull()), z)
            keep = [i for i in range(p) if i != j] + [p]
            gram = sums[np.ix_(keep, keep)] + ridge * np.eye(p)
            beta = np.linalg.solve(gram, sums[keep, j])
            guess = F.lit(float(beta[-1]))
            for i, b in zip(keep[:-1], beta[:-1]):
                guess = guess + F.lit(float(b)) * F.col(z[i])
            state = state.withColumn(z[j], F.when(col(t).isNull(), guess).otherwise(F.col(z[j])))
        state = cut_lineage(state)
        moved = old.select("_rid", *[F.col(n).alias(f"_o{i}") for i, n in enumerate(z)]).join(state, "_rid")
        change = moved.agg(F.max(F.greatest(*[F.abs(F.col(n) - F.col(f"_o{i}")) for i, n in enumerate(z)],
                                            F.lit(0.0)))).first()[0]
        if change is None or change < tol:
            break
    new = {t: F.coalesce(col(t).cast("double"), F.col(z[cols.index(t)]) * spread[t] + stats[t]["mean"])
           for t in targets}
    filled = state.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
    return replace_columns(done, {t: col(t).cast("double") for t in targets}).unionByName(filled)


def _normal_sums(df: DataFrame, z: Sequence[str]) -> np.ndarray:
    """Sums of products of the columns and a constant, as a symmetric matrix."""
    return cross_products(df.select(*z, F.lit(1.0).alias("_one")), [*z, "_one"])[1]


def impute(df: DataFrame, strategy: str = "mean", cat_strategy: str | None = "mode", constant: str = "Unknown",
           k: int = 5, max_iter: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """mean, median, mode, knn, iterative, drop, ffill or bfill; then the categories."""
    if strategy in ("mean", "median", "mode"):
        df = fill_numbers(df, strategy)
    elif strategy == "knn":
        df = impute_knn(df, k=k)
    elif strategy == "iterative":
        df = impute_iterative(df, max_iter=max_iter)
    elif strategy == "drop":
        df = df.na.drop("any")
    elif strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError("fills along the rows need order_by")
        cols = [c for c in df.columns if c not in order_by]
        df = fill_along(df, order_by, cols, backward=strategy == "bfill")
    elif strategy != "none":
        raise ValueError(f"unknown strategy {strategy!r}")
    return fill_categories(df, cat_strategy, constant) if cat_strategy else df
