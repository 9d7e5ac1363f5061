"""Scaling of numeric columns; statistics come from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .profile import moments
from .quantiles import quantile_table
from .roles import col, numeric_columns, replace_columns


def fit_scale(df: DataFrame, method: str = "standard", cols: Sequence[str] | None = None) -> dict[str, tuple]:
    """(centre, width) per column; a width of zero becomes one."""
    cols = numeric_columns(df) if cols is None else [c for c in cols if c in df.columns]
    if method in ("standard", "minmax"):
        stats = {c: s for c, s in moments(df, cols).items() if s["count"]}
        if method == "standard":
            return {c: (s["mean"], s["pstd"] or 1.0) for c, s in stats.items()}
        return {c: (s["min"], (s["max"] - s["min"]) or 1.0) for c, s in stats.items()}
    if method == "robust":
        q = quantile_table(df, cols, [0.25, 0.5, 0.75])
        return {c: (v[1], (v[2] - v[0]) or 1.0) for c, v in q.items() if v[0] is not None}
    raise ValueError(f"unknown scaling {method!r}")


def scale(df: DataFrame, method: str = "standard", cols: Sequence[str] | None = None) -> DataFrame:
    if method == "none":
        return df
    fitted = fit_scale(df, method, cols)
    return replace_columns(df, {c: (col(c).cast("double") - a) / b for c, (a, b) in fitted.items()})
