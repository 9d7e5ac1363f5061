"""Derived features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_table
from .roles import col, numeric_columns


def polynomial_features(df: DataFrame, degree: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """All monomials up to ``degree`` in place of the numeric columns: ``a``, ``a^2``, ``a b``."""
    cols = numeric_columns(df) if cols is None else list(cols)
    out = [col(c) for c in df.columns if c not in cols]
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            powers = {c: combo.count(c) for c in combo}
            name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            value = F.lit(1.0)
            for c in combo:
                value = value * col(c).cast("double")
            out.append(value.alias(name))
    return df.select(*out)


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int = 5) -> DataFrame:
    """Add ``<col>_binned``: index of the right-closed quantile interval, equal edges merged."""
    cols = [c for c in cols if c in df.columns]
    edges = quantile_table(df, cols, [i / bins for i in range(bins + 1)])
    new = {}
    for c in cols:
        cuts = sorted({e for e in edges[c] if e is not None})
        if len(cuts) < 2:
            new[f"{c}_binned"] = F.lit(None).cast("int")
            continue
        v = col(c).cast("double")
        index = F.when(v <= cuts[1], 0)
        for i, edge in enumerate(cuts[2:], start=1):
            index = index.when(v <= edge, i)
        new[f"{c}_binned"] = index.cast("int")
    return df.withColumns(new)
