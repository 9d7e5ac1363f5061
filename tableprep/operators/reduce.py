"""Linear reductions: Spark sums the cross products, the driver solves a p x p problem,
and the projection is a column expression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .roles import col, numeric_columns

EXPRESSION_COLUMNS = 6


def cross_products(df: DataFrame, cols: Sequence[str], centre: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """Rows used, and the matrix of summed products of (shifted) columns; rows with nulls are left out."""
    p = len(cols)
    shift = np.zeros(p) if centre is None else centre
    data = df.select(*[(col(c).cast("double") - float(m)).alias(f"_{i}")
                       for i, (c, m) in enumerate(zip(cols, shift))]).na.drop()
    out = np.zeros((p, p))
    if p <= EXPRESSION_COLUMNS:
        cells = [(i, j) for i in range(p) for j in range(i, p)]
        row = data.agg(F.count("*"), *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{n}")
                                       for n, (i, j) in enumerate(cells)]).first()
        for n, (i, j) in enumerate(cells):
            out[i, j] = out[j, i] = row[n + 1] or 0.0
        return row[0], out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((p, p)), 0
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            total += x.T @ x
            n += len(x)
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "s": np.append(total[i, j], n)})

    sums = data.mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    count = 0
    for r in sums.collect():
        if r["i"] < 0:
            count = int(r["s"])
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return count, out


def _means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    data = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).na.drop()
    row = data.agg(*[F.avg(f"_{i}") for i in range(len(cols))]).first()
    return np.array([v or 0.0 for v in row])


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Turn each column so that its loading of largest size is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _project(df: DataFrame, cols: Sequence[str], centre: np.ndarray, vectors: np.ndarray, prefix: str) -> DataFrame:
    made = []
    for k in range(vectors.shape[1]):
        value = F.lit(0.0)
        for c, m, w in zip(cols, centre, vectors[:, k]):
            value = value + (col(c).cast("double") - float(m)) * float(w)
        made.append(value.alias(f"{prefix}_{k + 1}"))
    return df.select(*[col(c) for c in df.columns if c not in cols], *made)


def reduce_pca(df: DataFrame, n_components: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns become ``PCA_1..k``, centred."""
    cols = numeric_columns(df) if cols is None else list(cols)
    centre = _means(df, cols)
    _, gram = cross_products(df, cols, centre)
    vectors = _signed(np.linalg.eigh(gram)[1][:, ::-1][:, :max(1, min(n_components, len(cols)))])
    return _project(df, cols, centre, vectors, "PCA")


def reduce_svd(df: DataFrame, n_components: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns become ``SVD_1..k``, not centred."""
    cols = numeric_columns(df) if cols is None else list(cols)
    _, gram = cross_products(df, cols)
    vectors = _signed(np.linalg.eigh(gram)[1][:, ::-1][:, :max(1, min(n_components, len(cols)))])
    return _project(df, cols, np.zeros(len(cols)), vectors, "SVD")


def reduce_lda(df: DataFrame, target: str, n_components: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns become ``LDA_1..k``, the directions that part the classes best."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != target]
    data = df.select(col(target).alias("_t"), *[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).na.drop()
    classes = data.groupBy("_t").agg(F.count("*").alias("n"), *[F.avg(f"_{i}").alias(f"m{i}") for i in range(len(cols))])
    classes = cut_lineage(classes)
    facts = classes.agg(F.count("*"), F.sum("n"), *[F.sum(F.col("n") * F.col(f"m{i}")) for i in range(len(cols))]).first()
    if facts[0] < 2:
        raise ValueError("the target needs two classes or more")
    centre = np.array(facts[2:], dtype=float) / facts[1]
    _, total = cross_products(df.filter(col(target).isNotNull()), cols, centre)
    # the classes stay where they are: only p x p sums over them are needed
    apart = classes.select(*[(F.sqrt("n") * (F.col(f"m{i}") - float(m))).alias(f"d{i}") for i, m in enumerate(centre)])
    _, between = cross_products(apart, apart.columns)
    within = (total - between) / max(facts[1] - facts[0], 1)
    within += np.eye(len(cols)) * 1e-12 * np.trace(within)
    root = np.linalg.inv(np.linalg.cholesky(within))
    vectors = root.T @ np.linalg.eigh(root @ between @ root.T)[1][:, ::-1]
    k = max(1, min(n_components, facts[0] - 1, len(cols)))
    return _project(df, cols, centre, _signed(vectors[:, :k]), "LDA")
