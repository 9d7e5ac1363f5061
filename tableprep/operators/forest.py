"""Isolation forest: trees are grown from a small sample of rows, scores are
computed where the rows are."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import quantile_table
from .roles import col

EULER = 0.5772156649


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes as (feature, cut, left, right, path length at a leaf)."""
    nodes: list[tuple] = []
    todo = [(x, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            f, cut, *kids, path = nodes[parent]
            kids[side] = here
            nodes[parent] = (f, cut, *kids, path)
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((-1, 0.0, here, here, depth + expected_path(len(part))))
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        below = part[:, f] < cut
        if below.all() or not below.any():
            below = part[:, f] <= part[:, f].min()
            cut = float(np.nextafter(part[below, f].max(), np.inf))
        nodes.append((f, cut, -1, -1, 0.0))
        todo += [(part[below], depth + 1, here, 0), (part[~below], depth + 1, here, 1)]
    return nodes


def draw_rows(df: DataFrame, cols: Sequence[str], wanted: int, seed: int = 42) -> np.ndarray:
    """``wanted`` rows of ``cols`` without nulls (all, if fewer), drawn evenly and the same for any partitioning.

    Equal rows are counted first, so each copy has a key of its own and values come in their
    shares: a row that is there once has a hash as its key, of ``m`` copies a binomial number
    falls below the threshold, with that many even keys. The smallest keys win. Only about
    four times ``wanted`` keys are made, however many copies a value has.
    """
    names = [f"_{i}" for i in range(len(cols))]
    data = df.select(*[col(c).cast("double").alias(n) for c, n in zip(cols, names)]).na.drop()
    rows = data.count()
    share = min(1.0, (4 * wanted + 1000) / max(rows, 1))
    counts = data.groupBy(*names).agg(F.count("*").alias("_m")).withColumn("_h", F.xxhash64(F.lit(seed), *names))

    @F.pandas_udf("array<double>")
    def keys(copies: pd.Series, hashed: pd.Series) -> pd.Series:
        out = []
        for m, h in zip(copies, hashed):
            rng = np.random.default_rng([seed & 0xFFFFFFFF, int(h) & 0xFFFFFFFFFFFFFFFF])
            out.append(rng.random(int(rng.binomial(m, share)) if share < 1.0 else int(m)) * share)
        return pd.Series(out)

    lone = (F.col("_h").bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("_u")
    once = counts.filter("_m = 1").select(*names, lone).filter(F.col("_u") < share)
    more = counts.filter("_m > 1").select(*names, F.explode(keys("_m", "_h")).alias("_u"))
    return once.unionByName(more).orderBy("_u", *names).limit(wanted).drop("_u").toPandas().to_numpy(dtype=float)


def fit_forest(df: DataFrame, cols: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42) -> dict:
    """Grow the trees from at most ``trees * size`` rows."""
    pool = draw_rows(df, cols, trees * size, seed)
    # order of the pool must not depend on how the rows were partitioned
    pool = pool[np.lexsort(pool.T[::-1])]
    rng = np.random.default_rng(seed)
    size = min(size, len(pool))
    limit = math.ceil(math.log2(max(size, 2)))
    grown = []
    for _ in range(trees):
        nodes = _grow(pool[rng.choice(len(pool), size, replace=False)], limit, rng)
        grown.append(tuple(np.array(v) for v in zip(*nodes)))
    return {"trees": grown, "norm": expected_path(size) or 1.0, "depth": limit}


def score_column(forest: dict, cols: Sequence[str]) -> Column:
    """Anomaly score in (0, 1); null where a feature is null."""
    trees, norm, depth = forest["trees"], forest["norm"], forest["depth"]

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy(dtype=float)
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, left, right, path in trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(depth + 1):
                f = feature[node]
                go_left = x[row, np.maximum(f, 0)] < cut[node]
                node = np.where(go_left, left[node], right[node])
            total += path[node]
        out = np.power(2.0, -total / len(trees) / norm)
        out[np.isnan(x).any(axis=1)] = np.nan
        return pd.Series(out).where(~np.isnan(out), None)

    return score(F.struct(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]))


def isolation_scores(df: DataFrame, cols: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42,
                     name: str = "score") -> DataFrame:
    return df.withColumn(name, score_column(fit_forest(df, cols, trees, size, seed), cols))


def isolation_flags(df: DataFrame, cols: Sequence[str], contamination: float = 0.05, trees: int = 100,
                    size: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``_outlier``: score above the (1 - contamination) quantile of all scores."""
    scored = isolation_scores(df, cols, trees, size, seed, "_score")
    # quantiles may take several passes, and only the scores are needed for them
    scores = cut_lineage(scored.select("_score"))
    edge = quantile_table(scores, ["_score"], [1 - contamination])["_score"][0]
    flag = F.coalesce(F.col("_score") > edge, F.lit(False)) if edge is not None else F.lit(False)
    return scored.withColumn("_outlier", flag).drop("_score")
