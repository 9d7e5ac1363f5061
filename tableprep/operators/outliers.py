"""Outlier treatment per numeric column: bounds, removal, forest, power transform."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forest import isolation_flags
from .profile import moments
from .quantiles import quantile_table
from .roles import col, numeric_columns, replace_columns


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, skip_flat: bool = True) -> dict[str, tuple]:
    """(lower, upper) per column; columns with a zero range are left out if ``skip_flat``."""
    out = {}
    for c, (lo, hi) in quantile_table(df, cols, [0.25, 0.75]).items():
        if lo is not None and (hi > lo or not skip_flat):
            out[c] = (lo - k * (hi - lo), hi + k * (hi - lo))
    return out


def zscore_bounds(df: DataFrame, cols: Sequence[str], z: float = 3.0, sample: bool = True) -> dict[str, tuple]:
    """mean -/+ z standard deviations: sample ones for capping, population ones for flags."""
    key = "std" if sample else "pstd"
    return {c: (s["mean"] - z * s[key], s["mean"] + z * s[key])
            for c, s in moments(df, cols).items() if s[key]}


def _clip(c: str, bounds: tuple) -> Column:
    v = col(c).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(bounds[1])), F.lit(bounds[0])))


def _outside(c: str, bounds: tuple) -> Column:
    v = col(c).cast("double")
    return F.coalesce((v < bounds[0]) | (v > bounds[1]), F.lit(False))


def clip_to(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return replace_columns(df, {c: _clip(c, b) for c, b in bounds.items()})


def outlier_flags(df: DataFrame, method: str = "iqr", cols: Sequence[str] | None = None,
                  k: float = 1.5, z: float = 3.0) -> DataFrame:
    """Add ``is_outlier_<c>`` (0/1) per column."""
    cols = numeric_columns(df) if cols is None else list(cols)
    bounds = iqr_bounds(df, cols, k) if method == "iqr" else zscore_bounds(df, cols, z, sample=False)
    return df.withColumns({
        f"is_outlier_{c}": _outside(c, bounds[c]).cast("int") if c in bounds else F.lit(0) for c in cols})


def yeo_johnson(v: Column, lam: float) -> Column:
    up = F.log1p(v) if lam == 0 else (F.pow(v + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-v) if lam == 2 else -(F.pow(1 - v, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(v >= 0, up).when(v < 0, down)


def box_cox(v: Column, lam: float) -> Column:
    return F.log(v) if lam == 0 else (F.pow(v, F.lit(lam)) - 1) / lam


def _transform(method: str):
    if method == "yeo-johnson":
        return yeo_johnson
    if method == "box-cox":
        return box_cox
    raise ValueError(f"unknown power transform {method!r}")


def _scaled_powers(x: np.ndarray, lam: float, method: str, shift: float, offsets: bool) -> np.ndarray:
    """The transform of ``x`` times exp(-shift), without its constant terms unless ``offsets``.

    Constants do not change a variance while all values have one sign, and leaving them out keeps small powers apart.
    """
    one = math.exp(-shift) if offsets else 0.0
    if method == "box-cox":
        return np.log(x) if lam == 0 else (np.exp(lam * np.log(x) - shift) - one) / lam
    size = np.log1p(np.abs(x))
    up = size * math.exp(-shift) if lam == 0 else (np.exp(np.where(x >= 0, lam * size, shift) - shift) - one) / lam
    down = -size * math.exp(-shift) if lam == 2 else -(np.exp(np.where(x < 0, (2 - lam) * size, shift) - shift) - one) / (2 - lam)
    return np.where(x >= 0, up, down)


def _shift(lam: float, method: str, least: float, most: float) -> float:
    """The largest exponent that values between ``least`` and ``most`` have, so powers stay below one."""
    if method == "box-cox":
        return 0.0 if lam == 0 else max(lam * math.log(least), lam * math.log(most))
    ends = []
    if most >= 0 and lam != 0:
        ends += [lam * math.log1p(most), lam * math.log1p(max(least, 0.0))]
    if least < 0 and lam != 2:
        ends += [(2 - lam) * math.log1p(-least), (2 - lam) * math.log1p(max(-most, 0.0))]
    return max(ends, default=0.0)


def _power_sums(df: DataFrame, cols: Sequence[str], grids: dict[str, list[float]], method: str,
                stats: dict[str, dict]) -> np.ndarray:
    """Per column and exponent: rows, sums of the scaled transform and its square about a centre, and the slope."""
    data = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    size = len(grids[cols[0]])
    ends = {c: (stats[c]["min"], stats[c]["max"]) for c in cols}
    shifts = {c: [_shift(g, method, *ends[c]) for g in grids[c]] for c in cols}
    mixed = {c: ends[c][0] < 0 <= ends[c][1] for c in cols}
    middle = {c: [_scaled_powers(np.array([stats[c]["mean"]]), g, method, s, mixed[c])[0] for g, s in zip(grids[c], shifts[c])] for c in cols}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cols), size, 4))
        for batch in batches:
            for i, c in enumerate(cols):
                x = batch.iloc[:, i].to_numpy(dtype=float)
                x = x[~np.isnan(x)]
                slope = np.log(x).sum() if method == "box-cox" else (np.sign(x) * np.log1p(np.abs(x))).sum()
                for j, lam in enumerate(grids[c]):
                    y = _scaled_powers(x, lam, method, shifts[c][j], mixed[c]) - middle[c][j]
                    total[i, j] += (len(x), y.sum(), (y * y).sum(), slope)
        yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    out = np.zeros(len(cols) * size * 4)
    for r in data.mapInPandas(partial, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r["k"]] = r["s"]
    out = out.reshape(len(cols), size, 4)
    return np.concatenate([out, np.array([shifts[c] for c in cols])[:, :, None]], axis=2)


def fit_power(df: DataFrame, cols: Sequence[str], method: str = "yeo-johnson") -> dict[str, float]:
    """The exponent of largest log-likelihood per column: a grid that moves until its best lies inside, refined three times.

    Variances are summed from powers scaled by their largest exponent and compared as logarithms, so no
    exponent overflows. A column without two different values keeps exponent 1.
    """
    _transform(method)
    stats = moments(df, cols) if cols else {}
    if method == "box-cox" and any(s["min"] is not None and s["min"] <= 0 for s in stats.values()):
        raise ValueError("box-cox needs values above zero")
    best = dict.fromkeys(cols, 1.0)
    open_ = [c for c in cols if stats[c]["min"] is not None and stats[c]["min"] < stats[c]["max"]]
    grids, fine = {c: [round(-4 + 0.25 * i, 10) for i in range(33)] for c in open_}, {c: 0.25 for c in open_}
    while open_:
        # columns are at different steps; those with grids of one length share a pass
        now = [c for c in open_ if len(grids[c]) == len(grids[open_[0]])]
        for c, sums in zip(now, _power_sums(df, now, grids, method, stats)):
            values = []
            for lam, (n, s, ss, slope, shift) in zip(grids[c], sums):
                var = (ss - s * s / n) / n
                if np.isfinite(var) and var > 0:
                    values.append((-n / 2 * (math.log(var) + 2 * shift) + (lam - 1) * slope, lam))
            if not values:
                open_.remove(c)
                continue
            best[c], ends = max(values)[1], (grids[c][0], grids[c][-1])
            known = [lam for _, lam in values]
            if best[c] in ends and len(known) == len(grids[c]):  # the best may lie beyond
                width, step = (ends[1] - ends[0]), grids[c][1] - grids[c][0]
                low = best[c] - step if best[c] == ends[1] else best[c] + step - width
                grids[c] = [round(low + step * i, 10) for i in range(len(grids[c]))]
            elif fine[c] <= 0.25 / 512:
                open_.remove(c)
            else:
                fine[c] /= 8
                grids[c] = [round(best[c] + fine[c] * i, 10) for i in range(-8, 9)]
    return best


def power_transform(df: DataFrame, cols: Sequence[str] | None = None, method: str = "yeo-johnson",
                    lambdas: dict[str, float] | None = None, standardize: bool = True) -> DataFrame:
    """Yeo-Johnson or Box-Cox with fitted or given exponents, then population standardisation."""
    cols = numeric_columns(df) if cols is None else list(cols)
    lambdas = fit_power(df, cols, method) if lambdas is None else lambdas
    apply = _transform(method)
    out = replace_columns(df, {c: apply(col(c).cast("double"), lambdas[c]) for c in cols})
    if not standardize:
        return out
    stats = moments(out, cols)
    return replace_columns(out, {c: (col(c) - s["mean"]) / (s["pstd"] or 1.0)
                                 for c, s in stats.items() if s["count"]})


def outliers(df: DataFrame, method: str = "iqr", action: str = "cap", cols: Sequence[str] | None = None,
             k: float = 1.5, z: float = 3.0, contamination: float = 0.05, transform: str = "yeo-johnson",
             sequential: bool = True, skip_flat: bool = True, seed: int = 42) -> DataFrame:
    """Treat outliers of the numeric columns.

    Capping does not move the bounds of other columns, so all are fitted at
    once. Removal goes column by column, each on the rows the last one left.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    if method == "isolation":
        method = "isolation_forest"
    if method not in ("iqr", "zscore", "isolation_forest"):
        raise ValueError(f"unknown outlier method {method!r}")
    if action == "transform":
        return power_transform(df, cols, transform)
    if action not in ("cap", "remove"):
        raise ValueError(f"unknown outlier action {action!r}")
    if method == "isolation_forest":
        if action == "cap":
            return _forest_cap(df, cols, contamination, seed)
        for c in cols:
            df = isolation_flags(df, [c], contamination, seed=seed).filter("NOT _outlier").drop("_outlier")
        return df

    def bounds(frame: DataFrame, names: Sequence[str], sample: bool) -> dict[str, tuple]:
        return iqr_bounds(frame, names, k, skip_flat) if method == "iqr" else zscore_bounds(frame, names, z, sample)

    if action == "cap":
        return clip_to(df, bounds(df, cols, True))
    for group in ([c] for c in cols) if sequential else [cols]:
        for c, b in bounds(df, group, False).items():
            df = df.filter(~_outside(c, b))
    return df


def _forest_cap(df: DataFrame, cols: Sequence[str], contamination: float, seed: int) -> DataFrame:
    """Clip to the 1 % and 99 % quantiles each column in which the forest flags a row."""
    flagged = [c for c in cols if not isolation_flags(df, [c], contamination, seed=seed).filter("_outlier").isEmpty()]
    q = quantile_table(df, flagged, [0.01, 0.99])
    return clip_to(df, {c: tuple(q[c]) for c in flagged})
