"""Whole preparation runs: a settings object, two step orders, presets, comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impute as missing
from ..operators.balance import balance
from ..operators.encode import encode
from ..operators.engineer import polynomial_features, quantile_bins
from ..operators.outliers import iqr_bounds, outliers, power_transform, zscore_bounds
from ..operators.reduce import reduce_lda, reduce_pca, reduce_svd
from ..operators.roles import categorical_columns, numeric_columns
from ..operators.scale import scale
from ..operators.select import select_importance, select_kbest, select_variance
from ..session import cut_lineage


@dataclass(frozen=True)
class PrepSpec:
    """Settings of a run; ``none`` leaves a step out."""

    order: str = "app"
    missing: str = "mean"
    cat_missing: str = "mode"
    constant: str = "Unknown"
    knn_neighbors: int = 5
    iter_max: int = 10
    outlier: str = "none"
    outlier_action: str = "cap"
    contamination: float = 0.05
    transform: str = "yeo-johnson"
    scaling: str = "none"
    encode: str = "none"
    max_categories: int | None = None
    drop_first: bool = True
    reduce: str = "none"
    n_components: int = 2
    select: str = "none"
    var_threshold: float = 0.0
    k_best: int | str = "all"
    imp_threshold: float = 0.01
    balance: str = "none"
    target: str | None = None
    id_col: str | None = None
    polynomial: bool = False
    degree: int = 2
    bin_columns: tuple[str, ...] = ()
    bins: int = 5
    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    seed: int = 42


def api_spec(**settings) -> PrepSpec:
    """Defaults of the service order: no category limit, all one-hot columns, a variance floor."""
    return replace(PrepSpec(order="api", max_categories=None, drop_first=False, var_threshold=0.01), **settings)


# fixed values: the settings of the presets
PRESETS = {
    "smart_clean": PrepSpec(missing="median", outlier="iqr", scaling="standard", encode="onehot", max_categories=10),
    "full": PrepSpec(missing="knn", outlier="iqr", scaling="minmax", encode="onehot", max_categories=15,
                     select="variance", var_threshold=0.01),
    "api": api_spec(missing="median", outlier="iqr", encode="onehot", scaling="standard"),
}


def _numbers(df: DataFrame, spec: PrepSpec) -> list[str]:
    """Numeric columns that steps may change; row keys in ``keep`` are carried along."""
    return [c for c in numeric_columns(df) if c not in spec.keep]


def _categories(df: DataFrame, spec: PrepSpec) -> list[str]:
    return [c for c in categorical_columns(df) if c not in spec.keep]


def _missing(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    nums, cats = _numbers(df, spec), _categories(df, spec)
    holes = missing.null_counts(df, nums + cats)
    if spec.missing in ("mean", "median", "mode"):
        df = missing.fill_numbers(df, spec.missing, nums)
        log += [f"{c}: nulls became the {spec.missing}" for c in nums if holes[c]]
    elif spec.missing == "knn":
        df = cut_lineage(missing.impute_knn(df, nums, spec.knn_neighbors))
        log.append("numbers: nulls filled from nearest rows")
    elif spec.missing == "iterative":
        df = cut_lineage(missing.impute_iterative(df, nums, spec.iter_max))
        log.append("numbers: nulls filled by iterated regressions")
    elif spec.missing == "drop":
        df = df.na.drop("any")
        log.append("rows with nulls left out")
    elif spec.missing != "none":
        raise ValueError(f"unknown strategy {spec.missing!r}")
    if spec.cat_missing in ("mode", "constant"):
        holed = [c for c in cats if holes[c]] if spec.missing != "drop" else []
        if holed:
            df = missing.fill_categories(df, spec.cat_missing, spec.constant, holed)
        log += [f"{c}: nulls became the {spec.cat_missing}" for c in holed]
    return df


def _outliers(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    nums = _numbers(df, spec)
    if spec.outlier_action == "transform":
        # the service order transforms only together with the range method
        if spec.order == "api" and spec.outlier != "iqr":
            return df
        log.append("numbers: power transform")
        return power_transform(df, nums, spec.transform)
    log.append(f"outliers by {spec.outlier}: {spec.outlier_action}")
    out = outliers(df, spec.outlier, spec.outlier_action, nums, contamination=spec.contamination, seed=spec.seed)
    return cut_lineage(out) if spec.outlier.startswith("isolation") else out


def _scale(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    log.append(f"numbers: {spec.scaling} scale")
    return scale(df, spec.scaling, [c for c in _numbers(df, spec) if c != spec.target])


def _encode(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    cats = [c for c in _categories(df, spec) if c != spec.target]
    return encode(df, spec.encode, cats, spec.max_categories, spec.drop_first, spec.target, log)


def _reduce(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    nums = [c for c in _numbers(df, spec) if c != spec.target]
    if len(nums) < 2 or (spec.order == "api" and len(nums) <= spec.n_components):
        return df
    if spec.reduce == "lda":
        if not spec.target:
            raise ValueError("lda needs a target")
        out = reduce_lda(df, spec.target, spec.n_components, nums)
    elif spec.reduce in ("pca", "svd"):
        out = (reduce_pca if spec.reduce == "pca" else reduce_svd)(df, spec.n_components, nums)
    else:
        raise ValueError(f"unknown reduction {spec.reduce!r}")
    log.append(f"{spec.reduce}: {spec.n_components} components")
    return out


def _select(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    held = [c for c in df.columns if c in spec.keep]
    body = df.drop(*held)
    if spec.select == "variance":
        out = select_variance(body, spec.var_threshold)
    elif spec.select == "kbest" and spec.target:
        out = select_kbest(body, spec.target, spec.k_best)
    elif spec.select == "importance" and spec.target:
        out = select_importance(body, spec.target, spec.imp_threshold, seed=spec.seed)
    else:
        raise ValueError(f"cannot select by {spec.select!r}")
    log.append(f"columns chosen by {spec.select}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in held or c in out.columns])


def _balance(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    out = balance(df, spec.target, spec.balance, spec.id_col, seed=spec.seed)
    log.append(f"classes balanced by {spec.balance}")
    return cut_lineage(out)


def _polynomial(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    nums = [c for c in _numbers(df, spec) if c != spec.target]
    if spec.order == "api" and len(nums) < 2:
        return df
    log.append(f"polynomials up to degree {spec.degree}")
    return polynomial_features(df, spec.degree, nums)


def _bins(df: DataFrame, spec: PrepSpec, log: list[str]) -> DataFrame:
    log += [f"{c}: {spec.bins} quantile bins" for c in spec.bin_columns if c in df.columns]
    return quantile_bins(df, spec.bin_columns, spec.bins)


def _steps(spec: PrepSpec) -> list[tuple[str, Callable]]:
    scaled = ("scaling", _scale) if spec.scaling != "none" else None
    encoded = ("encoding", _encode) if spec.encode != "none" else None
    middle = [encoded, scaled] if spec.order == "api" else [scaled, encoded]
    steps = [
        ("missing values", _missing),
        ("outliers", _outliers) if spec.outlier != "none" or spec.outlier_action == "transform" else None,
        *middle,
        ("reduction", _reduce) if spec.reduce != "none" else None,
        ("selection", _select) if spec.select != "none" else None,
        ("balancing", _balance) if spec.balance != "none" else None,
        ("polynomials", _polynomial) if spec.polynomial else None,
        ("bins", _bins) if spec.bin_columns else None,
    ]
    return [s for s in steps if s]


def prepare(df: DataFrame, spec: PrepSpec, on_error: str = "raise") -> tuple[DataFrame, list[str]]:
    """Run the steps in the order of ``spec.order``.

    A step that cannot run raises; with ``on_error="skip"`` it is noted and left out.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if spec.order not in ("app", "api"):
        raise ValueError(f"unknown order {spec.order!r}")
    log: list[str] = []
    if spec.drop:
        df = df.drop(*spec.drop)
    for name, step in _steps(spec):
        notes: list[str] = []
        try:
            df = step(df, spec, notes)
            log += notes
        except (ValueError, ArithmeticError) as problem:
            if on_error == "raise":
                raise
            log.append(f"{name} skipped: {problem}")
    return df, log


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing cells before and after."""
    def facts(df: DataFrame, stage: str) -> DataFrame:
        nulls = sum((F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns), F.lit(0))
        return df.agg(F.count("*").alias("rows"), nulls.alias("missing")).select(
            F.lit(stage).alias("stage"), "rows", F.lit(len(df.columns)).alias("columns"), "missing")
    return facts(before, "before").unionByName(facts(after, "after"))
