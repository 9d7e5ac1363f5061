"""Keyword rules that sort a table of request texts into intents and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.roles import col

# fixed values: the words that mark each intent
INTENTS = {
    "summary": ["summary", "describe", "info", "about", "overview", "tell me"],
    "plot": ["plot", "visual", "chart", "graph", "show", "display", "summar"],
    "preprocess": ["preprocess", "pre-process", "clean", "handle missing", "scale", "normalize", "encode", "impute",
                   "outlier", "drop column", "remove column"],
    "filter": ["filter", "where"],
    "correlation": ["correlat", "relationship", "relate"],
}
# fixed values: the words that ask for the whole chart set
ALL_CHARTS = ["all", "every", "comprehensive", "summar", "possible", "auto"]
# fixed values: per setting the words in order of precedence, and the default
SETTINGS = {
    "missing": ([("mean", ["mean"]), ("knn", ["knn"]), ("iterative", ["iterative", "mice"])], "median"),
    "scaling": ([("standard", ["standard", "z-score"]), ("minmax", ["minmax", "normalize"]), ("robust", ["robust"])], "none"),
    "outlier": ([("iqr", ["iqr"]), ("zscore", ["zscore", "z-score"]), ("isolation", ["isolation"])], "none"),
    "reduce": ([("pca", ["pca"])], "none"),
}


def has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def route_requests(df: DataFrame, text: str) -> DataFrame:
    """Add 0/1 columns ``is_<intent>``; a request may have several."""
    low = F.lower(col(text))
    flags = {f"is_{name}": F.coalesce(has_any(low, words).cast("int"), F.lit(0)) for name, words in INTENTS.items()}
    plotted = has_any(low, INTENTS["plot"]) & has_any(low, ALL_CHARTS)
    return df.withColumns({**flags, "is_plot_all": F.coalesce(plotted.cast("int"), F.lit(0))})


def route_prep_config(df: DataFrame, text: str) -> DataFrame:
    """Add the settings ``missing, scaling, outlier, reduce, encode`` a request asks for."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    out = {}
    for name, (rules, default) in SETTINGS.items():
        value = F.lit(default)
        for setting, words in reversed(rules):
            value = F.when(has_any(low, words), setting).otherwise(value)
        out[name] = value
    mentions = has_any(low, ["encode", "encoding", "categorical", "one-hot", "onehot"])
    out["encode"] = (F.when(mentions & low.contains("label") & low.contains("encod"), "label")
                     .when(mentions & low.contains("ordinal"), "ordinal").otherwise("onehot"))
    return df.withColumns(out)


def intent_counts(df: DataFrame, text: str) -> DataFrame:
    """intent, n: requests per intent."""
    names = list(INTENTS)
    one = route_requests(df, text).agg(*[F.sum(f"is_{n}").alias(n) for n in names])
    return one.unpivot([], names, "intent", "n")
