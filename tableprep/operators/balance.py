"""Class balancing, with draws that depend only on row keys and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .knn import nearest_rows
from .ordered import hash_ranked
from .roles import col, numeric_columns

# fixed values of the draws: multipliers for row id and draw number, and the modulus
NEIGHBOUR_STEP = (31, 17)
SHARE_STEP = (7919, 104729, 1000003)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(col(target).alias("class")).agg(F.count("*").alias("n"))


def _sizes(df: DataFrame, target: str) -> tuple[DataFrame, dict]:
    """Stored rows per class (``_class``, ``_size``), and their count, least, greatest and sum."""
    sizes = cut_lineage(df.filter(col(target).isNotNull()).groupBy(col(target).alias("_class")).agg(F.count("*").alias("_size")))
    facts = sizes.agg(F.count("*").alias("classes"), F.min("_size").alias("least"), F.max("_size").alias("most"),
                      F.sum("_size").alias("rows")).first().asDict()
    if facts["classes"] < 2 or facts["classes"] >= facts["rows"] / 2:
        raise ValueError(f"{target} is not a class column to balance")
    return sizes, facts


def _sized(df: DataFrame, target: str, sizes: DataFrame) -> DataFrame:
    """``df`` with the size of each row's class; a large table of classes is not broadcast."""
    return df.join(broadcast_if_small(sizes), col(target) == F.col("_class")).drop("_class")


def _unlabelled(df: DataFrame, target: str) -> DataFrame:
    """Rows without a class, which balancing leaves as they are."""
    return df.filter(col(target).isNull())


def balance_undersample(df: DataFrame, target: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, in hash order of the row id."""
    _, facts = _sizes(df, target)
    ranked = hash_ranked(df.filter(col(target).isNotNull()), [target], id_col, str(seed), rows=facts["rows"])
    return ranked.filter(F.col("_rank") < facts["least"]).drop("_rank").unionByName(_unlabelled(df, target))


def balance_oversample(df: DataFrame, target: str, id_col: str, seed: int = 42) -> DataFrame:
    """Rows of smaller classes repeated in turn up to the size of the largest."""
    sizes, facts = _sizes(df, target)
    most = F.lit(facts["most"])
    ranked = _sized(hash_ranked(df.filter(col(target).isNotNull()), [target], id_col, str(seed), rows=facts["rows"]), target, sizes)
    copies = F.floor(most / F.col("_size"))
    extra = F.when(F.col("_rank") < most % F.col("_size"), 1).otherwise(0)
    grown = ranked.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), copies + extra))).drop("_rank", "_size", "_c")
    return grown.unionByName(_unlabelled(df, target))


def balance_smote(df: DataFrame, target: str, id_col: str, features: Sequence[str] | None = None,
                  k: int = 5, seed: int = 42) -> DataFrame:
    """Smaller classes grown with points between a row and one of its k nearest of the class.

    New rows carry the class and the features; other columns are null.
    """
    features = [c for c in (numeric_columns(df) if features is None else features) if c not in (target, id_col)]
    sizes, facts = _sizes(df, target)
    k = min(k, facts["least"] - 1)
    if k < 1:
        raise ValueError("the smallest class has a single row")
    if facts["least"] == facts["most"]:
        return df
    grown = sizes.filter(F.col("_size") < facts["most"])
    few = _sized(df, target, grown).drop("_size")
    ranked = hash_ranked(few, [target], id_col, str(seed), rows=grown.agg(F.sum("_size")).first()[0])
    ranked = _sized(ranked, target, grown)
    size = F.col("_size")
    missing = F.lit(facts["most"]) - size
    drawn = (ranked.filter(F.col("_rank") < missing)
             .withColumn("_i", F.explode(F.sequence(F.col("_rank"), missing - 1, size))))
    near = nearest_rows(few, few, features, k, id_col, id_col, group=target, self_id=id_col)
    near = near.select(col(id_col).alias("_base"), F.transform("near", lambda n: n["pay"]).alias("_near"))
    a, b = NEIGHBOUR_STEP
    c, d, m = SHARE_STEP
    rid, i = col(id_col), F.col("_i")
    drawn = (drawn.join(near, rid == F.col("_base"))
             .withColumn("_other", F.element_at("_near", (F.pmod(rid * a + i * b + seed, F.lit(k)) + 1).cast("int")))
             .withColumn("_u", F.pmod(rid * c + i * d + seed, F.lit(m)) / float(m)))
    other = few.select(col(id_col).alias("_oid"), *[col(f).cast("double").alias(f"_o{n}") for n, f in enumerate(features)])
    drawn = drawn.join(other, F.col("_other") == F.col("_oid"))
    kinds = dict(df.dtypes)
    new = {f: col(f).cast("double") + F.col("_u") * (F.col(f"_o{n}") - col(f).cast("double"))
           for n, f in enumerate(features)}
    made = drawn.select(*[new[x].alias(x) if x in new else col(x) if x == target
                          else F.lit(None).cast(kinds[x]).alias(x) for x in df.columns])
    base = df.select(*[col(x).cast("double").alias(x) if x in new else col(x) for x in df.columns])
    return base.unionByName(made)


def balance(df: DataFrame, target: str, method: str = "smote", id_col: str | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    if id_col is None:
        raise ValueError("balancing needs id_col, a unique integer key")
    if method == "undersample":
        return balance_undersample(df, target, id_col, seed)
    if method == "oversample":
        return balance_oversample(df, target, id_col, seed)
    if method == "smote":
        return balance_smote(df, target, id_col, k=k, seed=seed)
    raise ValueError(f"unknown balancing {method!r}")
