"""Processing history, activity and recent entries, as append-only tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.roles import col

HISTORY = ("action string, params string, timestamp timestamp, rows long, columns int, "
           "success boolean, message string")


def history_append(spark: SparkSession, path: str, entries: Sequence[Mapping] | DataFrame) -> None:
    """Add finished actions: action, params (any JSON value), timestamp, shape, success, message.

    A frame of entries has the columns of ``HISTORY``, in any order.
    """
    if isinstance(entries, DataFrame):
        shape = [f.strip().rsplit(" ", 1) for f in HISTORY.split(",")]
        entries.select(*[col(n).cast(k).alias(n) for n, k in shape]).write.mode("append").parquet(path)
        return
    rows = [(e["action"], json.dumps(e.get("params", {}), sort_keys=True), e["timestamp"], *e["shape"],
             e.get("success", True), e.get("message", "")) for e in entries]
    spark.createDataFrame(rows, HISTORY).write.mode("append").parquet(path)


def history_recent(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.desc("timestamp"), "action", "rows").limit(n)


def latest_n(df: DataFrame, owner: str, ts: str, tie: str, n: int) -> DataFrame:
    """The newest n rows per owner; Spark trims each group before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(col(owner)).orderBy(col(ts).desc(), col(tie).desc()))
    return (df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
            .orderBy(owner, ts, tie))


def recent_activity(sources: Mapping[str, tuple[DataFrame, str, str]], n: int = 5) -> DataFrame:
    """Newest n entries of each (frame, time column, label column): kind, ts, label."""
    parts = []
    for kind, (df, ts, label) in sources.items():
        newest = df.select(F.lit(kind).alias("kind"), col(ts).alias("ts"), col(label).cast("string").alias("label"))
        parts.append(newest.orderBy(F.desc("ts"), "label").limit(n))
    return reduce(lambda a, b: a.unionByName(b), parts)


def activity_stats(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per owner in each (frame, owner column), zero where there are none."""
    parts = [df.groupBy(col(owner).alias("owner")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
             for kind, (df, owner) in sources.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.groupBy("owner").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in sources])


def export_messages(df: DataFrame, ts: str, message: str, response: str, context: str) -> DataFrame:
    """Chat rows as they are exported: formatted time, empty text for a missing context."""
    return df.select(F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                     col(message).alias("message"), col(response).alias("response"),
                     F.coalesce(col(context), F.lit("")).alias("context"))


def export_files(inventory: DataFrame) -> DataFrame:
    """File list as exported: rows, columns, size in KB with two digits."""
    return inventory.select("name", F.coalesce("rows", F.lit(0)).alias("rows"),
                            F.coalesce("columns", F.lit(0)).alias("columns"),
                            F.round(F.col("bytes") / 1024, 2).alias("size_kb"))
