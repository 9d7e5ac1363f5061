"""The catalogue of datasets: one row of facts per table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roles import col


def table_facts(df: DataFrame, name: str) -> DataFrame:
    """name, rows, columns, column_names, types, missing per column and in total, first row as JSON (null if there is none)."""
    nulls = [F.count(F.when(col(c).isNull(), 1)) for c in df.columns]
    types = F.create_map(*[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())])
    missing = F.create_map(*[v for c, n in zip(df.columns, nulls) for v in (F.lit(c), n)])
    facts = df.agg(F.count("*").alias("rows"), sum(nulls, F.lit(0)).alias("missing_total"), missing.alias("missing"))
    # of many files the one that Spark reads first; a split or two is read, not the table
    first = df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("row")).first()
    return facts.select(F.lit(name).alias("name"), F.lit(first and first["row"]).cast("string").alias("first_row"), "rows", F.lit(len(df.columns)).alias("columns"),
                        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"), types.alias("types"),
                        "missing", "missing_total")


def dataset_inventory(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Facts of many Parquet tables, given as name -> path, in one job; file sizes from one listing."""
    facts = reduce(lambda a, b: a.unionByName(b),
                   [table_facts(spark.read.parquet(path), name) for name, path in tables.items()])
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(list(tables.values())).select("path", "length"))
    owner = F.lit(None).cast("string")
    for name, path in tables.items():
        base = path.rstrip("/")
        owner = F.when(F.col("path").endswith(base) | F.col("path").contains(base + "/"), name).otherwise(owner)
    sizes = files.groupBy(owner.alias("name")).agg(F.sum("length").alias("bytes"))
    return facts.join(F.broadcast(sizes), "name", "left")


def write_inventory(inventory: DataFrame, path: str) -> None:
    inventory.withColumn("uploaded_at", F.current_timestamp()).write.mode("append").parquet(path)


def files_total(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"),
                         F.sum("columns").cast("long").alias("columns"), F.sum("bytes").alias("bytes"))
