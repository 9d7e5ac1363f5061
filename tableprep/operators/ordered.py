"""Row positions, fills and running totals over a whole ordered table.

A window without partitions would sort the table in one task. Here the table is
range-partitioned on the order key, each slice is numbered on its own, and a
small table with one row per slice carries counts, sums or last values over.
The sorted slices are written to the checkpoint folder first, so slice numbers
stay the same when a task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from .roles import col

SLICE, SLOT = "_slice", "_slot"
_LOW_BITS = (1 << 33) - 1


def _order(df: DataFrame, order_by: Sequence[str], descending: bool) -> list[Column]:
    keys = [col(c).desc() if descending else col(c).asc() for c in order_by]
    plain = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    # rows that tie on the key are told apart by their other columns
    rest = [col(f.name).asc() for f in df.schema.fields
            if f.name not in order_by and not isinstance(f.dataType, plain)]
    return keys + rest


def sorted_slices(df: DataFrame, order_by: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` with ``_slice`` (rising with the order) and ``_slot`` inside it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _order(df, order_by, descending)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = placed.select("*", F.spark_partition_id().alias(SLICE),
                             F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias(SLOT))
    return cut_lineage(numbered)


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "_pos",
                  descending: bool = False) -> DataFrame:
    """Add the row's position (from 0) in the order of ``order_by``."""
    slices = sorted_slices(df, order_by, descending)
    # one row per slice, so this window is as small as the number of slices
    sizes = slices.groupBy(SLICE).agg(F.count("*").alias("_n"))
    starts = sizes.select(SLICE, (F.sum("_n").over(W.orderBy(SLICE)) - F.col("_n")).alias("_start"))
    return (slices.join(F.broadcast(starts), SLICE)
            .withColumn(name, F.col("_start") + F.col(SLOT)).drop(SLICE, SLOT, "_start"))


def running_total(df: DataFrame, order_by: Sequence[str], value: str, name: str = "running_total") -> DataFrame:
    slices = sorted_slices(df, order_by)
    sums = slices.groupBy(SLICE).agg(F.coalesce(F.sum(col(value)), F.lit(0.0)).alias("_s"))
    starts = sums.select(SLICE, (F.sum("_s").over(W.orderBy(SLICE)) - F.col("_s")).alias("_start"))
    inner = W.partitionBy(SLICE).orderBy(SLOT).rowsBetween(W.unboundedPreceding, 0)
    return (slices.join(F.broadcast(starts), SLICE)
            .withColumn(name, F.coalesce(F.sum(col(value)).over(inner), F.lit(0.0)) + F.col("_start"))
            .drop(SLICE, SLOT, "_start"))


def fill_along(df: DataFrame, order_by: Sequence[str], cols: Sequence[str],
               partition_by: Sequence[str] = (), backward: bool = False) -> DataFrame:
    """Fill nulls with the last value seen before them (or after, ``backward``)."""
    slices = sorted_slices(df, [*partition_by, *order_by], descending=backward)
    group = [F.coalesce(col(p).cast("string"), F.lit("\0null")) for p in partition_by]
    slices = slices.withColumn("_group", F.concat_ws("\1", F.lit(""), *group))
    inner = W.partitionBy(SLICE, "_group").orderBy(SLOT).rowsBetween(W.unboundedPreceding, 0)
    local = slices.select("*", *[F.last(col(c), ignorenulls=True).over(inner).alias(f"_f{i}")
                                 for i, c in enumerate(cols)])
    # groups cut by a slice border: fewer than there are slices
    cut = F.broadcast(slices.groupBy("_group").agg(F.min(SLICE).alias("_a"), F.max(SLICE).alias("_b"))
                      .filter("_a < _b").select("_group"))
    ends = slices.join(cut, "_group").groupBy("_group", SLICE).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col(SLOT))).alias(f"_l{i}") for i, c in enumerate(cols)])
    before = W.partitionBy("_group").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("_group", SLICE, *[
        F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_p{i}") for i in range(len(cols))])
    joined = local.join(F.broadcast(carry), ["_group", SLICE], "left")
    return joined.select(*[
        F.coalesce(F.col(f"_f{cols.index(c)}"), F.col(f"_p{cols.index(c)}")).alias(c) if c in cols else col(c)
        for c in df.columns])


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, seed: str = "42",
                name: str = "_rank", rows: int | None = None) -> DataFrame:
    """Add each row's rank (from 0) in its group, in the order of ``md5(key | seed)``.

    The first hex digits of the hash cut every group into even slices, which are
    ranked separately; slice sizes give the offsets.
    """
    rows = df.count() if rows is None else rows
    digits = 1 if rows <= 10**6 else 2 if rows <= 10**8 else 3 if rows <= 10**10 else 4
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(seed))))
    hashed = hashed.withColumn("_cut", F.substring("_h", 1, digits))
    keys = [col(b) for b in by]
    sizes = hashed.groupBy(*keys, "_cut").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_cut")
    starts = sizes.select(*[col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_cut").alias("_c2"),
                          (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    inner = W.partitionBy(*keys, "_cut").orderBy("_h", col(key))
    same = F.col("_cut") == F.col("_c2")
    for i, b in enumerate(by):
        same = same & col(b).eqNullSafe(F.col(f"_b{i}"))
    ranked = hashed.withColumn("_in", F.row_number().over(inner) - 1).join(broadcast_if_small(starts), same)
    return ranked.select(*[col(c) for c in df.columns], (F.col("_start") + F.col("_in")).alias(name))
