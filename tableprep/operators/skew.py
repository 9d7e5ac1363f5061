"""Joins in which one key may hold much of either table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .roles import col


def chunk_sizes(left: DataFrame, right: DataFrame, on: Sequence[str], left_rows: int, right_rows: int,
                only_large: bool = True) -> DataFrame:
    """``on..., _nl, _nr``: into how many chunks each side of a key is cut.

    With ``only_large`` keys that need no cut are left out; otherwise keys that
    occur on both sides are listed.
    """
    a = left.groupBy(*on).agg(F.ceil(F.count("*") / left_rows).cast("int").alias("_nl"))
    b = right.groupBy(*on).agg(F.ceil(F.count("*") / right_rows).cast("int").alias("_nr"))
    if only_large:
        a, b = a.filter("_nl > 1"), b.filter("_nr > 1")
        both = a.join(b, list(on), "full").select(*on, F.coalesce("_nl", F.lit(1)).alias("_nl"),
                                                  F.coalesce("_nr", F.lit(1)).alias("_nr"))
    else:
        both = a.join(b, list(on))
    return broadcast_if_small(both)


def grid(left: DataFrame, right: DataFrame, sizes: DataFrame, on: Sequence[str],
         left_hash: Column, right_hash: Column, how: str = "left") -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_cl`` and ``_cr``: each pair of rows of a key meets in exactly one cell."""
    def sides(df: DataFrame, own: str, other: str, own_n: str, other_n: str, h: Column) -> DataFrame:
        n, m = F.coalesce(F.col(own_n), F.lit(1)), F.coalesce(F.col(other_n), F.lit(1))
        return (df.join(sizes, list(on), how).withColumn(own, F.pmod(h, n).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), m - 1))).drop("_nl", "_nr"))
    return (sides(left, "_cl", "_cr", "_nl", "_nr", left_hash),
            sides(right, "_cr", "_cl", "_nr", "_nl", right_hash))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate, which is always a single row."""
    return df.join(F.broadcast(one_row))


def row_hash(df: DataFrame) -> Column:
    """A number that differs between most rows, the same each time a row is read."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*[col(c) for c in plain])
