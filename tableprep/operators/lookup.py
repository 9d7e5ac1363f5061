"""Join a table to a dictionary of its own column values, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .roles import col

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HEAVY = 1_000


def fits_broadcast(table: DataFrame, columns: list[str], rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows and its text fits the byte limit."""
    text = sum((F.coalesce(F.octet_length(F.to_json(F.struct(col(c)))), F.lit(0)) for c in columns), F.lit(0))
    n, size = table.agg(F.count("*"), F.sum(text.cast("long"))).first()
    return n <= min(rows, BROADCAST_ROWS) and (size or 0) <= BROADCAST_BYTES


def lookup(df: DataFrame, key: str, table: DataFrame, result: str,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join ``table(_key, _n, result)``; ``_n`` is how often the key occurs in ``df``.

    A dictionary of checked size is broadcast. Otherwise the rows of the most
    frequent keys (a fixed number of them) meet a broadcast copy of those
    entries, and only the remaining rows are shuffled, so no key that reaches
    the shuffle holds more than ``1 / HEAVY`` of the rows.
    """
    table = cut_lineage(table.select("_key", "_n", result))
    out = [col(c) for c in df.columns]
    if fits_broadcast(table, ["_key", result], broadcast_rows):
        small = F.broadcast(table.select("_key", result))
        return df.join(small, col(key) == F.col("_key"), "left").select(*out, result)
    heavy = table.orderBy(F.desc("_n"), "_key").limit(HEAVY)
    marked = df.join(F.broadcast(heavy.select("_key", F.col(result), F.lit(True).alias("_hot"))),
                     col(key) == F.col("_key"), "left")
    done = marked.filter(F.col("_hot") | col(key).isNull()).select(*out, result)
    rest = marked.filter(F.col("_hot").isNull() & col(key).isNotNull()).select(*out)
    rest = rest.join(table.select("_key", result), col(key) == F.col("_key"), "left").select(*out, result)
    return done.unionByName(rest)
