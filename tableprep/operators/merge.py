"""Merges of two tables and concatenation of many.

Missing keys match each other. Spark picks the join: adaptive execution
broadcasts a side that turns out small. Keys with very many rows are found first, by
a summary of the most frequent ones, and salted, because adaptive execution cannot
split every side of every kind of outer join. Each side is read twice at most: its
keys for the summary, and its rows for the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import with_position
from .roles import col
from .skew import row_hash

HOT_ROWS = 1_000_000
#: Chunks that the largest keys are cut into; pairs of key and chunk that are counted, and reported.
CHUNKS = 64
TRACKED_PAIRS = 200_000
TOP_PAIRS = 20_000


def _names(keys: str | Sequence[str]) -> list[str]:
    """Keys given as a list or as comma-separated text."""
    if isinstance(keys, str):
        return [k.strip() for k in keys.split(",") if k.strip()]
    return list(keys)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def choose_keys(left: DataFrame, right: DataFrame, auto: str = "common") -> tuple[list[str], list[str]]:
    """Keys when none are given: all common columns, the first, or one named like an id."""
    both = common_columns(left, right)
    if auto == "common":
        return both, both
    if auto == "first":
        return both[:1], both[:1]
    if auto != "id":
        raise ValueError(f"unknown key rule {auto!r}")
    named = [c for c in both if "id" in c.lower()]
    if both:
        key = (named or both)[0]
        return [key], [key]
    ids = [[c for c in t.columns if "id" in c.lower()] for t in (left, right)]
    if all(ids):
        return ids[0][:1], ids[1][:1]
    return left.columns[:1], right.columns[:1]


def _check(df: DataFrame, names: Sequence[str]) -> None:
    for n in names:
        if n not in df.columns:
            raise ValueError(f"column {n!r} not found, available: {df.columns}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n")).filter("n > 1")


def _validate(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], rule: str) -> None:
    one_left, one_right = rule.startswith("one_to"), rule.endswith("to_one")
    for wanted, side, keys, name in ((one_left, left, lk, "left"), (one_right, right, rk, "right")):
        if wanted and not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"merge keys are not unique in the {name} table; not a {rule} merge")


def merge(left: DataFrame, right: DataFrame, left_on=None, right_on=None, how: str = "inner",
          suffixes: tuple[str, str] = ("", "_right"), indicator: bool = False,
          validate: str | None = None, auto: str = "common", order_by: tuple | None = None,
          split_hot: bool = True) -> DataFrame:
    """Merge on pairs of key columns.

    A key with one name on both sides appears once; other columns the tables
    share get the suffixes. Without keys they are chosen by ``auto``; with
    nothing in common the rows are paired by position (``order_by`` holds the
    order keys of both tables). ``split_hot=False`` saves the count of both
    tables where no key is known to hold much of either.
    """
    if how == "cross":
        raise ValueError("merges need keys: pairing all rows is not offered")
    if left_on is None and right_on is None:
        lk, rk = choose_keys(left, right, auto)
        if not lk:
            if order_by is None:
                raise ValueError("no common columns; positional merge needs order_by")
            return merge_positional(left, right, order_by[0], order_by[1], how, suffixes)
    else:
        lk = _names(left_on if left_on is not None else right_on)
        rk = _names(right_on if right_on is not None else left_on)
    if len(lk) != len(rk):
        raise ValueError("left and right need the same number of keys")
    _check(left, lk)
    _check(right, rk)
    if validate and validate != "many_to_many":
        _validate(left, right, lk, rk, validate)
    return _join(left, right, lk, rk, how, suffixes, indicator, split_hot)


def _join(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], how: str,
          suffixes: tuple[str, str], indicator: bool = False, split_hot: bool = True) -> DataFrame:
    shared = {a for a, b in zip(lk, rk) if a == b}
    clash = {c for c in common_columns(left, right) if c not in shared}
    # internal names keep both sides apart until the result is named
    l_in = left.select(*[col(c).alias(f"l{i}") for i, c in enumerate(left.columns)], F.lit(True).alias("in_l"))
    r_in = right.select(*[col(c).alias(f"r{i}") for i, c in enumerate(right.columns)], F.lit(True).alias("in_r"))
    li = {c: f"l{i}" for i, c in enumerate(left.columns)}
    ri = {c: f"r{i}" for i, c in enumerate(right.columns)}
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown merge {how!r}")
    joined = _equi_join(l_in, r_in, [li[a] for a in lk], [ri[b] for b in rk], how, split_hot)
    out: list[Column] = []
    for c in left.columns:
        value = F.coalesce(F.col(li[c]), F.col(ri[c])) if c in shared else F.col(li[c])
        out.append(value.alias(c + suffixes[0] if c in clash else c))
    for c in right.columns:
        if c not in shared:
            out.append(F.col(ri[c]).alias(c + suffixes[1] if c in clash else c))
    if indicator:
        out.append(F.when(F.col("in_l") & F.col("in_r"), "both").when(F.col("in_l"), "left_only")
                   .otherwise("right_only").alias("_merge"))
    return joined.select(*out)


def _same(lk: Sequence[str], rk: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(lk, rk)])


def _equi_join(l_in: DataFrame, r_in: DataFrame, lk: Sequence[str], rk: Sequence[str], how: str,
               split_hot: bool = True) -> DataFrame:
    """Null-safe join on key columns of different names; keys above HOT_ROWS rows are salted.

    Rows of such a key lie in chunks by a hash of the row, and meet every chunk of the other side.
    Each chunk was seen to hold rows, so a row of an outer join finds its partners in all
    cells it goes to, or, where the other side is not cut, goes to one cell: one join of
    the wanted kind does for all keys. Equal rows stay in one chunk.
    """
    kinds = _common_types(l_in, r_in, lk, rk)
    hot = _hot_keys(l_in, r_in, lk, rk, kinds) if split_hot else None
    if hot is None:
        return l_in.join(r_in, _same(lk, rk), how)

    def salted(df: DataFrame, keys: Sequence[str], own: str, other: str, cells: tuple[str, str]) -> DataFrame:
        h1, h2 = _key_hashes(keys, kinds)
        met = df.join(F.broadcast(hot), (h1 == F.col("h1")) & (h2 == F.col("h2")), "left")
        one = F.coalesce(F.col(own), F.array(F.lit(0)))
        chunk = F.pmod(row_hash(df), F.coalesce(F.col(f"n_{own}"), F.lit(1))).cast("int")
        return met.select(*df.columns, F.when(F.array_contains(one, chunk), chunk).otherwise(F.get(one, F.lit(0))).alias(cells[0]),
                          F.explode(F.coalesce(F.col(other), F.array(F.lit(0)))).alias(cells[1]))

    left = salted(l_in, lk, "left_chunks", "right_chunks", ("la", "lb"))
    right = salted(r_in, rk, "right_chunks", "left_chunks", ("rb", "ra"))
    return left.join(right, _same([*lk, "la", "lb"], [*rk, "ra", "rb"]), how).select(*l_in.columns, *r_in.columns)


def _common_types(l_in: DataFrame, r_in: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> list[str | None]:
    """The type in which values of a pair of keys are hashed alike; None where both have one type."""
    out: list[str | None] = []
    for a, b in zip(lk, rk):
        pair = [l_in.schema[a].dataType, r_in.schema[b].dataType]
        whole, numbers = (all(isinstance(t, kind) for t in pair) for kind in (T.IntegralType, T.NumericType))
        out.append(None if pair[0] == pair[1] else "bigint" if whole else "double" if numbers else "string")
    return out


def _key_hashes(keys: Sequence[str], kinds: Sequence[str | None]) -> tuple[Column, Column]:
    """128 bits that stand for the values of a key."""
    values = [F.col(k) if t is None else F.col(k).cast(t) for k, t in zip(keys, kinds)]
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def _heavy(df: DataFrame, keys: Sequence[str], kinds: Sequence[str | None]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Keys with more than HOT_ROWS rows: into how many chunks they are cut, and the chunks seen to hold rows.

    One narrow scan with a mergeable summary of the most frequent pairs of key and chunk, of fixed
    size: beyond 10^10 rows it finds the keys that hold about a thousandth of the table.
    """
    h1, h2 = _key_hashes(keys, kinds)
    item = F.concat_ws(":", h1, h2, F.pmod(row_hash(df), F.lit(CHUNKS)))
    found = df.select(item.alias("item")).agg(F.expr(f"approx_top_k(item, {TOP_PAIRS}, {TRACKED_PAIRS})")).first()[0]
    by_key: dict[tuple[int, int], dict[int, int]] = {}
    for pair in found or []:
        a, b, chunk = map(int, pair["item"].split(":"))
        by_key.setdefault((a, b), {})[chunk] = pair["count"]
    out = {}
    for key, chunks in by_key.items():
        rows, n = sum(chunks.values()), 1
        while n < CHUNKS and n * HOT_ROWS < rows:
            n *= 2
        if n > 1:
            out[key] = n, sorted({c % n for c in chunks})
    return out


def _hot_keys(l_in: DataFrame, r_in: DataFrame, lk: Sequence[str], rk: Sequence[str], kinds: Sequence[str | None]) -> DataFrame | None:
    """h1, h2 and the chunks of either side for keys with more than HOT_ROWS rows on a side; None if there are none."""
    left, right = _heavy(l_in, lk, kinds), _heavy(r_in, rk, kinds)
    if not left and not right:
        return None
    rows = [(*key, *left.get(key, (None, None)), *right.get(key, (None, None))) for key in {*left, *right}]
    return l_in.sparkSession.createDataFrame(
        rows, "h1 long, h2 long, n_left_chunks int, left_chunks array<int>, n_right_chunks int, right_chunks array<int>")


def merge_positional(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
                     how: str = "inner", suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Pair the rows of two tables by their position in the given orders."""
    a = with_position(left, left_order, "_pos")
    b = with_position(right, right_order, "_pos")
    return _join(a, b, ["_pos"], ["_pos"], how, suffixes, split_hot=False).drop("_pos")


def cross_file_zip(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
                   left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Two columns of two tables side by side, as long as the shorter table."""
    a = with_position(left.select(*dict.fromkeys([*left_order, left_col])), left_order, "_p")
    b = with_position(right.select(*dict.fromkeys([*right_order, right_col])), right_order, "_q")
    return (a.select("_p", col(left_col).alias(f"left__{left_col}"))
            .join(b.select("_q", col(right_col).alias(f"right__{right_col}")), F.col("_p") == F.col("_q"))
            .drop("_p", "_q"))


def concat_rows(frames: Sequence[DataFrame], join: str = "outer", keys: Sequence[str] | None = None) -> DataFrame:
    """Stack tables by column name: all columns, or only those common to all."""
    if keys is not None:
        frames = [f.withColumn("source", F.lit(k)) for f, k in zip(frames, keys, strict=True)]
    if join == "inner":
        names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*[col(c) for c in names]) for f in frames]
    elif join != "outer":
        raise ValueError(f"unknown join {join!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
                   ignore_index: bool = False) -> DataFrame:
    """Tables side by side by position; the shorter one is padded with nulls."""
    out = merge_positional(left, right, left_order, right_order, "outer")
    return out.toDF(*[str(i) for i in range(len(out.columns))]) if ignore_index else out


def concat_many(frames: Sequence[DataFrame], orders: Sequence[Sequence[str]], ignore_index: bool = False) -> DataFrame:
    """Any number of tables side by side by position; names seen before get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = None
    for df, order in zip(frames, orders, strict=True):
        placed = with_position(df, order, "_pos")
        names = []
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
            names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
        placed = placed.select(F.col("_pos"), *[col(c).alias(n) for c, n in zip(df.columns, names)])
        out = placed if out is None else out.join(placed, "_pos", "full")
    out = out.drop("_pos")
    return out.toDF(*[str(i) for i in range(len(out.columns))]) if ignore_index else out


def concat(frames: Sequence[DataFrame], axis: int = 0, join: str = "outer", keys: Sequence[str] | None = None,
           order_by: Sequence[Sequence[str]] | None = None, ignore_index: bool = False) -> DataFrame:
    if axis == 0:
        return concat_rows(frames, join, keys)
    if order_by is None or len(frames) != len(order_by) or not frames:
        raise ValueError("side-by-side concatenation takes tables and the order keys of each")
    return concat_many(frames, order_by, ignore_index)
