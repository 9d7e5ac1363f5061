"""Profiling: counts, summaries, frequencies, correlations, outlier counts.

Results are long frames, one row per column or per (column, value). Statistics
of all columns come from one aggregation; frequencies of all columns from one
unpivot and one grouped count, which combines on the map side and so does not
mind a value that holds much of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

from .quantiles import quantile_table
from .roles import categorical_columns, col, is_numeric, melt, numeric_columns, role_of
from .skew import beside, row_hash


# rows of at most this many columns are compared in full at once
NARROW = 4
# largest number of repeated hashes that is broadcast
SUSPECTS = 2_000_000


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A result with one row per column of ``df``."""
    return df.sparkSession.createDataFrame(rows, schema)


def long_form(df: DataFrame, cols: Sequence[str], dtype: str = "string") -> DataFrame:
    """(column, value) rows for the given columns."""
    if not cols:
        return _small(df, [], f"column string, value {dtype}")
    return melt(df.select(*[col(c).cast(dtype).alias(c) for c in cols]), cols)


class Facts:
    """Aggregates of one table: what was asked for is computed together, in one scan, when the first answer is read.

    Operators name what they need with ``ask``; those that share an instance share the scan,
    and an aggregate asked for twice is computed once. Answers are a few numbers per column.
    """

    def __init__(self, df: DataFrame):
        self.df, self._open, self._known, self.scans = df, {}, {}, 0

    def ask(self, what: str, column: str, *args) -> "Facts":
        """Register ``what`` (rows, missing, bytes, or one of ``MOMENTS``) of a column."""
        if (what, column) not in self._known:
            self._open[what, column] = _EXPRESSIONS[what](self.df, column)
        return self

    def ask_rows(self) -> "Facts":
        return self.ask("rows", "")

    def ask_missing(self) -> "Facts":
        for c in self.df.columns:
            self.ask("missing", c)
        return self.ask_rows()

    def ask_moments(self, cols: Sequence[str]) -> "Facts":
        for c in cols:
            for what in MOMENTS:
                self.ask(what, c)
        return self.ask_rows()

    def ask_bytes(self) -> "Facts":
        for c in self.df.columns:
            self.ask("bytes", c)
        return self

    def __getitem__(self, key: tuple[str, str]):
        if key not in self._known:
            names = list(self._open)
            row = self.df.agg(*[self._open[n].alias(f"f{i}") for i, n in enumerate(names)]).first()
            self._known.update(zip(names, row))
            self._open, self.scans = {}, self.scans + 1
        return self._known[key]

    @property
    def rows(self) -> int:
        return self["rows", ""]


MOMENTS = ("count", "mean", "std", "pstd", "min", "max")
_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _bytes(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.sum(F.octet_length(col(name))), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.sum(F.size(col(name)).cast("long") * _WIDTH.get(type(kind.elementType), 8)), F.lit(0)).cast("long")
    return F.count(col(name)) * _WIDTH.get(type(kind), 8)


_EXPRESSIONS = {
    "rows": lambda df, c: F.count("*"),
    "missing": lambda df, c: F.count(F.when(col(c).isNull(), 1)),
    "bytes": _bytes,
    "count": lambda df, c: F.count(col(c).cast("double")),
    "mean": lambda df, c: F.avg(col(c).cast("double")),
    "std": lambda df, c: F.stddev_samp(col(c).cast("double")),
    "pstd": lambda df, c: F.stddev_pop(col(c).cast("double")),
    "min": lambda df, c: F.min(col(c).cast("double")),
    "max": lambda df, c: F.max(col(c).cast("double")),
}


def shape(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    if facts is not None:
        return _small(df, [(facts.ask_rows().rows, len(df.columns))], "rows long, columns int")
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def missing_counts(df: DataFrame, digits: int | None = None, facts: Facts | None = None) -> DataFrame:
    """column, missing, missing_pct."""
    names = df.columns
    if facts is not None:
        n = facts.ask_missing().rows
        found = _small(df, [(n, c, facts["missing", c]) for c in names], "_n long, column string, missing long")
    else:
        one = df.agg(F.count("*").alias("_n"),
                     *[F.count(F.when(col(c).isNull(), 1)).alias(c) for c in names])
        found = melt(one, names, "column", "missing", ["_n"])
    pct = F.try_divide("missing", "_n") * 100
    if digits is not None:
        pct = F.round(pct, digits)
    return found.select("column", "missing", pct.alias("missing_pct"))


def missing_total(df: DataFrame) -> DataFrame:
    return df.agg(sum((F.count(F.when(col(c).isNull(), 1)) for c in df.columns), F.lit(0)).alias("missing"))


def missing_chart(df: DataFrame) -> DataFrame:
    """Columns with nulls, fewest first."""
    return missing_counts(df).filter("missing > 0").select("column", "missing").orderBy("missing", "column")


def memory_estimate(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Bytes per column: text length, or fixed width times filled rows."""
    if facts is not None:
        facts.ask_bytes()
        return _small(df, [(c, facts["bytes", c]) for c in df.columns], "column string, bytes long")
    return melt(df.agg(*[_bytes(df, c).alias(c) for c in df.columns]), df.columns, "column", "bytes")


def moments(df: DataFrame, cols: Sequence[str], facts: Facts | None = None) -> dict[str, dict]:
    """count, mean, std (n-1), pstd, min, max and rows, per column, in one pass."""
    facts = (Facts(df) if facts is None else facts).ask_moments(cols)
    return {c: {**{m: facts[m, c] for m in MOMENTS}, "rows": facts.rows} for c in cols}


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True, facts: Facts | None = None) -> dict[str, dict]:
    """Moments and quartiles (``q25``, ``q50``, ``q75``) per column."""
    cols = numeric_columns(df) if cols is None else list(cols)
    stats = moments(df, cols, facts)
    rows = stats[cols[0]]["rows"] if cols else 0
    for c, q in quantile_table(df, cols, [0.25, 0.5, 0.75], rows=rows, exact=exact).items():
        stats[c].update(zip(("q25", "q50", "q75"), q))
    return stats


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                     stats: dict[str, dict] | None = None) -> DataFrame:
    stats = numeric_stats(df, cols, exact) if stats is None else stats
    facts = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")
    return _small(df, [(c, *(s[f] for f in facts)) for c, s in stats.items()],
                  "column string, count long, " + ", ".join(f"{f} double" for f in facts[1:]))


def frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, value, n for every non-null value."""
    return (long_form(df, cols).filter("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def _number(numeric: Sequence[str]):
    """Texts of the named columns as numbers, to be put in order; null for others."""
    return F.when(F.col("column").isin(list(numeric)), F.col("value").cast("double"))


def _top(freq: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Distinct values and the most frequent one per column; on ties the smallest in the column's own order."""
    best = F.min(F.struct((-F.col("n")).alias("k"), _number(numeric).alias("x"), F.col("value").alias("v")))
    return (freq.groupBy("column").agg(F.count("*").alias("unique"), best.alias("_b"))
            .select("column", "unique", F.col("_b.v").alias("top"), (-F.col("_b.k")).alias("freq")))


def mode_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    return _top(frequencies(df, cols), nums).select("column", F.col("top").alias("mode"), F.col("freq"))


def modes(df: DataFrame, cols: Sequence[str], dtype: str = "string") -> dict[str, object]:
    """Most frequent value per column, smallest on ties; absent if all null."""
    freq = (long_form(df, cols, dtype).filter("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count("*").alias("n")))
    return {r["column"]: r["top"] for r in _top(freq).collect()}


def describe_all(df: DataFrame, exact: bool = True) -> DataFrame:
    """Numeric summary, and unique/top/freq for text columns."""
    text = categorical_columns(df)
    facts = Facts(df).ask_missing().ask_moments(numeric_columns(df))
    nums = describe_numeric(df, stats=numeric_stats(df, exact=exact, facts=facts))
    if not text:
        return nums.select("*", F.lit(None).cast("long").alias("unique"),
                           F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"))
    filled = _small(df, [(c, facts.rows - facts["missing", c]) for c in text], "column string, count long")
    tops = _top(frequencies(df, text)).join(F.broadcast(filled), "column")
    return nums.unionByName(tops, allowMissingColumns=True)


def first_values(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """column, first: the values of the first ``n`` rows in the order of ``order_by``, as texts; ties go by the other columns."""
    rest = [f.name for f in df.schema.fields if f.name not in order_by and f.dataType.typeName() not in ("map", "variant")]
    top = df.orderBy(*[col(c) for c in [*order_by, *rest]]).limit(n)
    # the rows are in one partition, in order; a struct keeps nulls
    lists = top.agg(*[F.collect_list(F.struct(col(c).cast("string").alias("v"))).alias(c) for c in df.columns])
    return melt(lists, df.columns, "column", "first").select("column", F.col("first.v").alias("first"))


def snapshot(df: DataFrame, order_by: Sequence[str] | None = None, first: int = 3) -> DataFrame:
    """Compact facts per column: type, missing %, rounded moments, cardinality; with ``order_by`` also the first values."""
    facts = Facts(df).ask_missing().ask_moments(numeric_columns(df))
    base = missing_counts(df, 1, facts).select("column", "missing_pct")
    nums = _small(df, [(c, *(s[k] for k in ("mean", "std", "min", "max"))) for c, s in moments(df, numeric_columns(df), facts).items()],
                  "column string, mean double, std double, min double, max double")
    nums = nums.select("column", *[F.round(m, 2).alias(m) for m in ("mean", "std", "min", "max")])
    text = categorical_columns(df, booleans=False)
    card = frequencies(df, text).groupBy("column").agg(F.count("*").alias("cardinality"))
    out = base.join(F.broadcast(nums), "column", "left").join(F.broadcast(card), "column", "left")
    return out.join(F.broadcast(first_values(df, order_by, first)), "column", "left") if order_by else out


def iqr_outlier_counts(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                       stats: dict[str, dict] | None = None) -> DataFrame:
    cols = numeric_columns(df) if cols is None else list(cols)
    q = (quantile_table(df, cols, [0.25, 0.75]) if stats is None
         else {c: [stats[c]["q25"], stats[c]["q75"]] for c in cols})
    tests = []
    for c in cols:
        lo, hi = q[c]
        v = col(c).cast("double")
        if lo is None or hi <= lo:
            tests.append(F.lit(0).cast("long").alias(c))
        else:
            tests.append(F.count(F.when((v < lo - k * (hi - lo)) | (v > hi + k * (hi - lo)), 1)).alias(c))
    return melt(df.agg(*tests), cols, "column", "outliers")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Per column the ``top`` values with counts, distinct count and mode."""
    cols = categorical_columns(df, booleans=False) if cols is None else list(cols)
    freq = frequencies(df, cols)
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    head = freq.withColumn("rank", rank).filter(F.col("rank") <= top)
    tops = _top(freq).select("column", "unique", F.col("top").alias("most_frequent"))
    return head.join(F.broadcast(tops), "column").select("column", "unique", "most_frequent", "rank", "value", "n")


def column_info(df: DataFrame, cols: Sequence[str], samples: int = 5) -> DataFrame:
    """Type, distinct, missing, smallest values; mean/median/std where numeric."""
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    stats = moments(df, nums)
    rows = stats[nums[0]]["rows"] if nums else None
    med = quantile_table(df, nums, [0.5], rows=rows)
    facts = _small(df, [(c, df.schema[c].dataType.simpleString(),
                         stats[c]["mean"] if c in stats else None,
                         med[c][0] if c in med else None,
                         stats[c]["std"] if c in stats else None) for c in cols],
                   "column string, dtype string, mean double, median double, std double")
    distinct = long_form(df, cols).filter("value IS NOT NULL").distinct()
    uniq = distinct.groupBy("column").agg(F.count("*").alias("unique"))
    miss = missing_counts(df.select(*[col(c) for c in cols])).select("column", "missing")
    rank = F.row_number().over(W.partitionBy("column").orderBy(_number(nums), "value"))
    some = (distinct.withColumn("_r", rank).filter(F.col("_r") <= samples).groupBy("column")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"]), "|")
                 .alias("samples")))
    out = facts.join(miss, "column").join(uniq, "column", "left").join(some, "column", "left")
    return out.select("column", "dtype", F.coalesce("unique", F.lit(0)).alias("unique"), "missing",
                      "samples", "mean", "median", "std")


def value_counts(df: DataFrame, column: str, n: int | None = None, normalize: bool = False) -> DataFrame:
    """value, n [, share of non-null rows], most frequent first."""
    counts = (df.filter(col(column).isNotNull()).groupBy(col(column).alias("value"))
              .agg(F.count("*").alias("n")))
    if normalize:
        total = counts.agg(F.sum("n").alias("_t"))
        counts = beside(counts, total).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if n is None else ordered.limit(n)


def nunique(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    cols = df.columns if cols is None else list(cols)
    if not exact:
        return melt(df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in cols]), cols, "column", "unique")
    # columns of a kind are stacked in their own type, which is cheaper than text
    kinds: dict[str, list[str]] = {}
    for c in cols:
        dtype = df.schema[c].dataType
        kind = "bigint" if isinstance(dtype, T.IntegralType) else "double" if isinstance(dtype, T.FractionalType) \
            and not isinstance(dtype, T.DecimalType) else "string"
        kinds.setdefault(kind, []).append(c)
    parts = [long_form(df, names, kind).distinct().groupBy("column").agg(F.count("value").alias("unique"))
             for kind, names in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else _small(df, [], "column string, unique long")


def schema_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    kinds = _small(df, [(f.name, f.dataType.simpleString(), role_of(f.dataType)) for f in df.schema.fields],
                   "column string, dtype string, role string")
    return (kinds.join(F.broadcast(missing_counts(df).select("column", "missing")), "column")
            .join(F.broadcast(nunique(df, exact=exact)), "column", "left")
            .withColumn("unique", F.coalesce("unique", F.lit(0))))


def type_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema.fields:
        name = f.dataType.simpleString()
        out[name] = out.get(name, 0) + 1
    return out


def pair_sums(df: DataFrame, cols: Sequence[str], centre: Sequence[float]) -> np.ndarray:
    """For each pair (i, j) over rows that have both: count, sums of d_i and d_i^2, and of d_i d_j.

    d is the distance to ``centre``. Each task adds up its batches as matrix
    products and hands on one matrix of each kind.
    """
    p, middle = len(cols), np.array(centre, dtype=float)
    data = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - middle
            have = ~np.isnan(x)
            d, m = np.where(have, x, 0.0), have.astype(float)
            total += np.stack([m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d])
        yield pd.DataFrame({"k": np.arange(4 * p * p), "s": total.ravel()})

    sums = data.mapInPandas(partial, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(4 * p * p)
    for r in sums:
        out[r["k"]] = r["s"]
    return out.reshape(4, p, p)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = None,
                       facts: Facts | None = None) -> DataFrame:
    """x, y, r for all ordered pairs; nulls are left out pair by pair."""
    cols = numeric_columns(df) if cols is None else list(cols)
    stats = moments(df, cols, facts)
    n, s, ss, sp = pair_sums(df, cols, [stats[c]["mean"] or 0.0 for c in cols])
    with np.errstate(divide="ignore", invalid="ignore"):
        var = ss - s * s / n
        r = (sp - s * s.T / n) / np.sqrt(var * var.T)
    out = []
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            flat = any(var[a, b] <= 1e-14 * ss[a, b] for a, b in ((i, j), (j, i))) or n[i, j] < 2
            out.append((x, y, None if flat else 1.0 if i == j else float(r[min(i, j), max(i, j)])))
    frame = _small(df, out, "x string, y string, r double")
    return frame if digits is None else frame.withColumn("r", F.round("r", digits))


def top_correlations(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    full = correlation_matrix(df, cols)
    return (full.filter("x < y AND r IS NOT NULL").withColumn("strength", F.abs("r"))
            .orderBy(F.desc("strength"), "x", "y").limit(n).drop("strength"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier full row.

    Wide rows are first counted by a hash of eight bytes, and only rows whose
    hash occurs again are compared in full.
    """
    rows = df
    if len(df.columns) > NARROW:
        hashed = df.withColumn("_h", row_hash(df))
        again = cut_lineage(hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))
        if again.count() <= SUSPECTS:
            rows = hashed.join(F.broadcast(again), "_h", "left_semi").drop("_h")
    return (rows.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")))


def group_aggregate(df: DataFrame, by: str, value: str, how: str = "sum") -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg, "count": F.count}[how]
    return (df.filter(col(by).isNotNull()).groupBy(col(by)).agg(agg(col(value).cast("double")).alias(how)))


def pivot_mean(df: DataFrame, x: str, y: str, z: str, wide: Sequence | None = None) -> DataFrame:
    """Mean of z per (y, x); long by default, one column per listed x if ``wide``."""
    data = df.select(col(x).alias("x"), col(y).alias("y"), col(z).cast("double").alias("z")).na.drop()
    if wide is None:
        return data.groupBy("y", "x").agg(F.avg("z").alias("mean"))
    return data.groupBy("y").pivot("x", list(wide)).agg(F.avg("z"))


def path_rollup(df: DataFrame, path: Sequence[str], value: str | None = None) -> DataFrame:
    """Sums (or row counts) for every prefix of ``path``: level, path..., id, parent, value."""
    data = df.select(*[col(p).cast("string").alias(p) for p in path],
                     (col(value).cast("double") if value else F.lit(1.0)).alias("_v")).na.drop(subset=list(path))
    rolled = data.rollup(*path).agg(F.sum("_v").alias("value"), F.grouping_id().alias("_g"))
    depth = F.lit(len(path)) - F.bit_count("_g")
    # a separator inside a value is escaped, so paths of other cuts have other ids
    part = lambda p: F.replace(F.replace(col(p), F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))
    ident = F.concat_ws("/", F.lit("all"), *[part(p) for p in path])
    above = F.concat_ws("/", F.lit("all"), *[F.when(F.col("level") > i + 1, part(p)) for i, p in enumerate(path)])
    rolled = rolled.select(depth.cast("int").alias("level"), *path, "value", ident.alias("id"))
    return rolled.withColumn("parent", F.when(F.col("level") == 0, F.lit("")).otherwise(above))
