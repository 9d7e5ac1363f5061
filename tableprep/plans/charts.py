"""The small tables behind charts. Aggregates run over all rows; points are sampled by key."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import profile
from ..operators.encode import distinct_counts
from ..operators.filters import sample_rows
from ..operators.quantiles import grouped_quantiles
from ..operators.roles import categorical_columns, col, find_column, is_numeric, melt, numeric_columns
from ..operators.skew import beside
from ..session import broadcast_if_small, cut_lineage

GRID_POINTS = 200
DENSITY_GROUPS = 1000
#: A group of more rows is cut into chunks of about so many.
DENSITY_ROWS = 1_000_000
KERNELS = "grp string, i int, t double"


# a null group is no text: groups travel as "n" or "v" and the text, and are read back at the end
def _group(c: Column) -> Column:
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))


def _ungroup(df: DataFrame, name: str = "grp") -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) != "n", F.expr(f"substring({name}, 2)")))


def _ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    v = [col(c).cast("double") for c in cols]
    row = df.agg(*[a.alias(f"m{i}") for i, a in enumerate([f(x) for x in v for f in (F.min, F.max)])]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def _bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; the largest value belongs to the last bin."""
    if high <= low:
        return F.when(v.isNotNull(), F.lit(0))
    # least() would take the bound for a null
    return F.when(v.isNotNull(), F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, x: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """bin, low, high, n [, color]; empty bins are left out."""
    low, high = _ranges(df, [x])[x]
    groups = [col(color).cast("string").alias("color")] if color else []
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = (high - low) / bins
    data = df.select(*groups, _bin(col(x).cast("double"), low, high, bins).alias("bin")).filter("bin IS NOT NULL")
    out = data.groupBy(*(["color"] if color else []), "bin").agg(F.count("*").alias("n"))
    return out.withColumn("low", low + F.col("bin") * width).withColumn("high", low + (F.col("bin") + 1) * width)


def multi_histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """column, bin, low, high, n for many columns, one unpivot and one grouped count."""
    ranges = {c: r for c, r in _ranges(df, cols).items() if r[0] is not None}
    if not ranges:
        return df.sparkSession.createDataFrame([], "column string, bin int, n long, low double, high double")
    data = df.select(*[_bin(col(c).cast("double"), *ranges[c], bins).alias(c) for c in ranges])
    long = melt(data, list(ranges), "column", "bin").filter("bin IS NOT NULL")
    out = long.groupBy("column", "bin").agg(F.count("*").alias("n"))
    low, width = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c, (a, b) in ranges.items():
        low = F.when(F.col("column") == c, F.lit(a)).otherwise(low)
        width = F.when(F.col("column") == c, F.lit((b - a) / bins)).otherwise(width)
    return out.select("column", "bin", "n", (low + F.col("bin") * width).alias("low"),
                      (low + (F.col("bin") + 1) * width).alias("high"))


def box(df: DataFrame, y: str, by: str | None = None, groups: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest points inside 1.5 ranges) and outliers per group.

    ``groups`` is the largest number of groups there can be, where that is known.
    """
    groups = 1 if by is None else groups
    group = _group(col(by)) if by else F.lit("vall")
    data = df.select(group.alias("grp"), col(y).cast("double").alias("v")).filter("v IS NOT NULL")
    q = grouped_quantiles(data, ["grp"], "v", [0.25, 0.5, 0.75], groups=groups)
    q = q.select("grp", "n", *[F.element_at("q", i + 1).alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    q = F.broadcast(q) if groups else broadcast_if_small(q)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= lo) & (F.col("v") <= hi)
    facts = ["grp", "n", "q1", "median", "q3"]
    return _ungroup(data.join(q, "grp").groupBy(*facts).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers")))


def multi_box(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``box`` of many columns at once; ``grp`` is the column."""
    return box(profile.long_form(df, cols, "double"), "value", "column", groups=len(cols))


def _kernels(values: np.ndarray, h: float, lo: float, hi: float, points: int) -> np.ndarray:
    """Kernels of all values at each grid point, added up."""
    grid = lo - 3 * h + np.arange(points) * (hi - lo + 6 * h) / (points - 1)
    values, times = np.unique(values, return_counts=True)
    total = np.zeros(points)
    for at in range(0, len(values), 4096):
        z = (grid - values[at:at + 4096, None]) / h
        total += times[at:at + 4096] @ np.exp(-0.5 * z * z)
    return total


def _kernel_frame(grp: str, total: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"grp": grp, "i": np.arange(len(total), dtype="int32"), "t": total})


def _kernel_sums(data: DataFrame, facts: dict[str, tuple], points: int) -> DataFrame:
    """grp, i, t: kernels of all values at the grid points, added up batch by batch.

    ``facts`` has h, lo and hi of every group. A task hands on ``points`` numbers per group.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for g, v in batch.groupby("grp")["v"]:
                if g in facts:
                    sums[g] = sums.get(g, 0) + _kernels(v.to_numpy(dtype=float), *facts[g], points)
        for g, total in sums.items():
            yield _kernel_frame(g, total)

    return data.mapInPandas(partial, KERNELS)


def _kernel_sums_by_chunk(data: DataFrame, facts: DataFrame, points: int) -> DataFrame:
    """The same sums for any number of groups: one shuffle brings the rows of a group, or of each of its chunks, together.

    A task goes through its groups in order and holds one of them; it hands on ``points`` numbers for each.
    """
    chunk = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / DENSITY_ROWS)).cast("int")
    rows = data.join(broadcast_if_small(facts, cut=False), "grp").withColumn("c", chunk) \
        .repartition("grp", "c").sortWithinPartitions("grp").select("grp", "v", "h", "lo", "hi")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None
        for batch in batches:
            done = []
            for g, part in batch.groupby("grp"):
                sums = _kernels(part["v"].to_numpy(dtype=float), *part[["h", "lo", "hi"]].iloc[0], points)
                if g != held:
                    if total is not None:
                        done.append(_kernel_frame(held, total))
                    held, total = g, 0
                total = total + sums
            if done:
                yield pd.concat(done)
        if total is not None:
            yield _kernel_frame(held, total)

    return rows.mapInPandas(partial, KERNELS)


def kde(df: DataFrame, x: str, by: str | None = None, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian density on a grid three bandwidths beyond the data, bandwidth by Scott's rule.

    Tasks add up kernels. The facts of up to ``DENSITY_GROUPS`` groups go to them as numbers and rows
    stay where they are; rows of more groups are shuffled once, large groups in chunks.
    """
    group = _group(col(by)) if by else F.lit("vall")
    data = df.select(group.alias("grp"), col(x).cast("double").alias("v")).filter("v IS NOT NULL")
    facts = data.groupBy("grp").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("s"),
                                    F.min("v").alias("lo"), F.max("v").alias("hi")).filter("s > 0")
    facts = cut_lineage(facts.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2))).drop("s"))
    at = F.col("lo") - 3 * F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1)
    known = facts.limit(DENSITY_GROUPS + 1).collect()
    if len(known) <= DENSITY_GROUPS:
        sums = _kernel_sums(data, {r["grp"]: (r["h"], r["lo"], r["hi"]) for r in known}, points)
    else:
        sums = _kernel_sums_by_chunk(data, facts, points)
    sums = sums.groupBy("grp", "i").agg(F.sum("t").alias("t"))
    out = sums.join(facts, "grp").select("grp", "i", at.alias("x"), (
        F.col("t") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    return _ungroup(out)


def violin(df: DataFrame, y: str, by: str | None = None, points: int = GRID_POINTS) -> DataFrame:
    """The density of each group with its quartiles."""
    boxes = box(df, y, by).select("grp", "q1", "median", "q3")
    boxes = boxes.withColumnRenamed("grp", "bgrp")
    return kde(df, y, by, points).join(boxes, F.col("grp").eqNullSafe(F.col("bgrp"))).drop("bgrp")


def distribution(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """Histogram and density of one column: kind, x, value."""
    bars = histogram(df, x, bins).select(F.lit("histogram").alias("kind"), F.col("low").alias("x"), F.col("n").cast("double").alias("value"))
    return bars.unionByName(kde(df, x).select(F.lit("density").alias("kind"), "x", F.col("density").alias("value")))


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """x_bin, y_bin, n over rows that have both values."""
    data = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).na.drop()
    r = _ranges(data, ["x", "y"])
    if r["x"][0] is None:
        return data.sparkSession.createDataFrame([], "x_bin int, y_bin int, n long")
    return (data.select(_bin(F.col("x"), *r["x"], bins).alias("x_bin"), _bin(F.col("y"), *r["y"], bins).alias("y_bin"))
            .groupBy("x_bin", "y_bin").agg(F.count("*").alias("n")))


def scatter(df: DataFrame, cols: Sequence[str], key: Sequence[str], n: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Points without nulls in ``cols``, a sample of ``n`` if given; ``extra`` holds colour and size columns."""
    names = list(dict.fromkeys([*key, *cols, *extra]))
    points = df.select(*[col(c) for c in names]).na.drop(subset=list(cols))
    return points if n is None else sample_rows(points, key, n)


def line(df: DataFrame, x: str, ys: Sequence[str], color: str | None = None) -> DataFrame:
    """x, series, value [, color] in the order of x."""
    ids = [col(x).alias("x")] + ([col(color).cast("string").alias("color")] if color else [])
    data = df.select(*ids, *[col(y).cast("double").alias(f"_{y}") for y in ys])
    long = melt(data, [f"_{y}" for y in ys], "series", "value", ["x"] + (["color"] if color else []))
    return long.withColumn("series", F.expr("substring(series, 2)")).orderBy("x", "series")


def bar(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> DataFrame:
    """Sum of y (or count) per x and colour."""
    keys = [col(x).cast("string").alias("x")] + ([col(color).cast("string").alias("color")] if color else [])
    value = F.sum(col(y).cast("double")) if y else F.count("*").cast("double")
    return df.filter(col(x).isNotNull()).groupBy(*keys).agg(value.alias("value"))


def bar_polar(df: DataFrame, theta: str, r: str) -> DataFrame:
    return bar(df, theta, r).select(F.col("x").alias("theta"), F.col("value").alias("r"))


def category_counts(df: DataFrame, x: str, n: int | None = None) -> DataFrame:
    return profile.value_counts(df, x, n)


def pie(df: DataFrame, names: str, values: str | None = None, n: int | None = None) -> DataFrame:
    """name, value, share of the whole, is_rest; with ``n`` the largest slices and one row for the rest."""
    slices = bar(df, names, values).select(F.col("x").alias("name"), "value", F.lit(False).alias("is_rest"))
    total = slices.agg(F.sum("value").alias("t"))
    if n is not None:
        slices = cut_lineage(slices)
        top = slices.orderBy(F.desc("value"), "name").limit(n)
        rest = slices.join(F.broadcast(top.select("name")), "name", "left_anti").agg(F.count("*").alias("_n"), F.sum("value").alias("value"))
        rest = rest.filter("_n > 0").select(F.lit("other").alias("name"), "value", F.lit(True).alias("is_rest"))
        slices = top.unionByName(rest)
    return beside(slices, total).select("name", "value", (F.col("value") / F.col("t")).alias("share"), "is_rest")


def funnel(df: DataFrame, stage: str, y: str | None = None) -> DataFrame:
    """Sum of y per stage, or rows per stage if y is not a number."""
    numeric = y is not None and is_numeric(df.schema[y].dataType)
    return bar(df, stage, y if numeric else None).select(F.col("x").alias("stage"), "value")


def waterfall(df: DataFrame, x: str, y: str, order_by: Sequence[str], n: int) -> DataFrame:
    """The first n rows, as the caller asks: position, x, delta and running total."""
    data = df.filter(col(x).isNotNull() & col(y).isNotNull())
    head = data.orderBy(*[col(o) for o in order_by]).limit(n)
    # at most n rows reach these windows
    w = W.orderBy(*[col(o) for o in order_by])
    return head.select((F.row_number().over(w)).alias("step"), col(x).alias("x"), col(y).cast("double").alias("delta"),
                       F.sum(col(y).cast("double")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"))


def pairplot(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """x, y, x_bin, y_bin, n for all pairs of the numeric columns and their diagonals."""
    cols = numeric_columns(df) if cols is None else list(cols)
    data = df.select(*[col(c).cast("double").alias(c) for c in cols]).na.drop()
    r = _ranges(data, cols)
    if not cols or r[cols[0]][0] is None:
        return df.sparkSession.createDataFrame([], "x string, y string, x_bin int, y_bin int, n long")
    binned = data.select(*[_bin(col(c), *r[c], bins).alias(f"b{i}") for i, c in enumerate(cols)])
    pairs = [(i, i) for i in range(len(cols))] + list(combinations(range(len(cols)), 2))
    cells = F.array(*[F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), F.col(f"b{i}").alias("x_bin"),
                               F.col(f"b{j}").alias("y_bin")) for i, j in pairs])
    return binned.select(F.explode(cells).alias("c")).groupBy("c.x", "c.y", "c.x_bin", "c.y_bin").agg(F.count("*").alias("n"))


def strip(df: DataFrame, x: str, y: str, key: str, per_category: int | None = None, seed: str = "42") -> DataFrame:
    """The points of each category; with ``per_category`` that many, lowest key hash first."""
    data = df.select(col(key).alias("key"), col(x).alias("x"), col(y).alias("y")).na.drop()
    if per_category is None:
        return data
    order = F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit(seed)))
    rank = F.row_number().over(W.partitionBy("x").orderBy(order, "key"))
    return data.withColumn("_r", rank).filter(F.col("_r") <= per_category).drop("_r")


def summary_table(df: DataFrame) -> DataFrame:
    """Numeric summary with type and missing count."""
    kinds = dict(df.dtypes)
    nums = numeric_columns(df)
    types = df.sparkSession.createDataFrame([(c, kinds[c]) for c in nums], "column string, dtype string")
    missing = profile.missing_counts(df.select(*[col(c) for c in nums])).select("column", "missing")
    return profile.describe_numeric(df).join(F.broadcast(types), "column").join(F.broadcast(missing), "column")


# one shape for charts of different kinds: chart, x, y, series, value
def _cells(df: DataFrame, chart: str | Column, x=None, y=None, series=None, value=None) -> DataFrame:
    pick = lambda c: (c if c is not None else F.lit(None)).cast("string")
    name = F.lit(chart) if isinstance(chart, str) else chart
    return df.select(name.alias("chart"), pick(x).alias("x"), pick(y).alias("y"), pick(series).alias("series"),
                     (value if value is not None else F.lit(None)).cast("double").alias("value"))


def auto_one(df: DataFrame, key: Sequence[str], x: str | None = None, y: str | None = None,
             rule: str = "app") -> tuple[str, DataFrame]:
    """The chart that fits the roles: correlations or scatter, histogram, else bars."""
    nums, cats = numeric_columns(df), categorical_columns(df)
    if x and y:
        return "scatter", scatter(df, [x, y], key)
    if len(nums) >= 2:
        if rule == "app":
            return "correlation", profile.correlation_matrix(df, nums, 2)
        return "scatter", scatter(df, nums[:2], key)
    if len(nums) == 1:
        return "histogram", histogram(df, nums[0], 30)
    return "bar", category_counts(df, (cats or df.columns)[0])


def auto_set(df: DataFrame, key: Sequence[str], columns: int | None = None, points: int | None = None,
             categories: int | None = None) -> DataFrame:
    """The standard set of charts as rows of chart, x, y, series, value.

    Correlations, distributions with boxes, category bars, scatters of neighbouring
    columns, pair bins, boxes by category, a 3-D scatter and densities. All columns, values and
    points are shown; ``columns`` keeps to the first numeric and categorical ones,
    ``points`` samples the scatters, ``categories`` leaves out bars and boxes of columns with
    more values. What these leave out is named in rows of chart "left out".
    """
    all_nums, all_cats = numeric_columns(df), categorical_columns(df, booleans=False)
    nums, cats = all_nums[:columns], all_cats[:columns]
    counts = distinct_counts(df, cats) if categories is not None else {}
    few = [c for c in cats if categories is None or counts.get(c, 0) <= categories]
    made: list[DataFrame] = []
    if len(nums) >= 2:
        made.append(_cells(profile.correlation_matrix(df, nums, 2), "correlation", F.col("x"), F.col("y"), None, F.col("r")))
    if nums:
        title = lambda c: F.concat(F.lit("distribution "), c)
        made.append(_cells(multi_histogram(df, nums), title("column"), F.col("low"), F.col("high"), F.lit("n"), F.col("n")))
        made.append(_box_cells(multi_box(df, nums), title("grp"), F.lit("all")))
    made += [_cells(category_counts(df, c), f"categories {c}", F.col("value"), None, None, F.col("n")) for c in few]
    made += [_cells(scatter(df, [a, b], key, points), f"scatter {a} {b}", col(a), col(b)) for a, b in zip(nums, nums[1:])]
    if len(nums) >= 2:
        made.append(_cells(pairplot(df, nums), "pairplot", F.concat_ws(":", "x", "x_bin"), F.concat_ws(":", "y", "y_bin"), None, F.col("n")))
    made += [_box_cells(box(df.filter(col(c).isNotNull()), nums[0], c, groups=categories), f"box {c} {nums[0]}") for c in few if nums]
    if len(nums) >= 3:
        solid = f"scatter3d {nums[0]} {nums[1]} {nums[2]}"
        made.append(_cells(scatter(df, nums[:3], key, points), solid, col(nums[0]), col(nums[1]), None, col(nums[2])))
    made += [_cells(kde(df, c), f"density {c}", F.col("x"), None, None, F.col("density")) for c in nums]
    gone = [c for c in all_nums + all_cats if c not in nums + few]
    if gone or not made:
        rows = df.sparkSession.createDataFrame([(c,) for c in gone], "c string")
        made.append(_cells(rows, "left out", F.col("c")))
    return reduce(lambda a, b: a.unionByName(b), made)


def _box_cells(boxes: DataFrame, chart: str | Column, x: Column | None = None) -> DataFrame:
    facts = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    long = boxes.unpivot(["grp"], facts, "fact", "value")
    return _cells(long, chart, F.col("grp") if x is None else x, None, F.col("fact"), F.col("value"))


def visual_summary(df: DataFrame) -> DataFrame:
    """Correlations, histograms and boxes of the numeric columns, counts of every categorical."""
    nums, cats = numeric_columns(df), categorical_columns(df)
    made = []
    if len(nums) >= 2:
        made.append(_cells(profile.correlation_matrix(df, nums, 2), "correlation", F.col("x"), F.col("y"), None, F.col("r")))
    if nums:
        hist = multi_histogram(df, nums, 40)
        made.append(_cells(hist, "hist", F.col("column"), F.col("bin"), None, F.col("n")))
        made.append(_box_cells(multi_box(df, nums), F.concat(F.lit("box "), "grp"), F.lit("all")))
    if cats:
        freq = profile.frequencies(df, cats)
        made.append(_cells(freq, "count", F.col("column"), F.col("value"), None, F.col("n")))
    return reduce(lambda a, b: a.unionByName(b), made)


def write_chart(chart: DataFrame, path: str, dataset: str, chart_type: str, name: str) -> None:
    """Append a chart's table as JSON rows, filed by dataset and type."""
    rows = chart.select(F.lit(dataset).alias("dataset"), F.lit(chart_type).alias("chart_type"), F.lit(name).alias("name"),
                        F.current_timestamp().alias("created"), F.to_json(F.struct(*[col(c) for c in chart.columns])).alias("data"))
    rows.write.mode("append").partitionBy("dataset", "chart_type").parquet(path)


def chart(df: DataFrame, kind: str, x=None, y=None, z=None, color=None, size=None, path=None, bins: int = 30,
          key: Sequence[str] = (), order_by: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Chart data by type name; missing columns are chosen by role, ``n`` limits points, slices or steps."""
    nums, cats = numeric_columns(df), categorical_columns(df)
    x, y, z, color, size = (find_column(df, c) if c is not None else None for c in (x, y, z, color, size))
    extra = [c for c in (color, size) if c]
    key = list(key) or df.columns[:1]

    def number(given, place=0):
        if given is None and len(nums) <= place:
            raise ValueError(f"{kind} needs more numeric columns")
        return given or nums[place]

    category = x or (cats or df.columns)[0]
    if kind == "auto":
        return auto_one(df, key, x, y)[1]
    if kind in ("distplot", "dist"):
        return distribution(df, number(x), bins)
    if kind in ("hist", "histogram"):
        return histogram(df, number(x), bins, color)
    if kind in ("box", "violin", "boxplot", "violinplot"):
        made = box if kind.startswith("box") else violin
        return made(df, number(y), x or color)
    if kind in ("scatter",):
        return scatter(df, [number(x), number(y, 1)], key, n, extra)
    if kind in ("scatter3d", "line3d"):
        return scatter(df, [number(x), number(y, 1), number(z, 2)], key, n, extra)
    if kind in ("line", "area"):
        return line(df, x or df.columns[0], [number(y, 1 if x is None else 0)], color)
    if kind in ("bar", "barh"):
        return bar(df, category, y, color)
    if kind == "bar_polar":
        return bar_polar(df, category, number(y))
    if kind in ("count", "countplot"):
        return category_counts(df, category, n)
    if kind == "pie":
        return pie(df, category, y, n)
    if kind in ("sunburst", "treemap"):
        return profile.path_rollup(df, path or [category], y)
    if kind == "funnel":
        return funnel(df, category, y)
    if kind == "waterfall":
        if n is None:
            raise ValueError("a waterfall needs n, its number of steps")
        return waterfall(df, category, number(y), order_by or key, n)
    if kind == "surface":
        return profile.pivot_mean(df, number(x), number(y, 1), number(z, 2))
    if kind in ("heatmap", "correlation"):
        return profile.correlation_matrix(df, nums, 2)
    if kind in ("density_contour", "contour", "density_heatmap", "jointplot"):
        return density_2d(df, number(x), number(y, 1))
    if kind in ("kde", "kdeplot"):
        return density_2d(df, x, y) if x and y else kde(df, number(x))
    if kind == "pairplot":
        return pairplot(df)
    if kind in ("catplot", "strip"):
        return strip(df, category, number(y), key[0], n)
    raise ValueError(f"unsupported chart {kind!r}")
