"""Tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.operators import profile
from tableprep.plans import charts

from .q_profile import LINE, ROLLUP, corr_sql, describe_sql, FACTS, missing_sql, rounded
from .registry import check, union


def bin_sql(c: str, table: str, bins: int) -> str:
    v, lo, hi = f"CAST({c} AS DOUBLE)", f"(SELECT CAST(min({c}) AS DOUBLE) FROM {table})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {table})"
    return f"CAST(least(floor(({v} - {lo}) / (({hi} - {lo}) / {bins})), {bins - 1}) AS INTEGER)"


def edge_sql(c: str, table: str, bins: int) -> str:
    lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {table})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {table})"
    return f"round({lo} + bin * (({hi} - {lo}) / {bins}), 4) AS low, round({lo} + (bin + 1) * (({hi} - {lo}) / {bins}), 4) AS high"


def hist_sql(c: str, table: str, bins: int, color: str | None = None) -> str:
    extra = f"{color} AS color, " if color else ""
    keep = "color, " if color else ""
    return f"""SELECT {keep}bin, n, {edge_sql(c, table, bins)} FROM (SELECT {extra}{bin_sql(c, table, bins)} AS bin, count(*) AS n
  FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL)"""


@check("chart_histogram", hist_sql("value", "events_dirty", 30, "event_type"))
def _(t):
    return rounded(charts.histogram(t.events_dirty, "value", 30, "event_type"), ["low", "high"])


@check("chart_multi_histogram", union(f"""SELECT '{c}' AS "column", * FROM ({hist_sql(c, 'lineitem', 20)})""" for c in LINE))
def _(t):
    return rounded(charts.multi_histogram(t.lineitem, LINE, 20), ["low", "high"])


def box_sql(y: str, table: str, group: str) -> str:
    return f"""SELECT grp, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT {group} AS grp, CAST({y} AS DOUBLE) AS v FROM {table} WHERE {y} IS NOT NULL) d JOIN (
  SELECT {group} AS grp, count(*) AS n, quantile_cont(CAST({y} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({y} AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST({y} AS DOUBLE), 0.75) AS q3 FROM {table} WHERE {y} IS NOT NULL GROUP BY 1) q USING (grp) GROUP BY grp"""


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]
_TYPE = "coalesce(event_type, 'null')"


@check("chart_box", f"SELECT * REPLACE (nullif(grp, 'null') AS grp) FROM ({box_sql('value', 'events_dirty', _TYPE)})")
def _(t):
    return rounded(charts.box(t.events_dirty, "value", "event_type"), BOX)


def kde_sql(x: str, table: str, group: str) -> str:
    return f"""SELECT grp, i, round(g, 4) AS x, round(sum(exp(-0.5 * ((g - v) / h) * ((g - v) / h))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
FROM (SELECT grp, v, n, h, i, lo - 3 * h + i * (hi - lo + 6 * h) / 199 AS g FROM
  (SELECT {group} AS grp, CAST({x} AS DOUBLE) AS v FROM {table} WHERE {x} IS NOT NULL) JOIN
  (SELECT {group} AS grp, count(*) AS n, stddev_samp(CAST({x} AS DOUBLE)) * pow(count(*), -0.2) AS h, CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi
   FROM {table} WHERE {x} IS NOT NULL GROUP BY 1) USING (grp), (SELECT CAST(range AS INTEGER) AS i FROM range(0, 200))) GROUP BY grp, i, g"""


@check("chart_kde", kde_sql("value", "events", "'all'"))
def _(t):
    return rounded(rounded(charts.kde(t.events, "value"), ["x"]), ["density"], 8)


@check("chart_violin", f"""SELECT * REPLACE (nullif(grp, 'null') AS grp) FROM (SELECT k.*, b.q1, b.median, b.q3 FROM ({kde_sql('value', 'events_dirty', _TYPE)}) k
JOIN ({box_sql('value', 'events_dirty', _TYPE)}) b USING (grp))""")
def _(t):
    out = rounded(charts.violin(t.events_dirty, "value", "event_type"), ["x", "q1", "median", "q3"])
    return rounded(out, ["density"], 8)


def bins2_sql(x: str, y: str, table: str, bins: int) -> str:
    return f"SELECT {bin_sql(x, table, bins)} AS x_bin, {bin_sql(y, table, bins)} AS y_bin, count(*) AS n FROM {table} GROUP BY 1, 2"


@check("chart_density_2d", bins2_sql("l_quantity", "l_extendedprice", "lineitem", 20))
def _(t):
    return charts.density_2d(t.lineitem, "l_quantity", "l_extendedprice", 20)


_MD5 = "md5(CAST({0} AS VARCHAR) || '|42')"


@check("chart_scatter", f"""SELECT event_id, user_id, value, event_type FROM events_dirty WHERE user_id IS NOT NULL AND value IS NOT NULL
ORDER BY {_MD5.format('event_id')}, event_id LIMIT 5000""")
def _(t):
    return charts.scatter(t.events_dirty, ["user_id", "value"], ["event_id"], 5000, ["event_type"])


@check("chart_scatter3d", f"SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders ORDER BY {_MD5.format('o_orderkey')}, o_orderkey LIMIT 5000")
def _(t):
    return charts.scatter(t.orders, ["o_orderkey", "o_totalprice", "o_custkey"], ["o_orderkey"], 5000, ["o_orderstatus"])


@check("chart_line", """SELECT event_id AS x, 'user_id' AS series, CAST(user_id AS DOUBLE) AS value FROM events
UNION ALL SELECT event_id, 'value', value FROM events""")
def _(t):
    return charts.line(t.events, "event_id", ["user_id", "value"])


@check("chart_bar", "SELECT l_returnflag AS x, l_linestatus AS color, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(charts.bar(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus"), ["value"], 2)


@check("chart_bar_polar", "SELECT event_type AS theta, round(sum(value), 2) AS r FROM events_dirty WHERE event_type IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(charts.bar_polar(t.events_dirty, "event_type", "value"), ["r"], 2)


@check("chart_category_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return charts.chart(t.part, "countplot", "p_brand")


@check("chart_pie", """SELECT p_brand AS name, CAST(count(*) AS DOUBLE) AS value, round(count(*) / (SELECT count(*) FROM part), 8) AS share,
  false AS is_rest FROM part GROUP BY 1""")
def _(t):
    return rounded(charts.pie(t.part, "p_brand"), ["share"], 8)


@check("chart_pie_other", """WITH s AS (SELECT p_brand AS name, CAST(count(*) AS DOUBLE) AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r
  FROM part GROUP BY 1)
SELECT name, value, round(value / (SELECT sum(value) FROM s), 8) AS share, false AS is_rest FROM s WHERE r <= 10
UNION ALL SELECT 'other', sum(value), round(sum(value) / (SELECT sum(value) FROM s), 8), true FROM s WHERE r > 10 HAVING count(*) > 0""")
def _(t):
    return rounded(charts.pie(t.part, "p_brand", n=10), ["share"], 8)


@check("chart_sunburst", ROLLUP.format(a="o_orderstatus", b="o_orderpriority", v="o_totalprice", t="orders"))
def _(t):
    return rounded(charts.chart(t.orders, "sunburst", y="o_totalprice", path=["o_orderstatus", "o_orderpriority"]), ["value"], 2)


@check("chart_treemap", ROLLUP.format(a="p_type", b="p_brand", v="1.0::DOUBLE", t="part"))
def _(t):
    return charts.chart(t.part, "treemap", path=["p_type", "p_brand"])


@check("chart_funnel", "SELECT event_type AS stage, round(sum(value), 2) AS value FROM events GROUP BY 1")
def _(t):
    return rounded(charts.funnel(t.events, "event_type", "value"), ["value"], 2)


@check("chart_funnel_counts", "SELECT event_type AS stage, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def _(t):
    return charts.funnel(t.events, "event_type", "props")


@check("chart_waterfall", """SELECT CAST(row_number() OVER w AS INTEGER) AS step, x, delta, round(sum(delta) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total FROM (
  SELECT event_type AS x, value AS delta, event_id FROM events_dirty WHERE event_type IS NOT NULL AND value IS NOT NULL ORDER BY event_id LIMIT 20)
WINDOW w AS (ORDER BY event_id)""")
def _(t):
    return rounded(charts.waterfall(t.events_dirty, "event_type", "value", ["event_id"], 20), ["total"])


@check("chart_surface", "SELECT l_suppkey AS y, l_linenumber AS x, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(charts.chart(t.lineitem, "surface", "l_linenumber", "l_suppkey", "l_extendedprice"), ["mean"], 6)


@check("chart_heatmap", corr_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], 2))
def _(t):
    return charts.chart(t.orders, "heatmap")


_PAIR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pair_sql(cols: list[str], table: str) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return union(f"SELECT '{a}' AS x, '{b}' AS y, x_bin, y_bin, n FROM ({bins2_sql(a, b, table, 20)})" for a, b in pairs)


@check("chart_pairplot", pair_sql(_PAIR, "lineitem"))
def _(t):
    return charts.pairplot(t.lineitem.select(*_PAIR))


@check("chart_strip", f"""SELECT key, x, y FROM (SELECT event_id AS key, event_type AS x, value AS y,
  row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format('event_id')}, event_id) AS r FROM events_dirty WHERE event_type IS NOT NULL AND value IS NOT NULL) WHERE r <= 50""")
def _(t):
    return charts.strip(t.events_dirty, "event_type", "value", "event_id", 50)


_CUST = {"c_custkey": "bigint", "c_acctbal": "double", "c_nationkey": "int", "const_col": "int"}


@check("chart_summary_table", f"""SELECT d.*, k.dtype, m.missing FROM ({describe_sql('customer_dirty', list(_CUST))}) d
JOIN ({missing_sql('customer_dirty', list(_CUST))}) m USING ("column")
JOIN (VALUES {', '.join(f"('{c}', '{k}')" for c, k in _CUST.items())}) k("column", dtype) USING ("column")""")
def _(t):
    return rounded(charts.summary_table(t.customer_dirty), FACTS)


@check("chart_auto_one", corr_sql("lineitem", LINE, 2))
def _(t):
    return charts.auto_one(t.lineitem, ["l_orderkey"])[1]


def _long(chart: str, x: str, y: str, series: str, value: str, src: str) -> str:
    return (f"SELECT '{chart}' AS chart, CAST({x} AS VARCHAR) AS x, CAST({y} AS VARCHAR) AS y, CAST({series} AS VARCHAR) AS series, "
            f"round(CAST({value} AS DOUBLE), 4) AS value FROM {src}")


def _box_long(chart: str, sql: str) -> list[str]:
    return [_long(chart, "grp", "NULL", f"'{f}'", f, f"({sql})") for f in BOX]


_SUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@check("visual_summary", union(
    [_long("correlation", "x", "y", "NULL", "r", f"({corr_sql('orders', _SUM, 2)})")]
    + [_long("hist", f"'{c}'", "bin", "NULL", "n", f"({hist_sql(c, 'orders', 40)})") for c in _SUM]
    + [s for c in _SUM for s in _box_long(f"box {c}", box_sql(c, "orders", "'all'"))]
    + [_long("count", f"'{c}'", c, "NULL", "n", f"(SELECT {c}, count(*) AS n FROM orders GROUP BY 1)") for c in ("o_orderstatus", "o_orderpriority")]))
def _(t):
    return rounded(charts.visual_summary(t.orders), ["value"])


def auto_sql(key: str, nums: list[str], cat: str, table: str) -> str:
    points = table
    parts = [_long("correlation", "x", "y", "NULL", "r", f"({corr_sql(table, nums, 2)})")]
    for c in nums:
        parts.append(_long(f"distribution {c}", "low", "high", "'n'", "n", f"({hist_sql(c, table, 30)})"))
        parts += _box_long(f"distribution {c}", box_sql(c, table, "'all'"))
    parts.append(_long(f"categories {cat}", cat, "NULL", "NULL", "n", f"(SELECT {cat}, count(*) AS n FROM {table} GROUP BY 1)"))
    parts += [_long(f"scatter {a} {b}", a, b, "NULL", "NULL", points) for a, b in zip(nums, nums[1:])]
    parts.append(_long("pairplot", "x || ':' || x_bin", "y || ':' || y_bin", "NULL", "n", f"({pair_sql(nums, table)})"))
    parts += _box_long(f"box {cat} {nums[0]}", box_sql(nums[0], table, cat))
    parts.append(_long(f"scatter3d {' '.join(nums[:3])}", nums[0], nums[1], "NULL", nums[2], points))
    parts += [_long(f"density {c}", "x", "NULL", "NULL", "density * 1000", f"({kde_sql(c, table, chr(39) + 'all' + chr(39))})") for c in nums]
    return union(parts)


@check("chart_auto_set", f"""SELECT chart, count(*) AS points, round(sum(value), 2) AS total
FROM ({auto_sql('event_id', ['event_id', 'user_id', 'value'], 'event_type', 'events')}) GROUP BY chart""")
def _(t):
    made = charts.auto_set(t.events.drop("props"), ["event_id"])
    value = F.round(F.when(F.col("chart").startswith("density"), F.col("value") * 1000).otherwise(F.col("value")), 4)
    return made.groupBy("chart").agg(F.count("*").alias("points"), F.round(F.sum(value), 2).alias("total"))


@check("chart_write", f"""SELECT 'lineitem' AS dataset, 'histogram' AS chart_type, 'l_quantity' AS name, bin, n FROM ({hist_sql('l_quantity', 'lineitem', 30)})
UNION ALL SELECT 'orders', 'histogram', 'o_totalprice', bin, n FROM ({hist_sql('o_totalprice', 'orders', 30)})""")
def _(t):
    path = t.workspace()
    charts.write_chart(charts.histogram(t.lineitem, "l_quantity"), path, "lineitem", "histogram", "l_quantity")
    charts.write_chart(charts.histogram(t.orders, "o_totalprice"), path, "orders", "histogram", "o_totalprice")
    data = F.from_json("data", "bin int, n long")
    return t.spark.read.parquet(path).select("dataset", "chart_type", "name", data["bin"].alias("bin"), data["n"].alias("n"))
