"""Profiling and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.operators import profile, quality
from tableprep.plans import report

from .registry import check, union

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = LINE + ["l_returnflag", "l_linestatus", "l_shipdate"]
DIRTY = ["event_id", "ts", "user_id", "event_type", "value"]
FACTS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def rounded(df, names, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def describe_sql(table: str, cols: list[str]) -> str:
    return union(f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {table}""" for c in cols)


def missing_sql(table: str, cols: list[str], digits: int = 4) -> str:
    return union(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), {digits}) AS missing_pct FROM {table}""" for c in cols)


@check("shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def _(t):
    return profile.shape(t.lineitem)


@check("missing_counts", f'SELECT "column", missing FROM ({missing_sql("events_dirty", DIRTY)})')
def _(t):
    return profile.missing_counts(t.events_dirty).select("column", "missing")


@check("missing_percentage", missing_sql("events_dirty", DIRTY, 2))
def _(t):
    return profile.missing_counts(t.events_dirty, 2)


@check("missing_total", f'SELECT CAST(sum(missing) AS BIGINT) AS missing FROM ({missing_sql("events_dirty", DIRTY)})')
def _(t):
    return profile.missing_total(t.events_dirty)


@check("missing_chart", f'SELECT "column", missing FROM ({missing_sql("events_dirty", DIRTY)}) WHERE missing > 0')
def _(t):
    return profile.missing_chart(t.events_dirty)


@check("memory_estimate", union(
    [f"""SELECT '{c}' AS "column", CAST(sum(strlen({c})) AS BIGINT) AS bytes FROM documents""" for c in ("text", "lang", "source")]
    + [f"""SELECT '{c}' AS "column", count({c}) * 8 AS bytes FROM documents""" for c in ("doc_id", "n_chars")]))
def _(t):
    return profile.memory_estimate(t.documents)


@check("describe_numeric", describe_sql("lineitem", LINE))
def _(t):
    return rounded(profile.describe_numeric(t.lineitem), FACTS)


def top_sql(table: str, c: str) -> str:
    return f"""(SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


def freq_sql(table: str, c: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"


@check("describe_all", f"""SELECT *, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq
FROM ({describe_sql("customer_dirty", ["c_custkey", "c_acctbal", "c_nationkey", "const_col"])})
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT c_mktsegment),
  {top_sql("customer_dirty", "c_mktsegment")}, {freq_sql("customer_dirty", "c_mktsegment")} FROM customer_dirty""")
def _(t):
    return rounded(profile.describe_all(t.customer_dirty), FACTS)


_ORDER_COLS = ["o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"]


def _snapshot_row(c: str) -> str:
    numeric = c in ("o_orderkey", "o_totalprice", "o_custkey")
    facts = (f"round(avg(CAST({c} AS DOUBLE)), 2) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 2) AS std, "
             f"round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, CAST(NULL AS BIGINT) AS cardinality"
             if numeric else "NULL AS mean, NULL AS std, NULL AS min, NULL AS max, count(DISTINCT " + c + ") AS cardinality")
    return f"""SELECT '{c}' AS "column", round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 1) AS missing_pct, {facts} FROM orders_dirty"""


@check("snapshot_stats", union(_snapshot_row(c) for c in _ORDER_COLS))
def _(t):
    return profile.snapshot(t.orders_dirty)


@check("snapshot_first_rows", union(f"""SELECT '{c}' AS "column", (
  SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'null'), ' | ' ORDER BY o_orderkey)
  FROM (SELECT * FROM orders_dirty ORDER BY o_orderkey LIMIT 3)) AS "first\"""" for c in _ORDER_COLS))
def _(t):
    found = profile.snapshot(t.orders_dirty, order_by=["o_orderkey"])
    return found.select("column", F.array_join("first", " | ", "null").alias("first"))


def outlier_sql(table: str, cols: list[str]) -> str:
    return union(f"""SELECT '{c}' AS "column", coalesce((SELECT count(*) FROM {table}, (
  SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {table}) q
  WHERE b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))), 0) AS outliers""" for c in cols)


@check("iqr_outlier_counts", outlier_sql("events_dirty", ["event_id", "user_id", "value"]))
def _(t):
    return profile.iqr_outlier_counts(t.events_dirty)


def category_sql(table: str, cols: list[str], top: int = 5) -> str:
    return union(f"""SELECT * FROM (SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {table}) AS "unique",
  {top_sql(table, c)} AS most_frequent, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS n
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {top}""" for c in cols)


@check("categorical_summary", category_sql("part", ["p_name", "p_brand", "p_type"]))
def _(t):
    return profile.categorical_summary(t.part)


def _info_row(c: str, kind: str, numeric: bool) -> str:
    facts = (f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, "
             f"round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std" if numeric else "NULL AS mean, NULL AS median, NULL AS std")
    return f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(DISTINCT {c}) AS "unique", count(*) - count({c}) AS missing,
  (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM customer_dirty WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples,
  {facts} FROM customer_dirty"""


@check("column_info", union([_info_row("c_nationkey", "int", True), _info_row("c_custkey", "bigint", True),
                             _info_row("c_mktsegment", "string", False)]))
def _(t):
    return rounded(profile.column_info(t.customer_dirty, ["c_nationkey", "c_custkey", "c_mktsegment"]), ["mean", "median", "std"])


@check("value_counts", """SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM events_dirty WHERE event_type IS NOT NULL GROUP BY event_type""")
def _(t):
    return rounded(profile.value_counts(t.events_dirty, "event_type", normalize=True), ["share"], 6)


@check("top_k_values", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, value LIMIT 10")
def _(t):
    return profile.value_counts(t.part, "p_name", 10)


@check("nunique", union(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique" FROM lineitem""" for c in LINE_ALL))
def _(t):
    return profile.nunique(t.lineitem)


@check("mode_value", union(f"""SELECT '{c}' AS "column", {top_sql(tab, c)} AS mode, {freq_sql(tab, c)} AS freq"""
                           for tab, c in [("events_dirty", "event_type"), ("events_dirty", "user_id")]))
def _(t):
    return profile.mode_values(t.events_dirty, ["event_type", "user_id"])


_KINDS = {"c_custkey": ("bigint", "numeric"), "c_acctbal": ("double", "numeric"), "c_mktsegment": ("string", "categorical"),
          "c_nationkey": ("int", "numeric"), "const_col": ("int", "numeric")}


@check("schema_profile", union(f"""SELECT '{c}' AS "column", '{k}' AS dtype, '{r}' AS role, count(*) - count({c}) AS missing,
  count(DISTINCT {c}) AS "unique" FROM customer_dirty""" for c, (k, r) in _KINDS.items()))
def _(t):
    return profile.schema_profile(t.customer_dirty)


def corr_sql(table: str, cols: list[str], digits: int) -> str:
    return union(f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0::DOUBLE" if a == b else
                 f"round(corr(CAST({min(a, b)} AS DOUBLE), CAST({max(a, b)} AS DOUBLE)), {digits})") + f" AS r FROM {table}" + (" LIMIT 1" if False else "")
                 if a != b else f"SELECT '{a}' AS x, '{b}' AS y, 1.0::DOUBLE AS r" for a in cols for b in cols)


@check("correlation_matrix", corr_sql("lineitem", LINE, 6))
def _(t):
    return profile.correlation_matrix(t.lineitem, digits=6)


@check("top_correlations", f"""SELECT x, y, r FROM ({corr_sql("lineitem", LINE, 6)}) WHERE x < y ORDER BY abs(r) DESC, x, y LIMIT 5""")
def _(t):
    return rounded(profile.top_correlations(t.lineitem, n=5), ["r"], 6)


@check("duplicate_rows", """SELECT CAST((SELECT count(*) FROM events_dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dup)) AS BIGINT) AS duplicates""")
def _(t):
    return profile.duplicate_rows(t.events_dup)


@check("constant_columns", union(f"""SELECT "column" FROM (SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM customer_dirty) WHERE n = 1"""
                                 for c in _KINDS))
def _(t):
    return quality.constant_columns(t.customer_dirty)


@check("high_cardinality_ratio", union(f"""SELECT "column", "unique" FROM (SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", count(*) AS n
FROM customer) WHERE "unique" > 0.5 * n""" for c in ("c_name", "c_mktsegment")))
def _(t):
    return quality.high_cardinality_ratio(t.customer)


_DUPS = "(SELECT count(*) FROM {0}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {0}))"


@check("quality_issues", f"""SELECT 'missing' AS issue, "column", missing AS value FROM ({missing_sql("customer_dirty", list(_KINDS))}) WHERE missing > 0
UNION ALL SELECT 'constant', 'const_col', 1
UNION ALL SELECT 'duplicates', NULL, v FROM (SELECT {_DUPS.format("customer_dirty")} AS v) WHERE v > 0
UNION ALL SELECT 'high_cardinality', 'c_mktsegment', u FROM (SELECT count(DISTINCT c_mktsegment) AS u, count(*) AS n FROM customer_dirty) WHERE u > 0.5 * n""")
def _(t):
    return quality.quality_issues(t.customer_dirty)


def score_sql(table: str, cols: list[str], weights: tuple, digits: int) -> str:
    a, b, c, d = weights
    nulls = " + ".join(f"count(*) - count({x})" for x in cols)
    return f"""SELECT rows, {len(cols)} AS columns, missing, duplicates, round((1 - missing / (rows * {len(cols)}.0::DOUBLE)) * {a}
  + (1 - duplicates / CAST(rows AS DOUBLE)) * {b} + least(rows / 1000.0::DOUBLE, 1.0) * {c} + {min(len(cols) / 10, 1) * d}, {digits}) AS score
FROM (SELECT count(*) AS rows, {nulls} AS missing, CAST({_DUPS.format(table)} AS BIGINT) AS duplicates FROM {table})"""


@check("quality_score_a", score_sql("events_dup", DIRTY, (30, 20, 25, 25), 4))
def _(t):
    return rounded(quality.quality_score(t.events_dup), ["score"])


@check("quality_score_b", score_sql("events_dup", DIRTY, (40, 30, 15, 15), 2))
def _(t):
    return quality.quality_score(t.events_dup, quality.WEIGHTS_B, 2)


def _summary_sql(table: str, kinds: dict[str, str], nums: list[str]) -> str:
    cols = list(kinds)
    typed: dict[str, int] = {}
    for k in kinds.values():
        typed[k] = typed.get(k, 0) + 1
    width = {"bigint": 8, "double": 8, "int": 4}
    size = lambda c: f"sum(strlen({c}))" if kinds[c] == "string" else f"count({c}) * {width[kinds[c]]}"
    facts = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    part = lambda section, column, metric, value, src: (
        f"SELECT '{section}' AS section, {column} AS \"column\", {metric} AS metric, CAST({value} AS DOUBLE) AS value FROM {src}")
    return union(
        [part("shape", "NULL", "'rows'", "count(*)", table), part("shape", "NULL", "'columns'", len(cols), "(SELECT 1)")]
        + [part("types", "NULL", f"'{k}'", n, "(SELECT 1)") for k, n in typed.items()]
        + [part("missing", '"column"', "'count'", "missing", f"({missing_sql(table, cols, 2)})"),
           part("missing", '"column"', "'percent'", "missing_pct", f"({missing_sql(table, cols, 2)})"),
           part("duplicates", "NULL", "'rows'", _DUPS.format(table), "(SELECT 1)")]
        + [part("memory", f"'{c}'", "'bytes'", size(c), table) for c in cols]
        + [part("numeric", '"column"', f"'{f}'", f'"{f}"', f"({describe_sql(table, nums)})") for f in facts]
        + [part("correlation", "x", "y", "r", f"({corr_sql(table, nums, 4)})")])


_KIND = {c: k for c, (k, _) in _KINDS.items()}


@check("data_summary", _summary_sql("customer_dirty", {c: k for c, k in _KIND.items() if c != "const_col"}, ["c_custkey", "c_acctbal", "c_nationkey"]))
def _(t):
    return rounded(report.data_summary(t.customer_dirty.drop("const_col")), ["value"])


@check("table_health", f"""SELECT d.*, m.missing, o.outliers, s.rows, s.duplicates, s.score AS table_score
FROM ({describe_sql("lineitem", LINE)}) d JOIN ({missing_sql("lineitem", LINE)}) m USING ("column")
JOIN ({outlier_sql("lineitem", LINE)}) o USING ("column") CROSS JOIN ({score_sql("lineitem", LINE_ALL, (40, 30, 15, 15), 2)}) s""")
def _(t):
    return rounded(report.table_health(t.lineitem), FACTS)


@check("group_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY l_returnflag")
def _(t):
    return rounded(profile.group_aggregate(t.lineitem, "l_returnflag", "l_extendedprice", "sum"), ["sum"], 2)


@check("group_mean", "SELECT event_type, round(avg(value), 6) AS mean FROM events_dirty WHERE event_type IS NOT NULL GROUP BY event_type")
def _(t):
    return rounded(profile.group_aggregate(t.events_dirty, "event_type", "value", "mean"), ["mean"], 6)


@check("pivot_mean", "SELECT l_linenumber AS y, l_returnflag AS x, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(profile.pivot_mean(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity"), ["mean"], 6)


@check("pivot_mean_wide", """SELECT l_linenumber AS y, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A",
  round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(profile.pivot_mean(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity", wide=["A", "N", "R"]), ["A", "N", "R"], 6)


ROLLUP = """SELECT CAST(CASE WHEN {a} IS NULL THEN 0 WHEN {b} IS NULL THEN 1 ELSE 2 END AS INTEGER) AS level, {a}, {b}, round(sum({v}), 2) AS value,
  CASE WHEN {a} IS NULL THEN 'all' WHEN {b} IS NULL THEN 'all/' || {a} ELSE 'all/' || {a} || '/' || {b} END AS id,
  CASE WHEN {a} IS NULL THEN '' WHEN {b} IS NULL THEN 'all' ELSE 'all/' || {a} END AS parent FROM {t} GROUP BY ROLLUP ({a}, {b})"""
# the same with the separator inside values
ROLLUP_SLASH = """WITH d AS (SELECT l_returnflag || '/' || l_linestatus AS a, l_linestatus || '/x' AS b, l_extendedprice AS v FROM lineitem)
SELECT CAST(CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN 1 ELSE 2 END AS INTEGER) AS level, a, b, round(sum(v), 2) AS value,
  CASE WHEN a IS NULL THEN 'all' ELSE 'all/' || replace(a, '/', '\\/') || CASE WHEN b IS NULL THEN '' ELSE '/' || replace(b, '/', '\\/') END END AS id,
  CASE WHEN a IS NULL THEN '' WHEN b IS NULL THEN 'all' ELSE 'all/' || replace(a, '/', '\\/') END AS parent FROM d GROUP BY ROLLUP (a, b)"""


@check("path_rollup", ROLLUP.format(a="l_returnflag", b="l_linestatus", v="l_extendedprice", t="lineitem"))
def _(t):
    return rounded(profile.path_rollup(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), ["value"], 2)


@check("path_rollup_slash", ROLLUP_SLASH)
def _(t):
    data = t.lineitem.select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("a"),
                             F.concat("l_linestatus", F.lit("/x")).alias("b"), F.col("l_extendedprice").alias("v"))
    return rounded(profile.path_rollup(data, ["a", "b"], "v"), ["value"], 2)
