"""Missing values, outliers, scaling, encoding, reduction, selection, balance, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.operators import balance, encode, engineer, impute, ordered, outliers, reduce, scale, select

from .q_profile import rounded
from .registry import check, union


def q(table: str, c: str, p: float) -> str:
    return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), {p}) FROM {table})"


def stat(table: str, fn: str, c: str) -> str:
    return f"(SELECT {fn}(CAST({c} AS DOUBLE)) FROM {table})"


def mode_of(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


# ---------------------------------------------------------------- missing values

NUMS = ["user_id", "value"]


def filled_sql(fill) -> str:
    return "SELECT event_id, event_type, " + ", ".join(
        f"round(coalesce(CAST({c} AS DOUBLE), {fill(c)}), 6) AS {c}" for c in NUMS) + " FROM events_dirty"


def _filled(t, strategy):
    return rounded(impute.fill_numbers(t.events_dirty.drop("ts"), strategy), NUMS, 6)


@check("impute_mean", filled_sql(lambda c: stat("events_dirty", "avg", c)))
def _(t):
    return _filled(t, "mean")


@check("impute_median", filled_sql(lambda c: q("events_dirty", c, 0.5)))
def _(t):
    return _filled(t, "median")


@check("impute_mode_numeric", filled_sql(lambda c: mode_of("events_dirty", c)))
def _(t):
    return _filled(t, "mode")


def knn_parts(table: str, key: str, feats: list[str], targets: list[str], k: int = 5) -> tuple[str, dict[str, str], str]:
    """Common tables, the filled expression per target, and the joins for rows of ``table`` as s."""
    p = len(feats)
    parts = []
    for target in targets:
        total = " + ".join(f"CASE WHEN r.{f} IS NULL OR d.{f} IS NULL THEN 0.0::DOUBLE ELSE (CAST(r.{f} AS DOUBLE) - d.{f}) * (CAST(r.{f} AS DOUBLE) - d.{f}) END" for f in feats)
        seen = " + ".join(f"CASE WHEN r.{f} IS NULL OR d.{f} IS NULL THEN 0 ELSE 1 END" for f in feats)
        parts.append(f"""fill_{target} AS (SELECT {key}, avg(pay) AS v FROM (
  SELECT {key}, pay, row_number() OVER (PARTITION BY {key} ORDER BY d2, pay) AS rn FROM (
    SELECT r.{key}, CAST(d.{target} AS DOUBLE) AS pay, ({total}) * {p} / ({seen}) AS d2
    FROM {table} r, {table} d WHERE r.{target} IS NULL AND d.{target} IS NOT NULL AND ({seen}) > 0))
  WHERE rn <= {k} GROUP BY {key})""")
    cols = {c: f"coalesce(CAST(s.{c} AS DOUBLE), fill_{c}.v, {stat(table, 'avg', c)})" for c in targets}
    joins = " ".join(f"LEFT JOIN fill_{c} ON s.{key} = fill_{c}.{key}" for c in targets)
    return ", ".join(parts), cols, joins


def _knn_sql(table: str, key: str, feats: list[str], targets: list[str]) -> str:
    parts, cols, joins = knn_parts(table, key, feats, targets)
    return f"WITH {parts} SELECT s.{key}, {', '.join(f'round({v}, 4) AS {c}' for c, v in cols.items())} FROM {table} s {joins}"


@check("impute_knn", _knn_sql("orders_dirty", "o_orderkey", ["o_totalprice", "o_custkey"], ["o_totalprice", "o_custkey"]))
def _(t):
    data = t.orders_dirty.select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(impute.impute_knn(data, ["o_totalprice", "o_custkey"]), ["o_totalprice", "o_custkey"])


@check("impute_iterative")
def _(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return impute.impute_iterative(t.lineitem_gaps, cols)


@check("impute_iterative_pair", """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem_gaps),
z AS (SELECT (l_quantity - mq) / sq AS y, (l_extendedprice - me) / se AS x FROM lineitem_gaps, s WHERE l_quantity IS NOT NULL),
g AS (SELECT sum(x * x) + 0.001 AS a, sum(x) AS b, count(*) + 0.001 AS d, sum(x * y) AS u, sum(y) AS v FROM z)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(coalesce(l_quantity, ((a * v - b * u) + (u * d - b * v) * (l_extendedprice - me) / se) / (a * d - b * b) * sq + mq), 4) AS l_quantity
FROM lineitem_gaps, s, g""")
def _(t):
    """One target and one predictor without nulls: the chain is one ridge regression."""
    data = t.lineitem_gaps.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(impute.impute_iterative(data, ["l_extendedprice", "l_quantity"]), ["l_quantity"], 4)


@check("impute_drop", "SELECT event_id, user_id, event_type, value FROM events_dirty WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL")
def _(t):
    return impute.impute(t.events_dirty.drop("ts"), "drop", cat_strategy=None)


@check("impute_cat_mode", f"SELECT event_id, coalesce(event_type, {mode_of('events_dirty', 'event_type')}) AS event_type FROM events_dirty")
def _(t):
    return impute.fill_categories(t.events_dirty.select("event_id", "event_type"), "mode")


@check("impute_cat_constant", "SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM customer_dirty")
def _(t):
    return impute.fill_categories(t.customer_dirty.select("c_custkey", "c_mktsegment"), "constant")


@check("fill_forward", """SELECT event_id, last_value(user_id IGNORE NULLS) OVER w AS user_id, last_value(event_type IGNORE NULLS) OVER w AS event_type,
  last_value(value IGNORE NULLS) OVER w AS value FROM events_dirty WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return ordered.fill_along(t.events_dirty.drop("ts"), ["event_id"], ["user_id", "event_type", "value"])


@check("fill_backward", """SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS value
FROM events_dirty""")
def _(t):
    return ordered.fill_along(t.events_dirty.select("event_id", "user_id", "value"), ["event_id"], ["value"], ["user_id"], backward=True)


# ---------------------------------------------------------------- outliers

def _iqr(table: str, c: str) -> tuple[str, str]:
    a, b = q(table, c, 0.25), q(table, c, 0.75)
    return f"({a} - 1.5 * ({b} - {a}))", f"({b} + 1.5 * ({b} - {a}))"


def clip_sql(c: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least(CAST({c} AS DOUBLE), {hi}), {lo}) END"


@check("outlier_iqr_cap", f"SELECT event_id, round({clip_sql('value', *_iqr('events_dirty', 'value'))}, 4) AS value FROM events_dirty")
def _(t):
    return rounded(outliers.outliers(t.events_dirty.select("event_id", "value"), "iqr", "cap", ["value"]), ["value"])


def _inside(c: str, lo: str, hi: str) -> str:
    return f"({c} IS NULL OR ({c} >= {lo} AND {c} <= {hi}))"


@check("outlier_iqr_remove", f"""WITH first AS (SELECT event_id, user_id, value FROM events_dirty WHERE {_inside('value', *_iqr('events_dirty', 'value'))}),
second AS (SELECT * FROM first WHERE {_inside('user_id', *_iqr('first', 'user_id'))})
SELECT * FROM second""")
def _(t):
    return outliers.outliers(t.events_dirty.select("event_id", "user_id", "value"), "iqr", "remove", ["value", "user_id"])


def _z(table: str, c: str, std: str) -> tuple[str, str]:
    m, s = stat(table, "avg", c), stat(table, std, c)
    return f"({m} - 3 * {s})", f"({m} + 3 * {s})"


@check("outlier_zscore_cap", f"SELECT event_id, round({clip_sql('value', *_z('events_dirty', 'value', 'stddev_samp'))}, 4) AS value FROM events_dirty")
def _(t):
    return rounded(outliers.outliers(t.events_dirty.select("event_id", "value"), "zscore", "cap", ["value"]), ["value"])


@check("outlier_zscore_remove", f"SELECT event_id, value FROM events_dirty WHERE {_inside('value', *_z('events_dirty', 'value', 'stddev_pop'))}")
def _(t):
    return outliers.outliers(t.events_dirty.select("event_id", "value"), "zscore", "remove", ["value"])


@check("outlier_iforest_facts", """SELECT count(*) FILTER (event_id % 500 = 7) AS planted_removed,
  count(*) FILTER (event_id % 500 <> 7 AND value BETWEEN (SELECT quantile_cont(value, 0.25) FROM events) AND (SELECT quantile_cont(value, 0.75) FROM events)) AS middle_kept
FROM events""")
def _(t):
    """Events with every 500th value made extreme: none of those stays, and the middle half of the others does."""
    is_planted = F.col("event_id") % 500 == 7
    lo, hi = t.events.agg(F.percentile("value", [0.25, 0.75])).first()[0]
    data = t.events.select("event_id", F.when(is_planted, F.lit(1e5) + F.col("event_id")).otherwise(F.col("value")).alias("value"))
    kept = outliers.outliers(data, "isolation_forest", "remove", ["value"]).select(F.lit(1).alias("n"), "*")
    planted = data.filter(is_planted).select(F.lit(0).alias("n"), "*")
    return kept.unionByName(planted).agg(
        (F.count_if(is_planted & (F.col("n") == 0)) - F.count_if(is_planted & (F.col("n") == 1))).alias("planted_removed"),
        F.count_if(~is_planted & F.col("value").between(lo, hi)).alias("middle_kept"))


_DISCRETE = "CASE WHEN l_orderkey % 100 = 7 THEN 1000 ELSE l_quantity END"


@check("outlier_iforest_discrete", f"""SELECT CAST(quantity AS DOUBLE) AS quantity, count(*) AS n FROM (SELECT {_DISCRETE} AS quantity FROM lineitem)
WHERE quantity BETWEEN 6 AND 45 GROUP BY quantity""")
def _(t):
    """A column of 50 values with a hundredth of the rows planted far off: all of these go, all inner values stay whole."""
    data = t.lineitem.select(F.expr(_DISCRETE).cast("double").alias("quantity"))
    kept = outliers.outliers(data, "isolation_forest", "remove", ["quantity"])
    return kept.filter("quantity BETWEEN 6 AND 45 OR quantity > 50").groupBy("quantity").agg(F.count("*").alias("n"))


@check("outlier_iforest_remove")
def _(t):
    return outliers.outliers(t.events.select("event_id", "value"), "isolation_forest", "remove", ["value"])


@check("outlier_iforest_cap", f"SELECT event_id, round({clip_sql('value', q('events', 'value', 0.01), q('events', 'value', 0.99))}, 4) AS value FROM events")
def _(t):
    return rounded(outliers.outliers(t.events.select("event_id", "value"), "isolation_forest", "cap", ["value"]), ["value"])


@check("outlier_power_transform", """WITH y AS (SELECT o_orderkey, (pow(o_totalprice / 1000.0 + 1, 0.5) - 1) / 0.5 AS y FROM orders)
SELECT o_orderkey, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 6) AS price FROM y""")
def _(t):
    data = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"))
    return rounded(outliers.power_transform(data, ["price"], lambdas={"price": 0.5}), ["price"], 6)


def _search(steps: int = 4) -> str:
    """The exponent of largest likelihood of a positive column: a grid, refined three times."""
    parts = ["f AS (SELECT count(*) AS n, sum(ln(o_totalprice + 1)) AS slope FROM orders)",
             "g0 AS (SELECT -4 + 0.25 * i AS lam FROM range(33) AS r(i))"]
    for s in range(steps):
        parts.append(f"""l{s} AS (SELECT lam, -n / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(o_totalprice + 1) ELSE pow(o_totalprice + 1, lam) / lam END))
  + (lam - 1) * slope AS ll FROM orders, g{s}, f GROUP BY lam, n, slope)""")
        parts.append(f"b{s} AS (SELECT arg_max(lam, ll) AS lam FROM l{s})")
        parts.append(f"g{s + 1} AS (SELECT lam + {0.25 / 8 ** (s + 1)!r} * i AS lam FROM b{s}, range(-8, 9) AS r(i))")
    return ", ".join(parts)


@check("outlier_power_fitted", f"""WITH {_search()},
y AS (SELECT o_orderkey, (pow(o_totalprice + 1, lam) - 1) / lam AS y FROM orders, b3)
SELECT o_orderkey, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 4) AS o_totalprice FROM y""")
def _(t):
    data = t.orders.select("o_orderkey", "o_totalprice")
    return rounded(outliers.outliers(data, "iqr", "transform", ["o_totalprice"]), ["o_totalprice"], 4)


@check("outlier_flags", "SELECT event_id, " + ", ".join(
    f"CASE WHEN {_inside(c, *_iqr('events_dirty', c))} THEN 0 ELSE 1 END AS is_outlier_{c}" for c in NUMS) + " FROM events_dirty")
def _(t):
    return outliers.outlier_flags(t.events_dirty, "iqr", NUMS).select("event_id", *[f"is_outlier_{c}" for c in NUMS])


# ---------------------------------------------------------------- scaling

SCALED = ["l_quantity", "l_extendedprice", "l_discount"]
_AS = {"standard": lambda c: f"({c} - {stat('lineitem', 'avg', c)}) / {stat('lineitem', 'stddev_pop', c)}",
       "minmax": lambda c: f"({c} - {stat('lineitem', 'min', c)}) / ({stat('lineitem', 'max', c)} - {stat('lineitem', 'min', c)})",
       "robust": lambda c: f"({c} - {q('lineitem', c, 0.5)}) / ({q('lineitem', c, 0.75)} - {q('lineitem', c, 0.25)})"}


def _scaled(method):
    sql = f"SELECT l_orderkey, l_partkey, {', '.join(f'round({_AS[method](c)}, 6) AS {c}' for c in SCALED)} FROM lineitem"

    @check(f"scale_{method}", sql)
    def _(t):
        data = t.lineitem.select("l_orderkey", "l_partkey", *SCALED)
        return rounded(scale.scale(data, method, SCALED), SCALED, 6)


for _m in _AS:
    _scaled(_m)


@check("scale_columns", f"SELECT l_orderkey, l_partkey, round({_AS['minmax']('l_quantity')}, 6) AS l_quantity, l_discount FROM lineitem")
def _(t):
    data = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    return rounded(scale.scale(data, "minmax", ["l_quantity", "absent"]), ["l_quantity"], 6)


# ---------------------------------------------------------------- encoding

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def onehot_sql(table: str, c: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in values)


@check("encode_onehot", f"SELECT c_custkey, {onehot_sql('customer_dirty', 'c_mktsegment', SEGMENTS)} FROM customer_dirty")
def _(t):
    return encode.encode_onehot(t.customer_dirty.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@check("encode_onehot_drop_first", f"SELECT c_custkey, {onehot_sql('customer_dirty', 'c_mktsegment', SEGMENTS[1:])} FROM customer_dirty")
def _(t):
    return encode.encode(t.customer_dirty.select("c_custkey", "c_mktsegment"), "onehot", drop_first=True)


@check("encode_onehot_wide", """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name AS v FROM part)),
s AS (SELECT count(*) AS n FROM l)
SELECT p_partkey, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 1 ELSE 0 END AS first_brand, n AS size, code AS one
FROM part JOIN l ON p_name = v, s""")
def _(t):
    first = t.part.agg(F.min("p_brand")).first()[0]
    wide = encode.encode_onehot(t.part.select("p_partkey", "p_brand", "p_name"), "p_name", form="vector")
    both = encode.encode(wide.select("*"), "onehot", ["p_brand"])
    return both.select("p_partkey", F.col(f"`p_brand_{first}`").alias("first_brand"),
                       F.col("p_name_onehot.size").alias("size"), F.col("p_name_onehot.one").alias("one"))


@check("encode_label", """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(event_type, 'nan') AS v FROM events_dirty))
SELECT event_id, code AS event_type FROM events_dirty JOIN l ON coalesce(event_type, 'nan') = v""")
def _(t):
    return encode.encode_label(t.events_dirty.select("event_id", "event_type"), "event_type")


@check("encode_label_many", """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name AS v FROM part))
SELECT p_partkey, code AS p_name FROM part JOIN l ON p_name = v""")
def _(t):
    # the path for dictionaries too large to broadcast
    return encode.encode_label(t.part.select("p_partkey", "p_name"), "p_name", broadcast_rows=0)


@check("encode_ordinal", """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM events_dirty WHERE event_type IS NOT NULL))
SELECT event_id, CAST(code AS DOUBLE) AS event_type FROM events_dirty LEFT JOIN l ON event_type = v""")
def _(t):
    return encode.encode_ordinal(t.events_dirty.select("event_id", "event_type"), "event_type")


@check("encode_binary", "SELECT l_orderkey, l_partkey, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS l_linestatus FROM lineitem")
def _(t):
    return encode.encode(t.lineitem.select("l_orderkey", "l_partkey", "l_linestatus"), "binary")


@check("encode_frequency", """WITH f AS (SELECT event_type AS v, count(*) / sum(count(*)) OVER () AS share FROM events_dirty WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_id, round(share, 8) AS event_type FROM events_dirty LEFT JOIN f ON event_type = v""")
def _(t):
    return rounded(encode.encode_frequency(t.events_dirty.select("event_id", "event_type"), "event_type"), ["event_type"], 8)


@check("encode_target", """WITH f AS (SELECT p_brand AS v, avg(p_retailprice) AS m FROM part GROUP BY 1)
SELECT p_partkey, round(m, 6) AS p_brand FROM part JOIN f ON p_brand = v""")
def _(t):
    data = t.part.select("p_partkey", "p_brand", "p_retailprice")
    return rounded(encode.encode(data, "target", ["p_brand"], target="p_retailprice"), ["p_brand"], 6).drop("p_retailprice")


# ---------------------------------------------------------------- reduction

_PCA = """WITH m AS (SELECT avg(o_totalprice / 1000.0) AS mx, avg(CAST(o_custkey AS DOUBLE)) AS my, covar_pop(o_totalprice / 1000.0, o_totalprice / 1000.0) AS a,
  covar_pop(o_totalprice / 1000.0, CAST(o_custkey AS DOUBLE)) AS b, covar_pop(CAST(o_custkey AS DOUBLE), CAST(o_custkey AS DOUBLE)) AS c FROM orders),"""
_SVD = """WITH m AS (SELECT 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, sum((o_totalprice / 1000.0) * (o_totalprice / 1000.0)) AS a,
  sum(o_totalprice / 1000.0 * o_custkey) AS b, sum(CAST(o_custkey AS DOUBLE) * o_custkey) AS c FROM orders),"""
_TWO = """
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM m),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u2,
  b / sqrt(b * b + (l2 - a) * (l2 - a)) AS w1, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS w2 FROM e),
s AS (SELECT *, CASE WHEN (CASE WHEN abs(u1) >= abs(u2) THEN u1 ELSE u2 END) < 0 THEN -1 ELSE 1 END AS su,
  CASE WHEN (CASE WHEN abs(w1) >= abs(w2) THEN w1 ELSE w2 END) < 0 THEN -1 ELSE 1 END AS sw FROM u)
SELECT o_orderkey, round(((o_totalprice / 1000.0 - mx) * u1 + (o_custkey - my) * u2) * su, 4) AS {0}_1,
  round(((o_totalprice / 1000.0 - mx) * w1 + (o_custkey - my) * w2) * sw, 4) AS {0}_2 FROM orders, s"""


def _two(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), "o_custkey")


@check("reduce_pca", _PCA + _TWO.format("PCA"))
def _(t):
    return rounded(reduce.reduce_pca(_two(t), 2, ["price", "o_custkey"]), ["PCA_1", "PCA_2"])


@check("reduce_svd", _SVD + _TWO.format("SVD"))
def _(t):
    return rounded(reduce.reduce_svd(_two(t), 2, ["price", "o_custkey"]), ["SVD_1", "SVD_2"])


_LDA = """WITH c AS (SELECT cls, count(*) AS n, avg(o_totalprice) AS x, avg(CAST(o_custkey AS DOUBLE)) AS y FROM orders_class GROUP BY cls),
m AS (SELECT count(*) AS n, avg(o_totalprice) AS mx, avg(CAST(o_custkey AS DOUBLE)) AS my, covar_pop(o_totalprice, o_totalprice) * count(*) AS ta,
  covar_pop(o_totalprice, CAST(o_custkey AS DOUBLE)) * count(*) AS tb, covar_pop(CAST(o_custkey AS DOUBLE), CAST(o_custkey AS DOUBLE)) * count(*) AS tc FROM orders_class),
b AS (SELECT sum(c.n * (x - mx) * (x - mx)) AS ba, sum(c.n * (x - mx) * (y - my)) AS bb, sum(c.n * (y - my) * (y - my)) AS bc, count(*) AS k FROM c, m),
w0 AS (SELECT *, (ta - ba) / (n - k) AS a0, (tb - bb) / (n - k) AS wb, (tc - bc) / (n - k) AS c0 FROM m, b),
w AS (SELECT *, a0 + 1e-12 * (a0 + c0) AS wa, c0 + 1e-12 * (a0 + c0) AS wc FROM w0),
e AS (SELECT *, (wc * ba - wb * bb) / (wa * wc - wb * wb) AS p, (wc * bb - wb * bc) / (wa * wc - wb * wb) AS q,
  (wa * bb - wb * ba) / (wa * wc - wb * wb) AS r, (wa * bc - wb * bb) / (wa * wc - wb * wb) AS s FROM w),
l AS (SELECT *, (p + s) / 2 + sqrt((p - s) * (p - s) / 4 + q * r) AS l1, (p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * r) AS l2 FROM e),
v AS (SELECT *, sqrt(q * q * wa + 2 * q * (l1 - p) * wb + (l1 - p) * (l1 - p) * wc) * CASE WHEN (CASE WHEN abs(q) >= abs(l1 - p) THEN q ELSE l1 - p END) < 0 THEN -1 ELSE 1 END AS d1,
  sqrt(q * q * wa + 2 * q * (l2 - p) * wb + (l2 - p) * (l2 - p) * wc) * CASE WHEN (CASE WHEN abs(q) >= abs(l2 - p) THEN q ELSE l2 - p END) < 0 THEN -1 ELSE 1 END AS d2 FROM l)
SELECT o_orderkey, cls, round(((o_totalprice - mx) * q + (o_custkey - my) * (l1 - p)) / d1, 4) AS LDA_1,
  round(((o_totalprice - mx) * q + (o_custkey - my) * (l2 - p)) / d2, 4) AS LDA_2 FROM orders_class, v"""


@check("reduce_lda", _LDA)
def _(t):
    return rounded(reduce.reduce_lda(t.orders_class, "cls", 2, ["o_totalprice", "o_custkey"]), ["LDA_1", "LDA_2"])


# ---------------------------------------------------------------- selection

@check("select_variance", "SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer_dirty")
def _(t):
    return select.select_variance(t.customer_dirty)


def chi2_sql(table: str, target: str, feats: list[str]) -> str:
    return union(f"""SELECT '{f}' AS feature, round(sum((o - e) * (o - e) / e), 4) AS score FROM (
  SELECT sum(CAST({f} AS DOUBLE)) AS o, (SELECT sum(CAST({f} AS DOUBLE)) FROM {table}) * count(*) / (SELECT count(*) FROM {table}) AS e
  FROM {table} GROUP BY {target})""" for f in feats)


_CHI = chi2_sql("lineitem", "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@check("select_kbest_scores", _CHI)
def _(t):
    return rounded(select.chi2_scores(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), ["score"])


@check("select_kbest", "SELECT cls, o_totalprice FROM orders_class")
def _(t):
    return select.select_kbest(t.orders_class.drop("o_orderkey"), "cls", 1)


@check("select_importance")
def _(t):
    data = t.documents.join(t.labels, "doc_id").select("quality", "n_chars", F.length("lang").alias("lang_chars"), "source")
    return select.select_importance(data, "quality", trees=20)


# ---------------------------------------------------------------- balance

_HASH = "md5(CAST(o_orderkey AS VARCHAR) || '|42')"


@check("class_counts", "SELECT cls AS class, count(*) AS n FROM orders_class GROUP BY cls")
def _(t):
    return balance.class_counts(t.orders_class, "cls")


@check("balance_undersample", f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {_HASH}, o_orderkey) AS r FROM orders_class)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders_class GROUP BY cls))""")
def _(t):
    return balance.balance_undersample(t.orders_class, "cls", "o_orderkey")


@check("balance_null_target", f"""WITH d AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cls END AS cls FROM orders_class)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {_HASH}, o_orderkey) AS r FROM d WHERE cls IS NOT NULL)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM d WHERE cls IS NOT NULL GROUP BY cls))
UNION ALL SELECT * FROM d WHERE cls IS NULL""")
def _(t):
    cls = F.when(F.col("o_orderkey") % 11 != 0, F.col("cls"))
    return balance.balance_undersample(t.orders_class.select("o_orderkey", "o_totalprice", cls.alias("cls")), "cls", "o_orderkey")


@check("balance_oversample", f"""WITH s AS (SELECT cls, count(*) AS n FROM orders_class GROUP BY cls), x AS (SELECT max(n) AS top FROM s),
r AS (SELECT c.*, s.n, row_number() OVER (PARTITION BY cls ORDER BY {_HASH}, o_orderkey) - 1 AS rk FROM orders_class c JOIN s USING (cls)),
k AS (SELECT r.*, top // n + CASE WHEN rk < top % n THEN 1 ELSE 0 END AS copies FROM r, x)
SELECT o_orderkey, o_totalprice, o_custkey, cls FROM k, range(0, 100) g(i) WHERE i < copies""")
def _(t):
    return balance.balance_oversample(t.orders_class, "cls", "o_orderkey")


_SMOTE = f"""WITH s AS (SELECT cls, count(*) AS n FROM orders_class GROUP BY cls), x AS (SELECT max(n) AS top, least(5, min(n) - 1) AS k FROM s),
r AS (SELECT c.*, s.n, row_number() OVER (PARTITION BY cls ORDER BY {_HASH}, o_orderkey) - 1 AS rk FROM orders_class c JOIN s USING (cls), x WHERE n < top),
nb AS (SELECT base, other, rn FROM (SELECT a.o_orderkey AS base, b.o_orderkey AS other, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY
    (a.o_totalprice - b.o_totalprice) * (a.o_totalprice - b.o_totalprice) + CAST((a.o_custkey - b.o_custkey) * (a.o_custkey - b.o_custkey) AS DOUBLE), b.o_orderkey) AS rn
  FROM r a JOIN r b ON a.cls = b.cls AND a.o_orderkey <> b.o_orderkey), x WHERE rn <= k),
d AS (SELECT r.*, rk + g.j * n AS i FROM r, x, range(0, 100) g(j) WHERE rk + g.j * n < top - n),
p AS (SELECT d.*, nb.other, ((d.o_orderkey * 7919 + d.i * 104729 + 42) % 1000003) / 1000003.0::DOUBLE AS u FROM d, x, nb
  WHERE nb.base = d.o_orderkey AND nb.rn = (d.o_orderkey * 31 + d.i * 17 + 42) % k + 1)
SELECT cls, round(o_totalprice, 4) AS o_totalprice, round(CAST(o_custkey AS DOUBLE), 4) AS o_custkey, o_orderkey FROM orders_class
UNION ALL SELECT p.cls, round(p.o_totalprice + u * (o.o_totalprice - p.o_totalprice), 4), round(p.o_custkey + u * (o.o_custkey - p.o_custkey), 4), NULL
FROM p JOIN orders_class o ON p.other = o.o_orderkey"""


@check("balance_smote", _SMOTE)
def _(t):
    grown = balance.balance(t.orders_class, "cls", "smote", "o_orderkey")
    return rounded(grown, ["o_totalprice", "o_custkey"])


# ---------------------------------------------------------------- features

@check("polynomial_features", """SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_tax, round(l_quantity * l_quantity, 6) AS "l_quantity^2",
  round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_quantity * l_tax, 6) AS "l_quantity l_tax",
  round(l_discount * l_discount, 6) AS "l_discount^2", round(l_discount * l_tax, 6) AS "l_discount l_tax", round(l_tax * l_tax, 6) AS "l_tax^2" FROM lineitem""")
def _(t):
    data = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    out = engineer.polynomial_features(data, 2, ["l_quantity", "l_discount", "l_tax"])
    return out.select(*[F.round(f"`{c}`", 6).alias(c) if " " in c or "^" in c else F.col(c) for c in out.columns])


def bins_sql(table: str, c: str, n: int) -> str:
    edges = [q(table, c, i / n) for i in range(1, n + 1)]
    return "CASE " + " ".join(f"WHEN {c} <= {e} THEN {i}" for i, e in enumerate(edges)) + " END"


@check("quantile_bins", f"SELECT event_id, value, {bins_sql('events_dirty', 'value', 5)} AS value_binned FROM events_dirty")
def _(t):
    return engineer.quantile_bins(t.events_dirty.select("event_id", "value"), ["value"], 5)
