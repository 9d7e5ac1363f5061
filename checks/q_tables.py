"""Sources, sinks, filters, windows, scalar expressions, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions import exprs
from tableprep.operators import filters, ordered
from tableprep.sources import history, inventory, io

from .registry import NAMES, check, union

# ---------------------------------------------------------------- sources and sinks

_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@check("read_csv", _ORDERS)
def _(t):
    path = io.write_csv(t.orders, t.workspace())
    return io.read_csv(t.spark, path).withColumn("o_orderdate", _stamp("o_orderdate"))


@check("write_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = io.write_csv(t.customer, t.workspace())
    return io.read_csv(t.spark, path, schema=t.customer.schema)


@check("read_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    path = t.workspace()
    events = t.events.drop("ts")
    events.write.json(path)
    return io.read_json(t.spark, path, schema=events.schema)


@check("read_parquet", "SELECT * FROM supplier")
def _(t):
    return io.read_parquet(t.spark, t.path("supplier"))


@check("read_with_rejects", """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'rejected' ELSE 'read' END AS status,
  count(*) AS n, round(sum(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END), 2) AS balance
FROM supplier GROUP BY 1""")
def _(t):
    broken = F.when(F.col("s_suppkey") % 7 == 0, "unreadable").otherwise(F.col("s_acctbal").cast("string"))
    path = io.write_csv(t.supplier.withColumn("s_acctbal", broken), t.workspace())
    good, bad = io.read_csv_with_rejects(t.spark, path, t.supplier.schema)
    read = good.agg(F.lit("read").alias("status"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return read.unionByName(bad.agg(F.lit("rejected").alias("status"), F.count("*").alias("n"), F.lit(0.0).alias("balance")))


@check("read_csv_latin1", "SELECT c_custkey, concat(c_mktsegment, chr(233), chr(252)) AS name FROM customer")
def _(t):
    named = t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit("\u00e9\u00fc")).alias("name"))
    path = t.workspace()
    # one part of the files in each encoding
    named.filter("c_custkey % 2 = 0").write.option("header", True).csv(f"{path}/a")
    named.filter("c_custkey % 2 = 1").write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/b")
    return io.read_csv(t.spark, f"{path}/*").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@check("read_csv_line_breaks", """
SELECT o_orderkey, o_custkey, concat(o_orderstatus, chr(10), o_orderpriority, ', "', o_orderstatus, '"') AS note, o_totalprice FROM orders""")
def _(t):
    note = F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("note")
    told = t.orders.select("o_orderkey", "o_custkey", note, "o_totalprice")
    path = t.workspace()
    # quoted headers in two orders, one with a column that nobody asks for
    writer = lambda df: df.write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer(told.filter("o_orderkey % 3 = 0").select("note", "o_totalprice", "o_orderkey", "o_custkey")).csv(f"{path}/a")
    writer(told.filter("o_orderkey % 3 > 0").withColumn("more", F.lit("x"))).csv(f"{path}/b")
    return io.read_csv_with_rejects(t.spark, f"{path}/*", told.schema)[0]


@check("check_files")
def _(t):
    path = t.workspace()
    io.write_many({"customer": t.customer, "orders": t.orders}, path, "csv")
    t.nation.select("n_name").write.text(f"{path}/nation")
    return io.check_files(t.spark, path).groupBy("extension", "status").agg(F.count("*").alias("files"))


@check("write_many", union(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "supplier", "orders")))
def _(t):
    made = {n: getattr(t, n) for n in ("customer", "supplier", "orders")}
    paths = io.write_many(made, t.workspace())
    parts = [t.spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, p in zip(made, paths)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# fixed values: number of columns of each table
_WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
          "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@check("dataset_inventory", union(
    f"SELECT '{n}' AS name, count(*) AS rows, {_WIDTH[n]} AS columns, CAST(0 AS BIGINT) AS missing_total FROM {n}" for n in NAMES))
def _(t):
    found = inventory.dataset_inventory(t.spark, {n: t.path(n) for n in NAMES})
    return found.select("name", "rows", "columns", "missing_total")


# types by their names in SQL; fixed values
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
          "FLOAT[]": "array<float>"}


@check("inventory_columns", union(f"""SELECT '{n}' AS name, d.column_name AS "column",
  CASE d.column_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} END AS type, r.rows - f.filled AS missing
FROM (SELECT * FROM (DESCRIBE {n})) d JOIN (UNPIVOT (SELECT count(COLUMNS(*)) FROM {n}) ON COLUMNS(*) INTO NAME name VALUE filled) f
ON f.name = d.column_name CROSS JOIN (SELECT count(*) AS rows FROM {n}) r""" for n in NAMES))
def _(t):
    found = inventory.dataset_inventory(t.spark, {n: t.path(n) for n in NAMES})
    return found.select("name", "types", F.explode("missing").alias("column", "missing")).select(
        "name", "column", F.element_at("types", F.col("column")).alias("type"), "missing")


@check("files_total", f"""SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows,
  CAST(sum(columns) AS BIGINT) AS columns FROM (
  {union(f"SELECT count(*) AS rows, {_WIDTH[n]} AS columns FROM {n}" for n in NAMES)})""")
def _(t):
    found = inventory.dataset_inventory(t.spark, {n: t.path(n) for n in NAMES})
    return inventory.files_total(found).drop("bytes")


@check("preview_head", "SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem "
       "ORDER BY l_extendedprice, l_orderkey, l_quantity LIMIT 15")
def _(t):
    return filters.preview_head(t.lineitem, ["l_extendedprice", "l_orderkey", "l_quantity"], 15).select(
        "l_orderkey", "l_extendedprice", "l_quantity")


# ---------------------------------------------------------------- filters

@check("filter_compare", "SELECT event_id, event_type, value FROM events_dirty WHERE value > 100")
def _(t):
    return filters.filter_compare(t.events_dirty, "value", ">", 100).select("event_id", "event_type", "value")


_OPS = {">": ">", "<": "<", ">=": ">=", "<=": "<=", "==": "=", "!=": "IS DISTINCT FROM"}


@check("filter_counts", union(
    f"""SELECT '{op}' AS op, (SELECT count(*) FROM events_dirty) AS original_rows, count(*) AS filtered_rows
FROM events_dirty WHERE user_id {sql} 42""" for op, sql in _OPS.items()))
def _(t):
    parts = [filters.filter_summary(t.events_dirty, "user_id", op, 42).withColumn("op", F.lit(op)) for op in _OPS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@check("filter_not_equal", "SELECT event_id, event_type FROM events_dirty WHERE event_type IS DISTINCT FROM 'click'")
def _(t):
    return filters.filter_compare(t.events_dirty, "event_type", "!=", "click").select("event_id", "event_type")


@check("drop_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def _(t):
    return filters.drop_columns(t.part, ["p_type", "p_size", "p_retailprice", "cabin"])


@check("drop_high_missing", "SELECT event_id, event_type FROM events")
def _(t):
    thin = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("value"))
    return filters.drop_high_missing(thin)


@check("high_cardinality_columns", """SELECT * FROM (
SELECT 'p_name' AS "column", count(DISTINCT p_name) AS "unique" FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE "unique" > 50""")
def _(t):
    return filters.high_cardinality_columns(t.part)


@check("dropna_rows", "SELECT * FROM customer_dirty WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL")
def _(t):
    return filters.dropna_rows(t.customer_dirty)


@check("top_category_filter", """SELECT p_partkey, p_brand FROM part WHERE p_brand IN (
  SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 20)""")
def _(t):
    return filters.top_category_filter(t.part, "p_brand").select("p_partkey", "p_brand")


@check("sample_rows", """SELECT event_id, user_id, value FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 2000""")
def _(t):
    return filters.sample_rows(t.events.select("event_id", "user_id", "value"), ["event_id"], 2000)


@check("text_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(coalesce(text, '')), 'data') "
       "OR contains(lower(coalesce(role, '')), 'data')")
def _(t):
    return t.conversations.filter(exprs.text_search("Data", F.col("text"), F.col("role"))).select("conv_id", "turn", "role")


@check("owner_filter", "SELECT event_id, event_type FROM events WHERE user_id = 7")
def _(t):
    return filters.filter_compare(t.events, "user_id", "==", 7).select("event_id", "event_type")


@check("sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC")
def _(t):
    return filters.sort_rows(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], descending=True)


# ---------------------------------------------------------------- windows and recent entries

@check("latest_n", """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3""")
def _(t):
    return history.latest_n(t.events, "user_id", "ts", "event_id", 3).select("user_id", "event_id", "event_type")


@check("recent_activity", """
SELECT 'order' AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, label FROM (SELECT o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS label FROM orders ORDER BY o_orderdate DESC, label LIMIT 5)
UNION ALL SELECT 'event', strftime(ts, '%Y-%m-%d %H:%M:%S'), label FROM (SELECT ts, CAST(event_id AS VARCHAR) AS label FROM events ORDER BY ts DESC, label LIMIT 5)
UNION ALL SELECT 'line', strftime(ts, '%Y-%m-%d %H:%M:%S'), label FROM (SELECT l_shipdate AS ts, CAST(l_orderkey AS VARCHAR) AS label FROM lineitem ORDER BY l_shipdate DESC, label LIMIT 5)""")
def _(t):
    found = history.recent_activity({"order": (t.orders, "o_orderdate", "o_orderkey"), "event": (t.events, "ts", "event_id"),
                                     "line": (t.lineitem, "l_shipdate", "l_orderkey")})
    return found.withColumn("ts", _stamp("ts"))


@check("activity_stats", """
SELECT owner, CAST(sum(a) AS BIGINT) AS events, CAST(sum(b) AS BIGINT) AS orders, CAST(sum(c) AS BIGINT) AS customers FROM (
  SELECT user_id AS owner, 1 AS a, 0 AS b, 0 AS c FROM events
  UNION ALL SELECT o_custkey, 0, 1, 0 FROM orders UNION ALL SELECT c_custkey, 0, 0, 1 FROM customer) GROUP BY owner""")
def _(t):
    return history.activity_stats({"events": (t.events, "user_id"), "orders": (t.orders, "o_custkey"),
                                   "customers": (t.customer, "c_custkey")})


@check("running_total", "SELECT event_id, round(coalesce(sum(value) OVER (ORDER BY event_id), 0), 2) AS running_total FROM events_dirty")
def _(t):
    return ordered.running_total(t.events_dirty.select("event_id", "value"), ["event_id"], "value").select(
        "event_id", F.round("running_total", 2).alias("running_total"))


# ---------------------------------------------------------------- scalar expressions

@check("relative_time", """
WITH g AS (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(ts)) AS BIGINT) AS s FROM events),
d AS (SELECT *, s // 86400 AS days, s % 86400 AS r FROM g)
SELECT event_id, CASE
  WHEN days = 0 AND r < 60 THEN 'Just now'
  WHEN days = 0 AND r < 3600 THEN (r // 60) || ' minute' || CASE WHEN r // 60 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN days = 0 THEN (r // 3600) || ' hour' || CASE WHEN r // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN days || ' days ago'
  ELSE strftime(ts, '%b %d, %Y') END AS shown FROM d""")
def _(t):
    return t.events.select("event_id", exprs.relative_time(F.col("ts"), F.lit("2024-01-31 00:00:00")).alias("shown"))


@check("human_bytes", """
WITH u AS (SELECT doc_id, n_chars * n_chars * 7 AS size FROM documents),
v AS (SELECT *, CASE WHEN size >= 1073741824 THEN 1073741824.0 WHEN size >= 1048576 THEN 1048576.0 WHEN size >= 1024 THEN 1024.0 ELSE 1.0 END AS d FROM u),
w AS (SELECT *, round(CAST(size AS DOUBLE) / CAST(d AS DOUBLE), 2) AS x FROM v)
SELECT doc_id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END ||
  CASE WHEN size >= 1073741824 THEN ' GB' WHEN size >= 1048576 THEN ' MB' WHEN size >= 1024 THEN ' KB' ELSE ' Bytes' END AS shown FROM w""")
def _(t):
    return t.documents.select("doc_id", exprs.human_bytes(F.col("n_chars") * F.col("n_chars") * 7).alias("shown"))


@check("truncate_text", "SELECT conv_id, turn, role, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS shown FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", "role", exprs.truncate_text(F.col("text"), 80).alias("shown"))


@check("safe_name", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N} _-]', '_', 'g') AS safe FROM pages")
def _(t):
    return t.pages.select("page_id", exprs.safe_name(F.col("url")).alias("safe"))


@check("file_stem", "SELECT page_id, split_part(url, '.', 1) AS stem FROM pages")
def _(t):
    return t.pages.select("page_id", exprs.file_stem(F.col("url")).alias("stem"))


@check("file_ext", r"SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext FROM pages")
def _(t):
    return t.pages.select("page_id", exprs.file_ext(F.col("url")).alias("ext"))


@check("split_list", """WITH i AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS items FROM documents)
SELECT doc_id, len(items) AS items, items[1] AS first_item FROM i""")
def _(t):
    items = exprs.split_list(F.col("text"))
    return t.documents.select("doc_id", F.size(items).cast("long").alias("items"), F.get(items, 0).alias("first_item"))


@check("to_json_row", """SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS row_json FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", exprs.to_json_row(F.col("s_suppkey"), F.col("s_name")).alias("row_json"))


@check("math_columns", """SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS root, round(ln(o_totalprice + 1), 6) AS log1p,
  round(abs(o_totalprice - 150000), 2) AS gap, greatest(least(o_totalprice, 200000.0::DOUBLE), 1000.0::DOUBLE) AS clipped FROM orders""")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.sqrt(p), 4).alias("root"), F.round(F.log1p(p), 6).alias("log1p"),
                           F.round(F.abs(p - 150000), 2).alias("gap"),
                           F.greatest(F.least(p, F.lit(200000.0)), F.lit(1000.0)).alias("clipped"))


# ---------------------------------------------------------------- history

_LOG = """SELECT 'order_' || o_orderstatus AS action, o_orderkey AS rows, o_orderdate AS ts FROM orders"""


def _log(t):
    return t.orders.select(F.concat(F.lit("order_"), "o_orderstatus").alias("action"), F.lit("{}").alias("params"),
                           F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("rows"),
                           F.lit(6).alias("columns"), F.lit(True).alias("success"), F.lit("").alias("message"))


@check("history_append", f"SELECT action, count(*) AS n, CAST(sum(rows) AS BIGINT) AS rows FROM ({_LOG}) GROUP BY action")
def _(t):
    path = t.workspace()
    for part in (0, 1):
        history.history_append(t.spark, path, _log(t).filter(F.col("rows") % 2 == part))
    return t.spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


@check("history_recent", f"SELECT action, rows, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ({_LOG}) ORDER BY ts DESC, action, rows LIMIT 10")
def _(t):
    return history.history_recent(_log(t)).select("action", "rows", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@check("history_export", """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS message, props AS response,
  coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END, '') AS context FROM events""")
def _(t):
    data = t.events.withColumn("file", F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")))
    path = io.write_csv(history.export_messages(data, "ts", "event_type", "props", "file"), t.workspace())
    read = io.read_csv(t.spark, path, schema="timestamp string, message string, response string, context string")
    return read.na.fill("", ["context"])
