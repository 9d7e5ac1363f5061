"""Preparation runs, presets, routing, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tableprep.plans import prepare, report, routing

from .q_prepare import bins_sql, knn_parts, mode_of, onehot_sql, q, stat
from .q_profile import DIRTY, rounded, score_sql
from .registry import check, union

TYPES = ["click", "error", "purchase", "signup", "view"]


def _capped(table: str, c: str) -> str:
    a, b = q(table, c, 0.25), q(table, c, 0.75)
    return f"greatest(least({c}, {b} + 1.5 * ({b} - {a})), {a} - 1.5 * ({b} - {a}))"


def _run_sql(fill: str, columns: str, outlier: bool = True, tail: str = "") -> str:
    """events_dirty filled, capped and standardised; ``columns`` come from the last stage."""
    value = lambda c: (f"coalesce(CAST({c} AS DOUBLE), " + (stat("events_dirty", "avg", c) if fill == "mean" else q("events_dirty", c, 0.5)) + ")")
    cap = (lambda c: _capped("f", c)) if outlier else (lambda c: c)
    return f"""WITH f AS (SELECT event_id, {value('user_id')} AS user_id, {value('value')} AS value,
  coalesce(event_type, {mode_of('events_dirty', 'event_type')}) AS event_type FROM events_dirty),
o AS (SELECT event_id, {cap('user_id')} AS user_id, {cap('value')} AS value, event_type FROM f){tail}
SELECT {columns}"""


def _std(c: str, table: str = "o") -> str:
    return f"round(({c} - {stat(table, 'avg', c)}) / {stat(table, 'stddev_pop', c)}, 6) AS \"{c}\""


def _onehots(values: list[str]) -> str:
    return onehot_sql("o", "event_type", values)


_DATA = lambda t: t.events_dirty.drop("ts")
_KEEP = ("event_id",)


@check("prepare_app_order", _run_sql("mean", f"event_id, {_std('user_id')}, {_std('value')}, {_onehots(TYPES[1:])}, {bins_sql('o', 'value', 5)} AS value_binned FROM o"))
def _(t):
    spec = prepare.PrepSpec(missing="mean", outlier="iqr", scaling="standard", encode="onehot", bin_columns=("value",), keep=_KEEP)
    return rounded(prepare.prepare(_DATA(t), spec)[0], ["user_id", "value"], 6)


def _std_code() -> str:
    return ("round((code - (SELECT avg(code) FROM c)) / (SELECT stddev_pop(code) FROM c), 6) AS event_type")


@check("prepare_api_order", _run_sql("median", f"event_id, {_std('user_id')}, {_std('value')}, {_std_code()} FROM c", tail=""",
l AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT event_type AS v FROM o)),
c AS (SELECT o.*, code FROM o JOIN l ON event_type = v)"""))
def _(t):
    spec = prepare.api_spec(missing="median", outlier="iqr", encode="label", scaling="standard", keep=_KEEP)
    return rounded(prepare.prepare(_DATA(t), spec)[0], ["user_id", "value", "event_type"], 6)


@check("preset_smart_clean", _run_sql("median", f"event_id, {_std('user_id')}, {_std('value')}, {_onehots(TYPES[1:])} FROM o"))
def _(t):
    spec = replace(prepare.PRESETS["smart_clean"], keep=_KEEP)
    return rounded(prepare.prepare(_DATA(t), spec)[0], ["user_id", "value"], 6)


def _std_flag(v: str) -> str:
    x = f"CASE WHEN event_type = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END"
    return f"round(({x} - (SELECT avg({x}) FROM o)) / (SELECT stddev_pop({x}) FROM o), 6) AS \"event_type_{v}\""


@check("preset_api", _run_sql("median", f"event_id, {_std('user_id')}, {_std('value')}, {', '.join(_std_flag(v) for v in TYPES)} FROM o"))
def _(t):
    spec = replace(prepare.PRESETS["api"], keep=_KEEP)
    out = prepare.prepare(_DATA(t), spec)[0]
    return rounded(out, [c for c in out.columns if c != "event_id"], 6)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _full_sql() -> str:
    nums = ["o_totalprice", "o_custkey"]
    parts, cols, joins = knn_parts("orders_dirty", "o_orderkey", nums, nums)
    flag = lambda c, v: f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\""
    ranged = lambda c: f"round(({c} - {stat('o', 'min', c)}) / ({stat('o', 'max', c)} - {stat('o', 'min', c)}), 6) AS {c}"
    return f"""WITH {parts}, f AS (SELECT s.o_orderkey, {', '.join(f'{v} AS {c}' for c, v in cols.items())},
  coalesce(o_orderpriority, {mode_of('orders_dirty', 'o_orderpriority')}) AS o_orderpriority, o_orderstatus FROM orders_dirty s {joins}),
o AS (SELECT o_orderkey, {', '.join(f'{_capped("f", c)} AS {c}' for c in nums)}, o_orderpriority, o_orderstatus FROM f)
SELECT o_orderkey, {', '.join(ranged(c) for c in nums)}, {', '.join(flag('o_orderpriority', v) for v in PRIORITIES[1:])},
  {', '.join(flag('o_orderstatus', v) for v in STATUSES[1:])} FROM o"""


@check("preset_full", _full_sql())
def _(t):
    spec = replace(prepare.PRESETS["full"], keep=("o_orderkey",))
    return rounded(prepare.prepare(t.orders_dirty, spec)[0], ["o_totalprice", "o_custkey"], 6)


@check("prepare_compare", """SELECT 'before' AS stage, count(*) AS rows, 4 AS columns, count(*) * 3 - count(user_id) - count(value) - count(event_type) AS missing FROM events_dirty
UNION ALL SELECT 'after', count(*), 7, 0 FROM events_dirty""")
def _(t):
    before = _DATA(t)
    spec = replace(prepare.PRESETS["smart_clean"], keep=_KEEP)
    return prepare.compare(before, prepare.prepare(before, spec)[0])


# ---------------------------------------------------------------- requests

def _any(words: list[str], text: str = "lower(text)") -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


_FLAGS = ", ".join(f"CAST({_any(w)} AS INTEGER) AS is_{n}" for n, w in routing.INTENTS.items())


@check("route_requests", f"""SELECT conv_id, turn, role, {_FLAGS},
  CAST({_any(routing.INTENTS['plot'])} AND {_any(routing.ALL_CHARTS)} AS INTEGER) AS is_plot_all FROM conversations""")
def _(t):
    return routing.route_requests(t.conversations, "text").drop("text")


def _setting(name: str) -> str:
    rules, default = routing.SETTINGS[name]
    return "CASE " + " ".join(f"WHEN {_any(words)} THEN '{value}'" for value, words in rules) + f" ELSE '{default}' END AS {name}"


@check("route_prep_config", f"""SELECT conv_id, turn, role, {', '.join(_setting(n) for n in routing.SETTINGS)},
  CASE WHEN m AND contains(lower(text), 'label') AND contains(lower(text), 'encod') THEN 'label'
       WHEN m AND contains(lower(text), 'ordinal') THEN 'ordinal' ELSE 'onehot' END AS encode
FROM (SELECT *, {_any(['encode', 'encoding', 'categorical', 'one-hot', 'onehot'])} AS m FROM conversations)""")
def _(t):
    return routing.route_prep_config(t.conversations, "text").drop("text")


@check("intent_counts", union(f"SELECT '{n}' AS intent, count(*) FILTER ({_any(w)}) AS n FROM conversations" for n, w in routing.INTENTS.items()))
def _(t):
    return routing.intent_counts(t.conversations, "text")


# ---------------------------------------------------------------- reports

_CUSTOMER = ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", "const_col"]


def _report_sql(name: str, cols: list[str], types: int, note: str) -> str:
    return f"""SELECT '{name}' AS name, rows, columns, {types} AS types, round(score, 1) AS score, missing, duplicates, {note} AS missing_columns
FROM ({score_sql(name, cols, (30, 20, 25, 25), 8)})"""


def _note(table: str, cols: list[str]) -> str:
    # the first five columns with nulls, in table order
    parts = [f"""SELECT {i} AS p, '{c}' AS c, count(*) - count({c}) AS m FROM {table}""" for i, c in enumerate(cols)]
    return f"""(SELECT coalesce(string_agg(c || '=' || m, ', ' ORDER BY p), '') FROM (SELECT * FROM ({union(parts)}) WHERE m > 0 ORDER BY p LIMIT 5))"""


_REPORT = union([_report_sql("events_dup", DIRTY, 4, _note("events_dup", DIRTY)),
                 _report_sql("customer_dirty", _CUSTOMER, 4, _note("customer_dirty", _CUSTOMER)),
                 _report_sql("region", ["r_regionkey", "r_name"], 2, _note("region", ["r_regionkey", "r_name"]))])


def _report(t, sizes=None):
    return report.report_table({"events_dup": t.events_dup, "customer_dirty": t.customer_dirty, "region": t.region}, sizes)


@check("report_table", _REPORT)
def _(t):
    return _report(t).drop("bytes")


@check("report_lines", f"""SELECT '' AS key, '# 3 dataset(s), 2024-05-01' AS text UNION ALL
SELECT name AS key, '## ' || name || ', score ' || printf('%.1f', score) || chr(10) ||
  format('{{:,}}', rows) || ' rows in ' || columns || ' columns of ' || types || ' type(s)' || CASE WHEN name = 'region' THEN ', 2 KB' ELSE '' END || chr(10) ||
  format('{{:,}}', duplicates) || ' repeated rows, ' || format('{{:,}}', missing) || ' empty cells' ||
  CASE WHEN missing_columns <> '' THEN ' (' || missing_columns || ')' ELSE '' END AS text FROM ({_REPORT})""")
def _(t):
    return report.report_lines(_report(t, {"region": 2048}), made="2024-05-01").drop("part")
