"""Registration of queries, access to tables, and the derived tables they use."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableprep.session import checkpoint_dir, tune
from tableprep.sources.io import read_parquet

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()

# Derived tables with nulls, repeats and noise; one text serves both engines.
FIXTURES = {
    "events_dirty": """
SELECT event_id, ts,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 10 = 3 THEN NULL
       WHEN event_id % 97 = 0 THEN value * 100 ELSE value END AS value
FROM {events}""",
    "events_dup": "SELECT * FROM {events_dirty} UNION ALL SELECT * FROM {events_dirty} WHERE event_id % 50 = 0",
    "customer_dirty": """
SELECT c_custkey,
  CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 11 = 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 7 = 5 THEN NULL ELSE c_nationkey END AS c_nationkey,
  1 AS const_col
FROM {customer}""",
    "nation_partial": """
SELECT CASE WHEN n_nationkey = 24 THEN NULL ELSE n_nationkey END AS n_nationkey, n_name
FROM {nation} WHERE n_nationkey % 5 <> 1
UNION ALL SELECT 99 AS n_nationkey, 'NOWHERE' AS n_name""",
    "part_names": """
SELECT p_partkey,
  CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '  ')
       WHEN p_partkey % 5 = 0 THEN concat(p_name, 's')
       WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS noisy_name
FROM {part}""",
    "orders_class": """
SELECT o_orderkey, o_totalprice, o_custkey,
  CASE WHEN o_orderkey % 20 = 0 THEN 'rare'
       WHEN o_orderkey % 4 = 0 THEN 'some' ELSE 'many' END AS cls
FROM {orders}""",
    "lineitem_gaps": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
  CASE WHEN (l_orderkey + l_partkey) % 211 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN (l_orderkey + l_suppkey) % 307 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax
FROM {lineitem}""",
    "orders_dirty": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 19 = 3 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 29 = 7 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  o_orderstatus
FROM {orders}""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale factor, and the derived ones, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            text = FIXTURES[name]
            return self.spark.sql(text, **{k: getattr(self, k) for k in set(re.findall(r"\{(\w+)\}", text))})
        if name in NAMES:
            return read_parquet(self.spark, self.path(name))
        raise AttributeError(name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def workspace(self) -> str:
        """A fresh folder that all executors share."""
        return f"{checkpoint_dir(self.spark)}/tableprep-{uuid.uuid4().hex}"


def with_fixtures(sql: str) -> str:
    """Put the derived tables a statement names in front of it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in FIXTURES.items():
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(body)
                used.append(name)

    need(sql)
    if not used:
        return sql.strip()
    heads = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', FIXTURES[n])})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def check(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests only."""
    def add(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return run
    return add


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)
