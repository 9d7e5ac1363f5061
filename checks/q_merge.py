"""Merges, fuzzy matching and concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.operators import fuzzy, merge

from .registry import check, union

# ---------------------------------------------------------------- exact merges

_JOIN = """SELECT c.c_custkey, c.c_acctbal, c.c_nationkey, n.n_nationkey, n.n_name
FROM customer_dirty c {how} JOIN nation_partial n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey"""


def _exact(how: str, sql_how: str) -> None:
    @check(f"merge_{how}", _JOIN.format(how=sql_how))
    def _(t):
        left = t.customer_dirty.select("c_custkey", "c_acctbal", "c_nationkey")
        return merge.merge(left, t.nation_partial, "c_nationkey", "n_nationkey", how)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _exact(_how, _sql)


@check("merge_multi_key", """SELECT a.l_partkey, a.l_suppkey, a.qty, b.price FROM
  (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) a JOIN
  (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b
  ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def _(t):
    a = t.lineitem.filter("l_returnflag = 'A'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    return merge.merge(a, b, "l_partkey, l_suppkey", ["l_partkey", "l_suppkey"])


@check("merge_suffixes", """SELECT a.o_custkey, a.n AS n_left, a.total AS total_left, b.n AS n_right, b.total AS total_right FROM
  (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a JOIN
  (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)""")
def _(t):
    side = lambda s: (t.orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey")
                      .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    return merge.merge(side("O"), side("F"), "o_custkey", "o_custkey", suffixes=("_left", "_right"))


@check("merge_indicator", """SELECT c.c_custkey, c.c_nationkey, n.n_nationkey, n.n_name,
  CASE WHEN c.l AND n.r THEN 'both' WHEN c.l THEN 'left_only' ELSE 'right_only' END AS _merge
FROM (SELECT c_custkey, c_nationkey, TRUE AS l FROM customer_dirty) c FULL JOIN (SELECT *, TRUE AS r FROM nation_partial) n
  ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def _(t):
    left = t.customer_dirty.select("c_custkey", "c_nationkey")
    return merge.merge(left, t.nation_partial, "c_nationkey", "n_nationkey", "outer", indicator=True)


@check("merge_validate", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return merge.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@check("merge_auto_common", """SELECT a.doc_id, a.lang, b.quality FROM
  (SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)) a
  JOIN labels b ON a.doc_id = b.doc_id AND a.toxic = b.toxic""")
def _(t):
    left = merge.merge(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "toxic"))
    return merge.merge(left, t.labels).drop("toxic")


@check("merge_auto_first", """SELECT a.s_nationkey, a.n AS n, b.n AS n_right FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) a
JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b USING (s_nationkey)""")
def _(t):
    a = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    b = t.supplier.filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return merge.merge(a, b, auto="first")


@check("merge_auto_id", """SELECT d.lang, d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def _(t):
    return merge.merge(t.documents.select("lang", "doc_id"), t.labels, auto="id")


_POS = """SELECT a.event_id, a.value, b.p_partkey, b.p_name
FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS p FROM events) a
{how} JOIN (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) b USING (p)"""


def _by_position(t, how):
    parts = t.part.select("p_partkey", "p_name", (-F.col("p_retailprice")).alias("low"))
    out = merge.merge(t.events.select("event_id", "value"), parts, how=how, order_by=(["event_id"], ["low", "p_partkey"]))
    return out.drop("low")


@check("merge_positional", _POS.format(how="INNER"))
def _(t):
    return _by_position(t, "inner")


@check("merge_positional_left", _POS.format(how="LEFT"))
def _(t):
    return _by_position(t, "left")


@check("cross_file_zip", """SELECT a.o_totalprice AS left__o_totalprice, b.value AS right__value
FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) a
JOIN (SELECT value, row_number() OVER (ORDER BY event_id) AS p FROM events) b USING (p)""")
def _(t):
    return merge.cross_file_zip(t.orders, t.events, "o_totalprice", "value", ["o_orderkey"], ["event_id"])


# ---------------------------------------------------------------- fuzzy

_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_SCORE = "CAST(round(100 * (1 - levenshtein(lk, rk)::DOUBLE / greatest(length(lk), length(rk)))) AS INTEGER)"
_BEST = f"""l AS (SELECT DISTINCT noisy_name AS lv, {_KEY.format('noisy_name')} AS lk FROM part_names),
r AS (SELECT DISTINCT p_name AS rv, {_KEY.format('p_name')} AS rk FROM part),
b AS (SELECT lv, rv, score FROM (SELECT lv, rv, {_SCORE} AS score, row_number() OVER (PARTITION BY lv ORDER BY {_SCORE} DESC, rv) AS rn FROM l, r)
  WHERE rn = 1 AND score >= 80)"""


@check("fuzzy_best_match", f"""WITH {_BEST}, f AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT n.p_partkey, n.noisy_name, x.p_partkey AS p_partkey_right, x.p_name, x.p_brand, b.score
FROM part_names n JOIN b ON n.noisy_name = b.lv JOIN f ON f.p_name = b.rv JOIN part x ON x.p_partkey = f.k""")
def _(t):
    return fuzzy.fuzzy_best_match(t.part_names, t.part.select("p_partkey", "p_name", "p_brand"), "noisy_name", "p_name", "p_partkey")


_TYPED = "SELECT p_name, count(*) AS n, max(p_size) AS size FROM part GROUP BY 1"


@check("fuzzy_key_map", f"""WITH {_BEST}, y AS ({_TYPED})
SELECT n.p_partkey, n.noisy_name, y.p_name, y.n, y.size FROM part_names n LEFT JOIN b ON n.noisy_name = b.lv
FULL JOIN y ON coalesce(b.rv, n.noisy_name) = y.p_name""")
def _(t):
    right = t.part.groupBy("p_name").agg(F.count("*").alias("n"), F.max("p_size").alias("size"))
    return fuzzy.fuzzy_key_map(t.part_names, right, "noisy_name", "p_name", "outer")


_TSORT = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@check("fuzzy_token_sort", f"""WITH l AS (SELECT DISTINCT p_brand || ' ' || p_name AS lv FROM part),
r AS (SELECT DISTINCT p_name || ' ' || p_brand AS rv FROM part),
k AS (SELECT lv, {_TSORT.format(_KEY.format('lv'))} AS lk FROM l), m AS (SELECT rv, {_TSORT.format(_KEY.format('rv'))} AS rk FROM r)
SELECT lv AS left_value, rv AS right_value, {_SCORE} AS score FROM k, m WHERE abs(length(lk) - length(rk)) <= 2 AND {_SCORE} >= 95""")
def _(t):
    left = t.part.select(F.concat_ws(" ", "p_brand", "p_name").alias("a"))
    right = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("b"))
    return fuzzy.fuzzy_pairs(left, right, "a", "b", 95, "token_sort").drop("n")


_SIM = "1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1}), 1)"


@check("fuzzy_record_link", f"""WITH s AS (SELECT s_suppkey, s_name, n_name, {_KEY.format('s_name')} AS k1, {_KEY.format('n_name')} AS k2
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey, replace(c_name, 'Customer', 'Supplier') AS c_name, n_name, {_KEY.format("replace(c_name, 'Customer', 'Supplier')")} AS k1, {_KEY.format('n_name')} AS k2
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT s.s_suppkey, c.c_custkey, c.c_name, c.n_name AS n_name_right, 2 AS matched FROM s, c
WHERE {_SIM.format('s.k1', 'c.k1')} >= 0.85 AND {_SIM.format('s.k2', 'c.k2')} >= 0.85""")
def _(t):
    left = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    right = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("c_name"), "n_name")
    out = fuzzy.fuzzy_record_link(left, right, ["s_name", "n_name"], ["c_name", "n_name"])
    return out.select("s_suppkey", "c_custkey", "c_name", "n_name_right", "matched")


# part names written in another alphabet, letter by letter; fixed values
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщьыз"
_CYR = f"translate(lower({{0}}), '{_LATIN}', '{_CYRILLIC}')"


# one letter for one letter: distances are those of the Latin keys, which the SQL compares byte by byte
@check("fuzzy_unicode", f"""WITH l AS (SELECT DISTINCT {_CYR.format('noisy_name')} AS lv, {_KEY.format('noisy_name')} AS lk FROM part_names),
r AS (SELECT DISTINCT {_CYR.format('p_name')} AS rv, {_KEY.format('p_name')} AS rk FROM part)
SELECT lv AS left_value, rv AS right_value, {_SCORE} AS score FROM l, r WHERE {_SCORE} >= 85""")
def _(t):
    cyrillic = lambda c: F.translate(F.lower(c), _LATIN, _CYRILLIC)
    left, right = t.part_names.select(cyrillic("noisy_name").alias("a")), t.part.select(cyrillic("p_name").alias("b"))
    return fuzzy.fuzzy_pairs(left, right, "a", "b", 85).drop("n")


# ---------------------------------------------------------------- concatenation

@check("concat_rows", """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer_dirty
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def _(t):
    return merge.concat_rows([
        t.customer_dirty.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))])


def _sides(t):
    return [t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment"),
            t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), "s_name")]


@check("concat_rows_inner", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return merge.concat_rows(_sides(t), join="inner")


@check("concat_keys", """SELECT c_custkey AS key, c_acctbal AS balance, 'customers' AS source FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'suppliers' FROM supplier""")
def _(t):
    return merge.concat([f.select("key", "balance") for f in _sides(t)], keys=["customers", "suppliers"])


@check("concat_columns", """SELECT a.event_id AS "0", a.value AS "1", b.p_partkey AS "2", b.p_name AS "3"
FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS p FROM events) a
FULL JOIN (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS p FROM part) b USING (p)""")
def _(t):
    return merge.concat([t.events.select("event_id", "value"), t.part.select("p_partkey", "p_name")], axis=1,
                        order_by=[["event_id"], ["p_partkey"]], ignore_index=True)


@check("concat_columns_many", """SELECT a.event_id, a.value, b.p_partkey, b.p_name, c.c_custkey, c.event_id AS event_id_2
FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS p FROM events) a
FULL JOIN (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS p FROM part) b USING (p)
FULL JOIN (SELECT c_custkey, c_custkey * 2 AS event_id, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) c USING (p)""")
def _(t):
    third = t.customer.select("c_custkey", (F.col("c_custkey") * 2).alias("event_id"))
    return merge.concat([t.events.select("event_id", "value"), t.part.select("p_partkey", "p_name"), third], axis=1,
                        order_by=[["event_id"], ["p_partkey"], ["c_custkey"]])
