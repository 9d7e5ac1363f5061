"""The registered queries over the given tables: thin, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_template as op3
from . import decontaminate as op4
from . import hard_negatives as op12
from . import langid as op2
from . import line_dedup as op8
from . import packing as op9
from . import prefix_trie as op13
from . import quality_model as op10
from . import quality_rules as op6
from . import secrets as op5
from . import simhash as op7
from . import token_counts as op1
from . import warc as op11
from .common import table


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return op1.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def remainder(n: int):
    """crc32 of the document's id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = op2.learn(docs.filter(remainder(5) != 0))
    return op2.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


CONTROL = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return op3.read_back(op3.format_conversations(told.unionByName(more)))


def word_tokenizer() -> str:
    """The vocabulary file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The contaminated documents and their items."""
    return op4.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).filter("contaminated")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = op5.secret_scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda m: m["kind"] != "random")
    number = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in ("assign", "access", "hex", "random")],
                        F.sha2(op5.span_digest(base), 256).alias("base_sha256"), op5.span_digest(F.col("found")).alias("spans"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return op6.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return op7.near_duplicates(table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op8.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return op9.pack(table(spark, folder, "documents"), word_tokenizer())


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = op10.learn(docs.filter(remainder(3) != 1), labels.filter(remainder(3) != 1))
    scored = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), op10.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = op11.write(table(spark, folder, "pages"))
    found = op11.captures(op11.read(spark, archives, payloads=False))
    page = F.filter(F.get("metadata", F.lit(0))["fields"], lambda f: f["name"] == "page-id")
    source = F.regexp_extract("top.refers_to", r"^<urn:page:(-?[0-9]+):", 1)
    return found.select(F.get(page, F.lit(0))["value"].cast("long").alias("page_id"), "top.payload_bytes", "top.payload_digest",
                        F.col("top.type").alias("record_type"), F.when(source != "", source).cast("long").alias("refers_to"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return op12.hard_negatives(vectors, F.col("id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return op13.prefix_trie(table(spark, folder, "conversations"), lead=F.crc32(F.col("conv").cast("string")) % 4,
                            base=F.col("conv") - F.col("conv") % 20)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language, op3_chat, op4_decontaminate, op5_secret_scan, op6_quality_rules, op7_simhash,
                                    op8_line_dedup, op9_packing, op10_quality, op11_warc, op12_hard_negatives, op13_prefix_trie)}

ORACLES: dict[str, str] = {
    "op3_chat": f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role || text, '([<\\[\\\\])', '\\1\\1', 'g')) + length('<s>[INST]  [/INST]</s>'))
    AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
    first_value(page_id) OVER same AS first_id, row_number() OVER same AS nth
  FROM p WINDOW same AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT)
    >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], lambda a, b: a || b) AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM d""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_aggregate([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding], 'sum') = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5""",
    "op13_prefix_trie": """
WITH own AS (
  SELECT conv_id, list(coalesce(role, '') || chr(10) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, ch: list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS lead
  FROM own),
r AS (
  SELECT a.conv_id AS c, list_concat(coalesce(b.turns[1:a.lead], []), a.turns[a.lead + 1:]) AS turns
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS whole FROM r, unnest(range(len(turns) + 1)) AS u(d)),
n AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole), '')) AS ends_sha256
  FROM m GROUP BY path, d),
k AS (
  SELECT *, (SELECT count(*) FROM n b WHERE b.depth = n.depth + 1 AND b.path[1:n.depth] = n.path) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(substr(path[depth], strpos(path[depth], chr(10)) + 1), '[^ \t-\r]+')) END AS saved
  FROM n)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children,
  (SELECT CAST(count(*) FILTER (s.n_children = 0) AS BIGINT) FROM k s WHERE s.path[1:t.depth] = t.path) AS n_leaves,
  (SELECT CAST(sum(s.saved) AS BIGINT) FROM k s WHERE s.path[1:t.depth] = t.path) AS saved_tokens, t.ends_sha256
FROM k t LEFT JOIN n p ON p.depth = t.depth - 1 AND p.path = t.path[1:t.depth - 1]""",
}
