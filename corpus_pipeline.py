"""Cleaning a corpus: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the
last return the columns of ``documents``. ``run`` writes each result as Parquet below
spark.checkpoint.dir and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import decontaminate, langid, line_dedup, packing, simhash
from tableprep.llm.common import pick, stored, table
from tableprep.llm.queries import word_tokenizer

#: A text goes only if no language is likelier than this.
LEAST_SCORE = 0.35


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; the rest goes (no letters, or no language fits).

    Null and empty texts go, repeated rows share their fate, texts of any length are read whole; languages that tie
    are decided as in ``langid``. An empty table stays empty. Further columns pass through under their names.
    """
    model = langid.learn(docs)
    names = docs.columns
    found = langid.identify(docs, model).toDF(*[f"_{i}" for i in range(len(names))], "lang_pred", "score", "ambiguous")
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; documents of which no word is left go.

    Null and empty texts lose nothing and stay. Of equal lines the one with the smallest (doc_id, line number) stays;
    rows that share a doc_id, null included, lose the same lines. n_chars is counted anew where lines went.
    """
    names = docs.columns
    cut = line_dedup.dedup_lines(docs).toDF(*[f"_{i}" for i in range(len(names))], "n_lines", "n_dropped")
    text, chars = f"_{names.index('text')}", f"_{names.index('n_chars')}"
    kept = cut.filter((F.col("n_dropped") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(chars, F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col(chars)))
    return kept.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the first by id, then by row number. Rows with a null id stay."""
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    # stored, so the numbers stay as they are
    rows = stored(flat.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    place = F.struct(F.col(f"_{names.index('doc_id')}").alias("id"), "row")
    known = rows.filter(f"_{names.index('doc_id')} IS NOT NULL").select(place.alias("place"), F.col(f"_{names.index('text')}").alias("text"))
    gone = simhash.near_duplicates(known, key="place").filter("place <> component_id").select(F.col("place.row").alias("gone"))
    kept = rows.join(gone, F.col("row") == F.col("gone"), "left_anti")
    return kept.select(*flat.columns).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Rows with a null id, a null or an empty text stay; rows that share an id go together. Texts are searched whole.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated AND doc_id IS NOT NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; null and empty texts give the end mark alone, repeated rows are packed each."""
    return packing.pack(docs, word_tokenizer())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; rows with a null key stay. Columns are taken by place."""
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    gone = pick(gone, gone="doc_id").distinct()
    return flat.join(gone, F.col(f"_{names.index('doc_id')}") == F.col("gone"), "left_anti").toDF(*names)


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL has neither the trained classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
