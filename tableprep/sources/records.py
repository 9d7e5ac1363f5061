"""Records of CSV files that are read in parallel, also where a quoted value holds line breaks.

A line changes whether the reader is inside quotes: it keeps the state, swaps it, or ends
in a state of its own. Such changes can be put together for a split without knowing how
the split begins; one row per split then tells every split its state, in the order of the
file, and each line is known as the start or the rest of a record. Only records of several
lines are grouped, and only files in which a line leaves quotes open are sorted at all.

The encoding is chosen for each file in the same scan: UTF-8 if all its lines are
valid, else ISO-8859-1, in which all bytes have a meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

LATIN = "ISO-8859-1"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), slot (rising in the split) and value of all lines; carriage returns stay."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("slot"), "value")


def quotes_after(line: Column, inside: bool, sep: str = ",") -> Column:
    """1 if quotes are open after ``line`` that begins inside or outside of them.

    A quote opens only at the start of a field; two in a row inside quotes are one letter.
    """
    pieces = F.split(line, '"', -1)
    quotes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1),
                         lambda before, i: F.when((before == "") & (i > 0), 2)
                         .when(before.endswith(sep) | (i == 0) & (before == ""), 1).otherwise(0))
    # 0 outside, 1 inside, 2 just closed; a quote after nothing (2) doubles the one before it
    step = F.aggregate(quotes, F.lit(int(inside)),
                       lambda s, q: F.when(s == 1, 2).when((s == 2) & (q == 2), 1).when(q == 1, 1).otherwise(0))
    return F.when(F.instr(line, '"') == 0, int(inside)).otherwise((step == 1).cast("int"))


def _xor(a: Column, b: Column) -> Column:
    return F.pmod(a + b, F.lit(2)).cast("int")


def file_facts(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, latin (not UTF-8), tangled (a line leaves quotes open), first (block, slot, value of the first line with text)."""
    text = F.regexp_replace("value", "\r$", "")
    return lines.groupBy("file").agg(
        F.max(~F.is_valid_utf8("value")).alias("latin"),
        F.max(quotes_after(F.col("value"), False, sep) == 1).alias("tangled"),
        F.min(F.when(F.length(text) > 0, F.struct("block", "slot", text.cast("binary").alias("bytes")))).alias("first"))


def _decoded(value: Column, latin: Column) -> Column:
    return F.when(latin, F.decode(value.cast("binary"), LATIN)).otherwise(value.cast("string"))


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """All records (file, head, first, record) and the first record (file, record) of every file.

    ``head`` is the place of a record's first line. Records without a letter are left out. A quote that no
    later line of the file closes makes no long record: its line and those after it stand on their own.
    """
    lines = raw_lines(spark, path)
    facts = broadcast_if_small(file_facts(lines, sep))
    known = lines.join(facts.select("file", "latin", "tangled", F.struct("first.block", "first.slot").alias("first")), "file")
    known = known.withColumn("value", _decoded(F.col("value"), F.col("latin"))).withColumn("head", F.struct("block", "slot"))
    wanted = ["file", "head", (F.col("head") == F.col("first")).alias("first"),
              F.regexp_replace("value", "\r$", "").alias("record")]
    single = known.filter(~F.col("tangled")).select(*wanted)
    heads = facts.filter(~F.col("tangled") & F.col("first").isNotNull()).select(
        "file", _decoded(F.col("first.bytes"), F.col("latin")).alias("record"))
    if not facts.filter("tangled").isEmpty():
        joined = cut_lineage(_joined_lines(known.filter("tangled"), sep).select(*wanted))
        single = single.unionByName(joined)
        heads = heads.unionByName(joined.filter("first").select("file", "record"))
    return single.filter(F.length("record") > 0), heads


def _joined_lines(lines: DataFrame, sep: str) -> DataFrame:
    """Lines of tangled files, those of one record put together."""
    here = W.partitionBy("file", "block").orderBy("slot")
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    outside, inside = quotes_after(F.col("value"), False, sep), quotes_after(F.col("value"), True, sep)
    # swaps up to a line, and what the last line with a state of its own makes of them
    told = (lines.withColumn("_o", outside).withColumn("_i", inside)
            .withColumn("_swaps", F.pmod(F.sum(F.when((F.col("_o") == 1) & (F.col("_i") == 0), 1).otherwise(0)).over(so_far), F.lit(2)).cast("int"))
            .withColumn("_own", F.last(F.when(F.col("_o") == F.col("_i"), _xor(F.col("_o"), F.col("_swaps"))), ignorenulls=True).over(so_far))
            .drop("_o", "_i"))
    told = cut_lineage(told)
    # one row per split from here to the next join
    blocks = W.partitionBy("file").orderBy("block")
    ends = told.groupBy("file", "block").agg(F.max_by("_swaps", "slot").alias("s"), F.max_by("_own", "slot").alias("c"))
    ends = ends.withColumn("_s", F.pmod(F.sum(F.when(F.col("c").isNull(), F.col("s")).otherwise(0)).over(
        blocks.rowsBetween(W.unboundedPreceding, 0)), F.lit(2)).cast("int"))
    own = F.last(F.when(F.col("c").isNotNull(), _xor(_xor(F.col("c"), F.col("s")), F.col("_s"))), ignorenulls=True)
    ends = ends.withColumn("after", _xor(F.coalesce(own.over(blocks.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)), F.col("_s")))
    starts = ends.select("file", "block", F.lag("after", 1, 0).over(blocks).alias("_start"))
    told = told.join(broadcast_if_small(starts), ["file", "block"]) \
        .withColumn("_after", _xor(F.coalesce("_own", "_start"), F.col("_swaps"))) \
        .withColumn("_before", F.coalesce(F.lag("_after").over(here), "_start"))
    heads = told.groupBy("file", "block").agg(F.max(F.when(F.col("_before") == 0, F.col("head"))).alias("h"),
                                             F.max_by("_after", "slot").alias("e"))
    whole = W.partitionBy("file")
    heads = heads.select("file", "block", F.last("h", ignorenulls=True).over(blocks.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
                         F.when(F.max_by("e", "block").over(whole) == 1, F.max("h").over(whole)).alias("_never"))
    own_head = F.last(F.when(F.col("_before") == 0, F.col("head")), ignorenulls=True).over(so_far)
    placed = told.join(broadcast_if_small(heads), ["file", "block"]).withColumn("_to", F.coalesce(own_head, F.col("_carry")))
    alone = ((F.col("_before") == 0) & (F.col("_after") == 0)) | F.coalesce(F.col("_to") == F.col("_never"), F.lit(False))
    placed = placed.withColumn("_alone", alone)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "slot", "value"))), lambda x: x["value"])
    grouped = placed.filter("NOT _alone").groupBy("file", F.col("_to").alias("head"), "first").agg(F.array_join(parts, "\n").alias("value"))
    return placed.filter("_alone").select("file", "head", "first", "value").unionByName(grouped)


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """file and latin of every file with a line, from one scan of its bytes."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value") \
        .groupBy("file").agg(F.max(~F.is_valid_utf8("value")).alias("latin"))
