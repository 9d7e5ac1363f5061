"""What the operators on text corpora share: columns by place, stored steps, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.session import checkpoint_dir

#: Bytes of the batches that Python workers get; a single longer text is a batch of its own.
BATCH = "4m"
#: Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a sieve, of 64 bits each.
SIEVE = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under new names, whatever else ``df`` has.

    ``pick(df, key="doc_id")`` selects column ``doc_id`` as ``key``. Columns are
    taken by place, so dots, clashing names and names that differ only in case do
    no harm; the first column of a name counts.
    """
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(name)}").alias(new) for new, name in wanted.items()])


def small_batches(df: DataFrame) -> None:
    """Texts go to Python in batches of about ``BATCH``, so a worker's memory does not follow the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df``, written as Parquet (with ``options`` of the writer) to the shared folder and read from there."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def sieve(keys: DataFrame, key: str, words: int = SIEVE) -> DataFrame:
    """A table of at most ``words`` rows, so a broadcast of a known size, that knows every value of the 64-bit ``key``.

    Each key sets one bit of 64 * ``words``; see ``passed``. Beyond that many keys it only lets more through.
    """
    at = F.xxhash64(key)
    return keys.select(F.pmod(at, F.lit(words)).cast("int").alias("sieve_word"),
                       F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`, 1), 64) as int))").alias("bit")) \
        .groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))


def passed(rows: DataFrame, key: str, known: DataFrame, words: int = SIEVE, out: bool = False) -> DataFrame:
    """``rows`` whose ``key`` may be known to the sieve (all that are, and a few more); with ``out`` the other rows.

    Rows are left where they are: nothing is shuffled.
    """
    named = rows.withColumn("sieve_at", F.pmod(F.xxhash64(key), F.lit(words)).cast("int"))
    set_bit = F.expr(f"shiftright(sieve_bits, cast(pmod(xxhash64(`{key}`, 1), 64) as int)) & 1") == 1
    met = named.join(F.broadcast(known), F.col("sieve_at") == F.col("sieve_word"), "left")
    seen = F.coalesce(set_bit, F.lit(False))
    return met.filter(~seen if out else seen).select(*rows.columns)


def grid(rows: DataFrame, key: str, member: str, run: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``cell``: keys of more than ``run`` members fall into the cells of a grid.

    Members of such a key are dealt to chunks by a hash; each goes to the cells of its
    chunk with every chunk, so any two meet in a cell, and a cell holds about two chunks.
    Other keys have the one cell 0. ``counted`` are the rows that count (all by
    default). There is at most one hot key per ``run`` rows; where there is none,
    nothing is joined.
    """
    hot = stored((rows if counted is None else counted).groupBy(key).count().filter(F.col("count") > run)
                 .select(F.col(key).alias("hot"), F.ceil(F.col("count") / run).cast("int").alias("chunks")), "hot-keys")
    if hot.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    n = F.coalesce("chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64(member), n).cast("int")
    joined = rows.join(hot, F.col(key) == F.col("hot"), "left").withColumn("n", n).withColumn("a", chunk)
    return joined.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1))) \
        .withColumn("cell", F.least("a", "b").cast("long") * F.col("n") + F.greatest("a", "b")) \
        .select(*rows.columns, "cell")
