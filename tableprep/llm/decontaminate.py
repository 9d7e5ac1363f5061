"""Benchmark decontamination by canonical templates.

Tokens are runs of letters and digits. Numbers, names and units become the typed
placeholders <num>, <name> and <unit>; all else is lower case. A name is a
capitalised token that does not open a sentence or a line. Windows of five
canonical tokens of which three or more are literal are hashed and joined with the
windows of the benchmark. Where a window has placeholders, its slots pair the
benchmark's values with the document's. Along one alignment (document place minus
item place) a benchmark value must always meet the same document value; windows of
an alignment that breaks this do not count. A document is contaminated by an item if
the counted windows are at least ``SIMILARITY`` of the item's windows.

A text opens a sentence. An item copied into the middle of a sentence begins with what
looks like a name there, so a document's window that begins with a name counts also
with that name as a literal. Items without such a window (too few tokens, or too few
literal ones) are compared by their lower-case tokens as they are: in windows of five,
or in one of the whole item if it has fewer.

So a question asked again with other numbers or names is found, and a text that only
shares the shape of its sentences is not.

Only DataFrame functions are used. The benchmark's windows are broadcast if the table
is counted to hold at most ``BROADCAST_ROWS`` rows (one window each, of at most five tokens);
a larger one is joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

WINDOW = 5
LITERALS = 3
SIMILARITY = 0.8
BROADCAST_ROWS = 200_000

#: A token, with the sign that ends a sentence before it, if any.
TOKEN = r"(?:^|[.!?:;\n][\s\"'(\[]*)?[\p{L}\p{M}\p{N}]+(?:[.,'][\p{L}\p{N}]+)*"
# Units of measure and money.
UNITS = ("mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ml l litre "
         "litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
         "years cent cents dollar dollars euro euros percent degree degrees mph kmh").split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


def canonical(raw: Column) -> Column:
    """Canonical form of a token as TOKEN finds it."""
    bare = F.regexp_replace(raw, r"^[^\p{L}\p{M}\p{N}]+", "")
    lower = F.lower(bare)
    # most tokens begin with a small letter: one test and no cutting
    return F.when(raw.rlike(r"^\p{Ll}"), F.when(raw.isin(UNITS), F.lit(UNIT)).otherwise(F.lower(raw))) \
        .when(bare.rlike(r"^\p{N}+(?:[.,]\p{N}+)*$"), F.lit(NUM)) \
        .when(lower.isin(UNITS), F.lit(UNIT)) \
        .when(raw.rlike(r"^\p{Lu}[\p{Ll}\p{M}]"), F.lit(NAME)).otherwise(lower)


def value(raw: Column) -> Column:
    """What stands in a slot."""
    return F.lower(F.regexp_replace(raw, r"^[^\p{L}\p{M}\p{N}]+", ""))


def tokens(rows: DataFrame) -> DataFrame:
    """key, raw: the tokens of each text as TOKEN finds them; the text opens a line."""
    text = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    return rows.select("key", F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("raw"))


def windows(rows: DataFrame, copied: bool = False) -> DataFrame:
    """key, at, h, slots for every window of the texts; slots are its raw tokens if it has placeholders.

    If ``copied``, windows that begin with a name come a second time, with it as a literal.
    """
    rows = tokens(rows)
    holder = lambda c: c.isin(NUM, NAME, UNIT)
    # the last bit of a token's hash says whether it is a placeholder
    rows = rows.select("key", "raw", F.transform(F.transform("raw", canonical), lambda c: F.xxhash64(c).bitwiseAND(-2)
                       .bitwiseOR(F.when(holder(c), 1).otherwise(0).cast("long"))).alias("t"))
    some = F.transform("t", lambda x, i: F.struct(
        i.alias("at"), F.xxhash64(x, *[F.get("t", i + k) for k in range(1, WINDOW)]).alias("h"),
        F.when(x.bitwiseOR(F.get("t", i + 1)).bitwiseOR(F.get("t", i + 2)).bitwiseOR(F.get("t", i + 3))
               .bitwiseOR(F.get("t", i + 4)).bitwiseAND(1) == 1,
               F.struct(F.slice(F.col("raw"), i + 1, WINDOW).alias("raw"),
                        F.transform(F.slice(F.col("t"), i + 1, WINDOW), lambda y: y.bitwiseAND(1)).alias("open"))).alias("slots")))
    # an expression, not a column: else Spark infers a filter on its size, moves that filter down and so
    # computes all that stands above for every token again
    complete = F.slice(some, 1, F.greatest(F.size("t") - (WINDOW - 1), F.lit(0)))
    if copied:
        name = F.xxhash64(F.lit(NAME)).bitwiseAND(-2).bitwiseOR(1)
        after = lambda i: [F.get("t", i + k) for k in range(1, WINDOW)]
        opened = F.transform(F.slice("t", 1, F.greatest(F.size("t") - (WINDOW - 1), F.lit(0))), lambda x, i: F.when(x == name, F.struct(
            i.alias("at"), F.xxhash64(F.xxhash64(F.lower(F.get("raw", i))).bitwiseAND(-2), *after(i)).alias("h"),
            F.when(reduce(Column.bitwiseOR, after(i)).bitwiseAND(1) == 1,
                   F.struct(F.slice(F.col("raw"), i + 1, WINDOW).alias("raw"),
                            F.transform(F.slice(F.col("t"), i + 1, WINDOW),
                                        lambda y, j: F.when(j == 0, 0).otherwise(y.bitwiseAND(1)).cast("long")).alias("open"))).alias("slots"))))
        complete = F.concat(complete, F.filter(opened, lambda w: w.isNotNull()))
    return rows.select("key", F.explode(complete).alias("w")).select("key", "w.at", "w.h", "w.slots")


def plain_windows(rows: DataFrame, size: int) -> DataFrame:
    """key, at, h for every run of ``size`` lower-case tokens."""
    rows = tokens(rows).select("key", F.transform("raw", lambda x: F.xxhash64(value(x))).alias("t"))
    # the size is part of the hash, so no window of another size or form is met
    some = F.transform("t", lambda x, i: F.xxhash64(F.lit("plain"), F.lit(size), x, *[F.get("t", i + k) for k in range(1, size)]))
    return rows.select("key", F.posexplode(F.slice(some, 1, F.greatest(F.size("t") - (size - 1), F.lit(0)))).alias("at", "h"))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """The windows that items are known by: item, item_at, h, item_slots, n (the item's windows), size (of plain ones)."""
    found = windows(items)
    literals = WINDOW - F.aggregate("slots.open", F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.filter(F.col("slots").isNull() | (literals >= LITERALS)).withColumn("size", F.lit(None).cast("int"))
    few = tokens(items.join(found.select("key").distinct(), "key", "left_anti")).filter(F.size("raw") > 0) \
        .select("key", F.least(F.size("raw"), F.lit(WINDOW)).alias("size"))
    for size in range(1, WINDOW + 1):
        plain = plain_windows(items.join(few.filter(F.col("size") == size).select("key").distinct(), "key", "left_semi"), size)
        found = found.unionByName(plain.withColumn("size", F.lit(size)), allowMissingColumns=True)
    sizes = found.groupBy("key").agg(F.count("*").alias("n"))
    return found.join(sizes, "key").select(F.col("key").alias("item"), F.col("at").alias("item_at"), "h",
                                           F.col("slots").alias("item_slots"), "n", "size")


def hits(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, item, similarity for every document and item of at least that similarity."""
    known = stored(benchmark_windows(items.filter("key IS NOT NULL").distinct()), "benchmark-windows")
    plain = [r["size"] for r in known.select("size").distinct().collect() if r["size"]]  # at most WINDOW
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    seen = windows(docs, copied=True)
    for size in plain:
        seen = seen.unionByName(plain_windows(docs, size), allowMissingColumns=True)
    met = seen.join(known.drop("size"), "h").withColumn("line", F.col("at") - F.col("item_at"))
    met = stored(met, "template-matches")
    pairs = F.arrays_zip(F.col("item_slots.raw").alias("b"), F.col("slots.raw").alias("d"), F.col("slots.open").alias("o"))
    pairs = F.transform(F.filter(pairs, lambda x: x["o"] == 1), lambda x: F.struct(
        value(x["b"]).alias("b"), value(x["d"]).alias("d")))
    # at most one pair per token of the item, for one alignment
    slots = met.filter("slots IS NOT NULL").select("key", "item", "line", F.explode(pairs).alias("p")) \
        .groupBy("key", "item", "line").agg(F.collect_set("p").alias("p"))
    broken = slots.filter(F.size(F.array_distinct("p.b")) < F.size("p")) \
        .select(F.col("key").alias("k2"), F.col("item").alias("i2"), F.col("line").alias("l2"), F.lit(True).alias("broken"))
    counted = met.join(broken, F.col("key").eqNullSafe(F.col("k2")) & (F.col("item") == F.col("i2"))
                       & (F.col("line") == F.col("l2")), "left") \
        .filter(F.col("broken").isNull() | F.col("slots").isNull())
    return counted.groupBy("key", "item").agg((F.count_distinct("item_at") / F.first("n")).alias("similarity")) \
        .filter(F.col("similarity") >= similarity)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Which benchmark items each document holds; one row per row of ``docs``.

    Returns key, contaminated, items (sorted array) and similarity (the greatest, 0
    if none). Null texts are empty and clean; items with a null id or without tokens match
    nothing. An item of one word is in every document that has the word. Rows that share a
    key (null included) are one document. An empty benchmark leaves all clean.
    """
    rows = pick(docs, key=key, text=text)
    found = hits(rows, pick(benchmark, key=item, text=item_text), similarity) \
        .groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("s"))
    kind = found.schema["items"].dataType
    return rows.select("key").join(found, F.col("key").eqNullSafe(F.col("k")), "left").select(
        F.col("key").alias(key), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(kind)).alias("items"), F.coalesce("s", F.lit(0.0)).alias("similarity"))
