"""Secret scans: patterns, and a battery of randomness tests with false discoveries held.

Three patterns give the base spans. The method adds spans of kind ``random``: runs of
encoding characters that look drawn at random. For each run the encoding is inferred
(digits, hex, base32, letters, letters and digits, base64, base64url), then

* chi-squared uniformity over that alphabet, number of runs above and below the middle
  of the alphabet, and lag-1 serial correlation must all be compatible with uniform,
  independent symbols (``LEVEL`` each);
* a p-value under the hypothesis of ordinary writing is computed: ordinary letters
  repeat, two of them agree with probability ``COINCIDENCE``, so chi-squared of n letters
  over A symbols has mean A - 1 + n (A * COINCIDENCE - 1). Its distance falls with every
  letter, so the test knows the length: short runs can hardly be called random. The
  Chernoff bound exp(-z * z / 2) keeps the value valid in the far tail.

All p-values of the corpus go through the Benjamini-Hochberg step at rate ``RATE``: one
count per cell of a fixed logarithmic grid (at most ``CELLS`` rows) gives the cut, where
each value counts as the upper edge of its cell.

Positions are code points, end exclusive. They come from marks set around the matches:
text between marks adds up to places. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

# The patterns, and the least length that counts (assign: of group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = r"[A-Za-z0-9+/_-]{20,}"
COINCIDENCE = 0.065
LEVEL_Z = 3.3
RATE = 0.01
STEPS, CELLS = 16, 16_384

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets, the narrowest first; a run belongs to the first that has all its symbols.
ALPHABETS = [DIGITS, DIGITS + LOWER[:6], DIGITS + UPPER[:6], LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
             DIGITS + UPPER + LOWER, DIGITS + UPPER + LOWER + "+/", DIGITS + UPPER + LOWER + "_-"]
MARK = "\x01"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all leftmost non-overlapping matches, in order."""
    # a mark that stands in the text becomes another sign that no pattern knows
    parts = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.size(parts) > 1, F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"),
                 F.array().cast("array<struct<start:int,end:int,found:string>>").alias("got")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x)).alias("at"), (~a["inside"]).alias("inside"),
            F.when(a["inside"], F.array_append(a["got"], F.struct(
                a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("found")))).otherwise(a["got"]).alias("got")),
        lambda a: a["got"])).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind: array<struct<start, end, found>>."""
    return {
        "assign": F.filter(_matches(text, ASSIGN),
                           lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST["assign"]),
        "access": F.filter(_matches(text, ACCESS), lambda m: m["end"] - m["start"] >= LEAST["access"]),
        # a run of at least 24 is the same run, found without the short ones
        "hex": _matches(text, HEX[:-1] + "{%d,}" % LEAST["hex"])}


def _alphabet(run: Column) -> Column:
    """The place in ALPHABETS of the encoding that a run is written in."""
    index = F.lit(len(ALPHABETS) - 1)
    for i, a in reversed(list(enumerate(ALPHABETS))):
        index = F.when(F.translate(run, a, "") == "", i).otherwise(index)
    return index


def _statistics(runs: DataFrame) -> DataFrame:
    """Adds size, chi2, runs_z, serial_z and cell to rows with ``found``."""
    size = F.array(*[F.lit(len(a)) for a in ALPHABETS])
    signs = F.array(*[F.lit(a) for a in ALPHABETS])
    rows = runs.withColumn("a", _alphabet(F.col("found"))) \
        .withColumn("n", F.length("found")).withColumn("size", F.get(size, "a")).withColumn("signs", F.get(signs, "a")) \
        .withColumn("chars", F.split("found", "", -1))
    rows = rows.withColumn("v", F.transform(F.filter("chars", lambda c: c != ""), lambda c: F.instr(F.col("signs"), c).cast("double")))
    kinds = F.array_distinct("chars")
    rows = rows.withColumn("chi2", F.aggregate(
        kinds, F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(
            a + F.pow(F.col("n") - F.length(F.replace(F.col("found"), c, F.lit(""))), F.lit(2)))) * F.col("size") / F.col("n") - F.col("n"))
    half = (F.col("size") + 1) / 2.0
    ups = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(x > half, 1.0).otherwise(0.0))
    turns = F.aggregate(F.transform("v", lambda x, i: ((x > half) != (F.get("v", i + 1) > half)).cast("int")),
                        F.lit(1), lambda a, x: a + F.coalesce(x, F.lit(0)))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("ups", ups).withColumn("turns", turns).withColumn("mean", total / F.col("n")).withColumn("sq", squares)
    lag = F.aggregate(F.transform("v", lambda x, i: (x - F.col("mean")) * (F.get("v", i + 1) - F.col("mean"))),
                      F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    n, up = F.col("n"), F.col("ups")
    down = n - up
    expected = 2 * up * down / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    spread = F.col("sq") - n * F.col("mean") ** 2
    rows = rows.withColumn("runs_z", F.when(variance > 0, (F.col("turns") - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))) \
        .withColumn("serial_z", F.when(spread > 0, lag / spread * F.sqrt(n)).otherwise(F.lit(99.0)))
    free, excess = F.col("size") - 1, n * (F.col("size") * COINCIDENCE - 1)
    more = F.greatest(excess, F.lit(0.0))
    z = (free + more - F.col("chi2")) / F.sqrt(2.0 * free + 4.0 * more)
    # log2 of exp(-z z / 2), in steps; rounded towards 1
    depth = F.when((z > 0) & (more > 0), F.floor(z * z / 2 * 1.4426950408889634 * STEPS)).otherwise(0)
    uniform = (F.col("chi2") - free) / F.sqrt(2.0 * free) <= LEVEL_Z
    even = uniform & (F.abs("runs_z") <= LEVEL_Z) & (F.abs("serial_z") <= LEVEL_Z)
    return rows.withColumn("cell", F.least(depth, F.lit(CELLS - 1)).cast("int")).withColumn("even", even) \
        .drop("a", "signs", "chars", "v", "ups", "turns", "mean", "sq", "n")


def cut(cells: list[tuple[int, int]], rate: float = RATE) -> int:
    """The lowest cell whose runs are called random: Benjamini-Hochberg over counts per cell."""
    total, seen, best = sum(n for _, n in cells), 0, CELLS
    for cell, n in sorted(cells, reverse=True):
        seen += n
        if 2.0 ** (-cell / STEPS) * total <= rate * seen:
            best = cell
    return best


def random_runs(spans: DataFrame, rate: float = RATE) -> DataFrame:
    """The random runs among rows with key, start, end, found: the same rows with statistics."""
    tested = stored(_statistics(spans), "random-runs")
    cells = tested.groupBy("cell").count().collect()  # at most CELLS rows
    return tested.filter(F.col("even") & (F.col("cell") >= cut([(r["cell"], r["count"]) for r in cells], rate)))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """All spans of every text, one row per row of ``docs``.

    Returns key, n_chars and ``found``: array<struct<start, end, rank, kind>> by start,
    then kind in the order assign, access, hex, random. A null text is empty and has
    none; so has an empty table. Repeated rows get equal results, null keys too.
    """
    rows = pick(docs, key=key, text=text).select("key", F.coalesce("text", F.lit("")).alias("text"))
    spans = base_spans(F.col("text"))
    rows = rows.select("key", F.length("text").alias("n_chars"),
                       *[c.alias(k) for k, c in spans.items()], _matches(F.col("text"), RUN).alias("runs"))
    bare = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    # each row gets an own number, so repeated keys stay apart; the stored table keeps it
    facts = stored(rows.select(F.monotonically_increasing_id().alias("row"), "key", "n_chars",
                               *[bare(k).alias(k) for k in spans], "runs"), "secret-spans")
    runs = facts.select("row", F.explode("runs").alias("m")).select("row", "m.start", "m.end", "m.found")
    added = random_runs(runs, rate).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("random"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    kinds = [*spans, "random"]
    mark = lambda r, k: F.transform(F.coalesce(F.col(k), none), lambda m: F.struct(
        m["start"].alias("start"), F.lit(r).alias("rank"), m["end"].alias("end"), F.lit(k).alias("kind")))
    return facts.drop("runs").join(added, "row", "left").select(
        F.col("key").alias(key), "n_chars", F.sort_array(F.concat(*[mark(r, k) for r, k in enumerate(kinds)])).alias("found"))


def span_digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"),
                                                                 m["end"].cast("string"))), ",")
