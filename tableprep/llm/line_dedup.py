"""Line dedup: equal lines, and lines within a small edit distance, stay only where they come first.

Lines of ``NEAR_LEAST`` code points may differ by EDITS, lines of ``SHORT_LEAST`` by one, and
in a pair the shorter line decides; below, lines must be equal.

Equal lines are found by two 64-bit hashes. For lines within ``EDITS`` edits, each line
is cut into EDITS + 1 segments of even length; after that many edits one segment still
stands somewhere in the other line. Every line puts its segments into an index by
(its length, number of the segment, substring) and looks up, for its own length and
each length down to EDITS less, only the substrings that a match can use: segment i
may have moved by at most i - 1 places as seen from the left end and by at most
EDITS + 1 - i as seen from the right end. Equal lengths need only moves to the right,
since the other line sees the same match as a move to the left.

Only hashes are shuffled: a run of lines that share a key, of which one is indexed,
gives its members, and only these lines' texts are fetched for the banded bit-parallel check
(an automaton of EDITS + 1 rows of 2 * EDITS + 1 bits, which move along the diagonal). A run gives one row per line that has an earlier near line, never its
pairs. Runs of more than ``RUN`` lines are cut into chunks that meet in the cells of
a grid, so every pair is still compared.

A line goes if it equals an earlier line, or if it is within EDITS of an earlier
line; earlier is by (key, line number) of its first occurrence. The rule has no
chains to follow: the earlier line counts even if it goes itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grid, passed, pick, sieve, small_batches, stored

EDITS = 2
#: Lines shorter than this (without outer white space) always stay.
LEAST = 10
#: Shorter lines may differ by one edit only.
NEAR_LEAST = 40
#: Shorter lines are compared for equality only.
SHORT_LEAST = 20
RUN = 2000
#: A line with more than one in so many of all occurrences is hot.
HOT = 10_000
#: Line hashes that a task remembers, so that a repeated line is indexed once.
MEMORY = 1_000_000


def cuts(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a line; the last ones are longer by one."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def places(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings that a line of ``length`` looks up among lines of length ``other``."""
    found, delta = [], length - other
    for i, (at, n) in enumerate(cuts(other, edits)):
        low = max(at - i, at + delta - (edits - i), 0)
        high = min(at + i, at + delta + (edits - i), length - n)
        # same length and place: both lines have this key in the index
        found += [(i, start, n) for start in range(low if delta else at + 1, high + 1)]
    return found


def allowed(length: int, edits: int) -> int:
    """Edits that may lie between a line of ``length`` and one as long or longer."""
    return edits if length >= NEAR_LEAST else min(edits, 1) if length >= SHORT_LEAST else 0


def line_keys(edits: int = EDITS):
    """The function that makes key rows (k, h) of lines: h is the line's hash, its last bit 1 for a lookup."""
    plans: dict[int, tuple[list, list]] = {}

    def plan(n: int) -> tuple[list, list]:
        if n not in plans:
            if len(plans) > 20_000:
                plans.clear()
            own = [(n << 4 | i, 4 * at, 4 * (at + size)) for i, (at, size) in enumerate(cuts(n, allowed(n, edits)))]
            looked = [(m << 4 | i, 4 * at, 4 * (at + size)) for m in range(n, max(n - edits, 0) - 1, -1)
                      if n - m <= allowed(m, edits) for i, at, size in places(n, m, allowed(m, edits)) if size]
            plans[n] = own, looked
        return plans[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen, digest, segment = set(), xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, owners = [], []
            for line in batch.column(0).to_pylist():
                h = digest(line.encode("utf-8", "surrogatepass"), 42) & ~1
                if h in seen:
                    continue
                if len(seen) >= MEMORY:
                    seen.clear()
                seen.add(h)
                wide = line.encode("utf-32-le", "surrogatepass")
                own, looked = plan(len(line))
                keys += [segment(wide[a:b], s) for s, a, b in own]
                keys += [segment(wide[a:b], s) for s, a, b in looked]
                owners += [h] * len(own) + [h | 1] * len(looked)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)),
                                              pa.array(np.array(owners, np.uint64).view(np.int64))], ["k", "h"])

    return run


def runs(batches: Iterator, columns: list[str], key: int) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal leading columns from sorted batches: arrays of rows that may end no run.

    The first ``key`` columns are the run's key. The last run of a batch waits for the next.
    """
    kept = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now)]
        if not len(now[0]):
            continue
        other = np.flatnonzero(np.any([c != c[-1] for c in now[:key]], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield [x[:last] for x in now]
        kept = [x[last:] for x in now]
    if kept is not None and len(kept[0]):
        yield kept


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k, those of runs with an indexed line and another line; each line once a run."""
    for k, h in runs(batches, ["k", "h"], 1):
        line = h & ~np.int64(1)
        order = np.lexsort((h, line, k))
        k, h, line = k[order], h[order], line[order]
        first = np.r_[True, (k[1:] != k[:-1]) | (line[1:] != line[:-1])]  # the index row comes before the lookup
        k, h, line = k[first], h[first], line[first]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        indexed = np.add.reduceat((h & 1) == 0, starts)
        keep = np.repeat((sizes > 1) & (indexed > 0), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(line[keep])], ["k", "h"])


def within(a: str, b: str, edits: int) -> bool:
    """Whether two texts are at most ``edits`` insertions, deletions and substitutions apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, n = 0, min(len(a), len(b))
    if a[:n] == b[:n]:
        return True
    while a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    # bit i of a row: with j letters of b, j - edits + i letters of a are read; no integer is wider than the band
    full = (1 << 2 * edits + 1) - 1
    rows = [((2 << e) - 1) << edits & full for e in range(edits + 1)]
    # for each letter its places in the band of column j, as they were at the column it was last seen in
    seen: dict[str, tuple[int, int]] = {}
    for i, c in enumerate(a[:edits]):
        seen[c] = seen.get(c, (0, 0))[0] | 1 << edits + i, 0
    for j, c in enumerate(b):
        if j + edits < len(a):
            x = a[j + edits]
            bits, since = seen.get(x, (0, j))
            seen[x] = bits >> j - since | 1 << 2 * edits, j
        bits, since = seen.get(c, (0, j))
        at, before, above = bits >> j - since, 0, 0
        for e, now in enumerate(rows):
            new = now & at
            if e:
                new |= before | before >> 1 | above << 1
            before, above, rows[e] = now, new, new & full
        if not rows[-1]:
            return False
    # of lines this near only one place of the last column counts
    return bool(rows[-1] >> len(a) - len(b) + edits & 1)


def later_lines(lines: list[str], order: list, edits: int) -> np.ndarray:
    """Which lines of a run have an earlier near line; ``order`` says what is earlier."""
    n = len(lines)
    length = np.array([len(x) for x in lines])
    # letters by kind: an edit changes at most two counts by one
    counts = np.zeros((n, 32), np.int16)
    for i, x in enumerate(lines):
        codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
        counts[i] = np.minimum(np.bincount(codes & 31, minlength=32), 10_000)
    place = np.array(sorted(range(n), key=order.__getitem__))
    late = np.zeros(n, bool)
    for r in range(1, n):
        i, before = place[r], place[:r]
        near = before[np.abs(length[before] - length[i]) <= edits]
        near = near[np.abs(counts[near] - counts[i]).sum(1) <= 2 * edits]
        late[i] = any(within(lines[j], lines[i], allowed(min(length[i], length[j]), edits)) for j in near)
    return late


def verified(edits: int = EDITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cell, h, line, rank in runs(batches, ["k", "cell", "h", "line", "rank"], 2):
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])])
            out = []
            for a, b in zip(starts, np.r_[starts[1:], len(k)]):
                if b - a > 1:
                    out.append(h[a:b][later_lines(list(line[a:b]), list(rank[a:b]), edits)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["h"])

    return run


def lines_of(rows: DataFrame) -> DataFrame:
    """key, no, line and its hashes, of lines that can go."""
    lines = rows.select("key", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")) \
        .filter(F.length(F.trim("line")) >= LEAST)
    return lines.withColumn("h", F.xxhash64("line").bitwiseAND(F.lit(-2))).withColumn("h2", F.xxhash64("line", F.lit(1)))


def near_lines(rows: DataFrame, firsts: DataFrame, edits: int = EDITS, run: int = RUN) -> DataFrame:
    """h of the lines that have an earlier line within ``edits`` edits.

    ``firsts`` has h and rank, a text that sorts as the first occurrences do.
    """
    long = rows.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length("line") >= SHORT_LEAST)
    met = stored(long.mapInArrow(line_keys(edits), "k long, h long").repartition("k").sortWithinPartitions("k")
                 .mapInArrow(shared, "k long, h long"), "shared-segments")
    # lines that share no segment stay out of the next shuffles
    known = stored(sieve(met.select("h"), "h"), "sieve")
    wanted = stored(met.select("h").distinct().join(passed(firsts, "h", known), "h").groupBy("h").agg(F.min("rank").alias("rank")), "shared-lines")
    hashed = long.select("line", F.xxhash64("line").bitwiseAND(F.lit(-2)).alias("h"))
    # one text per hash leaves a task, so copies of a common line do not meet
    texts = passed(hashed, "h", known).groupBy("h").agg(F.min("line").alias("line")).join(wanted, "h")
    texts = stored(texts, "shared-texts")
    return grid(met, "k", "h", run).join(texts, "h").select("k", "cell", "h", "line", "rank") \
        .repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(verified(edits), "h long").distinct()


def dropped_lines(rows: DataFrame, edits: int = EDITS, run: int = RUN) -> DataFrame:
    """key, gone (array of line numbers) of every document that loses lines; ``rows`` has key and text."""
    lines = lines_of(rows)
    firsts = stored(lines.groupBy("h", "h2").agg(F.min(F.struct("key", "no")).alias("first"), F.count("*").alias("n")), "first-lines")
    place = F.col("first.key")
    if rows.schema["key"].dataType.typeName() in ("long", "integer", "short", "byte"):
        # order-preserving text of a whole number
        place = F.lpad(F.hex(place.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rank = F.concat(F.when(place.isNull(), "0").otherwise(F.concat(F.lit("1"), place.cast("string"))), F.lit("\x00"),
                    F.lpad(F.hex(F.col("first.no").cast("long")), 16, "0"))
    near = stored(near_lines(rows, firsts.select("h", rank.alias("rank")), edits, run).withColumn("near", F.lit(True)), "near-lines")
    known = stored(firsts.join(near, "h", "left").filter("n > 1 OR near"), "known-lines")
    # lines that make up more than a HOT-th of all, so fewer than HOT of them, meet their facts by broadcast;
    # their rows then have a key of their own in the join by shuffle, where they find nothing
    edge = max((firsts.agg(F.sum("n")).first()[0] or 0) / HOT, run)
    facts = [F.col("first.key").alias("fk"), F.col("first.no").alias("fn"), F.coalesce("near", F.lit(False)).alias("near")]
    hot = known.filter(F.col("n") > edge).select("h", "h2", F.struct(*facts).alias("hot"))
    rest = known.filter(F.col("n") <= edge).select(F.col("h").alias("rh"), F.col("h2").alias("rh2"), F.struct(*facts).alias("rest"))
    # only lines that occur again or are near another go on
    again = passed(lines.select("key", "no", "h", "h2"), "h", stored(sieve(known.select("h"), "h"), "sieve"))
    spread = again.join(F.broadcast(hot), ["h", "h2"], "left") \
        .withColumn("j", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("key", "no"))) \
        .join(rest, (F.col("j") == F.col("rh")) & (F.col("h2") == F.col("rh2")), "left")
    met = spread.select("key", "no", F.coalesce("hot", "rest").alias("m")).filter("m IS NOT NULL")
    return met.filter(F.col("m.near") | ~(F.col("key").eqNullSafe(F.col("m.fk")) & (F.col("no") == F.col("m.fn")))) \
        .groupBy("key").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, run: int = RUN) -> DataFrame:
    """``docs`` with the text cut to the lines that stay, and n_lines, n_dropped added.

    Null texts stay null and empty ones empty, with 0 lines. A line of fewer than
    ``LEAST`` code points always stays, one of fewer than ``SHORT_LEAST`` goes only if it equals
    an earlier one; if the shorter of two has fewer than ``NEAR_LEAST``, one edit counts. Rows that share a key (null included) are one document: they
    lose the lines of the same numbers. Ties cannot occur: (key, line number) differ.
    """
    small_batches(docs)
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    t, k = f"_{names.index(text)}", f"_{names.index(key)}"
    gone = dropped_lines(pick(docs, key=key, text=text), edits, run)
    lines = F.split(F.col(t), "\n", -1)
    # only documents that lose lines, and a few more, are shuffled
    gone = stored(gone, "lines-gone")
    losers = stored(sieve(gone.select("key"), "key"), "sieve")
    # by shuffle also where Spark would broadcast, so the disk of a small run tells that of a large one
    joined = passed(flat, k, losers).join(gone.hint("merge"), F.col(k).eqNullSafe(F.col("key")), "left") \
        .unionByName(passed(flat, k, losers, out=True), allowMissingColumns=True)
    # kept numbers by set difference, so a text of many lines costs its length
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
                                    lambda i: F.get("lines", i)), "\n")
    out = joined.withColumn("lines", lines)
    return out.select(
        *[(F.when(F.col("gone").isNull(), F.col(t)).otherwise(kept) if c == t else F.col(c)).alias(c) for c in flat.columns],
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")).toDF(*names, "n_lines", "n_dropped")
