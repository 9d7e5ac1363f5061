"""Fuzzy matching of text columns, exact for the given threshold.

Two texts within a bounded edit distance must share one of the rarest q-grams of
each (prefix filtering), so candidate pairs come from an equi-join on a few rare
grams per distinct text instead of from all pairs. The length filter and the
edit distance, computed with the bound as a cut-off, are part of the join
condition: pairs that fail never leave it. A gram shared by many texts is cut
into a grid of chunks.

Where grams leave many pairs, as for numbered names, the texts are also cut into one
segment more than the edits allowed: one segment is found unchanged in the other text,
little moved. Segments are cut so that equal ones are rare, and the way with fewer pairs is taken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYS, score
from ..session import broadcast_if_small, cut_lineage, spread
from .lookup import lookup
from .merge import common_columns, merge
from .roles import col
from .skew import grid

TEXTS_PER_CHUNK = 2_000
TUPLES_PER_CHUNK = 2_000
#: Pairs that a task compares, about.
PAIRS_PER_TASK = 500_000
#: A search that compares more pairs looks for a better way.
MANY = 10_000_000
#: Longer texts, or such with more edits, have too many segments.
LONGEST, MOST_EDITS = 100, 20
#: A column that leads to at most so many right tuples needs no better one: verifying them costs less than a search.
FEW = 1_000


def similar_texts(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """Pairs ``a, b`` of distinct texts (columns ``a`` and ``b``) with similarity >= minimum.

    The frames hold one distinct non-null text column each.
    """
    if not 0 < minimum <= 1:
        raise ValueError("the similarity threshold must be in (0, 1]")
    return _search(_Texts(left, right, minimum))


class _Texts:
    """Two sets of texts with the signatures, ``s``, by which similar ones meet, and how many pairs do."""

    def __init__(self, left: DataFrame, right: DataFrame, minimum: float):
        # a text without a letter or digit is like nothing
        self.left, self.right = (self._spread(df.filter(F.length(c) > 0), c) for df, c in ((left, "a"), (right, "b")))
        self.minimum = minimum
        # an edit changes at most q padded grams; with q = 2 the prefix must fit the text
        q = 2 if 2 * (1 - minimum) / minimum <= 1 else 1
        grams_l, grams_r = _grams(self.left, "a", q), _grams(self.right, "b", q)
        seen = grams_l.select("g").unionByName(grams_r.select("g")).groupBy("g").agg(F.count("*").alias("f"))
        seen = broadcast_if_small(seen)
        self._take(_prefix(grams_l, seen, "a", q, minimum), _prefix(grams_r, seen, "b", q, minimum))
        if self.pairs > MANY:
            other = _segments(self.left, self.right, minimum, self.pairs / 20)
            if other is not None:
                self._take(*other)

    @staticmethod
    def _spread(texts: DataFrame, name: str) -> DataFrame:
        rows = texts.count()
        return spread(texts, rows, name) if rows > TEXTS_PER_CHUNK else texts

    def _take(self, sig_l: DataFrame, sig_r: DataFrame) -> None:
        """Keep these signatures if fewer pairs meet by them."""
        sig_l, sig_r = cut_lineage(sig_l), cut_lineage(sig_r)
        counts, pairs = _meetings(sig_l, sig_r, "s")
        if not hasattr(self, "pairs") or pairs < self.pairs:
            self.sig_l, self.sig_r, self.counts, self.pairs = sig_l, sig_r, counts, pairs


def _search(texts: _Texts) -> DataFrame:
    cell_l, cell_r = _cells(texts.sig_l, texts.sig_r, texts.counts, texts.pairs, "s", TEXTS_PER_CHUNK, F.xxhash64("a"), F.xxhash64("b"))
    # lengths are counted once a text, not once a pair
    l = cell_l.select("a", F.length("a").alias("_la"), *[F.col(c).alias(f"l{c}") for c in ("s", "_cl", "_cr")])
    r = cell_r.select("b", F.length("b").alias("_lb"), "s", "_cl", "_cr")
    allowed = F.floor((1 - texts.minimum) * F.greatest("_la", "_lb") + 1e-9).cast("int")
    near = (F.abs(F.col("_la") - F.col("_lb")) <= allowed) & (F.call_function("levenshtein", F.col("a"), F.col("b"), allowed) >= 0)
    meet = reduce(lambda x, y: x & y, [F.col(f"l{c}") == F.col(c) for c in ("s", "_cl", "_cr")])
    pairs = l.join(r, meet & near)
    same = texts.left.join(texts.right, F.col("a") == F.col("b")).select("a", "b")
    return pairs.select("a", "b").unionByName(same).distinct()


def _meetings(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, float]:
    """``on, _a, _b``: the rows of either side for keys of both, and the pairs of rows with one key."""
    counts = left.groupBy(on).agg(F.count("*").alias("_a")).join(right.groupBy(on).agg(F.count("*").alias("_b")), on)
    counts = cut_lineage(counts)
    return counts, counts.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0


def _cells(left: DataFrame, right: DataFrame, counts: DataFrame, pairs: float, on: str, rows: int,
           left_hash: Column, right_hash: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into a grid of at most ``rows`` a chunk, in as many tasks as the pairs need: their bytes say little."""
    sizes = counts.select(on, *[F.ceil(F.col(c) / rows).cast("int").alias(n) for c, n in (("_a", "_nl"), ("_b", "_nr"))])
    a, b = grid(left, right, broadcast_if_small(sizes.filter("_nl > 1 OR _nr > 1")), [on], left_hash, right_hash)
    tasks = min(int(pairs / PAIRS_PER_TASK) + 1, 10_000)
    return (a, b) if tasks == 1 else (a.repartition(tasks, on, "_cl", "_cr"), b.repartition(tasks, on, "_cl", "_cr"))


def _segments(left: DataFrame, right: DataFrame, minimum: float, most: float) -> tuple[DataFrame, DataFrame] | None:
    """Signatures of both sides by segments, unless they are more than ``most`` rows.

    A right text falls into t + 1 segments for t edits. In a left text within t edits a segment i has no
    edit, at most i - 1 before and t + 1 - i after it; a move by so many characters needs as many edits.
    """
    lengths = [dict(tuple(r) for r in df.groupBy(F.length(c)).count().collect()) for df, c in ((left, "a"), (right, "b"))]
    if max((max(x, default=0) for x in lengths)) > LONGEST or not all(lengths):
        return None
    meet = [(x, y, math.floor((1 - minimum) * max(x, y) + 1e-9)) for x in lengths[0] for y in lengths[1]]
    meet = [(x, y, t) for x, y, t in meet if abs(x - y) <= t]
    if max((t for _, _, t in meet), default=0) > MOST_EDITS:
        return None
    moves = {(x, y): [[m for m in range(-t, t + 1) if abs(m) <= i and abs(x - y - m) <= t - i and abs(m) + abs(x - y - m) <= t]
                      for i in range(t + 1)] for x, y, t in meet}
    cuts = {(y, t) for _, y, t in meet}
    total = sum(lengths[0][x] * sum(map(len, moves[x, y])) for x, y, _ in meet) + sum(lengths[1][y] * (t + 1) for y, t in cuts)
    if total > most:
        return None
    # how often two texts have the same character in a place
    places = right.select(F.length("b").alias("y"), F.posexplode(F.split("b", "")).alias("at", "c")).groupBy("y", "at", "c").count()
    places = places.groupBy("y", "at").agg((F.sum(F.col("count").cast("double") ** 2) / F.sum("count") ** 2).alias("p")).collect()
    alike = {(r["y"], r["at"]): r["p"] for r in places}
    starts = {(y, t): _cut_rarely([alike.get((y, j), 1.0) for j in range(y)], t) for y, t in cuts}
    parts = [{}, {}]
    for y, t in sorted(cuts):
        at = starts[y, t]
        parts[1].setdefault(y, []).extend((f"{y}.{t}.{i}#", at[i] + 1, at[i + 1] - at[i]) for i in range(t + 1))
    for x, y, t in sorted(meet):
        at = starts[y, t]
        parts[0].setdefault(x, []).extend((f"{y}.{t}.{i}#", at[i] + m + 1, at[i + 1] - at[i]) for i in range(t + 1) for m in moves[x, y][i]
                                          if at[i] + m >= 0 and at[i + 1] + m <= x)

    def signed(df: DataFrame, name: str, table: dict) -> DataFrame:
        table = df.sparkSession.createDataFrame(list(table.items()), "_n int, _parts array<struct<k: string, s: int, n: int>>")
        own = F.transform("_parts", lambda part: F.concat(part["k"], F.substring(F.col(name), part["s"], part["n"])))
        return df.join(F.broadcast(table), F.length(name) == F.col("_n")).select(name, F.explode(F.array_distinct(own)).alias("s"))

    return signed(left, "a", parts[0]), signed(right, "b", parts[1])


def _cut_rarely(alike: Sequence[float], t: int) -> list[int]:
    """Where t + 1 segments begin and the last ends, so that as few as possible are equal, if places are independent."""
    level = np.concatenate([[0.0], np.cumsum(np.log(alike))])
    equal = np.where(np.tri(len(level), dtype=bool).T, np.exp(np.minimum(level[None, :] - level[:, None], 0.0)), np.inf)
    best, back = equal[0], []
    for i in range(1, t + 1):
        ways = best[:, None] + equal * (2 * min(i, t - i, t // 2) + 1)
        back.append(ways.argmin(axis=0))
        best = ways.min(axis=0)
    at = [len(alike)]
    for came in reversed(back):
        at.append(int(came[at[-1]]))
    return [0, *at[::-1]]


def _grams(df: DataFrame, name: str, q: int) -> DataFrame:
    """One row per q-gram of the padded text; repeats of a gram are numbered."""
    padded = F.concat(F.lit("^" * (q - 1)), F.col(name), F.lit("$" * (q - 1)))
    starts = F.sequence(F.lit(1), F.length(padded) - (q - 1))
    gram = F.transform(starts, lambda i: F.substring(padded, i, F.lit(q)))
    return (df.filter(F.length(name) > 0).select(name, F.explode(gram).alias("g"))
            .groupBy(name, "g").agg(F.count("*").alias("m")))


def _prefix(grams: DataFrame, seen: DataFrame, name: str, q: int, minimum: float) -> DataFrame:
    """The rarest grams of each text, as many as its possible edits can destroy plus one."""
    ranked = grams.join(seen, "g").groupBy(name).agg(
        F.array_sort(F.flatten(F.collect_list(F.transform(
            F.sequence(F.lit(1), F.col("m")), lambda i: F.struct("f", "g", i.alias("i")))))).alias("t"))
    n = F.length(name)
    edits = F.floor((1 - minimum) * n / minimum + 1e-9)
    kept = F.slice("t", F.lit(1), (edits * q + 1).cast("int"))
    return ranked.select(name, F.explode(F.transform(kept, lambda g: F.concat(g["g"], F.lit("#"), g["i"]))).alias("s"))


def _distinct_keys(df: DataFrame, column: str, scorer: str) -> DataFrame:
    """value, key, n per distinct value."""
    text = col(column).cast("string")
    return (df.filter(text.isNotNull()).groupBy(text.alias("value")).agg(F.count("*").alias("n"))
            .withColumn("key", KEYS[scorer](F.col("value"))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                threshold: int = 80, scorer: str = "ratio") -> DataFrame:
    """left_value, right_value, score, n for all distinct value pairs at or above the threshold."""
    # read several times below, so the tables are scanned once
    lv = cut_lineage(_distinct_keys(left, left_on, scorer))
    rv = cut_lineage(_distinct_keys(right, right_on, scorer))
    if threshold < 1:
        raise ValueError("threshold 0 asks for all pairs; it starts at 1")
    minimum = (threshold - 0.5) / 100
    keys = similar_texts(lv.select(F.col("key").alias("a")).distinct(),
                         rv.select(F.col("key").alias("b")).distinct(), minimum)
    keys = keys.withColumn("score", score(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    return (lv.select(F.col("value").alias("left_value"), F.col("key").alias("a"), "n").join(keys, "a")
            .join(rv.select(F.col("value").alias("right_value"), F.col("key").alias("b")), "b")
            .select("left_value", "right_value", "score", "n"))


def best_values(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                threshold: int = 80, scorer: str = "ratio") -> DataFrame:
    """The best right value for each left value; ties go to the smaller one.

    The best is chosen among keys, each with its smallest value; values are joined last.
    """
    if threshold < 1:
        raise ValueError("threshold 0 asks for all pairs; it starts at 1")
    lv = cut_lineage(_distinct_keys(left, left_on, scorer))
    rv = cut_lineage(_distinct_keys(right, right_on, scorer).groupBy("key").agg(F.min("value").alias("value")))
    keys = similar_texts(lv.select(F.col("key").alias("a")).distinct(), rv.select(F.col("key").alias("b")), (threshold - 0.5) / 100)
    keys = keys.withColumn("score", score(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("k"), F.col("value").alias("v")))
    chosen = keys.join(rv, F.col("b") == F.col("key")).groupBy("a").agg(best.alias("b"))
    return lv.join(chosen, F.col("key") == F.col("a")).select(
        F.col("value").alias("left_value"), F.col("b.v").alias("right_value"), (-F.col("b.k")).alias("score"), "n")


def fuzzy_best_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_order: str,
                     threshold: int = 80, scorer: str = "ratio",
                     suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Each left row beside the first right row (by ``right_order``) of its best value."""
    best = best_values(left, right, left_on, right_on, threshold, scorer)
    first = (right.groupBy(col(right_on).cast("string").alias("_rv"))
             .agg(F.min_by(F.struct(*[col(c) for c in right.columns]), col(right_order)).alias("_row")))
    table = best.join(first, F.col("right_value") == F.col("_rv")).select(
        F.col("left_value").alias("_key"), F.col("n").alias("_n"),
        F.struct("score", "_row").alias("_match"))
    found = lookup(left.withColumn("_t", col(left_on).cast("string")), "_t", table, "_match")
    clash = set(common_columns(left, right))
    return found.filter("_match IS NOT NULL").select(
        *[col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns],
        *[F.col("_match._row")[c].alias(c + suffixes[1] if c in clash else c) for c in right.columns],
        F.col("_match.score").alias("score"))


def fuzzy_key_map(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner",
                  threshold: int = 80, scorer: str = "ratio",
                  suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Ordinary merge after mapping left keys to their best right value; others keep their own."""
    best = best_values(left, right, left_on, right_on, threshold, scorer)
    table = best.select(F.col("left_value").alias("_key"), F.col("n").alias("_n"), F.col("right_value").alias("_to"))
    keyed = lookup(left.withColumn("_t", col(left_on).cast("string")), "_t", table, "_to")
    keyed = keyed.withColumn("_merge_key", F.coalesce("_to", "_t")).drop("_t", "_to")
    other = right.withColumn("_merge_key", col(right_on).cast("string"))
    return merge(keyed, other, "_merge_key", "_merge_key", how, suffixes).drop("_merge_key")


def _alike(a: Column, b: Column, similar: float) -> Column:
    """Whether the similarity reaches ``similar``; distances far beyond are not counted out."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - similar) * longest + 1e-6).cast("int")
    edits = F.call_function("levenshtein", a, b, most)
    return F.when(longest == 0, F.lit(True)).when(F.abs(F.length(a) - F.length(b)) > most, F.lit(False)) \
        .otherwise((edits >= 0) & (1 - edits / longest >= similar))


def _near_values(texts: _Texts, left: DataFrame, right: DataFrame, similar: float) -> DataFrame:
    """``a, b``: distinct values alike; two empty texts are."""
    near = _search(texts).filter(_alike(F.col("a"), F.col("b"), similar))
    empty = left.filter("a = ''").join(right.filter("b = ''"), F.col("a") == F.col("b"))
    return near.unionByName(empty.select("a", "b"))


def _link_columns(lt: DataFrame, rt: DataFrame, lk: Sequence[str], rk: Sequence[str], wanted: int,
                  similar: float) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Left tuples with ``_use``, the ``wanted`` columns that lead to the fewest right tuples, and the near values per column.

    How many right tuples a column leads to is counted. Columns with more values come first,
    and only tuples without ``wanted`` columns of at most ``FEW`` right tuples go on to the next.
    A column whose search compares ``MANY`` pairs and more waits for the others, and is left out
    if the right tuples that those lead to are fewer.
    """
    kinds = rt.agg(*[F.approx_count_distinct(k).alias(k) for k in rk]).first()
    state = lt.withColumn("_costs", F.array().cast("array<struct<n:bigint,c:int>>"))
    is_open = F.size(F.filter("_costs", lambda o: o["n"] <= FEW)) < wanted
    nears, waiting = {}, []

    def texts(i: int) -> tuple[DataFrame, DataFrame, _Texts]:
        values = state.filter(is_open & F.col(lk[i]).isNotNull()).groupBy(F.col(lk[i]).alias("a")).agg(F.count("*").alias("_n"))
        values = cut_lineage(values)
        held = rt.filter(F.col(rk[i]).isNotNull()).groupBy(F.col(rk[i]).alias("b")).agg(F.count("*").alias("m"))
        return values, held, _Texts(values.select("a"), held.select("b"), similar)

    def searched(i: int, values: DataFrame, held: DataFrame, both: _Texts) -> DataFrame:
        nears[i] = cut_lineage(_near_values(both, values.select("a"), held.select("b"), similar))
        table = nears[i].join(held, "b").groupBy("a").agg(F.sum("m").alias("_to")).join(values, "a") \
            .select(F.col("a").alias("_key"), "_n", "_to")
        option = F.struct(F.coalesce("_to", F.lit(0)).cast("bigint").alias("n"), F.lit(i).alias("c"))
        met = lookup(state, lk[i], table, "_to")
        return cut_lineage(met.withColumn("_costs", F.when(is_open, F.array_append("_costs", option)).otherwise(F.col("_costs"))).drop("_to"))

    order = sorted(range(len(lk)), key=lambda i: (-kinds[rk[i]], i))
    for i in order:
        found = texts(i)
        if found[2].pairs > MANY and len(order) > 1:
            waiting.append((found[2].pairs, i, state.filter(is_open).count(), found))
            continue
        state = searched(i, *found)
        if state.filter(is_open).isEmpty():
            waiting = []
            break
    best = F.slice(F.array_sort("_costs"), 1, wanted)
    for _, i, before, found in sorted(waiting, key=lambda w: w[:2]):
        led = F.aggregate(best, F.lit(0.0), lambda s, o: s + o["n"])
        left, lacking, verified = state.filter(is_open).agg(F.count("*"), F.count(F.when(F.size("_costs") < wanted, 1)), F.sum(led)).first()
        if not left:
            break
        found = found if left == before else texts(i)
        if lacking or found[2].pairs < verified:
            state = searched(i, *found)
    use = F.transform(best, lambda o: o["c"])
    return state.select(*lk, use.alias("_use")), nears


def fuzzy_record_link(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
                      similar: float = 0.85, suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """All row pairs where enough column pairs are alike; every match is kept.

    A column pair counts when its similarity reaches ``similar``, and a row pair
    is kept when at least that share of its columns count. With m misses allowed, any
    m + 1 columns hold one that is alike: each left tuple of keys takes its candidates from
    the m + 1 columns that lead to the fewest right tuples, and the others only verify. A
    value that many tuples share is cut into a grid of chunks. A null is like nothing.
    """
    n = len(left_on)
    need = math.ceil(similar * n - 1e-9)
    lk, rk = [f"_k{i}" for i in range(n)], [f"_m{i}" for i in range(n)]
    key = KEYS["ratio"]
    l = left.select(F.struct(*[col(c) for c in left.columns]).alias("_l"), *[key(col(c)).alias(k) for c, k in zip(left_on, lk)])
    r = right.select(F.struct(*[col(c) for c in right.columns]).alias("_r"), *[key(col(c)).alias(k) for c, k in zip(right_on, rk)])
    # rows meet through distinct key tuples, so repeated keys are compared once
    lt, rt = cut_lineage(l.select(*lk).distinct()), cut_lineage(r.select(*rk).distinct())
    tuples, nears = _link_columns(lt, rt, lk, rk, n - need + 1, similar)
    alike = [F.col(x).isNotNull() & F.col(y).isNotNull() & _alike(F.col(x), F.col(y), similar) for x, y in zip(lk, rk)]
    total = F.size(F.filter("_alike", lambda x: x))
    hits = None
    for i, near in nears.items():
        led = cut_lineage(tuples.filter(F.array_contains("_use", i)).join(near, F.col(lk[i]) == F.col("a")).select(*lk, "_use", "b"))
        other = rt.filter(F.col(rk[i]).isNotNull()).withColumn("b", F.col(rk[i]))
        a, b = _cells(led, other, *_meetings(led, other, "b"), "b", TUPLES_PER_CHUNK, F.xxhash64(*lk), F.xxhash64(*rk))
        cell = ["b", "_cl", "_cr"]
        a = a.toDF(*[f"_to_{c}" if c in cell else c for c in a.columns])
        # a pair that an earlier column of the tuple leads to as well is found there
        elsewhere = F.exists("_use", lambda j: (j < i) & F.get("_alike", j))
        meet = reduce(lambda x, y: x & y, [F.col(f"_to_{c}") == F.col(c) for c in cell])
        sure = [F.lit(True) if j == i else one for j, one in enumerate(alike)]
        found = a.join(b, meet).withColumn("_alike", F.array(*sure)).filter((total >= need) & ~elsewhere) \
            .select(*lk, *rk, total.alias("matched"))
        hits = found if hits is None else hits.unionByName(found)
    same = lambda names, side: reduce(lambda x, y: x & y, [F.col(f"h.{k}").eqNullSafe(F.col(f"{side}.{k}")) for k in names])
    rows = (hits.alias("h").join(l.alias("l"), same(lk, "l")).join(r.alias("r"), same(rk, "r"))
            .select("l._l", "r._r", "h.matched"))
    clash = set(common_columns(left, right))
    return rows.select(*[F.col("_l")[c].alias(c + suffixes[0] if c in clash else c) for c in left.columns],
                       *[F.col("_r")[c].alias(c + suffixes[1] if c in clash else c) for c in right.columns], "matched")


def fuzzy_merge(left: DataFrame, right: DataFrame, left_on, right_on, threshold: int = 80, mode: str = "best",
                scorer: str = "ratio", how: str = "inner", right_order: str | None = None) -> DataFrame:
    if mode == "best":
        return fuzzy_best_match(left, right, left_on, right_on, right_order or right_on, threshold, scorer)
    if mode == "map":
        return fuzzy_key_map(left, right, left_on, right_on, how, threshold, scorer)
    if mode == "link":
        return fuzzy_record_link(left, right, left_on, right_on)
    raise ValueError(f"unknown mode {mode!r}")
