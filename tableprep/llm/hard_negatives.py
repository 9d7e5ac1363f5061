"""Hard-negative mining over an STR-packed R-tree of integer vectors.

Rows are sorted and tiled: slabs by quantiles of the coordinate of widest spread, ranges of
the next one inside a slab (ties are split by a hash), and in each range leaves of ``LEAF``
rows by two further coordinates. A leaf is one row of the stored index, with its bounding
box; boxes of ``FAN`` leaves and of a whole range are taken from these when they are read.

Against a query q a box [lo, hi] gives the interval of inner products: the upper end is the
sum of max(q_j lo_j, q_j hi_j) over the coordinates, the lower end that of the minima. A
search takes the boxes of a query best first, by upper end. A box goes unread if its
interval lies outside the score window of the query, or if its upper end is strictly below
the query's k-th score so far; the search of a range ends there, as all later boxes are
below. Queries advance in step, so those that open one leaf share one matrix product.

Queries are dealt to chunks of about ``CHUNK``, a bound on what is broadcast and on a task's
memory; one pass over the index serves a chunk, and the k best of each task are merged.
Scores are exact integers: doubles while they stay below 2^53, else 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, stored

LEAF = 256
FAN = 8
#: Rows of a range, which a task holds at once.
RANGE = 8_192
CHUNK = 16_384


def valid(vectors: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """id, label, v (floor of ``scale`` times each component, as doubles) of the rows that take part."""
    rows = pick(vectors, id=key, label=label, v=vector).select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", fine))
    rows = stored(rows.withColumn("v", F.transform("v", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))), "vectors")
    twice = stored(rows.groupBy("id").count().filter("count > 1").select(F.col("id").alias("twice")), "repeated-ids")
    if twice.isEmpty():
        return rows
    again = rows.join(twice, F.col("id") == F.col("twice"), "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return stored(rows.join(twice, F.col("id") == F.col("twice"), "left_anti").unionByName(again.select("id", "r.label", "r.v")), "vectors-once")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows of a matrix; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def spreads(rows: DataFrame) -> tuple[int, int, float, np.ndarray]:
    """Rows, longest vector, largest size of a component, and the variance of each coordinate."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dims:
        return n, dims or 0, 0.0, np.zeros(0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, largest = np.zeros(dims), np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            total, square, largest = total + x.sum(0), square + (x * x).sum(0), np.maximum(largest, np.abs(x).max(0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(square), pa.array(largest)], ["j", "s", "ss", "m"])

    got = rows.select("v").mapInArrow(sums, "j long, s double, ss double, m double").groupBy("j").agg(
        F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("m").alias("m")).toPandas().sort_values("j")
    return n, dims, float(got["m"].max()), (got["ss"] / n - (got["s"] / n) ** 2).to_numpy()


def _tiles(order: np.ndarray, axes: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive: rows ``order`` in leaves of at most ``leaf``, by each axis in turn."""
    order = order[np.argsort(axes[0][order], kind="stable")]
    leaves = math.ceil(len(order) / leaf)
    slabs = math.ceil(leaves ** (1 / len(axes)))
    if len(axes) == 1 or slabs <= 1:
        return np.array_split(order, leaves)
    return [tile for slab in np.array_split(order, slabs) for tile in _tiles(slab, axes[1:], leaf)]


def index(rows: DataFrame, dims: int, widest: list[int], n: int, leaf: int = LEAF, span: int = RANGE) -> DataFrame:
    """The leaves: tree, ids, labels, lo, hi, rows (numpy bytes), in the order of tiles."""
    ranges = max(1, math.ceil(n / span))
    slabs = math.ceil(math.sqrt(ranges))
    at = lambda j: F.coalesce(F.get("v", F.lit(widest[j % len(widest)])), F.lit(0.0)) if widest else F.lit(0.0)
    cuts = rows.agg(F.percentile_approx(at(0), [i / slabs for i in range(1, slabs)], 10_000)).first()[0] if slabs > 1 else []
    slab = sum((F.when(at(0) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = rows.withColumn("slab", slab).withColumn("x", at(1)).withColumn("h", F.xxhash64("id")) \
        .repartitionByRange(ranges, "slab", "x", "h").sortWithinPartitions("slab", "x", "h") \
        .select(F.spark_partition_id().cast("long").alias("p"), "id", "label", "v")
    third, fourth = [widest[j % len(widest)] for j in (2, 3)] if widest else (0, 0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees = [], 0

        def leaves(parts: list[pa.RecordBatch], tree: int) -> pa.RecordBatch:
            block = pa.Table.from_batches(parts)
            ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
            x = _matrix(block.column("v").combine_chunks(), dims)
            by_id = np.argsort(ids)
            axes = [x[:, third], x[:, fourth]] if dims else [ids, ids]
            out = []
            for tile in _tiles(by_id, axes, leaf):
                tile = tile[np.argsort(ids[tile])]
                m = x[tile]
                out.append((tree, ids[tile].tobytes(), labels[tile].tobytes(), m.min(0).tobytes(), m.max(0).tobytes(), m.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["tree", "ids", "labels", "lo", "hi", "rows"])

        for batch in batches:
            base = batch.column("p")[0].as_py() << 32 if batch.num_rows else 0
            while batch.num_rows:
                room = span - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == span:
                    yield leaves(held, base + trees)
                    held, trees = [], trees + 1
        if held:
            yield leaves(held, (held[0].column("p")[0].as_py() << 32) + trees)

    return stored(placed.mapInArrow(build, "tree long, ids binary, labels binary, lo binary, hi binary, rows binary"), "tree-leaves")


class Search:
    """The k best rows of each query over the leaves that are shown to it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int,
                 floor: np.ndarray | None = None, cap: np.ndarray | None = None, fan: int = FAN):
        self.low = -np.inf if vectors.dtype == np.float64 else np.iinfo(np.int64).min + 1
        top = np.inf if vectors.dtype == np.float64 else np.iinfo(np.int64).max
        n = len(vectors)
        self.q, self.plus, self.minus = vectors, np.maximum(vectors, 0), np.minimum(vectors, 0)
        self.ids, self.labels, self.same, self.k, self.fan = ids, labels, same, k, fan
        self.floor = np.full(n, self.low, vectors.dtype) if floor is None else floor.astype(vectors.dtype)
        self.cap = np.full(n, top, vectors.dtype) if cap is None else cap.astype(vectors.dtype)
        self.scores, self.found = np.full((n, k), self.low, vectors.dtype), np.zeros((n, k), np.int64)
        self.opened = self.boxes = 0

    def need(self) -> np.ndarray:
        """A score strictly below it is of no use to the query."""
        return np.maximum(self.floor, self.scores[:, -1])

    def _interval(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of queries ``q`` with each box."""
        plus, minus = self.plus[q], self.minus[q]
        return plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T

    def _open(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which boxes may hold an answer, and their upper ends."""
        least, most = self._interval(q, lo, hi)
        return (most >= self.need()[q, None]) & (least <= self.cap[q, None]), most

    def tree(self, lo: np.ndarray, hi: np.ndarray, leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Search one tree: boxes of its leaves and (ids, labels, rows) of each."""
        everyone = np.arange(len(self.q))
        self.boxes += len(everyone) * len(leaves)
        root, _ = self._open(everyone, lo.min(0)[None], hi.max(0)[None])
        live = everyone[root[:, 0]]
        starts = np.arange(0, len(leaves), self.fan)
        inner, _ = self._open(live, np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts))
        live, inner = live[inner.any(1)], inner[inner.any(1)]
        most = np.full((len(live), len(leaves)), self.low, self.q.dtype)
        for g, start in enumerate(starts):
            rows, stop = np.flatnonzero(inner[:, g]), min(start + self.fan, len(leaves))
            fits, upper = self._open(live[rows], lo[start:stop], hi[start:stop])
            most[rows, start:stop] = np.where(fits, upper, self.low)
        order = np.argsort(-most, axis=1, kind="stable")
        rows = np.arange(len(live))
        for step in range(len(leaves)):
            leaf = order[rows, step]
            upper = most[rows, leaf]
            going = (upper > self.low) & (upper >= self.need()[live[rows]])
            rows, leaf = rows[going], leaf[going]  # later boxes of the others are lower still
            if not len(rows):
                return
            self.opened += len(rows)
            hits = [self._scan(live[rows[leaf == one]], *leaves[one]) for one in np.unique(leaf)]
            self._merge(*[np.concatenate(x) for x in zip(*hits)])

    def _scan(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = self.q[q] @ rows.T
        fits = (scores >= self.need()[q, None]) & (scores <= self.cap[q, None]) & (ids[None] != self.ids[q, None])
        fits &= (labels[None] == self.labels[q, None]) == self.same
        a, b = np.nonzero(fits)
        return q[a], scores[a, b], ids[b]

    def _merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.k)])
        scores = np.concatenate([scores, self.scores[own].ravel()])
        ids = np.concatenate([ids, self.found[own].ravel()])
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.scores[q[best], rank[best]] = scores[order][best]
        self.found[q[best], rank[best]] = ids[order][best]


def _searched(leaves: DataFrame, dims: int, exact, queries: tuple, same: bool, k: int) -> DataFrame:
    """query (its place in ``queries``), score, id: the k best of every task over its leaves."""
    shared = leaves.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value[:3], same, k, *shared.value[3:])
        of, rows = None, []

        def flush() -> None:
            if rows:
                boxes = [[np.frombuffer(r[c]).astype(exact) for r in rows] for c in ("lo", "hi")]
                search.tree(*[np.stack(b) for b in boxes], [
                    (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64),
                     np.frombuffer(r["rows"]).reshape(len(r["ids"]) // 8, dims).astype(exact)) for r in rows])

        for batch in batches:
            for row in batch.to_pylist():
                if row["tree"] != of:
                    flush()
                    of, rows = row["tree"], []
                rows.append(row)
        flush()
        q, rank = np.nonzero(search.scores > search.low)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(search.scores[q, rank].astype(np.int64)), pa.array(search.found[q, rank])], ["query", "score", "id"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return leaves.mapInArrow(run, "query long, score long, id long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, leaf: int = LEAF, span: int = RANGE,
                   chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose ``id`` meets the condition ``anchors``. A row's score with an anchor is the inner
    product of the floors of ``scale`` times the components. The positives of an anchor are the ``positives`` best
    other rows of its label; for each, its negatives are the ``negatives`` best rows of other labels with
    low * positive <= 100 * score <= high * positive. Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that repeat an id
    count once, with the least (label, vector). A shorter vector ends in zeros. A score that may pass 63 bits
    raises. Empty tables give none. Labels and ids are integers.
    """
    small_batches(vectors)
    rows = valid(vectors, key, label, vector, scale)
    n, dims, largest, variance = spreads(rows)
    bound = dims * largest * largest
    if bound * 100 >= 2**63:
        raise ValueError("components are too large for exact 64-bit scores")
    exact = np.float64 if bound * 100 < 2**53 else np.int64
    leaves = index(rows, dims, [int(j) for j in np.argsort(-variance, kind="stable")], n, leaf, span)
    asked = rows.filter(anchors)
    chunks = max(1, math.ceil(asked.count() / chunk))
    asked = stored(asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "anchors")
    out = None
    for i in range(chunks):
        got = asked.filter(F.col("chunk") == i).select("id", "label", "v").orderBy("id").toArrow()
        ids, labels = got.column("id").to_numpy(), got.column("label").to_numpy()
        q = _matrix(got.column("v").combine_chunks(), dims).astype(exact) if len(ids) else np.zeros((0, dims), exact)
        best = _searched(leaves, dims, exact, (q, ids, labels), True, positives).toArrow()
        owner, score, positive = (best.column(c).to_numpy() for c in ("query", "score", "id"))
        # windows in hundredths are made whole: n >= ceil(low p / 100), n <= floor(high p / 100)
        floor, cap = -(-low * score // 100), high * score // 100
        pairs = vectors.sparkSession.createDataFrame(
            pa.table({"query": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score}))
        found = _searched(leaves, dims, exact, (q[owner], ids[owner], labels[owner], floor, cap), False, negatives)
        part = stored(found.join(F.broadcast(pairs), "query").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives")
        out = part if out is None else out.unionByName(part)
    return out
