"""Exact k nearest rows for a large set of queries among a large set of donors.

Comparing all pairs does not scale, and neither does a join that emits them. Donors
are cut into cells of a k-d tree: each node with too many donors is cut at quantiles of
the feature that spreads widest in it among those that queries have; donors that lack
the feature form a part of their own. There are about as many cells as donors in a cell
once a table is large, so both grow with its root.

A query first looks into the nearest cell; the k-th distance found there bounds the
cells that can hold a nearer donor. The tree, one box per cell, is walked for all
queries of a batch at once, dropping boxes beyond the bound. The ``RING`` nearest cells
come next, the bound falls, and then what is left within it. Inside a task distances
are computed in numpy, and only k rows per query and cell leave it.

A query that has one feature needs no tree: its nearest rows are those with the k + 1
values next to its own on either side. Donors and queries are sorted along the feature in
slices, and each slice knows the values at the ends of the others.

Distance is Euclidean over the features both rows have, scaled up by the share
of features missing; ties go to the smaller payload.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .roles import col
from .skew import grid

DONORS_PER_CELL = 8_000
DONORS_PER_CHUNK = 8_000
QUERIES_PER_CHUNK = 8_000
#: Cells of the second round.
RING = 8
#: Parts of a node.
FAN = 16
#: Groups are dealt to so many trees; rows of another group in a cell are passed over.
TREES = 1_024
#: Rows of a slice of a sorted feature, and the most neighbours that are looked up there.
ROWS_PER_SLICE = 200_000
LINE_K = 32
#: The number of the group null.
NO_GROUP = -(1 << 40)


def nearest_rows(queries: DataFrame, donors: DataFrame, features: Sequence[str], k: int,
                 query_id: str, payload: str, group: str | None = None,
                 self_id: str | None = None, visits: list | None = None) -> DataFrame:
    """``query_id, near`` where ``near`` is the sorted array of (d2, pay).

    ``payload`` is the donor column returned; ``group`` restricts matches to
    equal values; ``self_id`` names the donor column that identifies the query
    itself, which is then left out. ``visits`` gets the cells looked into, by round.
    """
    p = len(features)
    feats = [f"_f{i}" for i in range(p)]
    pay_type = donors.schema[payload].dataType.simpleString()

    def shaped(df: DataFrame, *extra) -> DataFrame:
        plain = df.select(*extra, F.coalesce(col(group).cast("string"), F.lit("\0")).alias("_g") if group else F.lit("").alias("_g"),
                          *[col(f).cast("double").alias(n) for f, n in zip(features, feats)])
        return plain.withColumn("_t", F.pmod(F.xxhash64("_g"), F.lit(TREES)).cast("int"))

    q = cut_lineage(shaped(queries, col(query_id).alias("_q")))
    d = shaped(donors, col(payload).alias("_pay"), (col(self_id) if self_id else F.lit(None)).cast("string").alias("_self"))
    parts, whole = [], group is None or dict(donors.dtypes)[group] in ("tinyint", "smallint", "int")
    if whole and not self_id and pay_type == "double" and k <= LINE_K:
        found, q = _on_lines(q, d, feats, k)
        parts += [] if found is None else [found]
    if not parts or not q.isEmpty():
        best = _in_cells(q, d, feats, k, pay_type, query_id=queries.schema[query_id].dataType.simpleString(),
                         copies=k + bool(self_id), visits=visits)
        parts += [] if best is None else [best]
    if not parts:
        kinds = dict(queries.dtypes)[query_id]
        return q.sparkSession.createDataFrame([], f"`{query_id}` {kinds}, near array<struct<d2: double, pay: {pay_type}>>")
    return reduce(DataFrame.unionByName, parts).select(F.col("_q").alias(query_id), F.col("_near").alias("near"))


def _in_cells(q: DataFrame, d: DataFrame, feats: Sequence[str], k: int, pay_type: str, query_id: str,
              copies: int, visits: list | None) -> DataFrame | None:
    """``_q, _near`` by the tree; ``copies`` donors with equal features are kept."""
    # of donors with equal features only the first ones can ever be used
    first = W.partitionBy("_g", *feats).orderBy("_pay", "_self")
    d = cut_lineage(d.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= copies).drop("_n"))
    tree, d = _tree(q, d, feats)
    shared = q.sparkSession.sparkContext.broadcast(tree)
    visit = _visitor(feats, k, pay_type, query_id=query_id)
    names, q_schema = q.columns, ", ".join(f"{n} {t}" for n, t in q.dtypes)

    def steps(skip: int, take: int | None):
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.iloc[start:start + 256]
                    at, cell = shared.value.home(part) if take == 1 and not skip else shared.value.within(part, skip, take)
                    out = part.iloc[at].copy()
                    out["_b"] = cell
                    yield out[[*names, "_b"]]
        return walk

    best = None
    for skip, take in ((0, 1), (0, RING), (RING, None)):
        if best is None:
            asked = q
        else:
            bound = F.when(F.size("_near") >= k, F.element_at("_near", k)["d2"])
            asked = q.join(best.select("_q", bound.alias("_bound")), "_q", "left")
        stops = cut_lineage(asked.mapInPandas(steps(skip, take), f"{q_schema}, _b int"))
        counts = stops.groupBy("_b").agg(F.count("*").alias("_c"), F.ceil(F.count("*") / QUERIES_PER_CHUNK).cast("int").alias("_nl"))
        sizes = broadcast_if_small(counts.join(tree.chunks(q.sparkSession), "_b"))
        if visits is not None:
            visits.append(sizes.agg(F.sum("_c")).first()[0] or 0)
        if sizes.isEmpty():
            break
        found = visit(stops, d, sizes.drop("_c"))
        if best is not None:
            found = found.unionByName(best.select("_q", F.explode("_near").alias("_n")).select("_q", "_n.d2", "_n.pay"))
        best = cut_lineage(found.groupBy("_q").agg(_best(k).alias("_near")))
    return best


def _on_lines(q: DataFrame, d: DataFrame, feats: Sequence[str], k: int) -> tuple[DataFrame | None, DataFrame]:
    """``_q, _near`` of the queries with one feature, and the other queries.

    A line is one feature of one group. Its values lie in slices, sorted also by payload, so that a value
    that many donors have is spread. A query whose last value looked at is as far as its k-th neighbour, by
    rounding, is handed on with the others.
    """
    p = len(feats)
    known = reduce(lambda a, b: a + b, [(F.col(f).isNotNull() & ~F.isnan(f)).cast("int") for f in feats])
    asked, others = q.filter(known == 1), q.filter(known > 1)
    if asked.isEmpty():
        return None, others
    number = F.coalesce(F.expr("try_cast(_g AS bigint)"), F.lit(NO_GROUP)) * p

    def points(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct((number + i).alias("_line"), F.col(f).alias("_x")) for i, f in enumerate(feats)]))
        return df.select(name, each.alias("_at")).select(name, "_at.*").filter(F.abs("_x") < float("inf"))

    spots = points(asked, "_q")
    lines = broadcast_if_small(spots.select("_line").distinct())
    rows = points(d, "_pay").join(lines, "_line", "left_semi").select("_line", "_x", "_pay", F.lit(False).alias("_ask"))
    rows = rows.unionByName(spots.select("_line", "_x").distinct().select("_line", "_x", F.lit(None).cast("double").alias("_pay"), F.lit(True).alias("_ask")))
    n, cores = rows.count(), q.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-n // ROWS_PER_SLICE), min(cores, -(-n // 10_000)), 1)
    shape = "_line bigint, _x double, _pay double, _ask boolean, _part int, _edge boolean"
    sliced = cut_lineage(rows.repartitionByRange(slices, "_line", "_x", "_pay").mapInPandas(_slice(k), shape))
    ends = sliced.filter("_edge").select("_line", "_x", "_pay", "_part").toPandas().sort_values("_line", ignore_index=True)
    ends = q.sparkSession.sparkContext.broadcast({c: ends[c].to_numpy() for c in ends.columns})
    cells = [f"{c}{i}" for c in ("_d", "_p") for i in range(k)]
    found = cut_lineage(sliced.drop("_edge").mapInPandas(_search(ends, k, p), f"_line bigint, _x double, _sure boolean, {', '.join(f'{c} double' for c in cells)}"))
    near = F.filter(F.array(*[F.struct(F.col(f"_d{i}").alias("d2"), F.col(f"_p{i}").alias("pay")) for i in range(k)]), lambda n: n["d2"].isNotNull())
    met = spots.join(found.select("_line", "_x", "_sure", near.alias("_near")), ["_line", "_x"])
    if not found.filter("NOT _sure").isEmpty():
        others = others.unionByName(q.join(met.filter("NOT _sure").select("_q"), "_q", "left_semi"))
    return met.filter(F.col("_sure") & (F.size("_near") > 0)).select("_q", "_near"), others


def _runs(line: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the run of equal values that each sorted row is in, and its place there."""
    new = np.ones(len(x), bool)
    new[1:] = (line[1:] != line[:-1]) | (x[1:] != x[:-1])
    run = np.cumsum(new) - 1
    return run, np.arange(len(x)) - np.flatnonzero(new)[run]


def _slice(k: int):
    """Rows of a slice: queries, and of each value the donors with the k smallest payloads, the values at both ends marked."""
    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if not own:
            return
        own = pd.concat(own, ignore_index=True).assign(_part=TaskContext.get().partitionId(), _edge=False)
        yield own[own["_ask"]]
        own = own[~own["_ask"]]
        own = own.iloc[np.lexsort((own["_pay"], own["_x"], own["_line"]))]
        line = own["_line"].to_numpy()
        run, place = _runs(line, own["_x"].to_numpy())
        if len(run):
            own["_edge"] = ((run < k + 2) & (line == line[0])) | ((run > run[-1] - (k + 2)) & (line == line[-1]))
        yield own[place < k]
    return shrink


def _search(ends, k: int, p: int):
    """The k nearest donors on its line for each query of a slice."""
    def nearest(asked: np.ndarray, x: np.ndarray, pay: np.ndarray) -> Iterator[np.ndarray]:
        order = np.lexsort((pay, x))
        x, pay = x[order], pay[order]
        run, place = _runs(np.zeros(len(x)), x)
        kept = place < k
        values = x[place == 0]
        pays, full = np.full((len(values), k), np.nan), np.zeros((len(values), k), bool)
        pays[run[kept], place[kept]], full[run[kept], place[kept]] = pay[kept], True
        for start in range(0, len(asked), 4096):
            at = asked[start:start + 4096]
            if not len(values):
                yield np.hstack([at[:, None], np.ones((len(at), 1)), np.full((len(at), 2 * k), np.nan)])
                continue
            beside = np.searchsorted(values, at, "right")[:, None] + np.arange(-(k + 1), k + 1)
            there = np.clip(beside, 0, len(values) - 1)
            gap = at[:, None] - values[there]
            with np.errstate(over="ignore"):
                far = np.where(beside == there, gap * gap * p, np.inf)
            every = np.where(full[there], far[:, :, None], np.inf).reshape(len(at), -1)
            theirs = pays[there].reshape(len(at), -1)
            best = np.lexsort((theirs, every))[:, :k]
            every, theirs = np.take_along_axis(every, best, 1), np.take_along_axis(theirs, best, 1)
            last = np.where(np.isfinite(every[:, -1]), every[:, -1], -1.0)
            sure = (far[:, 0] > last) & (far[:, -1] > last)
            missing = ~np.isfinite(every)
            every[missing], theirs[missing] = np.nan, np.nan
            yield np.hstack([at[:, None], sure[:, None], every, theirs])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if not own:
            return
        own = pd.concat(own, ignore_index=True)
        part, ask = own["_part"].iloc[0], own["_ask"].to_numpy()
        asked, own = own[ask].sort_values("_line", kind="stable"), own[~ask].sort_values("_line", kind="stable")
        own, end = {c: own[c].to_numpy() for c in own.columns}, ends.value
        names = ["_x", "_sure", *[f"{c}{i}" for c in ("_d", "_p") for i in range(k)]]
        for line, some in asked.groupby("_line"):
            a, b = np.searchsorted(own["_line"], [line, line + 1])
            c, e = np.searchsorted(end["_line"], [line, line + 1])
            other = end["_part"][c:e] != part
            x, pay = (np.concatenate([own[n][a:b], end[n][c:e][other]]) for n in ("_x", "_pay"))
            for block in nearest(some["_x"].to_numpy(), x, pay):
                out = pd.DataFrame(block, columns=names)
                out.insert(0, "_line", line)
                yield out.assign(_sure=out["_sure"] > 0)
    return search


def _best(k: int):
    return F.slice(F.array_sort(F.collect_list(F.struct("d2", "pay"))), 1, k)


class CellTree:
    """Boxes of the cells and of the nodes above them, level by level."""

    def __init__(self, cells: pd.DataFrame, feats: Sequence[str], path: Sequence[str]):
        self.feats, self.rows = list(feats), cells["_rows"].to_numpy()
        # a feature that some donor of a cell lacks says nothing about the cell
        lo = cells[[f"lo{i}" for i in range(len(feats))]].to_numpy(dtype=float)
        hi = cells[[f"hi{i}" for i in range(len(feats))]].to_numpy(dtype=float)
        keys = [cells[c].to_numpy() for c in path]
        self.levels = []
        for depth in range(1, 1 + len(path)):
            new = np.ones(len(cells), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys[:depth]], axis=0)
            starts = np.flatnonzero(new)
            if len(starts):
                self.levels.append((starts, np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.add.reduceat(self.rows, starts)))
        roots = keys[0][self.levels[0][0]] if self.levels else np.zeros(0, int)
        self.first = {int(t): (i, i + 1) for i, t in enumerate(roots)}

    def chunks(self, spark) -> DataFrame:
        """_b, _nr: into how many chunks the donors of a cell are cut."""
        return spark.createDataFrame(pd.DataFrame({
            "_b": np.arange(len(self.rows), dtype=np.int32), "_nr": -(-self.rows // DONORS_PER_CHUNK).astype(np.int32)}), "_b int, _nr int")

    def _distance(self, x: np.ndarray, known: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """A bound from below of the squared distance of rows ``x`` to the boxes ``node``; infinite for rows without features."""
        _, lo, hi, _ = self.levels[level]
        gap = np.fmax(np.fmax(lo[node] - x, x - hi[node]), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(known > 0, np.nansum(gap * gap, axis=1) * len(self.feats) / known, np.inf)

    def _asked(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = part[self.feats].to_numpy(dtype=float)
        known = (~np.isnan(x)).sum(1)
        spans = np.array([self.first.get(int(t), (0, 0)) for t in part["_t"]], dtype=int).reshape(-1, 2)
        return x, known, spans[:, 0], spans[:, 1]

    def _children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, below = self.levels[level][0], self.levels[level + 1][0]
        ends = np.append(starts[1:], len(self.rows))
        return np.searchsorted(below, starts[node]), np.searchsorted(below, ends[node])

    @staticmethod
    def _spread(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each ``at`` with every number from a to b."""
        n = b - a
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), np.repeat(a, n) + offset

    def home(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row found by taking the nearest box on every level, the fullest of equals."""
        x, known, a, b = self._asked(part)
        at = np.flatnonzero(b > a)
        a, b = a[at], b[at]
        for level in range(len(self.levels)):
            who, node = self._spread(at, a, b)
            far = self._distance(x[who], known[who], level, node)
            order = np.lexsort((node, -self.levels[level][3][node], far, who))
            order = order[np.isfinite(far[order])]
            at, one = np.unique(who[order], return_index=True)
            node = node[order][one]
            if level + 1 < len(self.levels):
                a, b = self._children(level, node)
        return (at, node) if len(self.levels) else (at[:0], at[:0])

    def within(self, part: pd.DataFrame, skip: int, take: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Cells within the bound of each row but its home cell, nearest first: ``take`` of them after ``skip``."""
        own = np.full(len(part), -1)
        own_at, own_cell = self.home(part)
        own[own_at] = own_cell
        x, known, a, b = self._asked(part)
        bound = part["_bound"].to_numpy(dtype=float)
        bound = np.where(np.isnan(bound), np.inf, bound * (1 + 1e-9))
        at = np.arange(len(part))
        for level in range(len(self.levels)):
            at, node = self._spread(at, a, b)
            far = self._distance(x[at], known[at], level, node)
            near = (far <= bound[at]) & np.isfinite(far)
            at, node, far = at[near], node[near], far[near]
            if level + 1 < len(self.levels):
                a, b = self._children(level, node)
        if not len(self.levels):
            return at[:0], at[:0]
        other = node != own[at]
        at, node, far = at[other], node[other], far[other]
        order = np.lexsort((node, far, at))
        at, node = at[order], node[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = (rank >= skip) & (rank < skip + take if take is not None else True)
        return at[kept], node[kept]


def _tree(q: DataFrame, d: DataFrame, feats: Sequence[str]) -> tuple[CellTree, DataFrame]:
    """The tree of the donors ``d``, and ``d`` with the number of its cell, ``_b``."""
    n = d.count()
    size = max(DONORS_PER_CELL, math.isqrt(n))
    # a feature that few rows have narrows few distances
    asked = F.broadcast(q.groupBy("_t").agg(*[(F.count(f) / F.count("*")).alias(f"_a{i}") for i, f in enumerate(feats)]))
    placed, path = d, ["_t"]
    marks = [s / FAN for s in range(1, FAN)]
    whole = [x for i, f in enumerate(feats) for x in (F.when(F.count(f) == F.count("*"), F.min(f)).alias(f"lo{i}"),
                                                      F.when(F.count(f) == F.count("*"), F.max(f)).alias(f"hi{i}"))]
    likely, cells = n, None  # rows of the largest node, as far as quantiles tell
    while cells is None:
        parts = placed.groupBy(*path).agg(
            F.count("*").alias("_rows"), *[x for i, f in enumerate(feats) for x in (
                (F.stddev_pop(f) * F.count(f) / F.count("*")).alias(f"_s{i}"), F.percentile_approx(f, marks, 100 * FAN).alias(f"_e{i}"),
                F.max(f).alias(f"_x{i}"))]).filter(F.col("_rows") > 2 * size).join(asked, "_t")
        # every mark, or fewer if few parts are enough; a mark at the top cuts nothing off
        step = F.greatest(F.floor(F.lit(FAN) * size / F.col("_rows")), F.lit(1))
        useful = lambda top: lambda e, n: (e < top) & ((n + 1) % step == 0)
        ways = [F.struct((F.col(f"_s{i}") * F.col(f"_a{i}")).alias("spread"), F.lit(-i).alias("_"),
                         F.array_distinct(F.filter(f"_e{i}", useful(F.col(f"_x{i}")))).alias("cuts")) for i in range(len(feats))]
        best = F.array_max(F.filter(F.array(*ways), lambda w: (w["spread"] > 0) & (F.size(w["cuts"]) > 0)))
        edges = cut_lineage(parts.select(*path, best.alias("_w")).filter("_w IS NOT NULL").select(*path, F.negative("_w._").alias("_k"), "_w.cuts"))
        last = edges.isEmpty()
        if not last:
            x = F.element_at(F.array(*feats), F.coalesce("_k", F.lit(0)) + 1)
            part = F.when(F.col("_k").isNull(), 0).when(x.isNull(), -1).otherwise(F.size(F.filter("cuts", lambda e: e < x)))
            placed = placed.join(broadcast_if_small(edges, cut=False), path, "left").withColumn(f"_p{len(path)}", part).drop("_k", "cuts")
            path.append(f"_p{len(path)}")
            likely = likely * 1.5 / FAN
        if last or likely <= 2 * size:
            cells = placed.groupBy(*path).agg(F.count("*").alias("_rows"), *whole).toPandas().sort_values(path, ignore_index=True)
            if not last and len(cells) and cells["_rows"].max() > 4 * size:
                cells = None  # equal values are in the way: go on
    tree = CellTree(cells, feats, path)
    numbers = d.sparkSession.createDataFrame(cells[path].assign(_b=np.arange(len(cells))), ", ".join(f"{c} int" for c in [*path, "_b"]))
    return tree, cut_lineage(placed.join(F.broadcast(numbers), path).drop(*path[1:]))


def _visitor(feats: Sequence[str], k: int, pay_type: str, query_id: str):
    p = len(feats)

    def top_k(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_q": left["_q"].iloc[:0], "d2": [], "pay": right["_pay"].iloc[:0]})
        order = np.argsort(right["_pay"].to_numpy(), kind="stable")
        right = right.iloc[order]
        pay, own = right["_pay"].to_numpy(), right["_self"].to_numpy()
        names, groups = pd.factorize(pd.concat([left["_g"], right["_g"]]))
        asked_group, donor_group = names[:len(left)], names[len(left):]
        donor = [right[f].to_numpy(dtype=float) for f in feats]
        ids, keys = left["_q"].to_numpy(), left["_q"].astype(str).to_numpy()
        matrix = [left[f].to_numpy(dtype=float) for f in feats]
        mask_self = bool(right["_self"].notna().any())
        parts = []
        for start in range(0, len(ids), 256):
            stop = min(start + 256, len(ids))
            total = np.zeros((stop - start, len(pay)))
            seen = np.zeros((stop - start, len(pay)))
            for a, b in zip(matrix, donor):
                gap = a[start:stop, None] - b[None, :]
                square = gap * gap
                known = ~np.isnan(square)
                total += np.where(known, square, 0.0)
                seen += known
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = total * p / seen
            dist[seen == 0] = np.inf
            if len(groups) > 1:
                dist[asked_group[start:stop, None] != donor_group[None, :]] = np.inf
            if mask_self:
                dist[keys[start:stop, None] == own[None, :]] = np.inf
            # everything up to the k-th distance, ties included; donors are in
            # payload order, so the column number breaks ties
            if dist.shape[1] > k:
                limit = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
                rows, cols = np.nonzero((dist <= limit) & np.isfinite(dist))
            else:
                rows, cols = np.nonzero(np.isfinite(dist))
            near = dist[rows, cols]
            order = np.lexsort((cols, near, rows))
            rows, cols, near = rows[order], cols[order], near[order]
            first = np.searchsorted(rows, rows)
            kept = np.arange(len(rows)) - first < k
            parts.append(pd.DataFrame({"_q": ids[start:stop][rows[kept]], "d2": near[kept], "pay": pay[cols[kept]]}))
        return pd.concat(parts, ignore_index=True)

    def visit(q: DataFrame, d: DataFrame, sizes: DataFrame) -> DataFrame:
        left, right = grid(q, d, sizes, ["_b"], F.xxhash64("_q"), F.xxhash64("_pay", "_self", *feats), how="inner")
        keys = ["_b", "_cl", "_cr"]
        return (left.select(*keys, "_q", "_g", *feats).groupBy(*keys)
                .cogroup(right.select(*keys, "_pay", "_self", "_g", *feats).groupBy(*keys))
                .applyInPandas(top_k, f"_q {query_id}, d2 double, pay {pay_type}"))

    return visit
