"""Exact quantiles with linear interpolation, at any table size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so
it is used only up to a checked number of cells. Above that a mergeable sketch
first brackets each wanted rank between two values; then one pass counts rows,
keeping values apart only inside the brackets, which hold a few ten-thousandths
of the table. A bracket with more than ``BRACKET`` values is narrowed by rank
selection: its values are cut into ``PARTS``, the part that holds the rank is kept,
and so on. Ranks are then read off side by side, each from its own few values; no task
sees those of a whole column. The sketch's error bound makes the result exact; a
rank outside its bracket would raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import SPREAD_ROWS, broadcast_if_small, cut_lineage, spread
from .roles import col

DIRECT_CELLS = 500_000
BROADCAST_GROUPS = 100_000
#: Columns whose quantiles are found in one pass.
COLUMNS = 32
#: Different values from which one rank is read off, and parts a larger bracket is cut into.
BRACKET = 50_000
PARTS = 64


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   rows: int | None = None, exact: bool = True,
                   direct_cells: int = DIRECT_CELLS) -> dict[str, list[float | None]]:
    """``{column: [quantile for each prob]}``; all-null columns give None."""
    if not cols:
        return {}
    probs = [float(p) for p in probs]
    rows = df.count() if exact and rows is None else rows
    if not exact or rows * len(cols) <= direct_cells:
        pick = F.percentile if exact else (lambda c, p: F.percentile_approx(c, p, 10_000))
        row = df.agg(*[pick(col(c).cast("double"), probs).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}
    wide = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    if rows <= SPREAD_ROWS:  # three passes over few rows: dealt to all cores once
        wide = cut_lineage(spread(wide, rows))
    out = {}
    for start in range(0, len(cols), COLUMNS):
        names = wide.columns[start:start + COLUMNS]
        out.update(zip(cols[start:start + COLUMNS], _side_by_side(wide.select(*names), probs, rows)))
    return out


def _side_by_side(wide: DataFrame, probs: list[float], rows: int) -> list[list[float | None]]:
    """Exact quantiles of all columns of ``wide`` in three passes; only values inside brackets leave their rows."""
    accuracy, bounds = _sketched(rows, probs)
    names, p = wide.columns, len(probs)
    row = wide.agg(*[x.alias(f"{k}{c}") for c in names for k, x in (
        ("n", F.count(c)), ("a", F.min(c)), ("z", F.max(c)), ("e", F.percentile_approx(c, bounds, accuracy)))]).first()
    edges = []  # per column and quantile: a value not above the rank's, and one not below
    for c in names:
        ends = [row["a" + c], row["z" + c]] * p if row["n" + c] < accuracy else row["e" + c]
        edges.append(list(zip(ends[::2], ends[1::2])) if ends and ends[0] is not None else [])
    below = wide.agg(*[F.count(F.when(F.col(c) < lo, 1)).alias(f"b{i}_{j}") for i, c in enumerate(names) for j, (lo, _) in enumerate(edges[i])],
                     F.lit(0).alias("_")).first()
    held = [F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.struct(F.lit(i * p + j).alias("_k0"), F.col(c).alias("_v")))
            for i, c in enumerate(names) for j, (lo, hi) in enumerate(edges[i])]
    if not held:
        return [[None] * p for _ in names]
    values = wide.select(F.inline(F.filter(F.array(*held), lambda h: h.isNotNull()))).groupBy("_k0", "_v").agg(F.count("*").alias("_c"))
    values = values.select("_k0", "_v", "_c", F.explode(F.array(F.lit(0), F.lit(1))).alias("_j"))
    ranks = []
    for i, c in enumerate(names):
        for j in range(len(edges[i])):
            spot = probs[j] * (row["n" + c] - 1)
            ranks += [(i * p + j, k, at - below[f"b{i}_{j}"]) for k, at in enumerate((math.floor(spot), math.ceil(spot)))]
    ranks = wide.sparkSession.createDataFrame([(a, 0, k, r) for a, k, r in ranks], "w_k0 int, _n long, _j int, _rank long")
    found = {(r["_k0"], r["_j"]): r["_v"] for r in _at_rank(values, ranks, ["_k0"], rows * 8 / accuracy <= BRACKET).collect()}
    out = []
    for i, c in enumerate(names):
        got = []
        for j in range(p):
            if not edges[i]:
                got.append(None)
                continue
            spot = probs[j] * (row["n" + c] - 1)
            a, z, part = found[i * p + j, 0], found[i * p + j, 1], spot - math.floor(spot)
            got.append(a if a == z else a * (1 - part) + z * part)
        out.append(got)
    return out


def _sketched(rows: int, probs: list[float]) -> tuple[int, list[float]]:
    """The accuracy of the sketch, and the probabilities that bracket each of ``probs``."""
    accuracy = 10_000 if rows <= 10**9 else 100_000
    slack = 3 / accuracy
    return accuracy, [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                      rows: int | None = None, direct_cells: int = DIRECT_CELLS,
                      groups: int | None = None) -> DataFrame:
    """One row per group with values: ``by..., n, q`` where ``q`` is the array of quantiles.

    ``groups`` is the largest number of groups there can be, where that is known.
    """
    probs = [float(p) for p in probs]
    data = df.select(*[col(b) for b in by], col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    rows = data.count() if rows is None else rows
    if rows <= direct_cells:
        return data.groupBy(*[col(b) for b in by]).agg(F.count("*").alias("n"), F.percentile("_v", probs).alias("q"))
    accuracy, bounds = _sketched(rows, probs)
    sketch = data.groupBy(*[col(b) for b in by]).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   F.percentile_approx("_v", bounds, accuracy).alias("_e"))
    # in a small group the slack is less than a few ranks, so all of it is kept apart
    small = F.col("_n") < accuracy
    sketch = sketch.select(*[col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_n", *[
        F.when(small, F.col("_max" if i % 2 else "_min")).otherwise(F.get("_e", i)).alias(f"_e{i}")
        for i in range(len(bounds))])
    same = reduce(lambda a, b: a & b, [col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)])
    known = groups is not None and groups <= BROADCAST_GROUPS
    near = data.join(F.broadcast(sketch) if known else broadcast_if_small(sketch), same)
    v, edges = F.col("_v"), [F.col(f"_e{i}") for i in range(len(bounds))]
    inside = reduce(lambda a, b: a | b, [(v >= lo) & (v <= hi) for lo, hi in zip(edges[::2], edges[1::2])])
    # place among the edges tells the gaps between brackets apart; all values of a gap share one entry
    place = sum(((v > e).cast("int") for e in edges), F.lit(0))
    names = [f"_k{i}" for i in range(len(by))]
    counts = (near.select(*[col(b).alias(k) for b, k in zip(by, names)], "_n", *edges, place.alias("_p"), v.alias("_x"), F.when(inside, v).alias("_v"))
              .groupBy(*names, "_n", *edges, "_p", "_v").agg(F.count("*").alias("_c"), F.min("_x").alias("_first")))
    # values between two edges of a bracket are at most this many, by the sketch's error
    bounded = rows * 8 / accuracy <= BRACKET
    if not bounded:
        counts = cut_lineage(counts)
    below = counts.groupBy(*names, "_n").agg(*[
        F.sum(F.when(F.col("_first") < lo, F.col("_c")).otherwise(0)).alias(f"_b{i}") for i, lo in enumerate(edges[::2])])
    ranks = []
    for i, p in enumerate(probs):
        spot = F.lit(p) * (F.col("_n") - 1)
        ranks += [F.struct(F.lit(2 * i + j).alias("_j"), (at - F.col(f"_b{i}")).alias("_rank")) for j, at in enumerate((F.floor(spot), F.ceil(spot)))]
    ranks = below.select(*[F.col(k).alias("w" + k) for k in names], "_n", F.inline(F.array(*ranks)))
    holds = [F.when((F.col("_v") >= lo) & (F.col("_v") <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges[::2], edges[1::2])) for _ in (0, 1)]
    values = counts.filter("_v IS NOT NULL").select(*names, "_v", "_c", F.posexplode(F.array(*holds)).alias("_j", "_in")).filter("_in IS NOT NULL").drop("_in")
    picked = _at_rank(values, ranks, names, bounded)
    got = picked.groupBy(*names).agg(*[F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(f"_q{j}") for j in range(2 * len(probs))])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("s" + k)) for k in names])
    total = below.select(*[F.col(k).alias("s" + k) for k in names], "_n")
    found = total.join(got, same, "left")
    out = []
    for i, p in enumerate(probs):
        part = F.lit(p) * (F.col("_n") - 1)
        part = part - F.floor(part)
        a, z = [F.coalesce(f"_q{j}", F.raise_error(F.lit("rank outside its bracket")).cast("double")) for j in (2 * i, 2 * i + 1)]
        out.append(F.when(a == z, a).otherwise(a * (1 - part) + z * part))
    return found.select(*[F.col("s" + k).alias(b) for k, b in zip(names, by)], F.col("_n").alias("n"), F.array(*out).alias("q"))


def _at_rank(values: DataFrame, ranks: DataFrame, names: Sequence[str], bounded: bool) -> DataFrame:
    """names, _j, _v: of the different values (names, _j, _v, count _c) the one at ``_rank`` (from 0, copies counted)."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("w" + k)) for k in names] + [F.col("_j") == F.col("wj")])
    wanted = ranks.withColumnRenamed("_j", "wj").drop("_n")
    while not bounded:
        values = cut_lineage(values)
        sizes = values.groupBy(*names, "_j").agg(F.count("*").alias("_many"), F.percentile_approx(
            "_v", [s / PARTS for s in range(1, PARTS)], 100 * PARTS).alias("_cuts"))
        if (sizes.agg(F.max("_many")).first()[0] or 0) <= BRACKET:
            break
        wanted = cut_lineage(wanted)
        cut = sizes.select(*[F.col(k).alias("c" + k) for k in names], F.col("_j").alias("cj"), F.when(
            F.col("_many") > BRACKET, F.array_distinct("_cuts")).otherwise(F.array().cast("array<double>")).alias("_cuts"))
        here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("c" + k)) for k in names] + [F.col("_j") == F.col("cj")])
        parted = values.join(broadcast_if_small(cut), here).withColumn("_part", F.size(F.filter("_cuts", lambda e: e < F.col("_v")))) \
            .select(*names, "_j", "_v", "_c", "_part")
        parted = cut_lineage(parted)
        held = parted.groupBy(*names, "_j", "_part").agg(F.sum("_c").alias("_sum"))
        run = W.partitionBy(*names, "_j").orderBy("_part")  # at most PARTS rows
        held = held.withColumn("_before", F.sum("_sum").over(run) - F.col("_sum"))
        chosen = held.join(wanted, same).filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_sum"))) \
            .select(*["w" + k for k in names], "wj", F.col("_part").alias("_one"), (F.col("_rank") - F.col("_before")).alias("_rank"))
        chosen = cut_lineage(chosen)
        values = parted.join(broadcast_if_small(chosen.drop("_rank"), cut=False), same & (F.col("_part") == F.col("_one"))).select(*names, "_j", "_v", "_c")
        wanted = chosen.drop("_one")
    run = W.partitionBy(*names, "_j").orderBy("_v")  # at most BRACKET values
    at = values.withColumn("_hi", F.sum("_c").over(run)).join(wanted, same)
    return at.filter((F.col("_hi") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_hi"))).select(*names, "_j", "_v")
