"""Hard negatives against plain loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import hard_negatives as hn
from tableprep.llm.queries import op12_hard_negatives

from helpers import FOLDER, HAVE

SCHEMA = "vec_id long, embedding array<float>, label int, ID string, v int, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def brute(rows, every=100, scale=256, positives=5, negatives=5, low=80, high=100):
    best = {}
    for key, vec, label in rows:
        if key is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        one = (label, [math.floor(scale * float(np.float32(x))) for x in vec])
        best[key] = min(best.get(key, one), one)
    dims = max((len(v) for _, v in best.values()), default=0)
    table = [(k, lab, v + [0] * (dims - len(v))) for k, (lab, v) in best.items()]
    out = []
    for a, label, q in table:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), k, lab == label) for k, lab, v in table if k != a)
        for neg, k, _ in [s for s in scored if s[2]][:positives]:
            p = -neg
            fits = [(-s, other) for s, other, same in scored if not same and low * p <= -100 * s <= high * p]
            out += [(a, k, i + 1, other, p, s) for i, (s, other) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, every=100, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(vectors(spark, rows), F.col("id") % every == 0, **options).collect())


def some(seed, n, dims=6, labels=3, values=None):
    rnd = random.Random(seed)
    value = (lambda: rnd.choice(values)) if values else (lambda: rnd.gauss(0, 1))
    return [(i, [value() for _ in range(dims)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed,values", [(1, None), (2, [0.0, 0.5, 1.0])])
def test_against_all_pairs(spark, seed, values):
    rows = some(seed, 400, values=values)
    assert mined(spark, rows, 20, leaf=7, span=60) == brute(rows, 20)


def test_chunks_of_queries(spark):
    rows = some(3, 300)
    assert mined(spark, rows, 3, chunk=30, leaf=16, span=100) == brute(rows, 3)


def test_rows_left_out_repeated_short_and_equal(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(4, 200, labels=2) + [(None, [1.0] * 6, 1), (300, None, 1), (301, [1.0] * 6, None), (302, [nan] * 6, 1), (303, [1.0, None] + [0.0] * 4, 0),
                                     (304, [inf] * 6, 1), (305, [], 1), (306, [2.0], 0), (20, [0.5] * 6, 0), (20, [0.5] * 6, 0), (40, [0.1] * 6, 1)]
    rows += [(1000 + i, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], i % 2) for i in range(150)]
    assert mined(spark, rows, 20, leaf=16, span=64) == brute(rows, 20)


def test_large_components_stay_exact(spark):
    rows = [(k, [x * 60_000 for x in v], lab) for k, v, lab in some(5, 150)]
    assert mined(spark, rows, 10) == brute(rows, 10)
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(0, [1e30], 0), (1, [1e30], 0)])


def test_empty_tables_and_single_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute([(0, [], 1), (1, [], 1), (2, [], 2)])


def test_boxes_prune():
    """Clusters far apart: boxes outside the window or below the k-th score stay unread, and the result is exact."""
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-400, 400, (40, 8))
    x = np.concatenate([c + rnd.integers(-5, 6, (64, 8)) for c in centres]).astype(float)
    ids, labels = np.arange(len(x)), np.arange(len(x)) % 3
    q = x[::64]
    leaves = [(ids[a:a + 32], labels[a:a + 32], x[a:a + 32]) for a in range(0, len(x), 32)]
    lo, hi = np.stack([m.min(0) for *_, m in leaves]), np.stack([m.max(0) for *_, m in leaves])
    p = (q * q).sum(1)
    search = hn.Search(q, ids[::64], labels[::64], False, 5, np.ceil(0.8 * p), np.floor(0.95 * p))
    search.tree(lo, hi, leaves)
    for i, v in enumerate(q):
        s = x @ v
        fits = (labels != labels[64 * i]) & (s >= np.ceil(0.8 * p[i])) & (s <= np.floor(0.95 * p[i])) & (ids != 64 * i)
        want = sorted(zip(-s[fits], ids[fits]))[:5]
        assert [(-a, b) for a, b in zip(search.scores[i], search.found[i]) if a > search.low] == want
    assert search.opened < search.boxes / 4


def test_tiles_hold_every_row_once():
    x = np.random.default_rng(2).normal(size=(1000, 2))
    tiles = hn._tiles(np.arange(1000), [x[:, 0], x[:, 1]], 30)
    assert sorted(np.concatenate(tiles)) == list(range(1000)) and max(map(len, tiles)) <= 30


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label)
            for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, FOLDER).collect()) == brute(rows)
