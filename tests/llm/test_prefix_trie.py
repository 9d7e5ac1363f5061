"""The prefix trie against plain loops over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableprep.llm import prefix_trie as pt
from tableprep.llm.queries import op13_prefix_trie

from helpers import FOLDER, HAVE

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string, at int, id int, slice string, `a.b` int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "s", 3) for r in rows], SCHEMA)


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    lead = lambda c: zlib.crc32(str(c).encode()) % 4 if rebuild else 0
    base = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    whole = {c: tuple(own.get(base(c), [])[:lead(c)] + t[lead(c):]) for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += worth
            leaves[path[:d]] += children[path] == 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), whole


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def found(spark, rows, rebuild=True):
    lead = {"lead": F.crc32(F.col("conv").cast("string")) % 4, "base": F.col("conv") - F.col("conv") % 20} if rebuild else {}
    return sorted((tuple(r) for r in pt.prefix_trie(turns(spark, rows), **lead).collect()), key=key)


def check(spark, rows, rebuild=True):
    assert found(spark, rows, rebuild) == sorted(brute(rows, rebuild)[0], key=key)


def some(seed, convs, words=("a b", "c", "", "d\te  f")):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(words)) for c in range(convs) for t in range(rnd.randrange(1, 7))]


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_all_prefixes(spark, rebuild):
    check(spark, some(1, 150), rebuild)


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = some(2, 40) + [(None, 0, "user", "x"), (50, None, None, None), (50, 3, "user", "z"), (50, 3, "user", "y"), (50, 3, "assistant", "z"),
                          (50, 3, "user", "y"), (-7, 0, "user", "n"), (-20, 1, "user", "m"), (-20, 2, None, "k\x0b\x0cl\x1cm"), (45, None, "user", "b"), (45, None, "user", "a")]
    check(spark, rows)
    check(spark, rows, False)


def test_long_chain_and_turnless_conversations(spark):
    chain = [(60, t, "user", f"w {t}") for t in range(300)] + [(80, t, "user", f"w {t}") for t in range(300) if t != 150]
    short = [(c, 0, "user", "only") for c in range(1, 20)]  # their base is absent: some are left without turns
    check(spark, chain + short)
    assert any(not t for t in brute(chain + short)[1].values())


def test_hot_nodes(spark, monkeypatch):
    same = [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]
    wide = [(c, t, "user", "hello" if t == 0 else f"own {c}") for c in range(2000, 2400) for t in range(2)]
    check(spark, same + wide)
    monkeypatch.setattr(pt, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(pt, "HEAVY", 1)
    monkeypatch.setattr(pt, "PIECE", 50)
    check(spark, same + wide)


def test_very_long_text(spark):
    check(spark, [(1, 0, "user", "word " * 200_000), (2, 0, "user", "word " * 200_000)], False)


def test_empty(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_contraction(spark, shape):
    rnd = random.Random(4)
    n = 400
    parent = [None] + [{"chain": i - 1, "star": 0, "random": rnd.randrange(i), "comb": i - 1 if i % 2 else max(0, i - 2)}[shape] for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    x, y = [rnd.randrange(100) for _ in range(n)], [rnd.randrange(5) for _ in range(n)]
    total = {i: [x[i], y[i]] for i in range(n)}
    for i in range(n - 1, 0, -1):
        total[parent[i]][0] += total[i][0]
        total[parent[i]][1] += total[i][1]
    tree = spark.createDataFrame(list(zip(range(n), parent, depth, x, y)), "id long, parent long, depth long, x long, y long")
    got = {r.id: [r.x, r.y] for r in pt.subtree_totals(tree, ["x", "y"]).collect()}
    assert got == total


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in op13_prefix_trie(spark, FOLDER).collect()), key=key) == sorted(brute(rows)[0], key=key)
