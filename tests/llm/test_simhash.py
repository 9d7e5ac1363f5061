import random
import re

import numpy as np
import xxhash
from helpers import documents

from tableprep.llm.graph import components
from tableprep.llm.simhash import fingerprint, forest, links, near_duplicates


def brute_print(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, near=3):
    left, label = set(range(len(prints))), {}
    while left:
        todo = [min(left)]
        first = todo[0]
        left.discard(first)
        while todo:
            i = todo.pop()
            label[i] = first
            hit = [j for j in left if (prints[i] ^ prints[j]).bit_count() <= near]
            left -= set(hit)
            todo += hit
    return [label[i] for i in range(len(prints))]


def test_fingerprints():
    for text in [None, "", " \n", "One", "one TWO", "a b c", "É é a b x", "w " * 5000, "some words of a text that is a bit longer\nthan others"]:
        assert np.uint64(np.int64(fingerprint(text))) == brute_print(text)


def test_components_of_documents(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(1, 300))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            texts.append(" ".join(c))
    texts += [None, "", "  ", texts[0].upper(), texts[1]]
    prints = [brute_print(t) for t in texts]
    ids = [3 * i + 10 for i in range(len(texts))]
    label = groups(prints)
    assert len(set(label)) < len(set(prints))  # some links join different texts
    want = {ids[i]: (f"{prints[i]:016x}", ids[label[i]]) for i in range(len(texts))}
    for run in (20_000, 3):
        out = near_duplicates(documents(spark, list(zip(ids, texts))), run=run)
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out.collect()} == want


def test_null_keys_and_empty_tables(spark):
    out = near_duplicates(documents(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "only here it is")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in out), key=repr) == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_links_join_all_that_are_near(spark):
    rng = np.random.default_rng(8)
    some = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for x in some for k in (1, 2, 3, 4)]
    nodes = np.unique(np.concatenate([some, np.array(near, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in nodes.view(np.int64)], "fp long")
    label = groups([int(x) for x in nodes])
    for run in (20_000, 2):
        found = {r["node"]: r["label"] for r in components(links(frame, run)).collect()}
        got = {}
        for x, g in zip(nodes.view(np.int64), label):
            got.setdefault(found.get(int(x), int(x)), set()).add(g)
        assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(label))


def test_forest_spans(spark):
    x = np.array([0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) + 7], np.uint64)
    assert len(forest(x)) == 7
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    assert {r["node"]: r["label"] for r in components(chain).collect()} == {**{i: 0 for i in range(1, 31)}, 101: 100}
    assert components(chain.limit(0)).count() == 0
