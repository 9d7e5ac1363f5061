import random

import pytest
from helpers import documents, edited

from tableprep.llm.line_dedup import cuts, dedup_lines, later_lines, places, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_within():
    rnd = random.Random(1)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9)))
        b = edited(rnd, a, rnd.randrange(5), "abc")
        for e in (1, 2, 3):
            assert within(a, b, e) == (distance(a, b) <= e), (a, b, e)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_key(edits):
    rnd = random.Random(2)
    for _ in range(2000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(8, 30)))
        b = edited(rnd, a, edits, "abc")
        if distance(a, b) > edits:
            continue
        a, b = sorted((a, b), key=len)  # the longer one looks up
        own = {(i, a[at:at + n]) for i, (at, n) in enumerate(cuts(len(a), edits))}
        keys = {(i, b[at:at + n]) for i, at, n in places(len(b), len(a), edits)}
        back = {(i, a[at:at + n]) for i, at, n in places(len(a), len(b), edits)} if len(a) == len(b) else set()
        other = {(i, b[at:at + n]) for i, (at, n) in enumerate(cuts(len(b), edits))}
        assert own & keys or (len(a) == len(b) and (own & other or other & back)), (a, b)


def test_order_decides_which_line_stays():
    lines = ["x" * 50, "x" * 49 + "y", "z" * 50]
    assert later_lines(lines, ["2", "1", "3"], 2).tolist() == [True, False, False]


def brute(docs):
    place = lambda i, j: (i is not None, i or 0, j)
    order = sorted({(place(i, j), x) for i, t in docs if t is not None for j, x in enumerate(t.split("\n"))})
    seen, gone = [], set()
    for at, x in order:
        if len(x.strip(" ")) < 10:
            continue
        if x in seen or len(x) >= 40 and any(len(y) >= 40 and distance(x, y) <= 2 for y in seen):
            gone.add(at)
        if x not in seen:
            seen.append(x)
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if place(i, j) not in gone) for i, t in docs}


@pytest.mark.parametrize("run", [2000, 5])
def test_documents_equal_brute_force(spark, run):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ijk") for _ in range(rnd.randrange(36, 70))) for _ in range(12)]
    pool = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3, 4])) for _ in range(90)] + ["short line", "short lin", "tiny", "", " " * 60]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 5)))) for i in range(-5, 40)]
    docs += [(None, pool[0] + "\n" + pool[1]), (70, None), (71, "")]
    out = dedup_lines(documents(spark, docs), run=run)
    assert out.columns == ["doc_id", "text", "TEXT", "key", "n", "gone", "a.b", "n_lines", "n_dropped"]
    rows = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
    assert {r["c0"]: r["c1"] for r in rows} == brute(docs)
    for r in rows:
        assert r["c8"] == r["c7"] - len((r["c1"] or "").split("\n")) * bool(r["c7"]) or r["c8"] == r["c7"]


def test_empty_table_copies_and_long_lines(spark):
    assert dedup_lines(documents(spark, [])).count() == 0
    long = "ab" * 20_000
    rows = dedup_lines(documents(spark, [(1, long), (2, long + "c"), (3, "b" + long), (4, "ba" * 20_010), (1, long)], False)).collect()
    assert sorted((r["doc_id"], len(r["text"]), r["n_dropped"]) for r in rows) == \
        [(1, 40_000, 0), (1, 40_000, 0), (2, 0, 1), (3, 0, 1), (4, 40_020, 0)]
    text_keys = spark.createDataFrame([("b", "one line of text"), ("a", "one line of text")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in dedup_lines(text_keys).collect()) == [("a", 0), ("b", 1)]


def test_documents_meet_their_lines_by_shuffle_at_any_size(spark, capsys):
    docs = [(i, f"a line that all share\nline {i} that stays for good, number {(i or 0) ** 2 * 977}") for i in [*range(5), 3, None, None]]
    out = dedup_lines(documents(spark, docs, False))
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2  # the two sieves
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in out.collect()) == \
        [("0", 1), ("1", 1), ("2", 1), ("3", 1), ("3", 1), ("4", 1), ("None", 0), ("None", 0)]


def test_short_lines_with_one_edit_go(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefgh ijk") for _ in range(n)) for n in (*range(18, 42), 39, 39, 40, 40)]
    pool = [edited(rnd, x, k, "abcxyz") for x in base for k in (0, 1, 1, 2)]
    rnd.shuffle(pool)
    seen, want = [], {}
    for i, x in enumerate(pool):
        free = lambda y: 2 if min(len(x), len(y)) >= 40 else 1 if min(len(x), len(y)) >= 20 else 0
        want[i] = len(x.strip(" ")) >= 10 and any(distance(x, y) <= free(y) for y in seen)
        seen.append(x)
    assert any(want[i] for i, x in enumerate(pool) if len(x) < 39)
    for run in (2000, 3):
        out = dedup_lines(documents(spark, list(enumerate(pool)), False), run=run).collect()
        assert {r["doc_id"]: bool(r["n_dropped"]) for r in out} == want
