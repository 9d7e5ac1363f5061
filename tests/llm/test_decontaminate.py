import re

import pytest
from helpers import FOLDER, HAVE, documents

from tableprep.llm.decontaminate import canonical, decontaminate

Q = "A train leaves Berlin at 9 and Maria drives 120 km in 3 hours. How far does Maria drive after Berlin at 9 in total?"
SAME = "A train leaves Paris at 7 and Peter drives 450 km in 2 hours. How far does Peter drive after Paris at 7 in total?"
OTHER = "A train leaves Paris at 7 and Peter drives 450 km in 2 hours. How far does Anna drive after Rome at 8 in total?"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_placeholders(spark):
    df = spark.createDataFrame([(w,) for w in ["the", "Berlin", ". Then", "12.5", "KG", "km", "x2", "2x", "USA", ".\nÉtat"]], "w string")
    from pyspark.sql import functions as F

    assert [r["c"] for r in df.select(canonical(F.col("w")).alias("c")).collect()] == \
        ["the", "<name>", "then", "<num>", "<unit>", "<unit>", "x2", "2x", "usa", "état"]


def test_other_values_are_caught_if_consistent(spark):
    rows = [(1, "Intro. " + SAME + " More words."), (2, OTHER), (3, None), (4, ""), (5, Q.upper()), (6, "x " * 30_000 + Q), (None, Q),
            (7, "Nothing of it at all is here"), (1, "again")]
    out = decontaminate(documents(spark, rows), items(spark, [(7, Q), (7, Q), (8, None), (9, "a b"), (None, Q), (10, "")]))
    got = sorted(((r["doc_id"], r["contaminated"], tuple(r["items"])) for r in out.collect()), key=repr)
    assert got == sorted([(1, True, (7,)), (1, True, (7,)), (2, False, ()), (3, False, ()), (4, False, ()), (5, False, ()),
                          (6, True, (7,)), (None, True, (7,)), (7, False, ())], key=repr)


def test_empty_tables(spark):
    assert decontaminate(documents(spark, []), items(spark, [(1, Q)])).count() == 0
    assert [r["contaminated"] for r in decontaminate(documents(spark, [(1, Q)]), items(spark, [])).collect()] == [False]


def test_join_by_shuffle_is_the_same(spark, monkeypatch):
    docs, known = documents(spark, [(1, SAME), (2, OTHER), (3, Q)]), items(spark, [(7, Q)])
    want = sorted(map(str, decontaminate(docs, known).collect()))
    monkeypatch.setattr("tableprep.llm.decontaminate.BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate(docs, known).collect())) == want


def test_copies_of_short_items_anywhere(spark):
    known = ["What is the capital of France?", "How many legs does a spider have?", "Capital of France?", "Why", "7 + 5 = ?",
             "Anna Berta Clara Dora Emil Fritz Gustav"]
    places = ["{}", "Some text. {} And more.", "Some text\n{}", "He asked, {} so often.", "> {}"]
    rows = [(10 * i + j, p.format(x)) for i, x in enumerate(known) for j, p in enumerate(places)]
    rows += [(90, "Some capital of Spain"), (91, "8 + 5 = ?"), (92, "Anna Berta Carl Dora Egon Fritz Gustav"), (93, "the capitals of france")]
    for some in (known, known[:2]):
        out = decontaminate(documents(spark, rows), items(spark, list(enumerate(some)))).collect()
        assert all(r["contaminated"] == (r["doc_id"] < 10 * len(some)) for r in out)
        assert all(r["doc_id"] // 10 in r["items"] for r in out if r["contaminated"])


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_query_against_word_windows(spark):
    from tableprep.llm.queries import op4_decontaminate, table

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    bench = {}
    for r in table(spark, FOLDER, "benchmark").collect():
        w = words(r["text"])
        bench[r["item_id"]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = {}
    for r in table(spark, FOLDER, "documents").collect():
        w = words(r["text"])
        have = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        want[r["doc_id"]] = sorted(i for i, b in bench.items() if b and len(b & have) >= 0.8 * len(b))
    got = {r["doc_id"]: list(r["items"]) for r in op4_decontaminate(spark, FOLDER).collect()}
    assert got == {i: v for i, v in want.items() if v} and got
