import re

import corpus_pipeline as pipeline
import pytest
from helpers import FOLDER, HAVE
from test_line_dedup import brute
from test_simhash import brute_print, groups

from tableprep.llm.common import stored, table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river house north over small light green water stone field long road under with many old new".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def story(n, step=1):
    return " ".join(WORDS[(i * i * step + i + step) % len(WORDS)] + (f"x{i % 7}" if i % 3 == 0 else "") for i in range(n))


def test_languages(spark):
    found = pipeline.keep_languages(spark, docs(spark, [(1, story(30)), (2, None), (3, "12 34 !"), (4, "the house"), (5, "")]), FOLDER)
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 4] and found.columns == COLUMNS.replace(",", "").split()[::2]


def test_lines(spark):
    rows = [(1, story(60) + "\n" + story(20, 2)), (2, story(60)), (3, "tiny\n" + story(60) + "\nand an own line of words"), (4, None)]
    found = {r["doc_id"]: r for r in pipeline.drop_lines(spark, docs(spark, rows), FOLDER).collect()}
    want = brute(rows)
    assert set(found) == {1, 3, 4} and all(found[i]["text"] == want[i] for i in found)
    assert found[3]["n_chars"] == len(want[3])


def test_near_duplicates(spark):
    rows = [(i, story(200 + i // 3, 1 + i // 3)) for i in range(12)] + [(50, story(200) + " end"), (None, story(200)), (60, None)]
    found = sorted(str(r["doc_id"]) for r in pipeline.drop_near_duplicates(spark, docs(spark, rows), FOLDER).collect())
    known = [(i, t) for i, t in rows if i is not None]
    label = groups([brute_print(t) for _, t in known])
    assert found == sorted([str(known[i][0]) for i in set(label)] + ["None"])


def test_near_duplicates_of_repeated_ids(spark):
    one, two = story(200), story(150, 5)
    rows = [(1, one), (1, one), (2, two), (2, one + " end"), (3, two), (4, story(90, 3)), (4, story(90, 3))]
    found = pipeline.drop_near_duplicates(spark, docs(spark, rows), FOLDER)
    label = groups([brute_print(t) for _, t in rows])
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted(rows[i] for i in set(label))


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_the_given_documents(spark):
    """Every stage on what the one before kept, each against a plain version."""
    now = table(spark, FOLDER, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stored(stage(spark, now, FOLDER), name)
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == table(spark, FOLDER, "documents").columns and set(after) <= set(before) and after
        if name == "language_id":
            assert set(after) == {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        if name == "near_duplicates":
            ids = sorted(before)
            label = groups([brute_print(before[i]) for i in ids])
            assert set(after) == {ids[i] for i in set(label)}
        if name != "line_dedup":
            assert all(after[i] == before[i] for i in after)
    packed = stored(pipeline.pack(spark, now, FOLDER), "packed")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


CLASHES = ["DOC_ID", "gone_id", "gone", "key", "row", "component_id", "contaminated", "score", "lang_pred", "n_lines", "a.b"]


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_clashing_columns_pass_every_filter(spark):
    rows = [(1, story(60)), (2, story(60)), (3, story(80, 3)), (None, story(70, 5)), (4, None), (5, "")]
    plain = docs(spark, rows)
    wide = plain.toDF(*[f"c{i}" for i in range(5)])
    wide = wide.selectExpr("*", *[f"'{c}' AS x{i}" for i, c in enumerate(CLASHES)]).toDF(*plain.columns, *CLASHES)
    for _, stage in pipeline.STAGES[:-1]:
        want = sorted(str(tuple(r)) for r in stage(spark, plain, FOLDER).collect())
        out = stage(spark, wide, FOLDER)
        assert out.columns == [*plain.columns, *CLASHES]
        found = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
        assert {tuple(r)[5:] for r in found} <= {tuple(CLASHES)}
        assert sorted(str(tuple(r)[:5]) for r in found) == want


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_empty_documents_pass_every_stage(spark):
    now = docs(spark, [])
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, FOLDER)
        assert now.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
