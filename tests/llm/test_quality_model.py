import numpy as np
import pytest
from helpers import FOLDER, HAVE, documents
from pyspark.sql import functions as F

from tableprep.llm import ngrams, quality_model as qm

GOOD, BAD = "the river runs north through green fields of stone", "BUY!! NOW!! $$$ CLICK!! HERE!! FREE!! $$$ WIN!!"


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice((GOOD if i % 4 else BAD).split(), 30))) for i in range(80)]
    labels = [(i, int(i % 4 > 0)) for i in range(80)] + [(None, 1), (500, 0), (3, None), (2, 7)]
    return qm.learn(documents(spark, rows + [(200, None)]), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_scores(spark, model):
    rows = [(1, GOOD), (2, BAD), (3, None), (4, ""), (5, GOOD * 20_000), (None, GOOD), (1, GOOD)]
    got = documents(spark, rows, False).select("doc_id", qm.score(F.col("text"), model).alias("s")).collect()
    assert got[0]["s"] > 0.9 > 0.1 > got[1]["s"] and got[2]["s"] == got[3]["s"] and got[4]["s"] > 0.9
    assert got[5]["s"] == got[0]["s"] == got[6]["s"] and all(0 <= r["s"] <= 1 for r in got)


def test_training_repeats(spark, model):
    bags = [qm.bag(t) for t in (GOOD, BAD) * 5]
    a, b = (qm.train(bags, np.array([1, 0] * 5)) for _ in range(2))
    assert (a["bucket"] == b["bucket"]).all() and a["bias"] == b["bias"]


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qm.score_text(GOOD, qm.learn(documents(spark, [(1, GOOD)]), none)) == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert qm.score_text(GOOD, qm.learn(documents(spark, [(1, GOOD)]), one)) > 0.9


def test_word_features():
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    words = ngrams.word_hashes(codes(" ab  c\tab\nba "))
    assert len(words) == 4 and words[0] == words[2] and len(set(words.tolist())) == 3
    pairs = ngrams.neighbours(ngrams.word_hashes(codes("x x y y x")))
    assert pairs[0] == pairs[2] and len(set(pairs.tolist())) == 3
    assert len(ngrams.word_hashes(codes(" \n"))) == 0 and len(ngrams.grams(codes("a"), 2, 16)) == 0


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_held_out_accuracy(spark):
    from tableprep.llm.queries import op10_quality, table

    out = op10_quality(spark, FOLDER)
    assert out.count() == table(spark, FOLDER, "documents").count()
    held = out.filter("held_out").join(table(spark, FOLDER, "labels"), "doc_id")
    assert held.filter("quality = predicted").count() >= 0.9 * held.count()
