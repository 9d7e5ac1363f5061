import numpy as np
import pytest
from helpers import FOLDER, HAVE, documents
from pyspark.sql import functions as F

from tableprep.llm import langid

TEXTS = {"en": "the house and the river are in the north of this country",
         "de": "das haus und der fluss sind im norden von diesem land über",
         "fr": "la maison et la rivière sont dans le nord de ce pays où"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TEXTS[c].split())), c) for i, c in enumerate(list(TEXTS) * 15)]
    rows += [(100, None, "en"), (101, "1 2 3", "de"), (None, "x", "xx"), (102, "the", None)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(k)
        distance = (code.shape[1] - code @ code.T) / 2
        assert distance[~np.eye(k, dtype=bool)].min() >= (1 if k < 4 else 3 if k < 9 else 4)
        assert (np.abs(code.sum(0)) < k).all()


def test_predictions(spark, model):
    assert model["langs"] == ["de", "en", "fr"]
    rows = [(1, "the north of the country"), (2, "der norden von diesem haus"), (3, "le nord de la maison"), (4, None), (5, ""),
            (6, "12 ... !"), (7, "the " * 100_000), (None, "the north of the country"), (1, "the north of the country")]
    out = langid.identify(documents(spark, rows), model)
    assert out.columns[:4] == ["doc_id", "text", "TEXT", "key"] and out.columns[-3:] == ["lang_pred", "score", "ambiguous"]
    got = [(r[0], r["lang_pred"]) for r in out.select("doc_id", "lang_pred").collect()]
    assert got == [(1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (None, "en"), (1, "en")]
    assert out.filter("score < 0 OR score > 1").count() == 0
    assert langid.identify(documents(spark, []), model).count() == 0


def test_a_text_between_languages_is_flagged(model):
    level = {**model, "w": np.zeros_like(model["w"]), "b": np.zeros_like(model["b"])}
    _, score, unclear = langid.decode(langid.vector(TEXTS["en"]), level)
    assert unclear and score == pytest.approx(1 / 3)
    assert not langid.decode(langid.vector(TEXTS["en"]), model)[2]


def test_without_or_with_one_language(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(documents(spark, [(1, "the")]), langid.learn(empty)).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    assert langid.identify(documents(spark, [(1, "the")]), langid.learn(one)).first()["lang_pred"] == "en"


def test_blocks_do_not_change_a_vector(monkeypatch):
    text = " ".join(TEXTS.values()) * 3
    whole = langid.vector(text)
    monkeypatch.setattr("tableprep.llm.ngrams.BLOCK", 1 << 30)
    assert np.allclose(whole, langid.vector(text))


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_held_out_accuracy(spark):
    from tableprep.llm.queries import op2_language, table

    out = op2_language(spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out")
    assert out.count() == table(spark, FOLDER, "documents").count()
    assert held.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * held.count()
