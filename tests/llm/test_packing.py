import zlib

import numpy as np
import pytest
from helpers import documents

from tableprep.llm import packing
from tableprep.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_encoder_equals_the_tokenizer(model, monkeypatch):
    packing._encoders.clear()
    monkeypatch.setattr(packing, "MEMORY", 3)
    monkeypatch.setattr(packing, "SLICE", 7)
    encode = packing.encoder(word_tokenizer())
    texts = ["", None, "Hello  World\n\tit's naïve", "a b c \x1f d", "<|endoftext|> x<|startoftext|>y", "é ́e ﬁ İ ΣΑΣ 1234 🙂",
                 "tabs\tand\r\nlines", "don't 'stop we'll", "x" * 500, "the end. the END, of it"]
    for text, got in zip(texts * 2, encode(texts * 2)):
        want = model.encode(text or "", add_special_tokens=False).ids + [packing.END]
        assert np.frombuffer(got, "<u2").tolist() == want, text


def test_words_share_the_ids_of_their_letters(model, monkeypatch):
    import tokenizers

    given = []

    class Counting:
        def __init__(self, path):
            self.own = model

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return self.own.encode_batch_fast(texts, **more)

    Counting.from_file = Counting
    packing._encoders.clear()
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("aeiounrstlé\u00e7\u00df"), 9)) for _ in range(400)]
    texts = [" ".join(f(x) + end for x in stems) for f in (str, str.capitalize) for end in ("", ",", ".", "***", "!?", "'", "'s")]
    texts += ["\u00c9A\u00d6\u00dd\u00ff. \u00b5m, \u00d7y \u00f7z A\u0301b.", "it's. don't' <|endoftext|>. a<|endoftext|>"]
    encode = packing.encoder(word_tokenizer())
    packing._encoders.clear()
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == model.encode(text, add_special_tokens=False).ids + [packing.END], text
    # letters go to the tokenizer once, not for each case and sign; apostrophes are left to it
    assert sum(map(len, given)) < 2 * sum(map(len, stems)) + sum(len(t) for t in texts if "'" in t)


def test_hilbert_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_tails_are_powers_of_two():
    assert list(packing.lengths(1000)) == [512, 256, 128, 64, 32, 8] and list(packing.lengths(0)) == []
    rows = [(i, np.arange(n, dtype="<u2").tobytes()) for i, n in enumerate([5, 30, 1, 7, 16, 3])]
    out = list(packing.cut_stream(iter(rows), 16))
    size = {}
    for *_, length, _, _, number, offset in [(p[0], p[1], p[2], p[3], p[4], p[5], p[6]) for p in out]:
        assert offset == size.get(number, 0)
        size[number] = offset + length
    assert sorted(size.values()) == [2, 4, 8, 16, 16, 16]


def test_pieces_cover_every_document_once(spark, model):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice("the river house naïve 12 stone,".split(), n)) for n in rng.integers(0, 900, 60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "long " * 20_000)]
    out = packing.pack(documents(spark, rows), word_tokenizer(), length=64, ranges=3).toPandas()
    assert list(out.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for i, text in rows:
        ids, at = model.encode(text or "", add_special_tokens=False).ids + [packing.END], 0
        for p in out[out.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        total = s.length.sum()
        assert total <= 64 and total & (total - 1) == 0


def test_nulls_copies_and_empty_tables(spark):
    out = packing.pack(documents(spark, [(None, "a"), (5, "a b"), (5, "a b")]), word_tokenizer(), ranges=2).collect()
    assert sorted(str(r["doc_id"]) for r in out if r["start"] == 0) == ["5", "5", "None"]
    assert sum(r["length"] for r in out) == 2 + 3 + 3
    assert packing.pack(documents(spark, []), word_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), word_tokenizer(), length=100)
