import random

import public_tokenizers
import pytest
from helpers import documents

from tableprep.llm.token_counts import Automaton, Counter, read_vocabulary, token_counts


def greedy(word, first, later):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, later
    return n


def test_automaton_is_greedy_longest_match():
    rnd = random.Random(2)
    some = lambda most: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, most))).encode()
    for _ in range(300):
        first, later = {some(4) for _ in range(5)}, {some(5) for _ in range(6)}
        automaton = Automaton(first, later)
        for _ in range(60):
            word = "".join(rnd.choice("abcd" if rnd.random() < 0.05 else "abc") for _ in range(rnd.randrange(0, 9))).encode()
            assert automaton.count(word) == greedy(word, first, later), (word, first, later)


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_counts_of_texts(spark, path):
    first, later = map(set, read_vocabulary(path))
    texts = ["Hello world, hello naïve  café\t東京\n", "", None, " \n ", "x" * 5000, "Hello world, hello naïve  café\t東京\n"]
    got = {r["doc_id"]: r for r in token_counts(documents(spark, list(enumerate(texts))), path).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        assert got[i]["n_words"] == len(words)
        assert got[i]["n_tokens"] == sum(greedy(b" " + w, first, later) for w in words)
        assert got[i]["n_unknown"] == 0
    assert token_counts(documents(spark, []), path).count() == 0
    assert token_counts(documents(spark, [(None, "a b")] * 2), path).filter("doc_id IS NULL AND n_words = 2").count() == 2


def test_a_full_memory_changes_nothing(path, monkeypatch):
    one = Counter(path)
    text = " ".join(f"word{i % 7} other{i}" for i in range(50))
    before = one.count(text)
    monkeypatch.setattr("tableprep.llm.token_counts.MEMORY", 3)
    assert Counter(path).count(text) == before
