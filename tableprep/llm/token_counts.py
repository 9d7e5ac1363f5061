"""Token counts by a linear longest-match automaton.

The vocabulary has pieces that begin a word and pieces that continue one. Greedy
longest match cuts a word into the longest piece that fits, again and again. Here the
pieces are a trie over bytes; each node has a failure link, the node that is reached
once the pieces are taken off that can be taken for sure, and the number of pieces
taken off on the way. So a word is read once from left to right, no piece is built,
and the count is the sum of the numbers on the links.

A word that cannot be cut whole counts as one unknown token.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

#: Words whose count a worker remembers; the memory is emptied when it is full.
MEMORY = 500_000
_counters: dict[str, "Counter"] = {}


class Automaton:
    """Counts of greedy longest-match pieces of words, from the pieces as bytes."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        # node 0 begins a word, node 1 continues it; a step is keyed by node * 256 + byte
        self.step: dict[int, int] = {}
        ends, parents = {}, [(0, 0), (0, 0)]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for b in piece:
                    to = self.step.get(at << 8 | b)
                    if to is None:
                        to = self.step[at << 8 | b] = len(parents)
                        parents.append((at, b))
                    at = to
                if at != root:
                    ends[at] = True
        self.fail, self.popped = [-1] * len(parents), [0] * len(parents)
        depth = [0, 0]
        for at, _ in parents[2:]:
            depth.append(depth[at] + 1)
        # a node's link leads to a shallower node, so parents and links are ready
        for node in sorted(range(2, len(parents)), key=depth.__getitem__):
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
                continue
            at, b = parents[node]
            to, n = self.fail[at], self.popped[at]
            while to >= 0 and (to << 8 | b) not in self.step:
                n += self.popped[to]
                to = self.fail[to]
            if to >= 0:
                self.fail[node], self.popped[node] = self.step[to << 8 | b], n

    def count(self, word: bytes) -> int:
        """Number of pieces; -1 if the word cannot be cut whole, 0 for an empty word."""
        step, fail, popped = self.step, self.fail, self.popped
        at, n = 0, 0
        for b in word:
            to = step.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = step.get(at << 8 | b)
            at = to
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


def byte_of_sign() -> dict[str, int]:
    """The printable signs that byte-level vocabularies write for bytes: themselves where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown}
    signs.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return signs


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (with its leading space) and pieces that continue it, from a byte-level JSON vocabulary."""
    data, signs = json.loads(Path(path).read_text(encoding="utf-8")), byte_of_sign()
    special = {t["content"] for t in data.get("added_tokens", ())}
    pieces = [bytes(signs[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Counter:
    """Counts of whole texts: words parted by white space, each read with a space before it."""

    def __init__(self, path: str):
        self.automaton, self.known = Automaton(*read_vocabulary(path)), {}

    def count(self, text: str | None) -> tuple[int, int, int]:
        """n_words, n_tokens, n_unknown."""
        words, known, look = (text or "").encode("utf-8", "surrogatepass").split(), self.known, self.automaton.count
        total = unknown = 0
        for word in words:
            n = known.get(word)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = known[word] = look(b" " + word)
            if n < 0:
                unknown, n = unknown + 1, 1
            total += n
        return len(words), total, unknown


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, made once in each worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counted(text: Column, path: str) -> Column:
    """struct<n_words, n_tokens, n_unknown> of a text column."""
    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def of(texts):
        import pandas as pd

        one = counter(path)
        return pd.DataFrame([one.count(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    return of(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens, n_unknown for every row of ``docs``.

    A null or empty text has none. Rows are counted one by one: repeated rows give
    repeated results, null keys stay null, an empty table gives no rows.
    """
    small_batches(docs)
    found = pick(docs, key=key, text=text).select("key", counted(F.col("text"), path).alias("c"))
    return found.select(F.col("key").alias(key), "c.n_words", "c.n_tokens", "c.n_unknown")
