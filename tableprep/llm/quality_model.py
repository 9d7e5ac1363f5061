"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, word pairs and
character n-grams;
a softmax over the classes reads that average. Vectors and softmax are trained
together by stochastic gradient descent in numpy.

Training uses a bounded sample: at most ``SAMPLE`` labelled documents of each class,
the first by a hash of their key, reduced on the executors to (bucket, count) pairs of
at most 2 ** ``BITS`` buckets. The output is shifted to the classes' shares among all
labelled rows. Scoring reads every whole text in blocks: since the softmax is linear
in the average, each bucket has one number and a text's score is their mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import pick, small_batches

BITS, ORDERS, DIMS = 16, (2, 3, 4), 8
SAMPLE = 1500
EPOCHS, RATE, VECTOR_RATE = 12, 0.5, 0.2


def features(text: str | None):
    """Buckets of all words, neighbouring words and n-grams, a block at a time; upper and lower case differ."""
    for codes in ngrams.blocks(text or "", max(ORDERS) - 1):
        found = ngrams.word_hashes(codes)
        yield ngrams.top(found, BITS)
        yield ngrams.top(ngrams.neighbours(found), BITS)
        for order in ORDERS:
            yield ngrams.grams(codes, order, BITS)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and their shares."""
    counts = np.zeros(1 << BITS)
    for some in features(text):
        counts += np.bincount(some, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(counts.sum(), 1)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3, epochs: int = EPOCHS, rate: float = RATE) -> dict:
    """Vectors and softmax for two classes; returns one number per bucket and the bias."""
    rng = np.random.default_rng(seed)
    e = ((rng.random((1 << BITS, DIMS)) - 0.5) / DIMS).astype(np.float32)
    w, b = (0.1 * rng.standard_normal((2, DIMS))).astype(np.float32), np.zeros(2, np.float32)
    steps, step = epochs * max(len(bags), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - step / steps)
            step += 1
            at, share = bags[i]
            v = share @ e[at] if len(at) else np.zeros(DIMS, np.float32)
            z = w @ v + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ w
            w -= lr * np.outer(p, v)
            b -= lr * 0.1 * p
            if len(at):
                # a text's buckets share its step; scaled so that the average moves by the rate
                e[at] -= (lr / max(float(share @ share), 1e-6)) * share[:, None] * np.clip(back, -1, 1) * VECTOR_RATE
    return {"bucket": (e @ (w[1] - w[0])).astype(np.float32), "bias": float(b[1] - b[0])}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
          sample: int = SAMPLE) -> dict:
    """A model from labelled documents; null keys, labels other than 0 and 1, and null texts teach nothing.

    Without both classes every score is the share of class 1 (0.5 without labels).
    """
    small_batches(docs)
    known = pick(labels, key=key, y=quality).filter("key IS NOT NULL AND y IN (0, 1)").distinct()
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return {"bucket": np.zeros(1 << BITS, np.float32), "bias": {(): 0.0, (0,): -9.0, (1,): 9.0}[tuple(n)]}
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(sample)
        chosen = some if chosen is None else chosen.union(some)

    @F.pandas_udf("at binary, share binary")
    def reduced(texts):
        import pandas as pd

        got = [bag(t) for t in texts]
        return pd.DataFrame({"at": [a.astype("<u4").tobytes() for a, _ in got], "share": [s.tobytes() for _, s in got]})

    # at most two classes times ``sample`` keys
    rows = pick(docs, key=key, text=text).join(F.broadcast(chosen), "key") \
        .select("key", "y", reduced(F.coalesce("text", F.lit(""))).alias("x")).collect()
    rows.sort(key=lambda r: (str(r["key"]), r["y"]))
    y = np.array([r["y"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return {"bucket": np.zeros(1 << BITS, np.float32), "bias": float(np.log(n[1] / n[0]))}
    model = train([(np.frombuffer(r["x"]["at"], "<u4").astype(np.int64), np.frombuffer(r["x"]["share"], np.float32)) for r in rows], y)
    model["bias"] += float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_text(text: str | None, model: dict) -> float:
    """Probability of class 1; an empty text is scored by the bias alone."""
    total, n = 0.0, 0
    for some in features(text):
        total, n = total + float(model["bucket"][some].sum(dtype=np.float64)), n + len(some)
    return float(1 / (1 + np.exp(-np.clip(model["bias"] + total / max(n, 1), -40, 40))))


def score(text: Column, model: dict) -> Column:
    """The score of a text column; null is empty, equal texts get equal scores."""
    import pandas as pd

    @F.pandas_udf("double")
    def of(texts):
        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return of(F.coalesce(text, F.lit("")))
