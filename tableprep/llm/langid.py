"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for every bit a binary classifier (logistic
regression over hashed character n-grams of one to three letters) says on which side a
text lies. Decoding adds up, per language, the logistic losses of its bits, each
weighted by how reliable that bit's classifier is, and takes the language of least
loss. The score is the softmax of the negative losses; a text whose two best
languages are closer than ``AMBIGUOUS`` is flagged.

The classifiers learn from a bounded sample: about ``SAMPLE`` labelled documents of
each language (all if there are fewer), chosen by a hash of their key, reduced on the
executors to one vector of 2 ** ``BITS`` half floats each. Prediction reads every whole text in
blocks and uses nothing but the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import pick, small_batches

BITS, ORDERS = 12, (1, 2, 3)
SAMPLE, SAMPLE_TOTAL = 500, 4000
ROUNDS = 80
AMBIGUOUS = 0.2
UNKNOWN = "und"


def vector(text: str | None) -> np.ndarray | None:
    """Root frequencies of the text's letter n-grams, of length one; None without a letter."""
    low, counts, some = (text or "").lower(), np.zeros(1 << BITS), False
    for codes in ngrams.blocks(low, 2):
        letter = ngrams.letters()[codes]
        if not letter.any():
            continue
        some = True
        x = np.where(letter, codes, 32).astype(np.uint32)
        x = np.r_[np.uint32(32), x[letter | np.r_[True, letter[:-1]]], np.uint32(32)]  # one space between words
        for order in ORDERS:
            counts += np.bincount(ngrams.grams(x, order, BITS), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum()).astype(np.float32) if some else None


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of -1 and 1: all different splits for up to five classes, else the best of random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1 if (c == 0 or not b >> (c - 1) & 1) else -1 for b in range(1, 1 << (k - 1))] for c in range(k)], float)
    rng, width = np.random.default_rng(seed), max(15, 6 * int(np.ceil(np.log2(k))))
    best, far = None, -1
    for _ in range(200):
        code = np.where(rng.random((k, width)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(0)) == k).any():
            continue
        distance = (width - code @ code.T) / 2
        nearest = distance[~np.eye(k, dtype=bool)].min()
        if nearest > far:
            best, far = code, nearest
    return best


def fit(x: np.ndarray, labels: list[str], seed: int = 5) -> dict:
    """Classifiers and codewords from vectors and their languages."""
    langs = sorted(set(labels))
    code = codewords(len(langs), seed)
    y = np.array([langs.index(v) for v in labels], int)
    if len(langs) < 2:
        return {"langs": langs, "code": code, "w": np.zeros((x.shape[1], code.shape[1]), np.float32),
                "b": np.ones(code.shape[1], np.float32), "trust": np.ones(code.shape[1])}
    weight = (1 / np.bincount(y))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    target, mean = code[y].astype(np.float32), (x * weight).sum(0)
    z = x - mean
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed = np.zeros_like(w)
    for _ in range(ROUNDS):
        pull = weight * target / (1 + np.exp(np.clip(target * (z @ w + b), -30, 30)))
        speed = 0.9 * speed + z.T @ pull - 1e-4 * w
        w, b = w + 10 * speed, b + pull.sum(0)
    margin = target * (z @ w + b)
    wrong = (weight * (margin <= 0)).sum(0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    return {"langs": langs, "code": code, "w": w, "b": b - mean @ w, "trust": np.maximum(trust, 0.1) / np.abs(trust).max()}


def decode(x: np.ndarray, model: dict) -> tuple[int, float, bool]:
    """Place of the language, score, ambiguous."""
    margin = x @ model["w"] + model["b"]
    loss = (np.logaddexp(0, -model["code"] * margin) * model["trust"]).sum(1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    best = np.sort(p)[::-1]
    return int(loss.argmin()), float(best[0]), bool(len(best) > 1 and best[0] - best[1] < AMBIGUOUS)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
          total: int = SAMPLE_TOTAL) -> dict:
    """A model from the labelled rows of ``docs``; rows with null language, key or no letter teach nothing.

    About ``sample`` rows of each language, and about ``total`` in all, reach the
    driver; with more languages than ``total`` the sample of each is one row.
    """
    small_batches(docs)
    rows = pick(docs, key=key, text=text, lang=lang).filter("lang IS NOT NULL AND key IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(1, min(sample, total // max(len(counts), 1)))
    if not counts:
        return fit(np.zeros((0, 1 << BITS), np.float32), [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    drawn = (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("lang"))

    @F.pandas_udf("binary")
    def reduced(texts):
        found = texts.map(vector, na_action=None)
        return found.map(lambda v: None if v is None else v.astype(np.float16).tobytes())

    got = rows.filter(drawn).select("lang", reduced("text").alias("x")).filter("x IS NOT NULL").collect()
    got.sort(key=lambda r: (r["lang"], r["x"]))
    return fit(np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), -1)
               if got else np.zeros((0, 1 << BITS), np.float32), [r["lang"] for r in got])


def predict(text: Column, model: dict) -> Column:
    """struct<lang_pred, score, ambiguous> of a text; ``und`` with score 0 without a letter or a model."""
    import pandas as pd

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(texts):
        out = []
        for t in texts:
            x = vector(t) if model["langs"] else None
            if x is None:
                out.append((UNKNOWN, 0.0, False))
            else:
                best, score, unclear = decode(x, model)
                out.append((model["langs"][best], score, unclear))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return of(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous added, row by row.

    Null and empty texts, and those without letters, are ``und``. Equal texts get
    equal results. Other columns stay, whatever their names.
    """
    first = docs.columns.index(text)
    flat = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).withColumn("found", predict(F.col(f"_{first}"), model))
    kept = [F.col(f"_{i}") for i in range(len(docs.columns))]
    return flat.select(*kept, "found.lang_pred", "found.score", "found.ambiguous") \
        .toDF(*docs.columns, "lang_pred", "score", "ambiguous")
