"""What the tests on text corpora share."""

import os
import random

FOLDER = "/root/testdata/sf0.001"
HAVE = os.path.isdir(FOLDER)


def documents(spark, rows, extra=True):
    """A small documents table with columns whose names operators use inside."""
    schema = "doc_id long, text string" + (", TEXT string, key int, n int, gone string, `a.b` int" if extra else "")
    return spark.createDataFrame([(*r, "x", 1, 2, "g", 3) if extra else r for r in rows], schema)


def edited(rnd: random.Random, text: str, n: int, letters: str = "abcdxyzé ") -> str:
    """``text`` after n random edits."""
    for _ in range(n):
        i, k = rnd.randrange(len(text) + 1), rnd.random()
        if k < 0.33:
            text = text[:i] + rnd.choice(letters) + text[i:]
        elif k < 0.66:
            text = text[:i] + text[i + 1:]
        else:
            text = text[:i] + rnd.choice(letters) + text[i + 1:]
    return text
