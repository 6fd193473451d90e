import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: Columns that operators use inside; a caller may have them too.
CLASHES = ("id", "blk", "bucket", "n", "node", "key", "h", "h1", "dk", "pos", "line", "counts", "least", "host", "host_rate", "first", "digest", "k", "y", "flags", "kept", "score")


def frame(spark, rows, schema, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("other") for c in CLASHES if c not in df.columns}) if clash else df


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """id, text: copies, edits, shared passages, null and empty texts, null and repeated ids, one very long text."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["The", "THE", "of", "it's", "#", "a|b"]
    bases = [words(rng, rng.randint(30, 120), vocabulary) for _ in range(8)]
    passage = words(rng, 40, vocabulary)
    rows = []
    for i in range(70):
        w = rng.choice(bases).split(" ")
        kind = i % 7
        if kind == 1:
            w[rng.randrange(len(w))] = "edited"
        elif kind == 2:
            w = [*w, "more", "words"]
        elif kind == 3:
            w = words(rng, rng.randint(0, 60), vocabulary).split(" ")
        elif kind == 4:
            w = [*words(rng, 50, vocabulary).split(" "), passage]
        elif kind == 5:
            w = w[: rng.randint(1, 9)]
        t = " ".join(w)
        rows.append((i, t.replace(" the ", "\n") if kind == 6 else t + "\n" + t[:60] + "\n" + t[:60]))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two three four"), (104, "one two three four"), (105, "ONE two three four five"),
             (106, "one two three four five"), (107, words(rng, 20000, vocabulary)), (108, "a" * 30000), (-3, bases[0])]
    return rows
