"""Small tables with every odd case, and plain versions of shared steps."""

import random

from pyspark.sql import types as T

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["ids", "spans", "counts", "fp", "component", "node", "key", "words", "kept", "rank", "n_bytes", "stratum", "good", "u", "v"]


def sentence(rng, n, words=None):
    words = words or ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_texts(seed=5):
    rng = random.Random(seed)
    one, two = sentence(rng, 120), sentence(rng, 90)
    return [None, "", " \n\t ", "x", "a b", "a b c", one, one, one + " tail", two, two.upper(), "é" * 40, "漢字 " * 30, "same line\n" * 30, "'s 'll don't 'S", "password = abcdefghijkl1 user: bob",
            "a\x00b  c", sentence(rng, 30_000), "ab" * 5_000]


def odd_docs(spark, texts=None, clashes=True):
    """Null ids, repeated rows, null columns; further columns are named like the operators' own."""
    texts = odd_texts() if texts is None else texts
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    if len(rows) > 9:
        rows += [rows[6], rows[9], (None, "text without an id and nothing else in it", "en", "src", 1), (None, texts[6], None, None, None)]
    names = NAMES + (CLASHES if clashes else [])
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType()}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return spark.createDataFrame([r + ("z",) * (len(names) - 5) for r in rows], schema)


def empty_docs(spark):
    return odd_docs(spark).limit(0)
