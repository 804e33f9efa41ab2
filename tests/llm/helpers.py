"""Small tables for the operators' tests."""

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, h string"


def words(rng, n, vocabulary=400):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def table(spark, texts, schema=DOCS):
    """Documents with columns whose names the operators use inside (k, h)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in texts], schema)


def odd_texts(rng):
    """Nulls, empty, blank and very long texts, repeated rows, ids that repeat, a null id."""
    long = " ".join(words(rng, 30_000))
    passage = " ".join(words(rng, 40))
    return [
        (0, "One two three. " + passage + "\nEnd of it!"), (1, None), (2, ""), (3, " \t\n"), (4, long), (5, "word"), (6, "two words"), (7, "x" * 5000),
        (8, "Other start, " + passage), (8, "Other start, " + passage), (9, "same id, first"), (9, "same id, second"), (None, passage + " tail"), (None, None),
        (10, "é ÀÉ ß 日本語 \U0001f600 don't"), (11, "One two three. " + passage + "\nEnd of it!"),
    ]


def rng(seed=0):
    return np.random.default_rng(seed)
