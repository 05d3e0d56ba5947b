"""Odd tables shared by the tests of the text operators."""
from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, mention string, "
    "start bigint, length int, kind string, bucket string, anchor bigint, kept boolean, rank bigint, s_length bigint"
)
EXTRA = (0.5, 7, "x", 1, 2, "k", "b", 3, True, 4, 5)


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    """Invented words; different seeds share few sequences."""
    r = random.Random(seed)
    words = [f"{r.choice('bdfgkmnt')}{r.choice('aeiou')}{chr(97 + r.randrange(26))}{r.randrange(vocabulary)}" for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def frame(spark, texts, ids=None, langs=None):
    """Documents with columns whose names operators use inside."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, g, "s", None if t is None else len(t), *EXTRA) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(99, 60_000)
#: Nulls, empty and blank texts, repeated rows and ids, a null id, a very long text.
ODD_IDS = [1, 2, 3, 4, 5, 5, 6, 6, None, 7]
ODD_TEXTS = [prose(1, 80), None, "", " \n\t ", prose(5, 90), prose(5, 90), prose(6, 70), prose(66, 70), prose(8, 60), LONG]


def odd(spark):
    return frame(spark, ODD_TEXTS, ODD_IDS)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
