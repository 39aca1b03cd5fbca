import os
import random
import sys

import pytest
from hypothesis import settings

settings.register_profile("no-deadline", deadline=None)
settings.load_profile("no-deadline")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=1, n=60):
    """Texts with exact and near copies, shared passages, repetition, and every odd case."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 160))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for k in range(0, n, 9):
        texts.append(texts[k])
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append("\n".join(w))
        texts.append(texts[k] + " " + passage)
        texts.append(passage.upper() + "\n" + passage)
    odd = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "x " * 30, "\n".join(["same line here"] * 6), "z" * 5000, "a\x00b\x1cc d\x0be", "<|endoftext|> x<|startoftext|>"]
    texts += odd + odd[3:6]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def nulls(spark):
    """Null ids, null and repeated rows, extra columns with names that operators use inside."""
    rows = [(None, "a b c d e f", 1, 2, 3), (None, None, 1, 2, 3), (5, "a b c d e f", 1, 2, 3), (5, "a b c d e f", 1, 2, 3), (6, None, None, None, None), (6, "q r s t u v", 0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, node long, block long, a long").withColumnRenamed("node", "n")
