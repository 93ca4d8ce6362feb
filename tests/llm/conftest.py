"""Small corpora with the awkward cases: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random

import pytest

from tidemark.llm.common import importable

CLASHES = "text_a string, component string, id long, words string, anchors string, first string, n_lines string"


@pytest.fixture(scope="session", autouse=True)
def package_for_workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """doc_id, text and columns that operators use names like."""
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 120))) for i in range(60)]
    base = text(200)
    for i in range(60, 75):  # near copies, some of them copies of each other
        w = base.split()
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    passage = text(30)
    rows += [(i, f"{text(20)} {passage} {text(10)}") for i in range(75, 82)]
    rows += [(90, None), (91, ""), (92, " \t\n "), (93, "one"), (94, "one"), (95, text(3)), (96, "x " * 3000), (97, "Ünï çödé ÀÉ — 日本語 🙂"), (98, rows[3][1]), (98, rows[3][1]), (99, rows[3][1].upper())]
    rows += [(-5, text(40)), (None, passage), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame([(i, t, "en", "s", 1, *["?"] * 2, 7, *["?"] * 4) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars int, " + CLASHES)
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
