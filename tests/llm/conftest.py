import os
import random

import pytest

# Python workers import the operators from here
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")]))


@pytest.fixture(autouse=True)
def _importable(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [(901, None), (902, ""), (903, " \t\n "), (904, "one"), (905, "Ünï çödé — ÉÉ"), (906, "...!!!"), (None, "a text without an id"), (None, None)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): distinct texts, copies, near copies, a shared passage, a very long text, odd cases and a repeated row."""
    rows = [(i, " ".join(words(i, 60 + 7 * i))) for i in range(20)]
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    for i in range(8):
        near = rows[5][1].split()
        near[4 * i + 3] = f"changed{i}"
        rows.append((200 + i, " ".join(near)))
    passage = " ".join(words(77, 40))
    rows += [(300 + i, " ".join(words(1000 + i, 30)) + " " + passage + "\n" + " ".join(words(2000 + i, 30))) for i in range(6)]
    rows.append((400, " ".join(words(5000, 30_000, 5000))))
    rows.append((401, "la " * 200))
    rows += ODD
    rows.append(rows[7])
    return rows


def table(spark, rows, more=""):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, f"doc_id BIGINT, text STRING{more}, id STRING, block INT, kept STRING")


def multiset(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
