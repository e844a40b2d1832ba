import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with a column that clashes with what operators make, from (doc_id, text[, source])."""

    def of(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", kept string").repartition(3)

    return of


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Rows that must not break anything: nulls, empty and long texts, ties, repeated rows."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)), (None, prose(6, 40)), (7, prose(7, 4000), None), (8, "é ü ß " * 30, "s2"),
        (9, prose(5, 59) + " end", "s2"), (10, "\x00 a\x00b | # $ % & < > *", "s3"), (11, "same same " * 50, "s3"), (12, "é" * 1000, "s1"), (13, "a" * 3000, "s1"),
    ]


#: Names that operators might use for columns of their own.
CLASHES = "_rate _keep _text _source _tokens _figures _row _doc key row host keep known figures base_failed kept bad tokens block weight draw n at epoch id rank shard size slot law node root path url end share seen score".split()


@pytest.fixture(scope="session")
def clashing(make):
    """A documents table with a column of every such name, each holding that name."""
    from pyspark.sql import functions as F

    return lambda rows: make(rows).drop("kept").select("*", *[F.lit(c).alias(c) for c in CLASHES])
