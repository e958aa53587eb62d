import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, n_tokens string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["An", "the", "rin", "tho", "edle", "Ing,", "stre", "on", "wha", "era"]) + r.choice("abcdefg") for _ in range(n))


def texts():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, odd white space."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    odd = "a b\tc  d\r\n　e \x1c f'll 12٣ café é <|endoftext|> <|ENDOFTEXT|>"
    lines = "\n".join([words(5, 30), words(6, 30), "", words(5, 30), "Short one.", "short   ONE."])
    return [
        None,
        "",
        "   \n\t ",
        base,
        base,
        near,
        base.upper(),
        words(2, 3),
        words(2, 3),
        words(3, 20_000),
        "x" * 30_000,
        odd,
        lines,
        lines + "\nnew line " + words(7, 12),
        words(5, 30).replace("tho", "thu", 1),
        "you idiot moron " + words(8, 40),
        "\U0001f600 漢字 " + words(9, 8),
    ]


@pytest.fixture(scope="session")
def rows():
    return [(i, t, "en", "src0", len(t or ""), 7, "k", "t") for i, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_ids(spark, rows):
    """Repeated rows, and rows with nulls in every column."""
    nulls = (None,) * 8
    return spark.createDataFrame([*rows[:6], rows[3], rows[3], nulls, nulls], SCHEMA)
