"""Fixtures with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, piece int, shard long, v string"

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000


def base_rows():
    para = " ".join(f"w{i % 97}x{i % 13}" for i in range(120))
    near = para.replace("w5x5", "other", 1)
    far = " ".join(f"q{i * 7 % 101}y{i % 17}" for i in range(120))
    return [
        (0, para, "en"), (1, near, "en"), (2, far, "fr"), (3, para, "en"), (3, para, "en"), (4, None, "en"), (5, "", None), (6, " \t\n", "de"),
        (7, "word", "en"), (8, "Word", "en"), (9, "two words", None), (10, LONG, "en"), (11, LONG + "tail", "en"), (None, para, "en"), (12, "été über señor 日本語 ²", "es"),
        (13, "a<|endoftext|>b \x0b c", "en"), (14, "!!! ??? 123", "en"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(d, t, lang, "s", None if t is None else len(t), 0.5, -1, 9, 7, "x") for d, t, lang in base_rows()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
