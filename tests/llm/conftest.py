import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, n_words string, code string, pos string, item_id string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 900


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with clashing names."""
    texts = [
        (1, "one two three four five six seven eight\nA line\n\n a LINE \nend"), (1, "one two three four five six seven eight\nA line\n\n a LINE \nend"),
        (2, None), (3, ""), (None, "no id here"), (None, None), (4, LONG), (5, LONG), (6, " \t\n\x0b "), (7, "é漢😀 mail a@b.com. 10.0.0.1 <|endoftext|>  x\x00y"), (1, "same id, another text"),
    ]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "x", "y", "z", "p", "q") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """The smallest tables."""
    return "/root/testdata/sf0.001"
