import pytest


@pytest.fixture()
def odd(spark):
    """Documents that every operator must take: nulls, blanks, ties, repeated rows, clashing columns."""
    rows = [(1, "alpha beta gamma delta " * 20, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "fr", None, 4), (5, "x", "en", "b", 1), (1, "alpha beta gamma delta " * 20, "en", "a", 5), (7, "é" * 5000, "fr", "b", 5000), (8, "one\ntwo\none\ntwo\n" * 30, "en", "b", 9)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, id int, component int")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
