import pytest


@pytest.fixture()
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns that clash with internal names."""
    long = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
    rows = [
        (1, "The same words stand here once more and again.", "a", 46),
        (2, "the  SAME words stand here\tonce more and again.", "a", 47),
        (3, None, "a", None),
        (4, "", None, 0),
        (5, " \n\t ", "b", 4),
        (None, "A text without a number, token = \"0123456789abcdef0123456789abcdef\" in it.", "b", 70),
        (6, "two words", "b", 9),
        (7, "two words", "b", 9),
        (7, "two words", "b", 9),
        (8, "one text of number eight with several words in it", "c", 50),
        (8, "another text of number eight which differs very much", "c", 52),
        (9, long, "c", len(long)),
        (10, long + " tail", "c", len(long) + 5),
        (11, "é ß 日本語 \U0001f600 Ünïcödé", "d", 10),
    ]
    schema = "doc_id long, text string, source string, n_chars long, start long, ids string, hash long, node long, sign long, _rank long, _salt long, _doc long, _SIGN long"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7, 8) for r in rows], schema)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
