import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "A long line of words that goes on and on, number {i}, and ends here at last.\n"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows
    and columns that clash with results."""
    rows = [
        (1, "The same text, word for word, in two documents of one table.", "en", "a", 60),
        (2, "The same text, word for word, in two documents of one table.", "en", "b", 60),
        (2, "The same text, word for word, in two documents of one table.", "en", "b", 60),
        (3, "The same text,  word for word, in two documents of one table. ", None, None, None),
        (4, None, "en", "a", None),
        (5, "", "fr", "a", 0),
        (6, " \n\t ", None, "a", 4),
        (7, "Le même texte, mot pour mot, avec des accents é è ç.\nÀ la ligne.", "fr", "a", 70),
        (8, "".join(LONG.format(i=i) for i in range(3000)), "en", "hot", 0),
        (9, "12345 !!! ### 999", None, "a", 17),
        (None, "A row without an id, which has a text of its own all the same.", "en", "a", 62),
        (11, "x", "xx", "a", 1),
        (-5, "Ünïcödé 🙂 漢字 text with a <|endoftext|> mark in it", "de", "a", 50),
    ]
    return spark.createDataFrame([(*r, True, 0.5, "clash") for r in rows], SCHEMA + ", kept boolean, score double, text_crc32 string")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
