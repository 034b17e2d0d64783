import pytest

LONG = "Hello there general  words and more words. " * 400
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"), (1, "the quick brown fox jumps over the lazy dog again and again"), (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None), (4, ""), (None, "no id here but some text"), (5, " \t\n "), (6, "one"), (7, "one two"), (8, LONG), (9, LONG + "tail"), (10, "idiot " * 3 + "you are\n\nstupid!!!"), (1, "another text under the same id"),
    (11, "a shared line of more than twenty letters\nown line one"), (12, "x\n  A shared line of more than twenty LETTERS \t\ny"), (13, "a shared line of more than twenty letters\na shared line of more than twenty letters"),
    (14, "日本語 テキスト 🙂 \x1c odd\xa0blanks 　 end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and foreign texts, with columns whose names an operator may want."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", -1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, h string, shard int").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
