import pytest

#: Texts that every text operator must bear: null, empty, white space, one word, accents, repeats, very long.
HARD = [None, "", " \t\n", "one", "Ünïcödé 日本 𐍈", "same same same", "same same same", "word " * 20_000, "x" * 50_000]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of hard cases with extra columns of clashing names, a null id and a repeated row."""
    rows = [(i, t, None if i == 2 else "en", None if i % 3 else "s", 1, "k", 1.0) for i, t in enumerate(HARD)]
    rows += [(None, "no id", "en", "s", 0, "k", 0.0), (1, "", "en", None, 1, "k", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string, score double").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, docs):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(9)] + [(None, 1, 1, "x"), (3, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("1 = 0")
