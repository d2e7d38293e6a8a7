import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, no words, repeated rows, a very long text, and names that operators use."""
    body = "one two three four five six seven eight nine ten " * 6
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(60000))
    rows = [
        (None, "a text without an id, long enough to have some words of its own", "en", "s", 1),
        (None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0), (3, " \t\n ", "en", "s", 4),
        (4, body, "en", "s", 1), (4, body, "en", "s", 1), (5, body.upper(), "de", "t", 1), (6, long, "fr", "t", 1),
        (7, "déjà vu \U0001f600 naïve ça\nété", "fr", None, 1), (8, "word", "en", "s", 4), (9, long, "fr", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_key", "token", "kept", "score", "leaks", "host", "k", "n"):
        df = df.selectExpr("*", f"doc_id as {name}")
    return df


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
