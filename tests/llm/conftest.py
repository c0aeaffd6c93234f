import pytest

LONG = "token word " * 30000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeats, ties, one very long text, and columns whose names operators use too."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 1, 9, "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 1, 9, "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 1, 9, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 9, "x"),
        (5, " \t\n ", "en", "b", 3, 9, "x"),
        (None, "a row without an id", "en", "b", 3, 9, "x"),
        (6, LONG, "en", "b", len(LONG), 9, "x"),
        (7, "mail bob@example.com or +1 (555) 123-4567, 192.168.0.1, 4111 1111 1111 1111\ntoken = abcdef123", "en", "b", 9, 9, "x"),
        (8, "é日本語 😀 \x1c line\r\nline\r\n\n", "ja", "b", 9, 9, "x"),
        (9, "the  quick brown\tfox jumps over the lazy dog and runs far away from here", "en", "a", 1, 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, fp string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def bpe():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")
