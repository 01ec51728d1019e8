import pytest

ODD = [None, "", " \t\n", "a", "A b", "a  b", "é ü", "one two three four", "one  two\nthree four", "word " * 3000, "x" * 40000, "same text here now", "same text here now", "\u0000 odd", "🙂 smile"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long and repeated texts, a null id, nulls elsewhere, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", 5, "x", 1) for i, t in enumerate(ODD)]
    rows += [(None, "text without id", "en", "s0", 1, "x", 1), (3, "a", None, "s1", 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
