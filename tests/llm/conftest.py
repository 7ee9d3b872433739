import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, bucket string, keys int, row string, kept string, n_words string, places string, pii_base string, quality_stats string, scan_key string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


def rows(*pairs):
    return [(i, t, lang, "s", None if t is None else len(t), "u", "b", 1, "r", "k", "n", "p", "x", "q", "z") for i, t, lang in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, ties, marks only, columns with clashing names."""
    words = " ".join(f"word{k}" for k in range(40))
    base = [(1, "", "en"), (2, None, "en"), (3, "  \n\t ", None), (4, LONG, "en"), (4, LONG, "en"), (None, "no id here at all", "de"), (5, words, "en"), (6, words, "fr"), (6, words, "fr"), (7, words + " more", None), (7, "another text under one id", "en"), (8, "!!! ??? 123", "en"), (9, "é ñ 😀 ß", "de"), (None, None, None)]
    return spark.createDataFrame(rows(*base), SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
