import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, spans string, base string, score double, "
           "ids string, fingerprint string, component_id string, h string, value string, node string, key string, word string")


def row(doc_id, text):
    return (doc_id, text, None, None, len(text) if text else None, *["x", "y", 0.5] + ["z"] * 8)


ODD_TEXTS = [
    (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "   \n\t "), (5, "a"),
    (6, "mail bob@x.org or +1 (017) 555-7713 now"), (6, "mail bob@x.org or +1 (017) 555-7713 now"),
    (7, "🙂 é ñ token = 'abcdef123' 🙂"), (8, "long " * 60_000 + "end"), (9, "x" * 200_000), (None, "no id here"), (10, "<p>&amp;"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, long and repeated texts, with columns named like what the operators add."""
    return spark.createDataFrame([row(*t) for t in ODD_TEXTS], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
