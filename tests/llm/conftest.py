import pytest

from tests.conftest import spark  # noqa: F401  the same session

LONG = " ".join(f"Long{k} text, with numbers!" for k in range(8000))


@pytest.fixture(scope="session")
def odd_docs(spark):  # noqa: F811
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "one two three four five six seven\nsecond line. And more", "en", "a"), (2, None, None, None), (3, "", "de", "b"), (4, LONG, "en", "a"),
        (5, "One Two three four five six seven\nsecond line. And more", "en", "a"), (6, "ein ß – 漢字 🎉\n\n\x00tail", "de", "b"), (6, "ein ß – 漢字 🎉\n\n\x00tail", "de", "b"),
        (None, "no id at all here", "fr", "c"), (8, " \t\n", None, "c"), (9, "short", "fr", None), (10, "x" * 5000, "en", "a"), (11, LONG + "and one more.", "en", "a"),
    ]
    extra = [(*r, 1.0, "x", 7, "k", "y", k, "own", 3) for k, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, score double, row string, features int, topic string, held_out string, _node long, node string, _id int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
