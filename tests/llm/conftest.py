import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, h string, rank string, root string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    long = " ".join(f"wort{k % 997} zeile{k % 13}\n" for k in range(20_000))
    rows = [
        (1, "a shared line of text\nsecond line only here\nshort", "en", "b", 10),
        (2, "A Shared line of text  \nother words follow in here", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (5, " \t\n ", None, "", 4),
        (6, long, "de", "b", len(long)),
        (7, long + " und", "de", "b", None),
        (8, "a shared line of text\nsecond line only here\nshort", None, None, 10),
        (9, "12345 !!!", "en", "é", 9),
        (9, "12345 !!!", "en", "é", 9),
        (None, "a shared line of text\nlast line of the nameless", "fr", "a", 10),
        (11, "idiot \U0001f600 а zero​width ▁ <0x41>", "en", "a", 10),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", None, "r") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
