import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, bin int, label string"

#: Nulls, empty and odd texts, ties, repeated rows.
ODD = ["", " ", "\n\n", "  a  b", "a \n b\t", "x y z w v", "The, the. THE!", "don't 've  x's", "é　ß Ñ", "\x00 a\x00b", "12 345,6. 7", "İ, ΑΣ. x", "word " * 3000, "x" * 5000, "a@b.cd +1 (555) 010-9999", "same text of six words here", "same text of six words here"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with extra columns whose names clash with those inside the operators."""
    rows = [(i, t, "en", "s", len(t), "p", "d", i, "l") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "same text of six words here", None, "s", 0, "p", "d", 1, "l"), (101, "same text of six words here", None, "s", 0, "p", "d", 1, "l")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
