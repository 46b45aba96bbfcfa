import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, ids=None, sources=None):
        rows = [((ids[i] if ids else i), t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return docs


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    return [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows, rows with null ids, columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [None, "", "   \n\t ", "one two three", "one two three", long, long, "a b c d e f g h", "naïve café ☯ 🍷 " * 40, "tie " * 300, None]
    df = make(texts, [1, 2, 3, 4, 4, 5, 6, None, 8, 9, 1], ["x", None, "x", "y", "y", None, "z", "z", "x", "y", "x"])
    return df.withColumns({"_rid": F.lit("clash"), "b": F.lit(1), "h": F.lit(2), "size": F.lit("s"), "kept": F.lit(True), "sid": F.lit(0)})


@pytest.fixture(scope="session")
def none(make):
    return make([])
