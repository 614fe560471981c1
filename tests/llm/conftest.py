import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture()
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, a very long text, repeated rows, near copies, clashing extra columns."""
    base = " ".join(f"word{i % 97}x{i % 13}" for i in range(140))
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [
        (1, base, "en", "b"), (1, base, "en", "b"), (2, base + " tail", "en", "b"), (3, None, None, None), (4, "", "fr", "a"),
        (5, " \t\n ", "fr", "a"), (None, "some text without an id", "en", None), (None, base, None, "a"), (6, long, "en", "c"),
        (7, "same same same same same same same", "en", "c"), (7, "other text of one id", "de", "c"), (8, "été über ☃ 日本語 \U0001f600\x00", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 0.5, "x", 1) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, size int")


@pytest.fixture()
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture()
def label_rows(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (7, 0, 1), (6, 5, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
