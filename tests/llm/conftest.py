import pytest

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) pairs; ``more`` adds columns whose names the operators use inside."""

    def make(rows, more=()):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(1) for c in more}) if more else df

    return make


#: Names that operators use for columns of their own.
CLASHING = ("id", "set", "key", "class", "low", "row", "n", "place", "item", "word", "code", "file", "part", "kept", "spans", "ids", "__id", "__set", "__hash", "__class", "__LOW", "__of", "__best", "__gone")
#: Rows with every kind of edge: nulls, empty and blank texts, repeated rows and ids, other scripts.
EDGES = [
    (None, "a text without an id, of several words"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "The same row twice, word for word."),
    (5, "The same row twice, word for word."),
    (6, "first text of an id that occurs twice"),
    (6, "second text of an id that occurs twice"),
    (7, "größe ÉTÉ 日本語 😀 нет  no-break  end"),
    (8, "x" * 5000),
]
