import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"

# Documents with columns whose names clash with those that the operators use themselves.
CLASHING = ["n", "key", "size", "row", "slot", "src", "start", "order", "norm", "w", "s", "p", "lines", "host", "said", "text2", "line", "b", "v",
            "vid", "ids", "fill", "lang_pred", "score", "kept", "target", "piece", "_word", "_bits", "dir", "license", "component", "heat"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("path", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHING])


def rows(texts):
    """Rows with the given (doc_id, text, lang, source)."""
    return [Row(i, t, lang, s, None if i is None else f"{s}/{i}.txt", *["x"] * len(CLASHING)) for i, t, lang, s in texts]


EDGES = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b ", "en", None), (4, "one", None, "b"), (5, "one  two", "en", "b"),
    (6, "one two", "de", "b"), (6, "one two", "de", "b"), (7, "\U0001f600 !!! 123", "en", None),
    (8, "the cat sat on the mat and then the cat left " * 3000, "en", "a"), (9, "x" * 30_000, "en", "a"),
    (10, "the cat sat on the mat and then the cat left\n" * 12, "en", "hot"), (11, "the cat sat on the mat and then the cat left\n" * 12, "en", "hot"),
    (12, "Released under the MIT License.\nsome text", None, "hot"), (13, "licence " * 5000, "en", "c"), (14, "é́ ΣΣ it's ½ <|endoftext|>", "fr", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows(EDGES), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)
