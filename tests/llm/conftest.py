import pytest
from pyspark.sql import types as T

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that operators use themselves
                     T.StructField("node", T.StringType()), T.StructField("line", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("id", T.StringType()), T.StructField("ids", T.StringType())])


def row(i, text, source="s1"):
    return (i, text, "en", source, len(text) if text is not None else None, "n", "l", "s", "i", "x")


LONG = " ".join(f"word{k % 977} is, no {k % 13}." for k in range(60_000))


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [row(1, "the cat sat on the mat and the dog ran off"), row(2, "the cat sat on the mat and the dog ran off", "s2"),
            row(2, "the cat sat on the mat and the dog ran off", "s2"), row(3, None), row(4, ""), row(5, "  \n\t "),
            row(None, "a text without an id, and it is fine"), row(None, None, None), row(6, LONG), row(7, LONG, None),
            row(8, "one"), row(9, "one two"), row(10, "x" * 3000), row(11, "日本語 🙂 é́ \x00 \x1c y"), row(12, "One")]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KIND)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], KIND)
