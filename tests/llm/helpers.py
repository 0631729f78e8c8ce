"""Small documents that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import SparkSession, functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def awkward(spark: SparkSession):
    long = " ".join(f"wort{i % 997} {i}" for i in range(30_000))
    rows = [
        (1, "one two three four", "a"), (1, "one two three four", "a"), (2, "one two three four", "a"), (3, None, "a"),
        (4, "", None), (None, "alone here", "b"), (5, long, "b"), (6, " \t\n ", "b"), (None, None, None), (7, "ÄÖ ß x", "c"),
    ]
    return documents(spark, rows)


def clash(docs, *names):
    """``docs`` with further columns that are named like an operator's output, or like its working columns."""
    return docs.withColumns({n: F.lit("clash") for n in names})


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
