import pytest

LONG = " ".join(f"word{i % 997} tail{i % 13}" for i in range(20_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "alpha beta gamma delta", "a"), (2, "alpha  beta\tgamma\ndelta", "a"), (3, None, None), (4, "", "b"), (5, "  ", "b"), (6, LONG, "a"), (7, LONG + " ", "b"), (8, LONG + " end", "c"),
        (9, "Über 的 😀 don't 12345 </s>", None), (10, "x", "c"), (10, "x", "c"), (None, "x", "a"), (None, None, None), (11, "a" * 9000, "a"), (12, "Licensed under the Apache License, Version 2.0.", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.select("*", F.lit("de").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("id"), F.lit(2).alias("rid"), F.lit("q").alias("row"), F.lit(0.5).alias("score"), F.lit(7).alias("fp"), F.lit(9).alias("size"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
