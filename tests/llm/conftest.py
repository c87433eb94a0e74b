import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use for columns of their own
                       T.StructField("score", T.StringType()), T.StructField("words", T.StringType()), T.StructField("block", T.StringType()),
                       T.StructField("ta", T.StringType()), T.StructField("n", T.StringType()), T.StructField("sig", T.StringType())])

SENTENCE = "one fine day the small brown fox went over the long green hill and saw two old dogs asleep by the mill"


def odd_texts():
    base = SENTENCE.split()
    near = [*base[:-1], "barn"]
    return [
        (1, SENTENCE), (2, SENTENCE), (2, SENTENCE), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t \r "), (7, "x" * 50_000),
        (8, "short text"), (9, "Short   TEXT"), (10, " ".join(f"w{i % 977}" for i in range(20_000))), (None, SENTENCE), (None, None),
        (11, "ß ü é 漢字 кириллица שלום"), (12, "line one that is long enough\nline one that is long enough\nLine one that is long enouga\n"),
        (13, "### *** $$$ | | | |"), (14, "mail a.b@c.example and a.b@c.example_d@e.fg 1.2.3.4.5.6.7.8 999.1.1.1"), (15, "call +1 (017) 555-7713 or 4111 1111 1111 1111 now"),
        (16, "    nbsp"), (17, "a b c d e f g a b c d e f g a b c d e"), (18, "0" * 30_000), (19, "a." * 20_000 + "@" + ".b" * 20_000), (20, "1 " * 20_000),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "x", "y", "z", "q", None, "") for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
