import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, and columns that could clash."""
    rng = random.Random(4)
    long_line = "the same long line that stands in many of the documents here"
    rows = [(i, f"{long_line}\n{words_of(rng, 70)}\nline {i}", ["en", "de"][i % 2], f"src{i % 3}", 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "src1", 0), (22, " \n\t", "en", "src1", 3), (None, words_of(rng, 60), "en", "src0", 1), (None, None, None, None, None)]
    rows += [(23, words_of(rng, 30000), "en", "src2", 1), (24, "x" * 100000, None, "src2", 1), (25, "short one", "de", None, 9), (25, "short one", "de", None, 9), (25, "another text", "de", None, 9)]
    near = words_of(rng, 200, 10**6)
    rows += [(30 + i, f"{near} tail{i}", "en", "src1", 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "of", "at", "key", "label", "n", "c", "kept", "score", "token", "tokens", "spans", "row", "domain", "epoch"):
        df = df.withColumn(name, df["source"])
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
