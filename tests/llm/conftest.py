import random

import pyarrow.parquet as pq
import pytest

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def make(spark):
    """Documents (doc_id, text) with a column whose name clashes."""

    def build(rows, id_col="doc_id"):
        schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("text", T.StringType()),
                               T.StructField("kept", T.StringType()), T.StructField("n", T.StringType())])
        return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def sf_docs():
    """(doc_id, text) of the smallest table, whole."""
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empties, odd spaces, long texts, copies and near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(500)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    long = text(40_000)
    near = text(300).split(" ")
    rows = [None, "", " \t\n", "one", "one two three four", "ONE two\u00a0three four", "\u00e9\u00c9 x\u2003y \U0001f600",
            long, long, long.upper(), text(20), "a b c d e f g h " * 30, "line\nline\n\nother\nline", "x\r\ny\x0bz\x0cw",
            "password = hunter22, API_KEY:\"abcdef\" token='a.b' secret==x Passwd : zzzzzz9", "AKIA" + "Q" * 16,
            "AKIA" + "Q" * 15 + " AKIAAKIA" + "7" * 20, "0123456789abcdef01234567 " + "f" * 23, "\u00e9\u00e9 deadbeef" * 8,
            "apikey=" + "0a1b2c3d" * 5, "#*$%&|<> \u00a3" * 9]
    rows += [" ".join(near[:i] + ["changed"] + near[i + 1 :]) for i in range(0, 300, 40)]
    rows += [" ".join(near)] * 5
    return list(enumerate(rows, start=1))
