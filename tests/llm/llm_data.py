import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("PROMOLIFT_TEST_SF", "/root/testdata/sf0.001")
DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# columns with names that the operators use themselves
CLASH = ["_id", "_hash", "_bytes", "_doc", "_label", "fp", "root", "score", "shard", "slot", "part", "kind", "row", "rows", "words", "runs",
         "item", "key", "label", "web", "hash", "bytes", "n"]


def frame(spark, rows, clash=False):
    """documents from (doc_id, text) pairs, with clashing extra columns if asked for."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def edge_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    body = "\n".join(" ".join(f"w{k}a{j}" for j in range(20)) for k in range(6))
    return [(None, None), (None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "123 !!! ***"), (5, "Hello"),
            (6, "Hello"), (7, body), (7, body), (8, body + "\nand one more line"), (9, long), (10, "été ÉTÉ İ ß \U0001F600"), (11, body)]


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_rows(), clash=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.exists(SF):
        pytest.skip("test tables not present")
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "embeddings")}
