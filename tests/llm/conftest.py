import pytest

from odd_documents import EDGES, SCHEMA


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with every odd case, and extra columns whose names operators use themselves."""
    docs = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    return docs.selectExpr("*", "length(text) AS n_chars", "1 AS row", "2 AS node", "'x' AS kept", "3 AS component", "4 AS `_id`")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def some(spark, folder):
    """Documents of the smallest tables, and their (id, text) pairs."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
