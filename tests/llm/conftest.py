import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with operators' own."""

    def make(rows):
        full = [(*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else tuple(r) for r in rows]
        docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in full], DOCS)
        return docs.selectExpr("*", "1 AS ident", "'x' AS hash", "2 AS body", "3 AS n", "4 AS kept", "5 AS row")

    return make
