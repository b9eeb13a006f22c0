"""Texts are read once for what queries ask, and the first rows by query are those of all pairs."""

import random

from pyspark.sql import functions as F

from lodestar.operators import bm25
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_okapi_tokens_are_staged(spark):
    assert "regexp_extract_all" not in plan(registry.QUERIES["r02_bm25_okapi"](spark, SF))


def test_fields_are_read_once(spark):
    for name in ("r05_bm25f_fields", "r06_field_dependence"):
        assert "regexp_extract_all" not in plan(registry.QUERIES[name](spark, SF))


def test_first_rows_of_many_queries(spark, monkeypatch):
    """With ties over many copies, small chunks, an id of text, and a query that nothing meets."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"d{k:04d}", rng.choices(words, [1 / (1 + i) for i in range(40)], k=rng.randint(0, 30))) for k in range(400)]
    rows += [(f"c{k:04d}", ["w30", "w31", "w30"]) for k in range(300)]
    tokens = spark.createDataFrame(rows, "ident string, tokens array<string>").repartition(5)
    asked = [(q, rng.choice(words), float(rng.randint(1, 3))) for q in range(30) for _ in range(6)] + [(50, "w30", 1.0), (51, "nowhere", 1.0)]
    queries = spark.createDataFrame(asked, "q long, term string, weight double")
    want = bm25.ranked(bm25.multi_query(tokens, queries, "ident", "q"), "ident", "bm25", 7, "q")
    pick = lambda df: sorted(map(tuple, df.select("q", "ident", "rank", "score").collect()))
    expected = pick(want)
    assert expected
    for added in (1 << 20, 300):
        monkeypatch.setattr(bm25, "ADDED", added)
        got = bm25.multi_top(tokens, queries, "ident", "q", 7)
        assert [x[:3] for x in pick(got)] == [x[:3] for x in expected]
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(pick(got), expected))
    monkeypatch.setattr(bm25, "HELD", 10)
    assert pick(bm25.multi_top(tokens, queries, "ident", "q", 7)) == expected
    assert bm25.multi_top(tokens, queries.where(F.lit(False)), "ident", "q", 7).collect() == []


def test_pairs_of_many_queries_stay_in_their_tasks(spark):
    """What is left to order is staged counts' first rows; neither texts nor terms are joined."""
    text = plan(registry.QUERIES["r40_bm25_multi_query"](spark, SF))
    assert "regexp_extract_all" not in text and "SortMergeJoin" not in text
