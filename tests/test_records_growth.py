"""Records: what is found of a text is found once and by tasks; no step puts all rows into one task."""

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import candidates as C
from lodestar.operators import rerank
from lodestar.plans import candidates as P
from lodestar.plans import judgments as Q

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_looked_at_by_tasks(spark):
    plan = plan_of(P.scored(spark, SF).select("candidate_id", "core_skill_match", "hyre_similarity"))
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_looks_equal_expressions(spark):
    odd = ["a vector search,engine. with c++", "", None, "FAISS　near\x85by\x1fagentic", "open-source open source  a/b testing", "x" * 50 + " map ", "Étude MRR, mrr. m r r"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").withColumn("p", T.pad(T.norm(F.col("t"))))
    ideal = C.template_tokens()
    got = rows.select("p", T.concepts(F.col("t")).alias("c"), T.word_jaccard(F.col("p"), ideal).alias("one"), T.jaccard(T.loose_tokens(F.col("p")), T.words(ideal)).alias("two"), T.hits(["c++", "open source"], F.col("p")).alias("h"), T.any_hit(["open-source"], T.hits(["open source"], F.col("p"))).alias("any")).collect()
    assert [r["one"] for r in got] == [r["two"] for r in got]
    assert [r["c"] for r in got] == [[f"concept_{n}" for n, al in V.CONCEPTS.items() if any(a in (t or "").lower() for a in al)] for t in odd]
    assert [sorted(r["h"]) for r in got] == [["c++"], [], [], [], ["open source"], [], []]
    assert [r["any"] for r in got] == [False] * 4 + [True] + [False] * 2


def test_conditions_do_not_repeat_features(spark):
    assert "ArrowEvalPython" not in plan_of(Q.near_misses(spark, SF))  # staged before its conditions


def test_the_tail_is_cut_before_it_is_ordered(spark):
    rows = spark.range(400).select(F.format_string("%03d", "id").alias("candidate_id"), (400 - F.col("id")).cast("double").alias("score"), F.when(F.col("id").isin(100, 102, 5), 2.0).otherwise(0.5).alias("severity"))
    tail = rerank.clean_tail(rows)
    got = tail.orderBy("rank").limit(2).collect()
    assert [r["candidate_id"] for r in got] == ["101", "103"] and tail.count() <= rerank.LOCK + rerank.CLEANUP
    everything = rows.orderBy(F.desc("score"), "candidate_id").limit(rerank.LOCK)
    assert not tail.join(everything, "candidate_id").count()
