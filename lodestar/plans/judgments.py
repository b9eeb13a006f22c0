"""Queries: judgments, reranking and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import vocabulary as V
from lodestar.operators import bm25, fusion, rerank
from lodestar.operators import candidates as C
from lodestar.operators import judges as J
from lodestar.plans import candidates as P
from lodestar.sources.staging import shared_path, staged
from lodestar.streaming import jobs

SIX = N.six


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """Pessimistic score, silver tier, three judges' consensus and disagreement."""
    mean, spread = J.consensus(J.three_judges())
    return P.scored(spark, d).select("candidate_id", SIX(J.pessimistic()).alias("pessimistic"), J.silver_tier().cast("long").alias("tier"), SIX(mean).alias("consensus"), SIX(spread).alias("disagreement"))


_B = "(core_skill_match * gp)"
JUDGMENTS_SQL = f"""WITH {P.FEATURES},
g AS (SELECT *, CASE WHEN honeypot < 0.2 THEN honeypot ELSE 1 END AS gh_, CASE WHEN title_match_score < 0.25 THEN 0.1::DOUBLE WHEN title_match_score < 0.8 THEN 0.4 + (title_match_score - 0.25) * 0.8 ELSE 1 END AS gt, CASE WHEN depth < 0.3 THEN 0.2 + depth / 0.3::DOUBLE * 0.3 ELSE 0.5 + (depth - 0.3) / 0.7::DOUBLE * 0.5 END AS gd, CASE WHEN production_evidence < 0.15 THEN 0.15::DOUBLE WHEN production_evidence < 0.5 THEN 0.4 + (production_evidence - 0.15) / 0.35::DOUBLE * 0.6 ELSE 1 END AS gp FROM f5),
h AS (SELECT *, CASE WHEN {_B} < 0.1 THEN 0.2::DOUBLE WHEN {_B} < 0.3 THEN 0.5 ELSE 0.7 + {_B} * 0.3 END AS gc, (production_evidence >= 0.75)::INT + (ir_ranking_experience >= 0.7)::INT + (core_skill_match >= 0.7 AND depth >= 0.65)::INT + (product_company_ratio >= 0.45)::INT + (yoe_fit_score >= 0.85 AND senior_title_held >= 0.5)::INT + (location_score >= 0.65 AND responsiveness_score >= 0.45)::INT AS pts,
 CASE WHEN honeypot < 0.5 OR disqualifier_skill_flag > 0 THEN 0 ELSE depth * production_evidence * behaviour END AS j1, CASE WHEN honeypot < 1 OR depth < 0.4 THEN 0 ELSE (depth + production_evidence) / 2 END AS j2, CASE WHEN honeypot < 0.2 THEN 0 ELSE (depth * 0.4 + production_evidence * 0.3 + yoe_fit_score * 0.2 + education * 0.1) * behaviour END AS j3 FROM g),
i AS (SELECT *, (j1 + j2 + j3) / 3 AS m, gh_ * gt * gd * gp * gc AS p FROM h)
SELECT candidate_id, round(CASE WHEN gt >= 0.8 AND gd >= 0.8 AND gp >= 0.8 AND gc >= 0.8 THEN least(p * 1.15, 1) ELSE p END, 6) + 0.0::DOUBLE AS pessimistic,
 CASE WHEN honeypot <= 0 THEN 0 WHEN keyword_stuffer_flag >= 0.75 THEN 1 ELSE least(5, greatest(0, greatest(0, pts - CASE WHEN disqualifier < 0.7 THEN 2 WHEN disqualifier < 1 THEN 1 ELSE 0 END) - CASE WHEN behaviour < 0.65 THEN 1 ELSE 0 END)) END::BIGINT AS tier,
 round(m, 6) + 0.0::DOUBLE AS consensus, round(sqrt(((j1 - m) ^ 2 + (j2 - m) ^ 2 + (j3 - m) ^ 2) / 3), 6) + 0.0::DOUBLE AS disagreement FROM i"""


def silver_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by rule, with their reasons."""
    return P.scored(spark, d).select("candidate_id", J.silver_tier().cast("long").alias("tier"), F.array_join(J.silver_reasons(), ",").alias("reasons"))


_POINTS = {"strong_production": "production_evidence >= 0.75", "strong_ir_ranking": "ir_ranking_experience >= 0.7", "deep_core_skills": "core_skill_match >= 0.7 AND depth >= 0.65", "product_company": "product_company_ratio >= 0.45", "senior_experience": "yoe_fit_score >= 0.85 AND senior_title_held >= 0.5", "reachable_logistics": "location_score >= 0.65 AND responsiveness_score >= 0.45"}
SILVER_SQL = f"""WITH {P.FEATURES}, s AS (SELECT *, {" + ".join(f"({p})::INT" for p in _POINTS.values())} AS pts, concat_ws(',', {", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _POINTS.items())}, CASE WHEN disqualifier < 0.7 THEN 'soft_disqualifier' WHEN disqualifier < 1 THEN 'minor_disqualifier' END, CASE WHEN behaviour < 0.65 THEN 'weak_behavior' END) AS why FROM f5)
SELECT candidate_id, CASE WHEN honeypot <= 0 THEN 0 WHEN keyword_stuffer_flag >= 0.75 THEN 1 ELSE least(5, greatest(0, greatest(0, pts - CASE WHEN disqualifier < 0.7 THEN 2 WHEN disqualifier < 1 THEN 1 ELSE 0 END) - CASE WHEN behaviour < 0.65 THEN 1 ELSE 0 END)) END::BIGINT AS tier,
 CASE WHEN honeypot <= 0 THEN 'hard_honeypot' WHEN keyword_stuffer_flag >= 0.75 THEN 'keyword_stuffer' WHEN why = '' THEN 'adjacent_fit' ELSE why END AS reasons FROM s"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = P.scored(spark, d).withColumn("severity", C.anachronisms())
    status = J.evidence_status()
    return rows.select("candidate_id", status.alias("status"), J.action(status).alias("action"), F.array_join(J.corroboration(), ",").alias("corroboration"))


EVIDENCE_SQL = f"""WITH {P.FEATURES}, sv AS ({P.ANACHRONISM_SQL.replace(f"WITH {P.RECORDS}, s AS", "WITH s AS")}),
e AS (SELECT *, CASE WHEN honeypot <= 0 THEN 'CONFIRMED_CONTRADICTION' WHEN severity > 0 THEN 'PROBABLE_CONTRADICTION' WHEN abs(honeypot - 0.05) < 1e-6 OR disqualifier < 1 THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS status FROM f5 JOIN sv USING (candidate_id))
SELECT candidate_id, status, CASE status WHEN 'CLEAR' THEN 'CONTINUE' WHEN 'AMBIGUOUS' THEN 'CLARIFY' WHEN 'PROBABLE_CONTRADICTION' THEN 'VERIFY' ELSE 'BLOCK' END AS action, concat_ws(',', CASE WHEN production_evidence >= 0.5 THEN 'production' END, CASE WHEN scale_signal >= 0.4 THEN 'scale' END, CASE WHEN assessment_score_avg >= 0.4 THEN 'assessment' END, CASE WHEN ir_ranking_experience >= 0.45 THEN 'retrieval' END) AS corroboration FROM e"""


def near_misses(spark: SparkSession, d: str) -> DataFrame:
    """Records with exactly one hard flag that almost holds, the twenty closest."""
    # Staged: conditions pushed below the features would have each record's features found anew for each of them.
    rows = P.scored(spark, d).select("candidate_id", F.when(F.col("honeypot_multiplier") > 0, J.near_misses()).alias("m"))
    rows = staged(rows, "misses").where(F.size("m") == 1)
    out = rows.select("candidate_id", F.col("m")[0]["flag"].alias("flag"), SIX(F.col("m")[0]["closeness"]).alias("closeness"))
    return out.orderBy(F.desc("closeness"), "candidate_id").limit(20)


NEAR_SQL = f"""WITH {P.FEATURES}, x AS (SELECT candidate_id, list_filter([CASE WHEN yoe > 0 AND floor(yoe * 12) + 30 - months BETWEEN 0 AND 12 THEN struct_pack(f := 'experience_timeline_exceeds_claim', c := 1 - (floor(yoe * 12) + 30 - months) / 12) END,
 CASE WHEN yoe >= 5 AND months / floor(yoe * 12) >= 0.45 AND months / floor(yoe * 12) < 0.55 THEN struct_pack(f := 'career_history_too_short_for_claimed_yoe', c := 1 - (months / floor(yoe * 12) - 0.45) / 0.1::DOUBLE) END,
 CASE WHEN idle_core = 1 OR idle = 4 THEN struct_pack(f := 'expert_skill_zero_duration', c := CASE WHEN idle_core = 1 THEN 1.0::DOUBLE ELSE 0.9 END) END, CASE WHEN current = 2 THEN struct_pack(f := 'multiple_current_jobs', c := 1.0::DOUBLE) END,
 CASE WHEN {P._has(V.OTHER_TITLES, "' ' || " + P._N("title") + " || ' '")} AND ir_ranking_experience >= 0.3 AND ir_ranking_experience < 0.45 THEN struct_pack(f := 'title_description_contradiction', c := (ir_ranking_experience - 0.3) / 0.15::DOUBLE) END], lambda s: s IS NOT NULL) AS m FROM f5 WHERE honeypot > 0)
SELECT candidate_id, m[1].f AS flag, round(m[1].c, 6) AS closeness FROM x WHERE len(m) = 1 ORDER BY closeness DESC, candidate_id LIMIT 20"""


def stability(spark: SparkSession, d: str) -> DataFrame:
    """Where the first twenty land as each feature in turn is left out."""
    rows = P.scored(spark, d).withColumn("retrieval", F.lit(0.5))
    return J.rank_stability(rows, 20).select("candidate_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "least", "most")])


def _stability_sql() -> str:
    factors, exponent = V.PROFILES["universal-v2"]
    weights = {k: w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()}
    value = lambda k: "0.5" if k == "bm25_score" else P.SHOWN[k]
    one = lambda drop: f"SELECT candidate_id, '{drop or ''}' AS drop_, round(({' + '.join(f'{w!r}::DOUBLE * {value(k)}' for k, w in weights.items() if k != drop)}) / {sum(w for k, w in weights.items() if k != drop)!r}::DOUBLE * behaviour ^ {exponent}::DOUBLE * honeypot * disqualifier, 9) AS s FROM f5"
    every = " UNION ALL ".join(one(k) for k in [None, *[k for k in weights if k != "bm25_score"]])
    return f"WITH {P.FEATURES}, v AS ({every}), r AS (SELECT candidate_id, drop_, row_number() OVER (PARTITION BY drop_ ORDER BY s DESC, candidate_id) AS rank FROM v) SELECT candidate_id, max(rank) FILTER (drop_ = '') AS rank, min(rank) AS least, max(rank) AS most FROM r GROUP BY candidate_id HAVING max(rank) FILTER (drop_ = '') <= 20"


def gate_effects(spark: SparkSession, d: str) -> DataFrame:
    """Gates in logarithms, zero gates as -99."""
    return P.scored(spark, d).select("candidate_id", *[SIX(F.coalesce(c, F.lit(-99.0))).alias(k) for k, c in J.gate_effects(V.PROFILES["universal-v2"][1]).items()])


GATE_SQL = f"WITH {P.FEATURES} SELECT candidate_id, round({V.PROFILES['universal-v2'][1]}::DOUBLE * ln(behaviour), 6) + 0.0::DOUBLE AS behavior, CASE WHEN honeypot > 0 THEN round(ln(honeypot), 6) ELSE -99.0::DOUBLE END + 0.0::DOUBLE AS honeypot, round(ln(disqualifier), 6) + 0.0::DOUBLE AS disqualifier FROM f5"


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Rows for rerankers: main and universal scores, gate, severity; scores rounded so that both engines order alike."""
    rows = P.scored(spark, d).withColumn("retrieval", F.lit(0.5)).withColumn("severity", C.anachronisms())
    return rows.select("candidate_id", "x_yoe", "ir_ranking_experience", "behavioral_multiplier", "responsiveness_score", "production_evidence", "honeypot_multiplier", "severity", F.round(C.score("main"), 9).alias("main"), F.round(C.score("universal-v2"), 9).alias("score"), (F.col("honeypot_multiplier") * F.col("disqualifier_multiplier")).alias("gate"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred after all rerankers: model hedge, top band, cleanup, scores reassigned, two bands sorted."""
    rows = staged(_headed(spark, d), "headed")
    top = rerank.hedge(rows, [F.col("production_evidence"), F.col("ir_ranking_experience")])
    scores = top.select("score")
    cleaned = rerank.cleanup(rerank.top_band(top), rerank.clean_tail(rows).select(*top.columns))  # the tail is of the fixture's pool
    out = rerank.final_bands(rerank.rescore(cleaned, scores))
    return rerank.rescore(out, scores).select("candidate_id", F.col("rank").cast("long").alias("rank"), SIX(F.col("score")).alias("score"))


RERANKED_SQL = f"""WITH {P.FEATURES}, sv AS ({P.ANACHRONISM_SQL.replace(f"WITH {P.RECORDS}, s AS", "WITH s AS")}),
a AS (SELECT candidate_id, yoe, ir_ranking_experience AS ir, behaviour, responsiveness_score AS resp, production_evidence AS pe, severity, round({P._score_sql("main")}, 9) AS main, round({P._score_sql("universal-v2")}, 9) AS score, honeypot * disqualifier AS gate FROM f5 JOIN sv USING (candidate_id)),
pool AS (SELECT *, (pe + ir) / 2 AS h, CASE WHEN gate > 0 THEN score / gate ELSE 0 END AS u FROM a ORDER BY main DESC, candidate_id LIMIT 3000),
mm AS (SELECT candidate_id, ((1 - 0.3625::DOUBLE) * (u - (SELECT min(u) FROM pool)) / (SELECT max(u) - min(u) FROM pool) + 0.3625::DOUBLE * (h - (SELECT min(h) FROM pool)) / (SELECT max(h) - min(h) FROM pool)) * gate AS m FROM pool),
m3 AS (SELECT candidate_id, row_number() OVER (ORDER BY m DESC, candidate_id) AS mr FROM mm QUALIFY mr <= 100),
own AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS orank FROM a),
fu AS (SELECT own.*, 0.73::DOUBLE / (60 + orank) + coalesce(0.27::DOUBLE / (60 + mr), 0) AS fused FROM own LEFT JOIN m3 USING (candidate_id) WHERE orank <= 100),
t0 AS (SELECT *, row_number() OVER (ORDER BY fused DESC, candidate_id) AS rank FROM fu),
sc AS (SELECT row_number() OVER (ORDER BY fused DESC) AS rank, fused FROM t0),
t1 AS (SELECT * EXCLUDE (rank), CASE WHEN rank <= 8 THEN row_number() OVER (PARTITION BY CASE WHEN rank <= 8 THEN 0 ELSE rank END ORDER BY round(rank - 8 * ir - 4 * exp(-((yoe - 7) ^ 2) / 8), 9), candidate_id) ELSE rank END AS rank FROM t0),
bad AS (SELECT rank, candidate_id, row_number() OVER (ORDER BY rank DESC) AS k FROM t1 WHERE severity > 1 QUALIFY k <= 2),
fresh AS (SELECT candidate_id, behaviour, resp, row_number() OVER (ORDER BY orank) AS k FROM own WHERE orank > 100 AND severity <= 1 QUALIFY k <= 2),
t2 AS (SELECT candidate_id, behaviour, resp, rank FROM t1 WHERE candidate_id NOT IN (SELECT bad.candidate_id FROM bad JOIN fresh USING (k)) UNION ALL SELECT fresh.candidate_id, behaviour, resp, bad.rank FROM fresh JOIN bad USING (k)),
t3 AS (SELECT * EXCLUDE (rank), CASE WHEN rank > 10 AND rank <= 13 THEN 10 + row_number() OVER (PARTITION BY rank > 10 AND rank <= 13 ORDER BY behaviour DESC, candidate_id) ELSE rank END AS rank FROM t2),
t4 AS (SELECT * EXCLUDE (rank), CASE WHEN rank > 64 AND rank <= 74 THEN 64 + row_number() OVER (PARTITION BY rank > 64 AND rank <= 74 ORDER BY resp DESC, candidate_id) ELSE rank END AS rank FROM t3)
SELECT candidate_id, t4.rank, round(fused, 6) AS score FROM t4 JOIN sc USING (rank)"""


def trees(spark: SparkSession, d: str) -> DataFrame:
    """Two small trees over vectors: 1 or 3 by the first number, 2 or 4 by the second."""
    one = {"feature": [0, -1, -1], "threshold": [0.0, 0.0, 0.0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0.0, 1.0, 3.0]}
    two = {"feature": [1, -1, -1], "threshold": [0.1, 0.0, 0.0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0.0, 2.0, 4.0]}
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return fusion.forest(rows, "embedding", [one, two]).select("vec_id", "prediction")


TREES_SQL = "SELECT vec_id, (CASE WHEN embedding[1] <= 0 THEN 1.0::DOUBLE ELSE 3 END + CASE WHEN embedding[2] <= 0.1::DOUBLE THEN 2 ELSE 4 END) / 2 AS prediction FROM embeddings"


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user by day, through a stream over the table."""
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    target = shared_path(spark, "rates")
    # Each batch's state of the windows it touched is written; the last one of a window counts.
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/table/batch={number}")
    query = jobs.windowed_rates(stream, width="1 day").writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint").start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{target}/table/batch=*")
    return rows.groupBy("start", "user_id").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", "n")


STREAM_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "l03_silver_labels": silver_labels,
    "r32_judgments": judgments,
    "r36_evidence": evidence,
    "r38_near_misses": near_misses,
    "w10_rank_stability": stability,
    "g23_gate_effects": gate_effects,
    "r24_reranked": reranked,
    "r23_trees": trees,
    "s01_stream_rates": stream_rates,
}
ORACLE = {
    "l03_silver_labels": SILVER_SQL,
    "r32_judgments": JUDGMENTS_SQL,
    "r36_evidence": EVIDENCE_SQL,
    "r38_near_misses": NEAR_SQL,
    "w10_rank_stability": _stability_sql(),
    "g23_gate_effects": GATE_SQL,
    "r24_reranked": RERANKED_SQL,
    "r23_trees": TREES_SQL,
    "s01_stream_rates": STREAM_SQL,
}
