"""Queries: sampling, splits, resampling, learned blends, agreement, labels by rule, roles, text of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import candidates as C
from lodestar.operators import studies as S
from lodestar.plans import candidates as P
from lodestar.plans import evaluation as Q

SIX = N.six


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """Seven documents of each language by digest, with their split and panel."""
    ident = F.col("doc_id").cast("string")
    return S.draw(_read(spark, d, "documents").select("doc_id", "lang"), "doc_id", "s", 7, "lang").select("doc_id", "lang", F.col("draw").cast("long").alias("draw"), S.split(ident).alias("split"), S.panel(ident).alias("panel"))


_MOD = Q._md5_mod("doc_id::VARCHAR", 100)
DRAWN_SQL = f"SELECT doc_id, lang, draw, CASE WHEN m < 70 THEN 'train' WHEN m < 85 THEN 'validation' ELSE 'test' END AS split, CASE WHEN m < 60 THEN 'discovery' WHEN m < 80 THEN 'calibration' ELSE 'lockbox' END AS panel FROM (SELECT doc_id, lang, {_MOD} AS m, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|s'), doc_id) AS draw FROM documents) WHERE draw <= 7"


def _two(spark: SparkSession, d: str):
    v = Q._votes(spark, d)
    return tuple(v.where(F.col("voter") == n).select("ident", "rank") for n in ("balance", "lines", "name"))


def unions(spark: SparkSession, d: str) -> DataFrame:
    """Two top tens one after the other without repeats; places filled from three rankings in turn."""
    a, b, c = _two(spark, d)
    union = S.ordered_union(a.where("rank <= 10"), b.where("rank <= 10"), "ident").select("ident", F.col("rank").cast("long").alias("rank"), F.lit("union").alias("kind"))
    bands = S.bands([(a, 10), (b, 25), (c, 40)], "ident").select("ident", F.col("rank").cast("long").alias("rank"), F.lit("bands").alias("kind"))
    return union.union(bands)


UNION_SQL = f"""
WITH {Q.VOTES}, a AS (SELECT ident, rank FROM votes WHERE voter = 'balance'), b AS (SELECT ident, rank FROM votes WHERE voter = 'lines'), c AS (SELECT ident, rank FROM votes WHERE voter = 'name'),
u AS (SELECT ident, min((part, rank)) AS spot FROM (SELECT ident, 0 AS part, rank FROM a WHERE rank <= 10 UNION ALL SELECT ident, 1, rank FROM b WHERE rank <= 10) GROUP BY ident),
x AS (SELECT ident, rank FROM a WHERE rank <= 10), y AS (SELECT ident, 10 + row_number() OVER (ORDER BY rank) AS rank FROM b ANTI JOIN x USING (ident) QUALIFY rank <= 25),
z AS (SELECT ident, 25 + row_number() OVER (ORDER BY rank) AS rank FROM c ANTI JOIN x USING (ident) ANTI JOIN y USING (ident) QUALIFY rank <= 40)
SELECT ident, row_number() OVER (ORDER BY spot, ident) AS rank, 'union' AS kind FROM u UNION ALL SELECT ident, rank, 'bands' FROM x UNION ALL SELECT ident, rank, 'bands' FROM y UNION ALL SELECT ident, rank, 'bands' FROM z"""
UNION_SQL = UNION_SQL.replace("b ANTI JOIN x USING (ident) QUALIFY rank <= 25", "b ANTI JOIN x USING (ident) QUALIFY 10 + row_number() OVER (ORDER BY b.rank) <= 25").replace("ANTI JOIN y USING (ident) QUALIFY rank <= 40", "ANTI JOIN y USING (ident) QUALIFY 25 + row_number() OVER (ORDER BY c.rank) <= 40").replace("ORDER BY rank) AS rank FROM b", "ORDER BY b.rank) AS rank FROM b").replace("ORDER BY rank) AS rank FROM c", "ORDER BY c.rank) AS rank FROM c")


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares weights of quantity, discount and tax for a line's price."""
    w = S.stack(_read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(k, round(v, 3)) for k, v in w.items()], "voter string, weight double")


STACK_SQL = """
WITH x AS (SELECT l_quantity AS q, l_discount AS c, l_tax AS t, l_extendedprice AS y FROM lineitem), m AS (SELECT avg(q) q, avg(c) c, avg(t) t, avg(y) y FROM x),
v AS (SELECT var_pop(q) qq, covar_pop(q, c) qc, covar_pop(q, t) qt, var_pop(c) cc, covar_pop(c, t) ct, var_pop(t) tt, covar_pop(q, y) qy, covar_pop(c, y) cy, covar_pop(t, y) ty FROM x),
d AS (SELECT *, qq * (cc * tt - ct * ct) - qc * (qc * tt - ct * qt) + qt * (qc * ct - cc * qt) AS det FROM v),
b AS (SELECT (qy * (cc * tt - ct * ct) - qc * (cy * tt - ct * ty) + qt * (cy * ct - cc * ty)) / det AS b1, (qq * (cy * tt - ct * ty) - qy * (qc * tt - ct * qt) + qt * (qc * ty - cy * qt)) / det AS b2, (qq * (cc * ty - cy * ct) - qc * (qc * ty - cy * qt) + qy * (qc * ct - cc * qt)) / det AS b3 FROM d)
SELECT '1' AS voter, round(y - b1 * q - b2 * c - b3 * t, 3) AS weight FROM m, b UNION ALL SELECT 'l_quantity', round(b1, 3) FROM b UNION ALL SELECT 'l_discount', round(b2, 3) FROM b UNION ALL SELECT 'l_tax', round(b3, 3) FROM b"""


def soft_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How far two rankings agree on pairs of suppliers of a nation, weighted by the gap of balances."""
    a, b, _ = _two(spark, d)
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("ident"), "s_nationkey", "s_acctbal").join(b, "ident")
    x, y = s.alias("x"), s.alias("y")
    pairs = x.join(y, (F.col("x.s_nationkey") == F.col("y.s_nationkey")) & (F.col("x.ident") < F.col("y.ident")))
    gap = F.abs(F.col("x.s_acctbal") - F.col("y.s_acctbal"))
    return S.soft_accuracy(pairs, (F.col("x.s_acctbal") > F.col("y.s_acctbal")) == (F.col("x.rank") < F.col("y.rank")), gap).select(SIX(F.col("accuracy")).alias("accuracy"), "n")


SOFT_SQL = f"WITH {Q.VOTES}, s AS (SELECT s_suppkey AS ident, s_nationkey AS k, s_acctbal AS v, rank FROM supplier JOIN votes ON ident = s_suppkey AND voter = 'lines') SELECT round(sum(CASE WHEN (x.v > y.v) = (x.rank < y.rank) THEN abs(x.v - y.v) ELSE 0 END) / sum(abs(x.v - y.v)), 6) AS accuracy, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.ident < y.ident"


def expert(spark: SparkSession, d: str) -> DataFrame:
    """A two-layer network over three features."""
    rows = P.scored(spark, d)
    out = S.network(rows, ["core_skill_match", "production_evidence", "yoe_fit_score"], [[0.5, -1.0], [1.5, 0.25], [-0.5, 2.0]], [0.1, -0.2], [1.0, -0.75], 0.05)
    return out.select("candidate_id", SIX(F.col("expert")).alias("expert"))


_EXPERTS = {"AI/ML Engineer": ([[0.5, -1.0], [1.5, 0.25], [-0.5, 2.0]], [0.1, -0.2], [1.0, -0.75], 0.05), "Search Engineer": ([[1.0, 0.5], [-0.25, 1.0], [0.75, -1.5]], [0.0, 0.3], [0.5, 1.25], -0.1)}


def routed_experts(spark: SparkSession, d: str) -> DataFrame:
    """Each record by the network of the role family that its title and jobs tell of."""
    rows = P.scored(spark, d)
    text = F.concat_ws(" ", "profile.current_title", F.transform("career_history", lambda j: j["description"]))
    out = S.routed(rows.withColumn("role", S.role_of(text)), "role", ["core_skill_match", "production_evidence", "yoe_fit_score"], _EXPERTS, "skill_depth_score")
    return out.select("candidate_id", "role", SIX(F.col("expert")).alias("expert"))


def _net_sql(w1, b1, w2, b2) -> str:
    names = ("core_skill_match", "production_evidence", "yoe_fit_score")
    hidden = [f"{w2[k]!r}::DOUBLE * greatest(0, {b1[k]!r}::DOUBLE + " + " + ".join(f"{w1[i][k]!r}::DOUBLE * {c}" for i, c in enumerate(names)) + ")" for k in range(len(b1))]
    return " + ".join([*hidden, f"{b2!r}::DOUBLE"])


_TOLD = [(r, " + ".join(f"contains(t, '{p}')::INT" for p in phrases)) for r, phrases in S.ROLE_HINTS.items()]
ROUTED_SQL = f"""WITH {P.FEATURES}, told AS (SELECT k, lower(any_value(c.title) || ' ' || string_agg(story, ' ' ORDER BY j)) AS t FROM c JOIN jobs USING (k) GROUP BY k),
n AS (SELECT k, [{", ".join(f"({n})" for _, n in _TOLD)}] AS n FROM told),
r AS (SELECT k, CASE WHEN list_max(n) > 0 THEN [{", ".join(f"'{r}'" for r, _ in _TOLD)}][list_position(n, list_max(n))] ELSE '{S.DEFAULT_ROLE}' END AS role FROM n)
SELECT candidate_id, role, round(CASE role {" ".join(f"WHEN '{r}' THEN {_net_sql(*w)}" for r, w in _EXPERTS.items())} ELSE depth END, 6) + 0.0::DOUBLE AS expert FROM f5 JOIN r USING (k)"""
EXPERT_SQL = f"WITH {P.FEATURES} SELECT candidate_id, round(greatest(0, 0.1::DOUBLE + 0.5 * core_skill_match + 1.5 * production_evidence - 0.5 * yoe_fit_score) - 0.75 * greatest(0, -0.2::DOUBLE - core_skill_match + 0.25 * production_evidence + 2 * yoe_fit_score) + 0.05, 6) + 0.0::DOUBLE AS expert FROM f5"

ROLES = {
    "search": {"titles": ["search engineer", "machine learning engineer"], "skills": ["elasticsearch", "ndcg", "python", "learning to rank", "milvus"], "evidence": ["retrieval", "ranking", "bm25", "relevance"]},
    "backend": {"titles": ["backend engineer", "java developer"], "skills": ["python", "kafka", "fastapi", "microservice"], "evidence": ["production", "latency", "users", "monitoring"]},
    "analyst": {"titles": ["data scientist"], "skills": ["excel", "python", "a/b testing"], "evidence": ["budgets", "campaigns"]},
}


def roles(spark: SparkSession, d: str) -> DataFrame:
    """Points of each record for each role; the five best of each role."""
    rows = S.role_points(C.texts(C.with_text(P.records(spark, d))).select("candidate_id", "x_full", "x_tokens"), ROLES)
    w = Window.partitionBy("role").orderBy(F.desc("points"), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("role", "candidate_id", F.col("points").cast("double").alias("points"), F.col("rank").cast("long").alias("rank"))


ROLES_SQL = f"WITH {P.FEATURES}, r AS (" + " UNION ALL ".join(f"SELECT candidate_id, '{r}' AS role, 2.0::DOUBLE * least({P._count(t['titles'], 'xf')}, 2) + least({P._count(t['skills'], 'xf')}, 6) + 0.5::DOUBLE * least({P._count(t['evidence'], 'xf')}, 4) AS points FROM f0" for r, t in ROLES.items()) + ") SELECT role, candidate_id, points, row_number() OVER (PARTITION BY role ORDER BY points DESC, candidate_id) AS rank FROM r QUALIFY rank <= 5"


def record_variants(spark: SparkSession, d: str) -> DataFrame:
    """Records without dates, with long tenures cut, with skills only: what their documents hold."""
    rows = C.complete(P.records(spark, d))
    variants = {
        "whole": rows,
        "dateless": rows.withColumn("career_history", F.transform("career_history", lambda j: j.withField("start_date", F.lit(None).cast("string")).withField("end_date", F.lit(None).cast("string")))),
        "short": rows.withColumn("career_history", F.transform("career_history", lambda j: j.withField("duration_months", F.least(j["duration_months"], F.lit(42))))),
        "skills": rows.withColumn("career_history", F.filter("career_history", lambda j: F.lit(False))),
    }
    every = [r.select("candidate_id", F.lit(v).alias("variant"), C._sum(F.col("career_history"), lambda j: j["duration_months"]).alias("months"), F.size(F.filter("career_history", lambda j: j["end_date"].isNotNull())).alias("ended"), F.size("skills").alias("skills")) for v, r in variants.items()]
    out = every[0].union(every[1]).union(every[2]).union(every[3])
    return out.groupBy("variant").agg(F.sum("months").cast("long").alias("months"), F.sum("ended").alias("ended"), F.sum("skills").alias("skills"))


VARIANT_SQL = f"WITH {P.RECORDS}, n AS (SELECT count(*) AS skills FROM skills), m AS (SELECT sum(months)::BIGINT AS months, sum(least(months, 42))::BIGINT AS cut, count(ended) AS ended FROM jobs) SELECT 'whole' AS variant, months, ended, skills FROM m, n UNION ALL SELECT 'dateless', months, 0, skills FROM m, n UNION ALL SELECT 'short', cut, ended, skills FROM m, n UNION ALL SELECT 'skills', 0, 0, skills FROM n"


def record_summaries(spark: SparkSession, d: str) -> DataFrame:
    """First skills, titles and the head of stories, as a payload of JSON with sorted keys."""
    rows = C.complete(P.records(spark, d))
    payload = F.struct(F.col("candidate_id"), F.slice(F.transform("skills", lambda s: s["name"]), 1, 4).alias("skills"), F.transform(F.slice("career_history", 1, 2), lambda j: F.substring(j["description"], 1, 20)).alias("stories"), F.slice(F.transform("career_history", lambda j: j["title"]), 1, 3).alias("titles"))
    return rows.select("candidate_id", F.to_json(payload).alias("payload"))


SUMMARY_SQL = f"""WITH {P.RECORDS}, a AS (SELECT k, list(name ORDER BY s) FILTER (s < 4) AS skills FROM skills GROUP BY k), b AS (SELECT k, list(story[1:20] ORDER BY j) FILTER (j < 2) AS stories, list(title ORDER BY j) FILTER (j < 3) AS titles FROM jobs GROUP BY k)
SELECT candidate_id, to_json(struct_pack(candidate_id := candidate_id, skills := skills, stories := stories, titles := titles))::VARCHAR AS payload FROM c JOIN a USING (k) JOIN b USING (k)"""


def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Of each story the first sentence that holds evidence and is neither short nor long."""
    jobs = C.complete(P.records(spark, d)).select("candidate_id", F.posexplode("career_history").alias("j", "job"))
    parts = F.filter(F.split("job.description", r"[.;] "), lambda s: F.lower(s).rlike("ranking|retrieval|deployed|production|shipped|serving") & F.length(s).between(25, 140))
    return jobs.select("candidate_id", F.col("j").cast("long").alias("j"), F.get(parts, F.lit(0)).alias("sentence")).where("sentence IS NOT NULL")


SENTENCE_SQL = f"WITH {P.RECORDS}, s AS (SELECT candidate_id, j, list_filter(regexp_split_to_array(story, '[.;] '), lambda x: regexp_matches(lower(x), 'ranking|retrieval|deployed|production|shipped|serving') AND length(x) BETWEEN 25 AND 140)[1] AS sentence FROM jobs JOIN c USING (k)) SELECT candidate_id, j, sentence FROM s WHERE sentence IS NOT NULL"


def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tier and relevance by rules of their own over titles, stories, years and reachability."""
    rows = C.complete(P.records(spark, d))
    text = F.concat_ws(" ", F.transform("career_history", lambda j: j["description"]))
    title, yoe, s = F.col("profile.current_title"), F.col("profile.years_of_experience"), F.col("signals")
    history = F.concat_ws(" ", F.transform("career_history", lambda j: j["title"]))
    target, built, shipped = "(?i)machine learning|ml engineer|ai engineer|search engineer|data scientist", ("ranking", "retrieval", "vector", "recommend", "relevance"), "(?i)shipped|deployed|production|latency|users"
    n = sum((F.lower(text).contains(b).cast("int") for b in built[1:]), F.lower(text).contains(built[0]).cast("int"))
    reach = F.when((s["recruiter_response_rate"] >= 0.5) & (T.days_since(s["last_active_date"]) <= 60) & s["open_to_work_flag"], 1.0).when((s["recruiter_response_rate"] < 0.2) | (T.days_since(s["last_active_date"]) > 150), -1.0).otherwise(0.0)
    points = F.when(title.rlike(target), 2.0).when(history.rlike(target), 1.0).otherwise(0.0) + F.when(title.rlike("(?i)senior|staff|lead|principal|head"), 0.5).otherwise(0.0) + F.least(n, F.lit(2)) + F.when(text.rlike(shipped), 1.0).otherwise(0.0) + F.when(yoe.between(5, 9), 1.0).when(yoe < 4, -1.0).when(yoe > 11, -0.5).otherwise(0.0) + reach
    return rows.select("candidate_id", F.greatest(F.lit(0), F.least(F.lit(5), F.bround(points, 0))).cast("long").alias("tier"), SIX(N.clamp(points / 8 * 5, 0, 5)).alias("relevance"))


_T = "machine learning|ml engineer|ai engineer|search engineer|data scientist"
LABEL_SQL = f"""WITH {P.RECORDS}, sig AS (SELECT k, {P.SIGNALS} FROM c), j AS (SELECT k, lower(string_agg(story, ' ')) AS story, lower(string_agg(title, ' ')) AS titles FROM jobs GROUP BY k),
p AS (SELECT candidate_id, (CASE WHEN regexp_matches(lower(title), '{_T}') THEN 2.0::DOUBLE WHEN regexp_matches(titles, '{_T}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(title), 'senior|staff|lead|principal|head') THEN 0.5::DOUBLE ELSE 0 END + least(contains(story, 'ranking')::INT + contains(story, 'retrieval')::INT + contains(story, 'vector')::INT + contains(story, 'recommend')::INT + contains(story, 'relevance')::INT, 2)
 + CASE WHEN regexp_matches(story, 'shipped|deployed|production|latency|users') THEN 1 ELSE 0 END + CASE WHEN yoe BETWEEN 5 AND 9 THEN 1.0::DOUBLE WHEN yoe < 4 THEN -1 WHEN yoe > 11 THEN -0.5 ELSE 0 END + CASE WHEN rr >= 0.5 AND active >= DATE '2026-04-09' AND otw THEN 1 WHEN rr < 0.2 OR active < DATE '2026-01-09' THEN -1 ELSE 0 END)::DOUBLE AS p FROM c JOIN sig USING (k) JOIN j USING (k))
SELECT candidate_id, greatest(0, least(5, round_even(p, 0)))::BIGINT AS tier, round(least(greatest(p / 8 * 5, 0), 5), 6) + 0.0::DOUBLE AS relevance FROM p"""


def term_mining(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents that hold a seed, by language: how many documents hold them, the ten most of each."""
    docs = _read(spark, d, "documents").where(F.lower("text").rlike(r"\blicen[cs]e|\bversion\b"))
    terms = docs.select("lang", "doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), V.STOPWORDS, ()))).alias("term"))
    n = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("lang", "term", "n", F.col("rank").cast("long").alias("rank"))


MINING_SQL = rf"WITH t AS (SELECT lang, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{V.TOKEN}'), lambda w: NOT list_contains({P._STOP}, w)))) AS term FROM documents WHERE regexp_matches(lower(text), '\blicen[cs]e|\bversion\b')) SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank FROM t GROUP BY lang, term QUALIFY rank <= 10"


def greedy_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Swaps of neighbours in a ranking that don't touch each other, best first."""
    r = Q._ranking(spark, d, 40).join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    swaps = r.withColumns({"b": F.lead("doc_id").over(Window.orderBy("rank")), "m": F.lead("n_chars").over(Window.orderBy("rank"))}).where("b IS NOT NULL")
    return S.greedy_disjoint(swaps.select(F.col("doc_id").alias("a"), "b", ((F.col("doc_id") * 31 + F.col("b") * 17) % 101).cast("double").alias("gain")))


SWAPS_SQL = """
WITH RECURSIVE r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40),
s AS (SELECT *, row_number() OVER (ORDER BY gain DESC, a, b) AS place FROM (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY rank) AS b, ((doc_id * 31 + lead(doc_id) OVER (ORDER BY rank) * 17) % 101)::DOUBLE AS gain FROM r) WHERE b IS NOT NULL),
t AS (SELECT a, b, gain, place, TRUE AS kept, [a, b] AS used FROM s WHERE place = 1 UNION ALL SELECT s.a, s.b, s.gain, s.place, NOT list_has_any(used, [s.a, s.b]), CASE WHEN list_has_any(used, [s.a, s.b]) THEN used ELSE list_concat(used, [s.a, s.b]) END FROM t JOIN s ON s.place = t.place + 1)
SELECT a, b, gain FROM t WHERE kept"""


def strengths(spark: SparkSession, d: str) -> DataFrame:
    """Strengths of event types from who comes first in a user's day."""
    e = _read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "ts")
    first = e.groupBy("user_id", "day", "event_type").agg(F.min("ts").alias("ts"))
    kinds = F.create_map(*[F.lit(x) for kv in zip(("click", "error", "purchase", "signup", "view"), range(5)) for x in kv])
    first = first.withColumn("k", kinds[F.col("event_type")].cast("long"))
    x, y = first.alias("x"), first.alias("y")
    pairs = x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.day") == F.col("y.day")) & (F.col("x.k") < F.col("y.k")))
    judged = pairs.groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.count_if(F.col("x.ts") < F.col("y.ts")).alias("wins_a"), F.count_if(F.col("x.ts") > F.col("y.ts")).alias("wins_b"))
    return S.bradley_terry(judged).select("ident", SIX(F.col("strength")).alias("strength"))


def resampled(spark: SparkSession, d: str) -> DataFrame:
    """The share of good documents with its interval over fifty resamples."""
    return S.bootstrap(_read(spark, d, "labels"), "doc_id", "quality", 50).select(SIX(F.col("mean")).alias("mean"), SIX(F.col("low")).alias("low"), SIX(F.col("high")).alias("high"))


RESAMPLED_SQL = f"""
WITH u AS (SELECT quality, r, {Q._md5_mod("'|' || doc_id || '|' || r", 1 << 20)} / {float(1 << 20)}::DOUBLE AS u FROM labels, range(1, 51) t(r)), w AS (SELECT quality, r, {" + ".join(f"(u >= {p})::INT" for p in S.POISSON)} AS w FROM u), m AS (SELECT r, sum(w * quality) / sum(w) AS m FROM w GROUP BY r)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


def resampled_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """How well length orders documents by quality, with its interval over thirty resamples."""
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.bootstrap_ndcg(rows, "doc_id", "n_chars", "quality", 10, 30).select(*[SIX(F.col(c)).alias(c) for c in ("mean", "low", "high")])


_WORTH = lambda place: f"coalesce(sum((2 ^ quality - 1) / log2({place} + 1)) FILTER ({place} <= 10), 0)"
RESAMPLED_NDCG_SQL = f"""
WITH u AS (SELECT doc_id, n_chars, quality, r, {Q._md5_mod("'|' || doc_id || '|' || r", 1 << 20)} / {float(1 << 20)}::DOUBLE AS u FROM labels JOIN documents USING (doc_id), range(1, 31) t(r)),
e AS (SELECT doc_id, n_chars, quality, r, unnest(range({" + ".join(f"(u >= {p})::INT" for p in S.POISSON)})) AS copy FROM u),
p AS (SELECT r, quality, row_number() OVER (PARTITION BY r ORDER BY n_chars DESC, doc_id, copy) AS a, row_number() OVER (PARTITION BY r ORDER BY quality DESC, doc_id, copy) AS b FROM e),
m AS (SELECT r, coalesce({_WORTH("a")} / nullif({_WORTH("b")}, 0), 0) AS m FROM p GROUP BY r)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


QUERIES = {
    "u06_drawn_and_split": drawn,
    "u02_unions_and_bands": unions,
    "g12_stacked_weights": stacked,
    "a26_soft_pairs": soft_pairs,
    "r22_expert_network": expert,
    "r22_routed_experts": routed_experts,
    "r39_roles": roles,
    "p11_record_variants": record_variants,
    "p08_record_summaries": record_summaries,
    "t18_evidence_sentences": evidence_sentences,
    "l01_rule_labels": rule_labels,
    "a23_term_mining": term_mining,
    "w12_greedy_swaps": greedy_swaps,
    "g16_strengths": strengths,
    "a14_bootstrap": resampled,
    "a14_bootstrap_ndcg": resampled_ndcg,
}
ORACLE = {
    "r22_routed_experts": ROUTED_SQL,
    "u06_drawn_and_split": DRAWN_SQL,
    "u02_unions_and_bands": UNION_SQL,
    "g12_stacked_weights": STACK_SQL,
    "a26_soft_pairs": SOFT_SQL,
    "r22_expert_network": EXPERT_SQL,
    "r39_roles": ROLES_SQL,
    "p11_record_variants": VARIANT_SQL,
    "p08_record_summaries": SUMMARY_SQL,
    "t18_evidence_sentences": SENTENCE_SQL,
    "l01_rule_labels": LABEL_SQL,
    "a23_term_mining": MINING_SQL,
    "w12_greedy_swaps": SWAPS_SQL,
    "a14_bootstrap": RESAMPLED_SQL,
    "a14_bootstrap_ndcg": RESAMPLED_NDCG_SQL,
}
