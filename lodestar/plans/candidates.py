"""Queries: candidate records made from the customers by integer arithmetic, so that SQL can make the same ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import bm25
from lodestar.operators import candidates as C
from lodestar.sources.staging import spread, staged

TITLES = ["Senior Machine Learning Engineer", "Data Scientist", "Backend Engineer", "Marketing Manager", "Junior ML Engineer", "Search Engineer", "Accountant", "Lead AI Engineer", "Java Developer"]
COMPANIES = ["Flipkart", "TCS", "Acme Corp", "Infosys", "Tiny Labs", "Swiggy", "Wipro"]
INDUSTRIES = ["Software", "IT Services", "Fintech", "Manufacturing", "Data Platform"]
SIZES = ["1-10", "51-200", "1001-5000", "10001+"]
STORIES = [
    "Built a ranking and retrieval system with vector search, deployed to production for 10m users at low latency.",
    "Wrote a paper on computer vision and speech recognition, opencv and robotics in a research lab.",
    "Managed campaigns and budgets.",
    "Implemented microservice backend service in python with fastapi, monitoring and on-call, serving a million users.",
    "Learning to rank with ndcg and mrr, recommendation relevance, bm25 indexing; shipped, launched, a/b tested inference.",
    "LangChain prompt engineering experiments.",
]
SKILLS = ["Python", "Milvus", "NLP", "NDCG", "PyTorch", "Excel", "LangChain", "Embeddings", "Kafka", "Photoshop", "Learning to Rank", "A/B Testing", "LoRA", "Elasticsearch", "open-source"]
LEVELS = ["beginner", "intermediate", "advanced", "expert"]
CITIES = ["Pune, Maharashtra", "Berlin", "Chennai", "Greater Noida", "Austin"]
COUNTRIES = ["India", "Germany", "India", "India", "USA"]
DEGREES = ["B.Tech", "M.Tech", "Ph.D", "BA"]
FIELDS = ["Computer Science", "History", "Statistics"]
TIERS = ["tier_1", "tier_2", "tier_3"]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(T.words(values), (index % len(values)).cast("int"))


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    job = lambda j: F.struct(
        _pick(COMPANIES, k * 3 + j * 5).alias("company"),
        _pick(TITLES, k + j * 2).alias("title"),
        _pick(INDUSTRIES, k + j).alias("industry"),
        _pick(SIZES, k + j * 3).alias("company_size"),
        _pick(STORIES, k * 5 + j * 7).alias("description"),
        F.concat((2024 - j * 2).cast("string"), F.lit("-01-01")).alias("start_date"),
        F.when(j > 0, F.concat((2026 - j * 2 - k % 9).cast("string"), F.lit("-01-01"))).alias("end_date"),
        ((j == 0) | (k % 31 == 0)).alias("is_current"),
        ((k * 7 + j * 11) % 60).cast("int").alias("duration_months"),
    )
    skill = lambda s: F.struct(_pick(SKILLS, k * 5 + s * 4).alias("name"), _pick(LEVELS, k + s).alias("proficiency"), ((k * 13 + s * 17) % 70).cast("int").alias("endorsements"), ((k * 11 + s * 19) % 90 * F.when(k % 17 == 0, 0).otherwise(1)).cast("int").alias("duration_months"))
    study = lambda e: F.struct(F.lit("A College").alias("institution"), _pick(DEGREES, k + e).alias("degree"), _pick(FIELDS, k + e * 2).alias("field_of_study"), _pick(TIERS, k + e).alias("tier"), (2010 + e * 3).cast("int").alias("start_year"), (F.lit(2014) + e * 3 - F.when(k % 41 == 0, 9).otherwise(0)).cast("int").alias("end_year"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: i < n)
    signals = F.struct(
        (k % 3 != 0).alias("open_to_work_flag"), (k % 2 == 0).alias("verified_email"), (k % 5 < 3).alias("verified_phone"), (k % 7 < 4).alias("linkedin_connected"), (k % 4 == 1).alias("willing_to_relocate"),
        ((k % 11) / 10.0).alias("recruiter_response_rate"), (k * 3 % 200).cast("double").alias("avg_response_time_hours"), ((k % 9) / 8.0).alias("interview_completion_rate"), ((k % 13 - 1) / 12.0).alias("offer_acceptance_rate"),
        (k * 7 % 101).cast("double").alias("profile_completeness_score"), (k % 120 - 10).cast("double").alias("github_activity_score"), (k % 90).cast("int").alias("profile_views_received_30d"), (k % 14).cast("int").alias("applications_submitted_30d"),
        (k % 12).cast("int").alias("saved_by_recruiters_30d"), (k % 260).cast("int").alias("search_appearance_30d"), (k % 8 * 20).cast("int").alias("notice_period_days"), (k % 60).cast("int").alias("endorsements_received"),
        F.format_string("2026-%02d-%02d", (k % 5 + 1).cast("int"), (k % 28 + 1).cast("int")).alias("last_active_date"), F.lit("remote").alias("preferred_work_mode"),
        F.when(k % 4 == 0, F.create_map(F.lit("Python"), (k % 100).cast("double"), F.lit("NDCG"), (k * 3 % 100).cast("double"))).otherwise(F.create_map().cast("map<string,double>")).alias("skill_assessment_scores"),
        F.struct((k % 40).cast("double").alias("min"), (k % 37 + 5).cast("double").alias("max")).alias("expected_salary_range_inr_lpa"),
    )
    profile = F.struct(_pick(TITLES, k).alias("current_title"), F.lit("Engineer").alias("headline"), F.concat(F.lit("Engineer with "), (k % 15).cast("string"), F.lit("+ years of experience.")).alias("summary"), F.lit("Software").alias("current_industry"), _pick(CITIES, k).alias("location"), _pick(COUNTRIES, k).alias("country"), (k % 19 + F.when(k % 23 == 0, 4).otherwise(0)).cast("double").alias("years_of_experience"))
    rows = spread(spark.read.parquet(f"{d}/customer.parquet"))
    return rows.select(F.format_string("CAND_%07d", k).alias("candidate_id"), k.alias("k"), profile.alias("profile"), F.transform(upto(1 + k % 5), job).alias("career_history"), F.transform(upto(1 + k % 2), study).alias("education"), F.transform(upto(2 + k % 15), skill).alias("skills"), signals.alias("signals"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values: list[str], index: str) -> str:
    return f"{_sql_list(values)}[({index}) % {len(values)} + 1]"


RECORDS = f"""
c AS (SELECT c_custkey AS k, printf('CAND_%07d', c_custkey) AS candidate_id, {_at(TITLES, "c_custkey")} AS title, 'Engineer' AS headline, 'Engineer with ' || (c_custkey % 15) || '+ years of experience.' AS summary, {_at(CITIES, "c_custkey")} AS city, {_at(COUNTRIES, "c_custkey")} AS country, (c_custkey % 19 + CASE WHEN c_custkey % 23 = 0 THEN 4 ELSE 0 END)::DOUBLE AS yoe FROM customer),
jobs AS (SELECT k, j, {_at(COMPANIES, "k * 3 + j * 5")} AS company, {_at(TITLES, "k + j * 2")} AS title, {_at(INDUSTRIES, "k + j")} AS industry, {_at(SIZES, "k + j * 3")} AS size, {_at(STORIES, "k * 5 + j * 7")} AS story, j = 0 OR k % 31 = 0 AS current, (k * 7 + j * 11) % 60 AS months, CASE WHEN j > 0 THEN 2026 - j * 2 - k % 9 END AS ended FROM c, range(5) r(j) WHERE j < 1 + k % 5),
skills AS (SELECT k, s, {_at(SKILLS, "k * 5 + s * 4")} AS name, {_at(LEVELS, "k + s")} AS level, (k * 13 + s * 17) % 70 AS endorsements, (k * 11 + s * 19) % 90 * CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END AS months FROM c, range(17) r(s) WHERE s < 2 + k % 15),
studies AS (SELECT k, e, {_at(DEGREES, "k + e")} AS degree, {_at(FIELDS, "k + e * 2")} AS field, {_at(TIERS, "k + e")} AS tier, 2010 + e * 3 AS a, 2014 + e * 3 - CASE WHEN k % 41 = 0 THEN 9 ELSE 0 END AS b FROM c, range(2) r(e) WHERE e < 1 + k % 2)"""
_N = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9+#\\s]', ' ', 'g'))"


def _has(terms, padded_sql: str) -> str:
    return "(" + " OR ".join(f"contains({padded_sql}, '{t}')" for t in T.padded(terms)) + ")"


def _count(terms, padded_sql: str) -> str:
    every = T.padded(terms)
    singles = list(dict.fromkeys(t for t in every if " " not in t.strip()))
    return " + ".join(f"contains({padded_sql}, '{t}')::INT" for t in [*singles, *(t for t in every if " " in t.strip())])


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


_EVERY = [T.norm_literal(a) for g in (*V.MUST.values(), *V.NICE.values()) for a in g]


def _alias(aliases) -> str:
    normal = [T.norm_literal(a) for a in aliases]
    return f"CASE WHEN list_has_any(terms, {_sql_list(normal)}) THEN 1.0::DOUBLE WHEN {_count(normal, 'xf')} > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"


_TITLE = "greatest(" + ", ".join(f"CASE WHEN contains(tt, '{t}') THEN {w} ELSE 0.08 END" for term, w in V.TITLES.items() for t in T.padded([term])) + ")::DOUBLE"
_CONCEPT_SQL = "concat_ws(' ', " + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(t), '{a}')''' for a in al)} THEN 'concept_{n}' END" for n, al in V.CONCEPTS.items()) + ")"
_LOG60 = "ln(61.0::DOUBLE)"
_OWN = "list_distinct(list_filter(regexp_split_to_array(xf, '\\s+'), lambda w: w <> ''))"
_IDEAL = _sql_list(C.template_tokens())
_LIKE = f"len(list_intersect({_OWN}, {_IDEAL})) / (len({_OWN}) + len({_IDEAL}) - len(list_intersect({_OWN}, {_IDEAL})))"
SIGNALS = """(k % 3 <> 0) AS otw, (k % 11) / 10.0::DOUBLE AS rr, (k * 3 % 200)::DOUBLE AS rt, (k % 9) / 8.0::DOUBLE AS icr, (k % 13 - 1) / 12.0::DOUBLE AS oar, (k * 7 % 101)::DOUBLE AS pcs, (k % 120 - 10)::DOUBLE AS gh, k % 12 AS saved, k % 8 * 20 AS notice, k % 60 AS er, make_date(2026, (k % 5 + 1)::INT, (k % 28 + 1)::INT) AS active"""
FEATURES = f"""{RECORDS},
sig AS (SELECT k, {SIGNALS} FROM c),
txt AS (SELECT c.k, concat_ws(' ', c.title, headline, summary, 'Software', city, country) || chr(10) || (SELECT string_agg(title || ' ' || company || ' ' || industry || ' ' || story || ' ' || months || ' months', chr(10) ORDER BY j) FROM jobs WHERE jobs.k = c.k) || chr(10) || (SELECT string_agg(name || ' ' || level || ' ' || months || ' months endorsements ' || endorsements, ' ' ORDER BY s) FROM skills WHERE skills.k = c.k) || chr(10) || (SELECT string_agg(degree || ' ' || field || ' A College ' || tier, chr(10) ORDER BY e) FROM studies WHERE studies.k = c.k) || chr(10) || 'open_to_work ' || CASE WHEN otw THEN 'True' ELSE 'False' END || ' response_rate ' || rr || ' github_activity ' || gh || ' notice_period ' || notice || ' remote' AS t,
 (SELECT summary || ' ' || string_agg(title || ' ' || story || ' ' || industry, ' ' ORDER BY j) FROM jobs WHERE jobs.k = c.k) AS career, (SELECT string_agg({_N("title")}, ' ' ORDER BY j) FROM jobs WHERE jobs.k = c.k) AS titles FROM c JOIN sig USING (k)),
nrm AS (SELECT k, CASE WHEN {_CONCEPT_SQL} <> '' THEN t || chr(10) || {_CONCEPT_SQL} ELSE t END AS doc, ' ' || {_N(f"CASE WHEN {_CONCEPT_SQL} <> '' THEN t || chr(10) || {_CONCEPT_SQL} ELSE t END")} || ' ' AS xf, ' ' || {_N("career")} || ' ' AS xc, titles FROM txt),
sk AS (SELECT k, list_distinct(flatten(list(list_append(list_filter(string_split({_N("name")}, ' '), lambda w: length(w) > 2), {_N("name")})))) AS terms, count(*) AS n,
 {_clamp(f"sum(CASE WHEN {_has(_EVERY, _chr := chr(39) + ' ' + chr(39) + ' || ' + _N('name') + ' || ' + chr(39) + ' ' + chr(39))} THEN 0.45::DOUBLE * CASE level WHEN 'beginner' THEN 0.35 WHEN 'intermediate' THEN 0.6 WHEN 'advanced' THEN 0.85 ELSE 1.0 END + 0.35::DOUBLE * least(months / 36.0::DOUBLE, 1) + 0.2::DOUBLE * least(ln(1 + endorsements::DOUBLE) / {_LOG60}, 1) ELSE 0 END) / greatest(1, least(7, count(*) FILTER ({_has(_EVERY, _chr)})))")} AS depth,
 avg(least(ln(1 + endorsements::DOUBLE) / {_LOG60} * CASE WHEN endorsements > 30 AND months < 6 THEN 0.55::DOUBLE ELSE 1 END, 1)) AS trust,
 count(*) FILTER (level = 'expert' AND months = 0) AS idle, count(*) FILTER (level = 'expert' AND months = 0 AND {_has([T.norm_literal(a) for g in V.MUST.values() for a in g], _chr)}) AS idle_core FROM skills GROUP BY k),
jb AS (SELECT k, sum(months)::DOUBLE AS months, sum(months) FILTER ({_has(V.PRODUCT_COMPANIES, _cx := "' ' || " + _N("company") + " || ' '")} OR (NOT {_has(V.SERVICES, _cx)} AND ({_has(V.PRODUCT_INDUSTRIES, _ix := "' ' || " + _N("industry") + " || ' '")} OR (list_contains({_sql_list(V.PRODUCT_SIZES)}, size) AND {_has(V.TECH_INDUSTRIES, _ix)}))))::DOUBLE AS product, sum(months) FILTER ({_has(V.SERVICES, _cx)})::DOUBLE AS services,
 sum(months) FILTER ({_has([*V.RETRIEVAL_TERMS, *V.LEARNING_TERMS], "' ' || " + _N("title || ' ' || story") + " || ' '")})::DOUBLE AS learning, count(*) FILTER (months >= 18) AS long, count(*) FILTER (current) AS current, list_sort(list(months) FILTER (NOT current)) AS done FROM jobs GROUP BY k),
ed AS (SELECT k, max(least(CASE tier WHEN 'tier_1' THEN 1.0 WHEN 'tier_2' THEN 0.8 ELSE 0.5 END + CASE WHEN field IN ('Computer Science', 'Statistics') THEN 0.12 ELSE 0 END + CASE WHEN degree IN ('M.Tech', 'Ph.D') THEN 0.05 ELSE 0 END, 1))::DOUBLE AS education, bool_or(b < a) AS impossible FROM studies GROUP BY k),
f0 AS (SELECT c.*, sig.* EXCLUDE (k), nrm.* EXCLUDE (k), sk.* EXCLUDE (k), jb.* EXCLUDE (k), ed.* EXCLUDE (k), ' ' || {_N("title")} || ' ' || {_N("headline")} || ' ' || titles || ' ' AS tt FROM c JOIN sig USING (k) JOIN nrm USING (k) JOIN sk USING (k) JOIN jb USING (k) JOIN ed USING (k)),
f1 AS (SELECT *, {_clamp(" + ".join(f"{w} * {_alias(V.MUST[g])}" for g, w in V.MUST_WEIGHTS.items()))} AS core_skill_match, {_clamp(f"({_count(_EVERY, 'xf')}) / 12.0::DOUBLE")} AS jd_keyword_coverage_score, ({" + ".join(_alias(a) for a in V.NICE.values())}) / 5 AS nice_skill_match,
 {_clamp(f"({_count(V.RETRIEVAL_TERMS, 'xc')}) / 7.0::DOUBLE")} AS ir_ranking_experience, {_clamp(f"least(({_count(V.PRODUCTION_TERMS, 'xc')}) / 8.0::DOUBLE, 1) + CASE WHEN long >= 2 THEN 0.08::DOUBLE ELSE 0 END")} AS production_evidence, {_clamp(f"({_count(V.SCALE_TERMS, 'xc')}) / 4.0::DOUBLE")} AS scale_signal,
 {_clamp(f"({_count(V.CODE_TERMS, _both := chr(39) + ' ' + chr(39) + ' || ' + _N('title') + ' || xc')}) / 4.0::DOUBLE")} AS code_writing_recent, {_clamp(f"({_count(V.OPEN_SOURCE_TERMS, 'xf')}) / 3.0::DOUBLE")} AS open_source_signal, {_count(V.VISION_TERMS, "xf")} AS vision, {_count(V.WRAPPER_TERMS, "xf")} AS wrapper, {_has(V.RESEARCH_TERMS, "xc")} AS research, {_LIKE} AS hyre_similarity,
 CASE WHEN {_has(V.OTHER_TITLES, "' ' || " + _N("title") + " || ' '")} THEN least({_TITLE}, 0.18) ELSE {_TITLE} END AS title_match_score, {_clamp("coalesce(product, 0) / greatest(1, months)")} AS product_company_ratio, len(coalesce(done, [])) AS nd,
 CASE WHEN len(coalesce(done, [])) = 0 THEN 0 ELSE (done[(len(done) - 1) // 2 + 1] + done[len(done) // 2 + 1]) / 2.0::DOUBLE END AS median, len(list_filter(coalesce(done, []), lambda m: m < 18)) AS short, len(list_filter(coalesce(done, []), lambda m: m < 9)) AS tiny FROM f0),
f2 AS (SELECT *, CASE WHEN yoe >= 10 AND short / greatest(1, nd) <= 0.4 AND median >= 18 THEN 0.0::DOUBLE WHEN (nd >= 3 AND median < 18) OR tiny >= 3 THEN 1.0::DOUBLE WHEN short >= 3 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS hop,
 CASE WHEN months > 0 AND coalesce(services, 0) / greatest(months, 1) > 0.8 AND product_company_ratio < 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS consulting_only_flag, CASE WHEN {_has(V.SENIOR, "' ' || " + _N("title") + " || ' ' || titles || ' '")} AND title_match_score > 0.55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS senior_title_held,
 CASE WHEN vision >= 3 AND ir_ranking_experience < 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS disqualifier_skill_flag,
 CASE WHEN yoe >= 7 THEN 1.0::DOUBLE ELSE exp(-((yoe - 7) ^ 2) / 13.52) END * CASE WHEN yoe < 3 THEN 0.55::DOUBLE ELSE 1 END AS yoe_fit_score, {_clamp("coalesce(learning, 0) / 60")} AS ml_ai_tenure_score,
 CASE WHEN active >= DATE '2026-05-25' THEN 1.0::DOUBLE WHEN active >= DATE '2026-05-09' THEN 0.9 WHEN active >= DATE '2026-04-09' THEN 0.72 WHEN active >= DATE '2026-02-08' THEN 0.5 ELSE 0.22 END * CASE WHEN otw THEN 1.0::DOUBLE ELSE 0.68 END AS availability_score,
 {_clamp("0.25::DOUBLE * (k % 90) / 80 + 0.2::DOUBLE * (k % 14) / 12 + 0.35::DOUBLE * saved / 12 + 0.2::DOUBLE * (k % 260) / 250")} AS engagement_score,
 0.75::DOUBLE * rr + 0.25::DOUBLE * CASE WHEN rt = 0 THEN 0.15 WHEN rt <= 12 THEN 1.0 WHEN rt <= 24 THEN 0.85 WHEN rt <= 72 THEN 0.65 WHEN rt <= 168 THEN 0.35 ELSE 0.15 END AS responsiveness_score, icr AS interview_reliability,
 0.7::DOUBLE * pcs / 100 + 0.3::DOUBLE * (CASE WHEN k % 2 = 0 THEN 0.45 ELSE 0 END + CASE WHEN k % 5 < 3 THEN 0.35 ELSE 0 END + CASE WHEN k % 7 < 4 THEN 0.2 ELSE 0 END) AS profile_quality,
 CASE WHEN notice = 0 THEN 0.2::DOUBLE WHEN notice <= 30 THEN 1.0 WHEN notice <= 60 THEN 0.93 WHEN notice <= 90 THEN 0.85 WHEN notice <= 120 THEN 0.45 ELSE 0.2 END AS notice_period_score,
 CASE WHEN city IN ('Pune, Maharashtra', 'Greater Noida') THEN 1.0::DOUBLE WHEN country = 'India' THEN 0.68 WHEN k % 4 = 1 THEN 0.42 ELSE 0.1 END AS location_score, CASE WHEN k % 4 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relocation_willing,
 CASE WHEN gh < 0 THEN 0 ELSE least(gh / 100, 1) END AS github_signal, CASE WHEN k % 4 = 0 THEN (k % 100 + k * 3 % 100) / 200.0::DOUBLE ELSE 0 END AS assessment_score_avg FROM f1),
f3 AS (SELECT *, {_clamp("0.75::DOUBLE * title_match_score + 0.25::DOUBLE * product_company_ratio - CASE WHEN production_evidence > 0.45 OR ir_ranking_experience > 0.65 THEN 0.18::DOUBLE ELSE 0.35::DOUBLE END * hop")} AS career_trajectory_score,
 CASE WHEN n >= 12 AND core_skill_match >= 0.55 THEN (2 + (production_evidence < 0.3)::INT + (ir_ranking_experience < 0.25)::INT + (depth < 0.45)::INT + (trust < 0.35)::INT) / 6.0::DOUBLE ELSE 0 END AS keyword_stuffer_flag FROM f2),
f4 AS (SELECT *, list_filter([CASE WHEN yoe > 0 AND months > floor(yoe * 12) + 30 THEN 'experience_timeline_exceeds_claim' END, CASE WHEN yoe >= 5 AND months < floor(yoe * 12) * 0.45 THEN 'career_history_too_short_for_claimed_yoe' END, CASE WHEN abs(k % 15 - months / 12) <= 1.5 AND yoe - k % 15 >= 3 THEN 'summary_career_yoe_contradiction' END, CASE WHEN idle_core >= 2 OR idle >= 5 THEN 'expert_skill_zero_duration' END,
 CASE WHEN current > 2 THEN 'multiple_current_jobs' END, CASE WHEN impossible THEN 'impossible_education_timeline' END, CASE WHEN {_has(V.OTHER_TITLES, "' ' || " + _N("title") + " || ' '")} AND ir_ranking_experience >= 0.45 THEN 'title_description_contradiction' END], lambda x: x IS NOT NULL) AS hard,
 list_filter([CASE WHEN consulting_only_flag > 0 THEN 'consulting_only' END, CASE WHEN k % 40 > k % 37 + 5 THEN 'salary_inversion' END, CASE WHEN pcs < 40 AND er > 40 THEN 'endorsement_inflation_low_profile' END, CASE WHEN research AND production_evidence < 0.35 THEN 'pure_research_without_deployment' END, CASE WHEN disqualifier_skill_flag > 0 THEN 'cv_speech_robotics_primary' END, CASE WHEN keyword_stuffer_flag >= 0.75 THEN 'keyword_stuffer' END, CASE WHEN hop >= 1 THEN 'title_hopper' END,
 CASE WHEN wrapper >= 1 AND production_evidence < 0.35 AND ir_ranking_experience < 0.3 AND (ml_ai_tenure_score < 0.25 OR yoe < 4) THEN 'llm_wrapper_only' END, CASE WHEN ({_has(V.JUNIOR, "' ' || " + _N("title") + " || ' '")} OR yoe < 4) AND senior_title_held = 0 AND production_evidence < 0.6 AND ir_ranking_experience < 0.6 THEN 'junior_for_senior_role' END], lambda x: x IS NOT NULL) AS soft FROM f3),
claims AS (SELECT k, count(*) FILTER (k % 4 = 0 AND ((name = 'Python' AND k % 100 < CASE level WHEN 'beginner' THEN 10 WHEN 'intermediate' THEN 30 WHEN 'advanced' THEN 50 ELSE 65 END) OR (name = 'NDCG' AND k * 3 % 100 < CASE level WHEN 'beginner' THEN 10 WHEN 'intermediate' THEN 30 WHEN 'advanced' THEN 50 ELSE 65 END))) AS fails FROM skills GROUP BY k),
f5 AS (SELECT f4.*, least(greatest(CASE WHEN otw THEN 1.05::DOUBLE ELSE 0.9 END * (0.5 + 0.5 * sqrt(responsiveness_score)) * (0.7 + 0.3 * profile_quality) * (0.85 + 0.25 * availability_score) * (0.8 + 0.2 * icr) * CASE WHEN saved > 5 THEN 1.03::DOUBLE WHEN saved = 0 THEN 0.97 ELSE 1 END * CASE WHEN github_signal > 0.2 THEN 1.03::DOUBLE ELSE 1 END
 * CASE WHEN k % 4 = 0 THEN CASE WHEN assessment_score_avg > 0.6 THEN 1.05::DOUBLE WHEN assessment_score_avg < 0.4 THEN 0.9 ELSE 1 END * greatest(0.86::DOUBLE ^ fails, 0.55) ELSE 1 END * CASE WHEN oar >= 0 THEN 0.85::DOUBLE + 0.3 * oar ELSE 1 END * CASE WHEN profile_quality > 0.82 THEN 1.02::DOUBLE ELSE 1 END * CASE WHEN notice_period_score >= 1 THEN 1.05::DOUBLE WHEN notice_period_score <= 0.2 THEN 0.7 ELSE 1 END, 0.25), 1.1) AS behaviour,
 CASE WHEN len(hard) = 0 THEN 1.0::DOUBLE WHEN len(list_filter(hard, lambda h: NOT list_contains({_sql_list(V.SOFT_HONEYPOTS)}, h))) = 0 THEN 0.05 ELSE 0 END AS honeypot,
 greatest(CASE WHEN list_contains(soft, 'consulting_only') THEN CASE WHEN production_evidence > 0.5 THEN 0.8::DOUBLE ELSE 0.35 END ELSE 1 END * {" * ".join(f"CASE WHEN list_contains(soft, '{f}') THEN {w}::DOUBLE ELSE 1 END" for f, w in V.DISQUALIFIERS.items())}, 0.05) AS disqualifier FROM f4 JOIN claims USING (k))"""

#: Feature and its name in the SQL.
SHOWN = {f: {"skill_depth_score": "depth", "endorsement_trust": "trust", "education_score": "education"}.get(f, f) for f in V.FEATURES if f not in ("backend_depth_score", "data_bi_depth_score")}


def scored(spark: SparkSession, d: str) -> DataFrame:
    return C.gates(C.features(C.with_text(records(spark, d))))


def features(spark: SparkSession, d: str) -> DataFrame:
    return C.features(C.with_text(records(spark, d))).select("candidate_id", F.md5(F.col("doc_text").cast("binary")).alias("document"), *[N.six(F.col(f)).alias(f) for f in SHOWN])


FEATURES_SQL = f"WITH {FEATURES} SELECT candidate_id, md5(doc) AS document, {', '.join(f'round({e}, 6)::DOUBLE + 0.0::DOUBLE AS {f}' for f, e in SHOWN.items())} FROM f3"


def flags_and_gates(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("candidate_id", F.array_join("flags", ",").alias("flags"), N.six(F.col("behavioral_multiplier")).alias("behaviour"), N.six(F.col("honeypot_multiplier")).alias("honeypot"), N.six(F.col("disqualifier_multiplier")).alias("disqualifier"))


GATES_SQL = f"WITH {FEATURES} SELECT candidate_id, array_to_string(list_concat(hard, soft), ',') AS flags, round(behaviour, 6) AS behaviour, honeypot, round(disqualifier, 6) AS disqualifier FROM f5"


def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all profiles without retrieval."""
    rows = scored(spark, d).withColumn("retrieval", F.lit(0.5))
    return rows.select("candidate_id", *[N.six(C.score(p)).alias(p.replace("-", "_")) for p in V.PROFILES])


def _score_sql(profile: str, retrieval: str = "0.5") -> str:
    factors, exponent = V.PROFILES[profile]
    weights = {k: w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()}
    parts = " + ".join(f"{w!r}::DOUBLE * {retrieval if k == 'bm25_score' else SHOWN[k]}" for k, w in weights.items())
    return f"({parts}) / {sum(weights.values())!r}::DOUBLE * behaviour ^ {exponent}::DOUBLE * honeypot * disqualifier"


SCORES_SQL = f"WITH {FEATURES} SELECT candidate_id, {', '.join(f'round({_score_sql(p)}, 6) + 0.0::DOUBLE AS ' + p.replace('-', '_') for p in V.PROFILES)} FROM f5"


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred: retrieval against the default query, scaled to 0..1, then the main profile's score."""
    rows = C.with_text(records(spark, d)).withColumn("tokens", T.tokens(F.col("doc_text")))
    rows = C.gates(C.features(bm25.matched(rows, bm25_terms())))
    # Records are rendered and counted once; statistics, scale and order are told from what scores need.
    gates = ["behavioral_multiplier", "honeypot_multiplier", "disqualifier_multiplier"]
    rows = staged(rows.select("candidate_id", *bm25.MATCHED, *[k for k in V.WEIGHTS if k != "bm25_score"], *gates), "matched")
    rows = bm25.score(rows, bm25_terms())
    low, high = rows.agg(F.min("bm25"), F.max("bm25")).first()
    rows = rows.withColumn("retrieval", N.minmax(F.col("bm25"), F.lit(low or 0.0), F.lit(high or 0.0)))
    out = rows.withColumn("total", C.score("main"))
    top = bm25.ranked(out.select("candidate_id", "total"), "candidate_id", "total", 100)
    return top.select("candidate_id", F.col("rank").cast("long").alias("rank"), "score")


def bm25_terms() -> list[str]:
    import re

    low = V.DEFAULT_QUERY.lower()
    return [t for t in re.findall(V.TOKEN, low) if t not in V.STOPWORDS] + [p.replace("/", "_").replace(" ", "_") for p in V.PHRASES if p in low]


_STOP = _sql_list(list(dict.fromkeys(V.STOPWORDS)))
RANKING_SQL = f"""WITH {FEATURES},
tok AS (SELECT k, list_concat(list_filter(regexp_extract_all(lower(doc), '{V.TOKEN}'), lambda w: NOT list_contains({_STOP}, w)), list_transform(list_filter({_sql_list(V.PHRASES)}, lambda p: contains(lower(doc), p)), lambda p: replace(replace(p, '/', '_'), ' ', '_'))) AS tokens FROM nrm),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_sql_list(bm25_terms())}) AS term) GROUP BY term), st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
tf AS (SELECT k, len(tokens) AS length, term, count(*) AS tf FROM (SELECT k, tokens, unnest(tokens) AS term FROM tok) SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT tok.k, coalesce(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.5 * (0.25 + 0.75 * length / mean) + tf)), 0) AS bm25 FROM tok CROSS JOIN st LEFT JOIN tf USING (k) LEFT JOIN df USING (term) LEFT JOIN q USING (term) GROUP BY tok.k),
r AS (SELECT candidate_id, round({_score_sql("main", "(bm25 - (SELECT min(bm25) FROM b)) / (SELECT max(bm25) - min(bm25) FROM b)")}, 6) + 0.0::DOUBLE AS score FROM f5 JOIN b USING (k))
SELECT candidate_id, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank, score FROM r QUALIFY rank <= 100"""


def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean score and rows kept above a threshold for floors of the behaviour multiplier."""
    rows = C.features(C.with_text(records(spark, d))).withColumn("retrieval", F.lit(0.5))
    # A record's features are found once: floors differ only in the gate, which every record passes with each.
    floors = (0.25, 0.55, 0.85)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), C.behaviour(f).alias("behavioral_multiplier")) for f in floors]))
    every = C.gates(rows).withColumn("each", each).withColumns({k: F.col(f"each.{k}") for k in ("floor", "behavioral_multiplier")}).select("floor", C.score("main").alias("s"))
    return every.groupBy("floor").agg(N.six(F.avg("s")).alias("mean"), F.count_if(F.col("s") > 0.2).alias("n_over"))


FLOOR_SQL = f"WITH {FEATURES}, fl AS (SELECT unnest([0.25, 0.55, 0.85]::DOUBLE[]) AS floor), s AS (SELECT floor, {_score_sql('main').replace('behaviour ^', 'greatest(behaviour, floor) ^')} AS s FROM f5, fl) SELECT floor, round(avg(s), 6) AS mean, count(*) FILTER (s > 0.2) AS n_over FROM s GROUP BY floor"


def counterfactuals(spark: SparkSession, d: str) -> DataFrame:
    """Change of score when the place, or the behaviour, is another: spread by variant."""
    rows = records(spark, d)
    profile, signals = F.col("profile"), F.col("signals")
    variants = {
        "place": (profile.withField("location", F.lit("Pune")).withField("country", F.lit("India")), signals),
        "behaviour": (profile, signals.withField("recruiter_response_rate", F.lit(0.5)).withField("open_to_work_flag", F.lit(True))),
    }
    delta = _deltas(rows, variants)
    return delta.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.abs("delta") > 1e-9).alias("n_changed"), N.six(F.max(F.abs("delta"))).alias("largest"))


def _deltas(rows: DataFrame, variants: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(variant, delta): change of a record's score by variant of its profile or signals, each given by a pair of columns.

    What the variants share is found once, before they part; a record's scores meet by its id.
    """
    every = {"": (F.col("profile"), F.col("signals"))} | variants
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), p.alias("profile"), s.alias("signals")) for v, (p, s) in every.items()]))
    apart = C.shared(rows).withColumn("each", each).withColumns({k: F.col(f"each.{k}") for k in ("variant", "profile", "signals")}).drop("each")
    scores = C.gates(C.features(C.with_text(apart))).withColumn("retrieval", F.lit(0.5)).select("candidate_id", "variant", C.score("main").alias("s"))
    met = scores.groupBy("candidate_id").agg(F.max(F.when(F.col("variant") == "", F.col("s"))).alias("base"), F.collect_list(F.when(F.col("variant") != "", F.struct("variant", "s"))).alias("others"))
    return met.select("base", F.inline("others")).select("variant", (F.col("s") - F.col("base")).alias("delta"))


_PLACE = FEATURES.replace(f"{_at(CITIES, 'c_custkey')} AS city, {_at(COUNTRIES, 'c_custkey')} AS country", "'Pune' AS city, 'India' AS country").replace("WHEN city IN ('Pune, Maharashtra', 'Greater Noida')", "WHEN city IN ('Pune', 'Pune, Maharashtra', 'Greater Noida')")
_BEHAVIOUR = FEATURES.replace("(k % 3 <> 0) AS otw, (k % 11) / 10.0::DOUBLE AS rr", "TRUE AS otw, 0.5::DOUBLE AS rr")
_SCORE = f"SELECT candidate_id, {_score_sql('main')} AS s FROM f5"
COUNTERFACTUAL_SQL = f"""
SELECT variant, count(*) AS n, count(*) FILTER (abs(o.s - b.s) > 1e-9) AS n_changed, round(max(abs(o.s - b.s)), 6) AS largest
FROM (SELECT 'place' AS variant, * FROM (WITH {_PLACE} {_SCORE}) UNION ALL SELECT 'behaviour', * FROM (WITH {_BEHAVIOUR} {_SCORE})) o JOIN (WITH {FEATURES} {_SCORE}) b USING (candidate_id) GROUP BY variant"""


def counterfactual_audit(spark: SparkSession, d: str) -> DataFrame:
    """Change of score when the name, the place or the behaviour, or place and behaviour together, are neutral: spread by variant."""
    rows = records(spark, d)
    rows = rows.withColumn("profile", F.col("profile").withField("anonymized_name", F.concat(F.lit("Person "), "candidate_id")))
    named = lambda **fields: reduce(lambda p, f: p.withField(f[0], F.lit(f[1])), fields.items(), F.col("profile"))
    neutral, own = reduce(lambda s, f: s.withField(f[0], F.lit(f[1])), NEUTRAL.items(), F.col("signals")), F.col("signals")
    variants = {
        "name_neutralized": (named(anonymized_name="Neutral Candidate"), own),
        "location_undisclosed": (named(location="Undisclosed", country=""), own),
        "preferred_location": (named(location="Pune, Maharashtra", country="India"), own),
        "behavioral_neutral": (F.col("profile"), neutral),
        "location_and_behavior": (named(location="Undisclosed", country=""), neutral),
    }
    delta = _deltas(rows, variants)
    return delta.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.abs("delta") > 1e-9).alias("n_changed"), N.six(F.avg("delta")).alias("mean"), N.six(F.max(F.abs("delta"))).alias("largest"))


#: Behaviour that says nothing.
NEUTRAL = {"recruiter_response_rate": 0.50, "avg_response_time_hours": 48.0, "profile_views_received_30d": 20, "applications_submitted_30d": 2, "saved_by_recruiters_30d": 2, "search_appearance_30d": 80, "interview_completion_rate": 0.70, "offer_acceptance_rate": 0.60}
_CITY = f"{_at(CITIES, 'c_custkey')} AS city, {_at(COUNTRIES, 'c_custkey')} AS country"
_QUIET = lambda sql: sql.replace("(k % 11) / 10.0::DOUBLE AS rr, (k * 3 % 200)::DOUBLE AS rt, (k % 9) / 8.0::DOUBLE AS icr, (k % 13 - 1) / 12.0::DOUBLE AS oar", "0.5::DOUBLE AS rr, 48.0::DOUBLE AS rt, 0.7::DOUBLE AS icr, 0.6::DOUBLE AS oar").replace("k % 12 AS saved", "2 AS saved")
_AWAY = FEATURES.replace(_CITY, "'Undisclosed' AS city, '' AS country")
_AUDITED = {"name_neutralized": FEATURES, "location_undisclosed": _AWAY, "preferred_location": FEATURES.replace(_CITY, "'Pune, Maharashtra' AS city, 'India' AS country"), "behavioral_neutral": _QUIET(FEATURES), "location_and_behavior": _QUIET(_AWAY)}
AUDIT_SQL = f"""
SELECT variant, count(*) AS n, count(*) FILTER (abs(o.s - b.s) > 1e-9) AS n_changed, round(avg(o.s - b.s), 6) + 0.0::DOUBLE AS mean, round(max(abs(o.s - b.s)), 6) AS largest
FROM ({" UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM (WITH {sql} {_SCORE})" for v, sql in _AUDITED.items())}) o JOIN (WITH {FEATURES} {_SCORE}) b USING (candidate_id) GROUP BY variant"""


def importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean contribution of each feature to relevance, and how far leaving it out would lower the mean."""
    rows = scored(spark, d).withColumn("retrieval", F.lit(0.5))
    parts = C.contributions("main")
    wide = rows.select("candidate_id", *[c.alias(k) for k, c in parts.items()])
    return wide.unpivot("candidate_id", list(parts), "feature", "contribution").groupBy("feature").agg(N.six(F.avg(F.abs("contribution"))).alias("importance"), F.count_if(F.col("contribution") > 0).alias("n_positive"))


_TOTAL = sum(V.WEIGHTS.values())
IMPORTANCE_SQL = f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{k}' AS feature, round(avg(abs({w!r}::DOUBLE / {_TOTAL!r}::DOUBLE * {'0.5' if k == 'bm25_score' else SHOWN[k]})), 6) AS importance, count(*) FILTER ({w!r}::DOUBLE * {'0.5' if k == 'bm25_score' else SHOWN[k]} > 0) AS n_positive FROM f5" for k, w in V.WEIGHTS.items())


def anachronism(spark: SparkSession, d: str) -> DataFrame:
    return C.complete(records(spark, d)).select("candidate_id", N.six(C.anachronisms()).alias("severity"))


_RE2 = {k: (p.replace("(?![- ]?index)", "([^- i]|[- ][^i]|$)"), y) for k, (p, y) in V.TECHNOLOGIES.items()}
_LIMIT = "CASE " + " ".join(f"WHEN regexp_matches(name, '(?i){p}') THEN {(V.TECHNOLOGY_YEAR - y) * 12 + V.TECHNOLOGY_SLACK}" for p, y in _RE2.values()) + " END"
_EARLY = " OR ".join(f"(ended < {y} AND regexp_matches(story, '(?i){p}'))" for p, y in _RE2.values())
ANACHRONISM_SQL = f"WITH {RECORDS}, s AS (SELECT k, max(CASE WHEN months > {_LIMIT} THEN round_even(months / ({_LIMIT})::DOUBLE, 2) END) AS worst FROM skills GROUP BY k), j AS (SELECT k, bool_or(NOT current AND ({_EARLY})) AS early FROM jobs GROUP BY k) SELECT candidate_id, coalesce(worst, CASE WHEN early THEN 1.01::DOUBLE ELSE 0 END) AS severity FROM c JOIN s USING (k) JOIN j USING (k)"

QUERIES = {
    "r09_features": features,
    "r11_flags_and_gates": flags_and_gates,
    "r18_profile_scores": profile_scores,
    "r20_ranking": ranking,
    "r42_floor_sweep": floor_sweep,
    "p10_counterfactuals": counterfactuals,
    "p10_counterfactual_audit": counterfactual_audit,
    "a19_importance": importance,
    "r33_anachronism": anachronism,
}
ORACLE = {
    "r09_features": FEATURES_SQL,
    "r11_flags_and_gates": GATES_SQL,
    "r18_profile_scores": SCORES_SQL,
    "r20_ranking": RANKING_SQL,
    "r42_floor_sweep": FLOOR_SQL,
    "a19_importance": IMPORTANCE_SQL,
    "p10_counterfactuals": COUNTERFACTUAL_SQL,
    "p10_counterfactual_audit": AUDIT_SQL,
    "r33_anachronism": ANACHRONISM_SQL,
}
