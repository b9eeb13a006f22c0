"""Candidate records: rendering, the feature matrix, flags, gates, scores.

Every step is a projection. Texts are normalised in a first one and counted in the next, so that no expression is
expanded into the many that use it; nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V

from .plan import DEFAULT, Plan

EMPTY_JOBS = "array<struct<company:string,title:string,industry:string,company_size:string,description:string,start_date:string,end_date:string,is_current:boolean,duration_months:int>>"


def _printed(c: Column) -> Column:
    """As the interpreter of the records' origin prints it: True, False, None."""
    return F.coalesce(F.initcap(c.cast("string")), F.lit("None"))


def _months(job: Column) -> Column:
    return F.coalesce(job["duration_months"], F.lit(0))


def render() -> Column:
    """The record as a document: profile, jobs, skills, studies, signals, concept markers; empty sections go."""
    p, s = F.col("profile"), F.col("signals")
    profile = T.join_nonempty([p[f] for f in ("current_title", "headline", "summary", "current_industry", "location", "country")])
    jobs = F.transform("career_history", lambda j: T.join_nonempty([j["title"], j["company"], j["industry"], j["description"], F.concat(_months(j).cast("string"), F.lit(" months"))]))
    skill = F.transform("skills", lambda k: F.concat_ws(" ", F.coalesce(k["name"], F.lit("None")), F.coalesce(k["proficiency"], F.lit("None")), F.coalesce(k["duration_months"], F.lit(0)).cast("string"), F.lit("months endorsements"), F.coalesce(k["endorsements"], F.lit(0)).cast("string")))
    studies = F.transform("education", lambda e: T.join_nonempty([e["degree"], e["field_of_study"], e["institution"], e["tier"]]))
    signals = T.join_nonempty([F.concat(F.lit("open_to_work "), _printed(s["open_to_work_flag"])), F.concat(F.lit("response_rate "), F.coalesce(s["recruiter_response_rate"].cast("string"), F.lit("None"))), F.concat(F.lit("github_activity "), F.coalesce(s["github_activity_score"].cast("string"), F.lit("None"))), F.concat(F.lit("notice_period "), F.coalesce(s["notice_period_days"].cast("string"), F.lit("None"))), s["preferred_work_mode"]])
    sections = F.concat(F.array(profile), jobs, F.array(F.array_join(skill, " ")), studies, F.array(signals))
    return F.array_join(F.filter(sections, lambda x: x != ""), "\n")


def complete(rows: DataFrame) -> DataFrame:
    """Missing lists are empty ones."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("career_history", "education", "skills")})


def with_text(rows: DataFrame) -> DataFrame:
    """Adds doc_text."""
    rows = complete(rows).withColumn("doc_text", render())
    marks = F.array_join(T.concepts(F.col("doc_text")), " ")
    return rows.withColumn("doc_text", F.when(marks != "", F.concat_ws("\n", "doc_text", marks)).otherwise(F.col("doc_text")))


def template_tokens(query: str = V.DEFAULT_QUERY) -> list[str]:
    """Distinct tokens of the ideal record of the first role that a query names."""
    low = query.lower()
    role = next((r for r in V.ROLE_TEMPLATES if r.split("/")[0].lower() in low or r.lower() in low), "AI/ML Engineer")
    return list(dict.fromkeys(V.ROLE_TEMPLATES[role].lower().replace(",", " ").replace(".", " ").split()))


def _sum(array: Column, f) -> Column:
    return F.aggregate(F.transform(array, lambda x: f(x).cast("double")), F.lit(0.0), lambda a, x: a + x)


def _has(terms, text: Column) -> Column:
    return T.has_term(terms, T.pad(text))


def _product_job(j: Column) -> Column:
    """Of a normalised job."""
    company, industry = j["company"], j["industry"]
    has = T.has_term
    return has(V.PRODUCT_COMPANIES, company) | (~has(V.SERVICES, company) & (has(V.PRODUCT_INDUSTRIES, industry) | (j["size"].isin(V.PRODUCT_SIZES) & has(V.TECH_INDUSTRIES, industry))))


def _absent(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds those of the columns that aren't there."""
    return rows.withColumns({k: c for k, c in columns.items() if k not in rows.columns})


def shared(rows: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Adds what jobs, skills, studies and titles alone decide, so that variants of a record that differ in place, name or signals find it once."""
    return counts(texts(complete(rows), whole=False), plan, whole=False)


def texts(rows: DataFrame, whole: bool = True) -> DataFrame:
    """Normalised texts that features count in; that of the whole record only if asked."""
    jobs = F.col("career_history")
    career = F.concat(F.array(F.col("profile.summary")), F.flatten(F.transform(jobs, lambda j: F.array(j["title"], j["description"], j["industry"]))))
    blank = F.transform(career, lambda x: F.coalesce(x, F.lit("")))
    titles = F.array_join(F.transform(jobs, lambda j: T.norm(j["title"])), " ")
    job = lambda j: F.struct(T.pad(T.norm(j["company"])).alias("company"), T.pad(T.norm(j["industry"])).alias("industry"), F.coalesce(j["company_size"], F.lit("")).alias("size"), T.pad(T.norm(F.concat_ws(" ", F.coalesce(j["title"], F.lit("None")), F.coalesce(j["description"], F.lit("None"))))).alias("text"), _months(j).alias("months"))
    skill = lambda s: F.struct(T.norm(s["name"]).alias("name"), T.norm(s["proficiency"]).alias("level"), F.coalesce(s["duration_months"], F.lit(0)).alias("months"), F.coalesce(s["endorsements"], F.lit(0)).alias("endorsements"))
    if whole:
        rows = rows.withColumn("x_full", T.pad(T.norm(F.col("doc_text"))))
        rows = rows.withColumn("x_tokens", F.split(F.expr("substring(x_full, 2, length(x_full) - 2)"), " "))
    rows = _absent(rows, {"x_career": T.pad(T.norm(F.array_join(blank, " "))), "x_title": T.norm(F.col("profile.current_title")), "x_headline": T.norm(F.col("profile.headline")), "x_titles": titles, "x_jobs": F.transform("career_history", job), "x_skills": F.transform("skills", skill)})
    rows = _absent(rows, {"x_names": F.col("x_skills.name")})
    words = F.filter(F.split(F.array_join("x_names", " "), r"\s+"), lambda w: F.length(w) > 2)
    return _absent(rows, {"x_career_tokens": F.split(F.expr("substring(x_career, 2, length(x_career) - 2)"), " "), "x_terms": F.concat("x_names", words)})


def counts(rows: DataFrame, plan: Plan = DEFAULT, whole: bool = True) -> DataFrame:
    """Evidence counts, and facts of jobs, skills and studies. What a text holds of all lists is found once, then counted by list."""
    normal = [T.norm_literal(a) for g in (*plan.must.values(), *plan.nice.values()) for a in g]
    in_full = [*V.OPEN_SOURCE_TERMS, *V.VISION_TERMS, *V.WRAPPER_TERMS, *normal]
    in_career = [*V.RETRIEVAL_TERMS, *V.PRODUCTION_TERMS, *V.SCALE_TERMS, *V.RESEARCH_TERMS, *([] if plan.default else normal)]
    both = T.pad(F.concat_ws(" ", "x_title", F.expr("substring(x_career, 2, length(x_career) - 2)")))
    if whole:
        rows = rows.withColumns({"x_in_full": T.hits(in_full, F.col("x_full")), "x_like": T.word_jaccard(F.col("x_full"), template_tokens(plan.query))})
    rows = _absent(
        rows,
        {
            "x_in_career": T.hits(in_career, F.col("x_career")),
            "x_in_both": T.hits(V.CODE_TERMS, both),
            "x_named": F.array_intersect(T.words(dict.fromkeys(normal)), F.col("x_terms")),
        },
    )
    full, held = F.col("x_in_full"), F.col("x_in_career")

    def alias(aliases: list[str]) -> Column:
        own = [T.norm_literal(a) for a in aliases]
        return F.when(F.arrays_overlap(T.words(own), F.col("x_named")), 1.0).when(T.any_hit(own, full), 0.7).otherwise(0.0)

    zero = F.lit(0.0)
    done = F.array_sort(F.transform(F.filter("career_history", lambda j: ~F.coalesce(j["is_current"], F.lit(False))), _months))
    study = F.transform("education", lambda e: N.clamp(F.when(e["tier"] == "tier_1", 1.0).when(e["tier"] == "tier_2", 0.8).otherwise(0.5) + F.when(_has(V.STUDY_FIELDS, T.norm(e["field_of_study"])), 0.12).otherwise(0.0) + F.when(_has(V.DEGREES, T.norm(e["degree"])), 0.05).otherwise(0.0)))
    has = T.has_term
    months = lambda f: _sum(F.filter("x_jobs", f), lambda j: j["months"])
    out = {
        "c_retrieval": T.count_hits(V.RETRIEVAL_TERMS, held),
        "c_production": T.count_hits(V.PRODUCTION_TERMS, held),
        "c_scale": T.count_hits(V.SCALE_TERMS, held),
        "c_code": T.count_hits(V.CODE_TERMS, F.col("x_in_both")),
        "c_research": T.count_hits(V.RESEARCH_TERMS, held),
        "c_role": T.count_hits(normal, held) if not plan.default else F.lit(0),
        "c_months": _sum(F.col("career_history"), _months),
        "c_product": months(_product_job),
        "c_services": months(lambda j: has(V.SERVICES, j["company"])),
        "c_learning": months(lambda j: has([*V.RETRIEVAL_TERMS, *V.LEARNING_TERMS], j["text"])),
        "c_role_months": months(lambda j: has([*normal, *plan.titles], j["text"])) if not plan.default else zero,
        "c_done": done,
        "c_depth": _skill_depth(plan),
        "c_study": F.array_max(study),
    }
    in_whole = {
        "c_open_source": T.count_hits(V.OPEN_SOURCE_TERMS, full),
        "c_vision": T.count_hits(V.VISION_TERMS, full),
        "c_wrapper": T.count_hits(V.WRAPPER_TERMS, full),
        "c_relevant": T.count_hits(normal, full),
        "c_core": reduce(lambda a, b: a + b, [F.lit(plan.weights[g]) * alias(al) for g, al in plan.must.items()]),
        "c_nice": reduce(lambda a, b: a + b, [alias(al) for al in plan.nice.values()], zero) / max(1, len(plan.nice)),
    }
    return _absent(rows, out | (in_whole if whole else {}))


def _skill_depth(plan: Plan) -> Column:
    relevant = [T.norm_literal(a) for g in (*plan.must.values(), *plan.nice.values()) for a in g]
    level = F.create_map(*[F.lit(x) for kv in V.PROFICIENCY.items() for x in kv])
    scored = F.transform(
        F.filter("x_skills", lambda s: (s["name"] != "") & T.has_term(relevant, T.pad(s["name"]))),
        lambda s: 0.45 * F.coalesce(F.try_element_at(level, s["level"]), F.lit(0.4)) + 0.35 * N.clamp(s["months"] / 36.0) + 0.20 * N.clamp(N.saturation(s["endorsements"])),
    )
    return T.let(scored, lambda x: N.clamp(_sum(x, lambda y: y) / F.greatest(F.lit(1), F.least(F.lit(7), F.size(x)))))


def features(rows: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Adds the features and flags; needs doc_text. Plans but the default one take evidence of their own skills as retrieval and production evidence."""
    s, p = F.col("signals"), F.col("profile")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rows = counts(texts(rows), plan)
    title_text = T.pad(F.concat_ws(" ", "x_title", "x_headline", "x_titles"))
    weighed = ", ".join(f"CASE WHEN contains(p, {T.quoted(t)}) THEN {float(w)!r}D ELSE 0.08D END" for term, w in plan.titles.items() for t in T.padded([term]))
    best_title = lambda text: T.let_sql(text, f"greatest(0.08D, 0.08D, {weighed})")
    title = best_title(title_text)
    if not plan.default:  # a past title counts less if the present one is far from the role
        present = best_title(T.pad(F.concat_ws(" ", "x_title", "x_headline")))
        title = F.when((present < 0.35) & (title > 0.65), F.least(title, F.lit(0.55))).when((present < 0.65) & (title > 0.85), F.least(title, F.lit(0.72))).otherwise(title)
    title = F.when(_has(V.OTHER_TITLES, F.col("x_title")), F.least(title, F.lit(0.18))).otherwise(title)
    trust = F.transform("skills", lambda k: N.clamp(N.saturation(zero(k["endorsements"])) * F.when((zero(k["endorsements"]) > 30) & (zero(k["duration_months"]) < 6), 0.55).otherwise(1.0)))
    tests = F.map_values(F.coalesce(s["skill_assessment_scores"], F.create_map().cast("map<string,double>")))
    github = zero(s["github_activity_score"])
    yoe = zero(p["years_of_experience"])
    days = T.days_since(s["last_active_date"])
    flag = lambda f: F.coalesce(s[f], F.lit(False))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    place, country = T.norm(p["location"]), T.norm(p["country"])
    rows = rows.withColumns(
        {
            "core_skill_match": N.clamp(F.col("c_core")),
            "jd_keyword_coverage_score": N.clamp(F.col("c_relevant") / 12.0),
            "nice_skill_match": N.clamp(F.col("c_nice")),
            "skill_depth_score": F.col("c_depth"),
            "endorsement_trust": F.when(F.size("skills") > 0, N.clamp(_sum(trust, lambda x: x) / F.size("skills"))).otherwise(0.0),
            "assessment_score_avg": F.when(F.size(tests) > 0, N.clamp(_sum(tests, lambda x: x) / (100 * F.size(tests)))).otherwise(0.0),
            "github_signal": F.when(github < 0, 0.0).otherwise(N.clamp(github / 100.0)),
            "product_company_ratio": N.clamp(F.col("c_product") / F.greatest(F.lit(1.0), F.col("c_months"))),
            "ir_ranking_experience": F.greatest(N.clamp(F.col("c_retrieval") / 7.0), N.clamp(F.col("c_role") / 8.0)),
            "production_evidence": F.greatest(N.clamp(N.clamp(F.col("c_production") / 8.0) + F.when(F.size(F.filter("career_history", lambda j: _months(j) >= 18)) >= 2, 0.08).otherwise(0.0)), N.clamp(F.col("c_role") / 12.0)),
            "title_match_score": N.clamp(title),
            "scale_signal": N.clamp(F.col("c_scale") / 4.0),
            "code_writing_recent": N.clamp(F.col("c_code") / 4.0),
            "yoe_fit_score": F.when(yoe >= plan.years[1], 1.0).otherwise(N.clamp(N.gaussian(yoe, plan.years[1], 2.6))) * F.when(yoe < 3, 0.55).otherwise(1.0),
            "education_score": N.or_else(F.coalesce("c_study", F.lit(0.0)), 0.45),
            "ml_ai_tenure_score": N.clamp(F.greatest("c_learning", "c_role_months") / 60.0),
            "open_source_signal": N.clamp(F.col("c_open_source") / 3.0),
            "availability_score": N.clamp(N.steps(days, [(14, 1.0), (30, 0.9), (60, 0.72), (120, 0.5)], 0.22) * F.when(flag("open_to_work_flag"), 1.0).otherwise(0.68)),
            "engagement_score": N.clamp(0.25 * zero(s["profile_views_received_30d"]) / 80 + 0.20 * zero(s["applications_submitted_30d"]) / 12 + 0.35 * zero(s["saved_by_recruiters_30d"]) / 12 + 0.20 * zero(s["search_appearance_30d"]) / 250),
            "responsiveness_score": N.clamp(0.75 * N.clamp(zero(s["recruiter_response_rate"])) + 0.25 * N.steps(N.or_else(s["avg_response_time_hours"], 999), [(12, 1.0), (24, 0.85), (72, 0.65), (168, 0.35)], 0.15)),
            "interview_reliability": N.clamp(zero(s["interview_completion_rate"])),
            "profile_quality": N.clamp(0.70 * N.clamp(zero(s["profile_completeness_score"]) / 100.0) + 0.30 * (F.when(flag("verified_email"), 0.45).otherwise(0.0) + F.when(flag("verified_phone"), 0.35).otherwise(0.0) + F.when(flag("linkedin_connected"), 0.20).otherwise(0.0))),
            "notice_period_score": N.steps(N.or_else(s["notice_period_days"], 180), [(30, 1.0), (60, 0.93), (90, 0.85), (120, 0.45)], 0.20),
            "location_score": F.when(_has(plan.places, place), 1.0).when(country.contains("india"), 0.68).when(flag("willing_to_relocate"), 0.42).otherwise(0.10),
            "relocation_willing": one(flag("willing_to_relocate")),
            "backend_depth_score": F.lit(0.0),
            "data_bi_depth_score": F.lit(0.0),
            "hyre_similarity": F.col("x_like"),
            "x_yoe": yoe,
        }
    )
    rows = rows if plan.default else _role_depth(rows, plan)
    n = F.size("c_done")
    median = F.when(n == 0, 0.0).otherwise((F.get("c_done", F.floor((n - 1) / 2).cast("int")) + F.get("c_done", F.floor(n / 2).cast("int"))) / 2.0)
    short = F.size(F.filter("c_done", lambda m: m < 18))
    hop = F.when((F.col("x_yoe") >= 10) & (short / F.greatest(F.lit(1), n) <= 0.4) & (median >= 18), 0.0).when(((n >= 3) & (median < 18)) | (F.size(F.filter("c_done", lambda m: m < 9)) >= 3), 1.0).when(short >= 3, 0.6).otherwise(0.0)
    rows = rows.withColumns({"x_hop": hop, "consulting_only_flag": one((F.col("c_months") > 0) & (F.col("c_services") / F.greatest(F.col("c_months"), F.lit(1.0)) > 0.8) & (F.col("product_company_ratio") < 0.2)), "senior_title_held": one(_has(V.SENIOR, F.concat_ws(" ", "x_title", "x_titles")) & (F.col("title_match_score") > 0.55)), "disqualifier_skill_flag": one((F.col("c_vision") >= 3) & (F.col("ir_ranking_experience") < 0.3))})
    strong = (F.col("production_evidence") > 0.45) | (F.col("ir_ranking_experience") > 0.65)
    stuffed = F.lit(2) + (F.col("production_evidence") < 0.30).cast("int") + (F.col("ir_ranking_experience") < 0.25).cast("int") + (F.col("skill_depth_score") < 0.45).cast("int") + (F.col("endorsement_trust") < 0.35).cast("int")
    rows = rows.withColumns({"career_trajectory_score": N.clamp(0.75 * F.col("title_match_score") + 0.25 * F.col("product_company_ratio") - F.when(strong, 0.18).otherwise(0.35) * F.col("x_hop")), "keyword_stuffer_flag": F.when((F.size("skills") >= 12) & (F.col("core_skill_match") >= 0.55), N.clamp(stuffed / 6.0)).otherwise(0.0)})
    return rows.withColumn("hard_flags", _hard_flags(plan)).withColumn("soft_flags", _soft_flags()).withColumn("flags", F.concat("hard_flags", "soft_flags"))


def _role_depth(rows: DataFrame, plan: Plan) -> DataFrame:
    """For backend and data plans: depth by categories of evidence, which then stands for retrieval and production evidence."""
    c, groups = F.col, set(plan.must)
    full, tokens = c("x_full"), c("x_tokens")
    present = T.pad(c("x_title"))
    data_first = any(t in next(iter(plan.titles), "") for t in ("senior data analyst", "business intelligence developer", "bi developer"))

    def measured(rows: DataFrame, table: dict) -> DataFrame:
        return rows.withColumns({f"d_{k}": N.clamp(T.count_terms(terms, full, tokens) / deep) for k, (terms, deep) in table.items()})

    def raised(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        return rows.withColumns({k: F.greatest(c(k), v) for k, v in values.items()})

    if "software_backend" in groups and not data_first:
        rows = measured(rows, V.BACKEND_DEPTH)
        kinds = [c(f"d_{k}") for k in V.BACKEND_DEPTH]
        delivered = T.count_terms(V.BACKEND_DELIVERY, c("x_career"), c("x_career_tokens"))
        rows = rows.withColumns({"backend_depth_score": N.category_depth(kinds, [1.0] * 4), "d_surface": N.clamp(T.count_terms(V.BACKEND_SURFACE, full, tokens) / 15.0), "d_delivered": delivered, "d_titled": T.has_term(V.BACKEND_TITLES, present)})
        made = N.clamp(0.26 * c("d_api") + 0.22 * c("d_db") + 0.16 * c("d_scale") + 0.12 * c("d_infra") + 0.24 * c("d_surface"))
        limit = N.clamp(0.40 + 0.40 * N.clamp(c("d_delivered") / 4.0) + 0.20 * N.clamp(c("c_production") / 2.0))
        rows = raised(rows, {"jd_keyword_coverage_score": c("d_surface"), "ir_ranking_experience": N.clamp(0.60 * c("d_surface") + 0.40 * c("backend_depth_score")), "production_evidence": F.least(made, limit), "scale_signal": F.greatest(c("d_scale"), 0.55 * c("d_surface")), "code_writing_recent": N.clamp(0.50 * c("d_api") + 0.30 * c("d_db") + 0.20 * c("d_surface")), **({"title_match_score": F.when(c("d_titled"), 0.98).otherwise(0.0)} if plan.backend_first else {})})
        # Words of the trade without delivery in the career don't make depth.
        thin = (c("d_delivered") <= 3) & (c("c_production") == 0) & ~c("d_titled")
        rows = rows.withColumn("ir_ranking_experience", F.when(thin, F.least(c("ir_ranking_experience"), F.lit(0.72))).otherwise(c("ir_ranking_experience")))
    if "data_bi" in groups:
        rows = measured(rows, V.DATA_DEPTH)
        kinds = [c(f"d_{k}") for k in V.DATA_DEPTH]
        rows = rows.withColumn("data_bi_depth_score", N.category_depth(kinds, [1.0] * 5))
        rows = raised(rows, {"ir_ranking_experience": c("data_bi_depth_score"), "production_evidence": N.clamp(0.25 * c("d_sql") + 0.25 * c("d_warehouse") + 0.20 * c("d_viz") + 0.20 * c("d_etl") + 0.10 * c("d_impact")), "scale_signal": c("d_impact"), **({"title_match_score": F.when(T.has_term(V.DATA_TITLES, present), 0.98).otherwise(0.0)} if data_first else {})})
    return rows


def _flags(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))


def _hard_flags(plan: Plan) -> Column:
    """Contradictions within a record."""
    yoe, months = F.col("x_yoe"), F.col("c_months")
    expected = F.floor(yoe * 12)
    said = F.regexp_extract(F.coalesce("profile.summary", F.lit("")), r"(?i)\bwith\s+(\d+(?:\.\d+)?)\+?\s+years?\s+of\s+(?:hands[- ]on\s+)?experience\b", 1).try_cast("double")
    idle = F.filter("x_skills", lambda s: (s["level"] == "expert") & (s["months"] == 0))
    core = F.filter(idle, lambda s: T.has_term([T.norm_literal(a) for g in plan.must.values() for a in g], T.pad(s["name"])))
    start, end = (lambda e: F.coalesce(e["start_year"], F.lit(0))), (lambda e: F.coalesce(e["end_year"], F.lit(0)))
    return _flags(
        {
            "experience_timeline_exceeds_claim": (expected > 0) & (months > expected + 30),
            "career_history_too_short_for_claimed_yoe": (yoe >= 5) & (F.size("career_history") > 0) & (months < expected * 0.45),
            "summary_career_yoe_contradiction": said.isNotNull() & (F.size("career_history") > 0) & (F.abs(said - months / 12.0) <= 1.5) & (yoe - said >= 3.0),
            "expert_skill_zero_duration": (F.size(core) >= 2) | (F.size(idle) >= 5),
            "multiple_current_jobs": F.size(F.filter("career_history", lambda j: F.coalesce(j["is_current"], F.lit(False)))) > 2,
            "impossible_education_timeline": F.exists("education", lambda e: (start(e) != 0) & (end(e) != 0) & ((end(e) < start(e)) | (start(e) < 1970) | (end(e) > 2035))),
            "title_description_contradiction": _has(V.OTHER_TITLES, F.col("x_title")) & (F.col("ir_ranking_experience") >= 0.45),
        }
    )


def _soft_flags() -> Column:
    s = F.col("signals")
    low, high = F.coalesce(s["expected_salary_range_inr_lpa"]["min"], F.lit(0.0)), F.coalesce(s["expected_salary_range_inr_lpa"]["max"], F.lit(0.0))
    production, retrieval, yoe = F.col("production_evidence"), F.col("ir_ranking_experience"), F.col("x_yoe")
    return _flags(
        {
            "consulting_only": F.col("consulting_only_flag") > 0,
            "salary_inversion": (low > high) & (high > 0),
            "endorsement_inflation_low_profile": (F.coalesce(s["profile_completeness_score"], F.lit(0.0)) < 40) & (F.coalesce(s["endorsements_received"], F.lit(0)) > 40),
            "pure_research_without_deployment": (F.col("c_research") > 0) & (production < 0.35),
            "cv_speech_robotics_primary": F.col("disqualifier_skill_flag") > 0,
            "keyword_stuffer": F.col("keyword_stuffer_flag") >= 0.75,
            "title_hopper": F.col("x_hop") >= 1,
            "llm_wrapper_only": (F.col("c_wrapper") >= 1) & (production < 0.35) & (retrieval < 0.30) & ((F.col("ml_ai_tenure_score") < 0.25) | (yoe < 4)),
            "junior_for_senior_role": (_has(V.JUNIOR, F.col("x_title")) | (yoe < 4)) & (F.col("senior_title_held") == 0) & (production < 0.6) & (retrieval < 0.6),
        }
    )


def behaviour(floor: float = 0.25) -> Column:
    """The behaviour multiplier."""
    s = F.col("signals")
    saved = F.coalesce(s["saved_by_recruiters_30d"], F.lit(0))
    tests = F.coalesce(s["skill_assessment_scores"], F.create_map().cast("map<string,double>"))
    expected = F.create_map(*[F.lit(x) for kv in V.EXPECTED_ASSESSMENT.items() for x in kv])
    by_name = F.map_from_entries(F.transform(F.map_entries(tests), lambda e: F.struct(T.norm(e["key"]).alias("key"), e["value"].alias("value"))))
    short = F.when(F.size(tests) == 0, 0).otherwise(T.let(by_name, lambda m: F.size(F.filter("x_skills", lambda k: F.coalesce(F.try_element_at(m, k["name"]) < F.try_element_at(expected, k["level"]) - 20, F.lit(False))))))
    claims = F.when(F.size(tests) > 0, F.when(F.col("assessment_score_avg") > 0.6, 1.05).when(F.col("assessment_score_avg") < 0.4, 0.9).otherwise(1.0) * N.clamp(F.pow(F.lit(0.86), short), 0.55, 1.0)).otherwise(1.0)
    offer = s["offer_acceptance_rate"]
    factors = [
        F.when(F.coalesce(s["open_to_work_flag"], F.lit(False)), 1.05).otherwise(0.90),
        0.5 + 0.5 * F.sqrt("responsiveness_score"),
        0.7 + 0.3 * F.col("profile_quality"),
        0.85 + 0.25 * F.col("availability_score"),
        0.8 + 0.2 * F.col("interview_reliability"),
        F.when(saved > 5, 1.03).when(saved == 0, 0.97).otherwise(1.0),
        F.when(F.col("github_signal") > 0.2, 1.03).otherwise(1.0),
        claims,
        F.when(offer >= 0, 0.85 + 0.30 * N.clamp(offer)).otherwise(1.0),
        F.when(F.col("profile_quality") > 0.82, 1.02).otherwise(1.0),
        F.when(F.col("notice_period_score") >= 1, 1.05).when(F.col("notice_period_score") <= 0.2, 0.70).otherwise(1.0),
    ]
    return N.clamp(reduce(lambda a, b: a * b, factors), floor, 1.10)


def gates(rows: DataFrame, floor: float = 0.25) -> DataFrame:
    """Adds the behaviour, honeypot and disqualifier multipliers."""
    hard = F.col("hard_flags")
    honeypot = F.when(F.size(hard) == 0, 1.0).when(F.size(F.array_except(hard, T.words(V.SOFT_HONEYPOTS))) == 0, 0.05).otherwise(0.0)
    consulting = F.when(F.array_contains("soft_flags", "consulting_only"), F.when(F.col("production_evidence") > 0.5, 0.80).otherwise(0.35)).otherwise(1.0)
    disqualifier = N.clamp(reduce(lambda a, b: a * b, [F.when(F.array_contains("soft_flags", k), v).otherwise(1.0) for k, v in V.DISQUALIFIERS.items()], consulting), 0.05, 1.0)
    return rows.withColumns({"behavioral_multiplier": behaviour(floor), "honeypot_multiplier": honeypot, "disqualifier_multiplier": disqualifier})


def score(profile: str = "main", retrieval: str = "retrieval", semantic: str | None = None) -> Column:
    """The weighted mean of features times the gates, by profile."""
    factors, exponent = V.PROFILES[profile]
    weights = {k: w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()}
    total = weights["bm25_score"] + sum(w for k, w in weights.items() if k != "bm25_score")
    parts = [F.lit(w) * (N.clamp(F.col(retrieval)) if k == "bm25_score" else F.col(k)) for k, w in weights.items()]
    if semantic:
        parts.append(F.lit(V.SEMANTIC_WEIGHT) * N.clamp(F.col(semantic)))
        total += V.SEMANTIC_WEIGHT
    relevance = reduce(lambda a, b: a + b, parts) / total
    return F.greatest(F.lit(0.0), relevance * F.pow("behavioral_multiplier", F.lit(exponent)) * F.col("honeypot_multiplier") * F.col("disqualifier_multiplier"))


def plan_weights(plan: Plan) -> dict[str, float]:
    """Weights for plans but the default one: more on title, coverage and retrieval, by the groups that are active."""
    w = {
        "bm25_score": 0.24, "core_skill_match": 0.20, "jd_keyword_coverage_score": 0.12, "nice_skill_match": 0.04, "skill_depth_score": 0.08, "endorsement_trust": 0.02, "assessment_score_avg": 0.02,
        "github_signal": 0.02, "product_company_ratio": 0.04, "ir_ranking_experience": 0.02, "production_evidence": 0.08, "title_match_score": 0.22, "senior_title_held": 0.04, "career_trajectory_score": 0.06,
        "scale_signal": 0.03, "code_writing_recent": 0.05, "yoe_fit_score": 0.08, "education_score": 0.02, "ml_ai_tenure_score": 0.01, "open_source_signal": 0.01, "location_score": 0.04, "relocation_willing": 0.01, "notice_period_score": 0.01,
    }
    groups = set(plan.must)
    if "ranking_information_retrieval" in groups:
        w |= {"ir_ranking_experience": 0.10, "bm25_score": 0.16, "code_writing_recent": 0.04}
    if groups & {"embeddings_retrieval", "vector_database", "llm_production"}:
        w |= {"ml_ai_tenure_score": 0.04, "product_company_ratio": 0.07}
    if groups & {"software_backend", "cloud_devops", "data_bi"}:
        w |= {"bm25_score": 0.16, "core_skill_match": 0.12, "jd_keyword_coverage_score": 0.24, "ir_ranking_experience": 0.10, "production_evidence": 0.10, "title_match_score": 0.24, "senior_title_held": 0.04, "career_trajectory_score": 0.04, "ml_ai_tenure_score": 0.06, "product_company_ratio": 0.02}
    if plan.backend_first:
        w |= {"bm25_score": 0.22, "core_skill_match": 0.16, "jd_keyword_coverage_score": 0.40, "ir_ranking_experience": 0.14, "production_evidence": 0.14, "title_match_score": 0.05, "career_trajectory_score": 0.00, "product_company_ratio": 0.00}
    return w


def plan_score(plan: Plan, retrieval: str = "retrieval") -> Column:
    """The score for a plan but the default one: title damping, floors of behaviour, and mercy for soft flags."""
    weights, c, groups = plan_weights(plan), F.col, set(plan.must)
    relevance = reduce(lambda a, b: a + b, [F.lit(w) * (N.clamp(c(retrieval)) if k == "bm25_score" else c(k)) for k, w in weights.items()]) / sum(weights.values())
    title, role = c("title_match_score"), c("ir_ranking_experience")
    damping = F.when(title < 0.35, F.when(role < 0.85, 0.72).otherwise(0.82))
    if "software_backend" in groups:
        damping = damping.when(title < 0.65, 0.90)
    soft = F.size(F.array_except("flags", T.words(["consulting_only", "salary_inversion", "title_hopper", "endorsement_inflation_low_profile", "llm_wrapper_only", "junior_for_senior_role"]))) == 0
    behaviour = c("behavioral_multiplier")
    if groups & {"cloud_devops", "data_bi"}:
        behaviour = N.clamp(0.88 + 0.12 * behaviour, 0.88, 1.03)
    elif "software_backend" in groups:
        years = c("yoe_fit_score") >= 0.75
        floor = F.when((title >= 0.98) & (role >= 0.70) & years & soft, 0.94).when((title >= 0.95) & (role >= 0.50) & years & soft, 0.88).when((title >= 0.80) & (role >= 0.60) & years & soft, 0.76).otherwise(0.0)
        behaviour = F.greatest(behaviour, floor)
    disqualifier = F.when((F.size("flags") > 0) & soft, F.greatest(c("disqualifier_multiplier"), F.lit(0.95))).otherwise(c("disqualifier_multiplier"))
    factor = F.lit(1.0)
    if plan.backend_first:
        production = c("production_evidence")
        factor = F.when((title >= 0.94) & (title < 0.98) & (c("senior_title_held") >= 0.5) & (production >= 0.68) & (role >= 0.75), 1.12).otherwise(1.0) * F.when((title >= 0.90) & (title < 0.95) & (c("core_skill_match") >= 0.95) & (production < 0.62) & (c("ml_ai_tenure_score") >= 0.80), 0.88).otherwise(1.0)
    return F.greatest(F.lit(0.0), relevance * damping.otherwise(1.0) * behaviour * c("honeypot_multiplier") * disqualifier * factor)


def contributions(profile: str = "main", retrieval: str = "retrieval") -> dict[str, Column]:
    """What each feature adds to relevance: their sum is the relevance, as the score is linear in them."""
    factors, _ = V.PROFILES[profile]
    weights = {k: w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()}
    total = sum(weights.values())
    return {k: F.lit(w / total) * (N.clamp(F.col(retrieval)) if k == "bm25_score" else F.col(k)) for k, w in weights.items()}


def anachronisms() -> Column:
    """The worst contradiction in time: claimed months over possible ones for a skill, 1.01 for a job that ended before its technology, else 0."""
    def limit(s: Column) -> Column:
        name = F.coalesce(s["name"], F.lit(""))
        out = F.when(F.lit(False), F.lit(0.0))
        for pattern, year in V.TECHNOLOGIES.values():
            out = out.when(name.rlike("(?i)" + pattern), float((V.TECHNOLOGY_YEAR - year) * 12 + V.TECHNOLOGY_SLACK))
        return out

    ratios = F.transform("skills", lambda s: F.coalesce(s["duration_months"], F.lit(0)) / limit(s))
    worst = F.bround(F.array_max(F.filter(ratios, lambda r: r > 1)), 2)
    ended = lambda j: F.year(F.try_to_date(F.substring(j["end_date"], 1, 10), "yyyy-MM-dd"))
    early = F.exists("career_history", lambda j: ~F.coalesce(j["is_current"], F.lit(False)) & F.coalesce(T.any_of((ended(j) < year) & F.coalesce(j["description"], F.lit("")).rlike("(?i)" + pattern) for pattern, year in V.TECHNOLOGIES.values()), F.lit(False)))
    return F.coalesce(worst, F.when(early, 1.01).otherwise(0.0))
