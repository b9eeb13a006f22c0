"""Judgments of scored candidates: labels, evidence levels, near misses, explanations. Needs features, gates and, where said, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.sources.staging import staged

ACTIONS = {"CLEAR": "CONTINUE", "AMBIGUOUS": "CLARIFY", "PROBABLE_CONTRADICTION": "VERIFY", "CONFIRMED_CONTRADICTION": "BLOCK"}


def pessimistic() -> Column:
    """A product of gates: title, depth, production, core skill."""
    title, depth, production = F.col("title_match_score"), F.col("skill_depth_score"), F.col("production_evidence")
    honeypot = F.when(F.col("honeypot_multiplier") < 0.20, F.col("honeypot_multiplier")).otherwise(1.0)
    g_title = F.when(title < 0.25, 0.10).when(title < 0.80, 0.40 + (title - 0.25) * 0.80).otherwise(1.0)
    g_depth = F.when(depth < 0.30, 0.20 + depth / 0.30 * 0.30).otherwise(0.50 + (depth - 0.30) / 0.70 * 0.50)
    g_production = F.when(production < 0.15, 0.15).when(production < 0.50, 0.40 + (production - 0.15) / 0.35 * 0.60).otherwise(1.0)
    both = F.col("core_skill_match") * g_production
    g_core = F.when(both < 0.10, 0.20).when(both < 0.30, 0.50).otherwise(0.70 + both * 0.30)
    product = honeypot * g_title * g_depth * g_production * g_core
    return F.when((g_title >= 0.8) & (g_depth >= 0.8) & (g_production >= 0.8) & (g_core >= 0.8), F.least(product * 1.15, F.lit(1.0))).otherwise(product)


def _silver_points() -> dict[str, Column]:
    """Points of evidence by name, with their thresholds."""
    c = F.col
    return {
        "strong_production": c("production_evidence") >= 0.75,
        "strong_ir_ranking": c("ir_ranking_experience") >= 0.70,
        "deep_core_skills": (c("core_skill_match") >= 0.70) & (c("skill_depth_score") >= 0.65),
        "product_company": c("product_company_ratio") >= 0.45,
        "senior_experience": (c("yoe_fit_score") >= 0.85) & (c("senior_title_held") >= 0.5),
        "reachable_logistics": (c("location_score") >= 0.65) & (c("responsiveness_score") >= 0.45),
    }


def silver_reasons() -> Column:
    """Why a record has its silver tier: what decides alone, else points, then what takes from them; `adjacent_fit` if nothing does."""
    c = F.col
    less = [F.when(c("disqualifier_multiplier") < 0.7, "soft_disqualifier").when(c("disqualifier_multiplier") < 1.0, "minor_disqualifier"), F.when(c("behavioral_multiplier") < 0.65, "weak_behavior")]
    found = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in _silver_points().items()], *less))
    found = F.when(F.size(found) == 0, F.array(F.lit("adjacent_fit"))).otherwise(found)
    return F.when(c("honeypot_multiplier") <= 0, F.array(F.lit("hard_honeypot"))).when(c("keyword_stuffer_flag") >= 0.75, F.array(F.lit("keyword_stuffer"))).otherwise(found)


def silver_tier() -> Column:
    """Six points of evidence, less for flags and behaviour, at most five."""
    c = F.col
    score = reduce(lambda a, b: a + b, [p.cast("int") for p in _silver_points().values()])
    score = F.greatest(F.lit(0), score - F.when(c("disqualifier_multiplier") < 0.7, 2).when(c("disqualifier_multiplier") < 1.0, 1).otherwise(0))
    score = F.greatest(F.lit(0), score - F.when(c("behavioral_multiplier") < 0.65, 1).otherwise(0))
    return F.when(c("honeypot_multiplier") <= 0, 0).when(c("keyword_stuffer_flag") >= 0.75, 1).otherwise(F.least(F.lit(5), score))


def three_judges() -> list[Column]:
    """A strict product, a threshold on depth, a lenient mean."""
    c = F.col
    strict = F.when((c("honeypot_multiplier") < 0.5) | (c("disqualifier_skill_flag") > 0), 0.0).otherwise(c("skill_depth_score") * c("production_evidence") * c("behavioral_multiplier"))
    depth = F.greatest("backend_depth_score", "data_bi_depth_score", "skill_depth_score")
    domain = F.when((c("honeypot_multiplier") < 1) | (depth < 0.4), 0.0).otherwise((depth + c("production_evidence")) / 2)
    lenient = F.when(c("honeypot_multiplier") < 0.2, 0.0).otherwise((c("skill_depth_score") * 0.4 + c("production_evidence") * 0.3 + c("yoe_fit_score") * 0.2 + c("education_score") * 0.1) * c("behavioral_multiplier"))
    return [strict, domain, lenient]


def consensus(judges: list[Column]) -> tuple[Column, Column]:
    """Mean, and population deviation as disagreement."""
    n = len(judges)
    mean = reduce(lambda a, b: a + b, judges) / n
    return mean, F.sqrt(reduce(lambda a, b: a + b, [F.pow(j - mean, 2) for j in judges]) / n)


def evidence_status() -> Column:
    """What the record's evidence allows to say; needs severity."""
    hard = F.col("honeypot_multiplier") <= 0
    soft = (F.abs(F.col("honeypot_multiplier") - 0.05) < 1e-6) | (F.col("disqualifier_multiplier") < 1)
    return F.when(hard, "CONFIRMED_CONTRADICTION").when(F.col("severity") > 0, "PROBABLE_CONTRADICTION").when(soft, "AMBIGUOUS").otherwise("CLEAR")


def action(status: Column) -> Column:
    return T_map(ACTIONS)[status]


def T_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def corroboration() -> Column:
    c = F.col
    return F.array_compact(F.array(F.when(c("production_evidence") >= 0.5, F.lit("production")), F.when(c("scale_signal") >= 0.4, F.lit("scale")), F.when(c("assessment_score_avg") >= 0.4, F.lit("assessment")), F.when(c("ir_ranking_experience") >= 0.45, F.lit("retrieval"))))


def near_misses() -> Column:
    """(flag, closeness) of hard flags that almost hold: 1 is at the threshold."""
    yoe, months = F.col("x_yoe"), F.col("c_months")
    expected = F.floor(yoe * 12)
    gap, ratio = expected + 30 - months, F.try_divide(months, expected.cast("double"))
    idle = F.filter("x_skills", lambda s: (s["level"] == "expert") & (s["months"] == 0))
    core = F.size(F.filter(idle, lambda s: T.has_term([T.norm_literal(a) for g in V.MUST.values() for a in g], T.pad(s["name"]))))
    current = F.size(F.filter("career_history", lambda j: F.coalesce(j["is_current"], F.lit(False))))
    r = F.col("ir_ranking_experience")
    say = lambda c, k, v: F.when(c, F.struct(F.lit(k).alias("flag"), v.cast("double").alias("closeness")))
    return F.array_compact(
        F.array(
            say((expected > 0) & (gap >= 0) & (gap <= 12), "experience_timeline_exceeds_claim", 1 - gap / 12.0),
            say((yoe >= 5) & (F.size("career_history") > 0) & (ratio >= 0.45) & (ratio < 0.55), "career_history_too_short_for_claimed_yoe", 1 - (ratio - 0.45) / 0.10),
            say((core == 1) | (F.size(idle) == 4), "expert_skill_zero_duration", F.when(core == 1, 1.0).otherwise(0.9)),
            say(current == 2, "multiple_current_jobs", F.lit(1.0)),
            say(T.has_term(V.OTHER_TITLES, T.pad(F.col("x_title"))) & (r >= 0.30) & (r < 0.45), "title_description_contradiction", (r - 0.30) / 0.15),
        )
    )


def gate_effects(exponent: float) -> dict[str, Column]:
    """Gates in logarithms: with the relevance's they add up to the score's; null where a gate is zero."""
    log = lambda c: F.when(F.col(c) > 0, F.log(F.col(c)))
    return {"behavior": exponent * log("behavioral_multiplier"), "honeypot": log("honeypot_multiplier"), "disqualifier": log("disqualifier_multiplier")}


def rank_stability(rows: DataFrame, top: int, profile: str = "universal-v2", ident: str = "candidate_id") -> DataFrame:
    """(ident, rank, least, most): where the first rows land as each feature in turn is left out of the mean.

    The score is linear in features, so each variant is a projection; a row is ranked by how many rows of its variant
    stand before it, counted against the top rows' scores only (a broadcast of top rows by features).
    """
    factors, exponent = V.PROFILES[profile]
    weights = {k: w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()}
    value = lambda k: N.clamp(F.col("retrieval")) if k == "bm25_score" else F.col(k)
    terms = {k: F.lit(w) * value(k) for k, w in weights.items()}
    gates = F.pow("behavioral_multiplier", F.lit(exponent)) * F.col("honeypot_multiplier") * F.col("disqualifier_multiplier")
    kept = lambda drop: (reduce(lambda a, b: a + b, [t for k, t in terms.items() if k != drop]) / sum(w for k, w in weights.items() if k != drop)) * gates
    drops = [None, *[k for k in weights if k != "bm25_score"]]
    # The features alone are staged: without it each variant would expand them anew.
    needed = [k for k in weights if k != "bm25_score"] + ["retrieval", "behavioral_multiplier", "honeypot_multiplier", "disqualifier_multiplier"]
    rows = staged(rows.select(ident, *needed), "features")
    shown = lambda d: F.struct(F.lit(d or "").alias("drop"), F.round(kept(d), 9).alias("s"))
    long = lambda rows, each: rows.select(ident, F.explode(F.array_compact(F.array(*each))).alias("x")).select(ident, "x.drop", "x.s")
    first = rows.select(ident, F.round(kept(None), 9).alias("s")).orderBy(F.desc("s"), ident).limit(top).select(ident)
    targets = long(rows.join(F.broadcast(first), ident, "left_semi"), map(shown, drops)).select(F.col(ident).alias("t_id"), F.col("drop").alias("t_drop"), F.col("s").alias("t_s"))
    targets = staged(targets, "targets")
    # A variant of a row counts only if it isn't behind all targets: few are, and only these are rounded and compared.
    floors = {r["t_drop"]: r["s"] for r in targets.groupBy("t_drop").agg(F.min("t_s").alias("s")).collect() if r["s"] is not None}
    near = long(rows, [F.when(kept(d) >= floors[d or ""] - 1e-6, shown(d)) for d in drops if (d or "") in floors]) if floors else long(rows, map(shown, drops))
    ahead = near.join(F.broadcast(targets), (F.col("drop") == F.col("t_drop")) & ((F.col("s") > F.col("t_s")) | ((F.col("s") == F.col("t_s")) & (F.col(ident) < F.col("t_id")))), "inner").groupBy("t_id", "t_drop").agg(F.count("*").alias("n"))
    ranks = targets.join(ahead, ["t_id", "t_drop"], "left").select("t_id", "t_drop", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    return ranks.groupBy(F.col("t_id").alias(ident)).agg(F.max(F.when(F.col("t_drop") == "", F.col("rank"))).alias("rank"), F.min("rank").alias("least"), F.max("rank").alias("most"))
