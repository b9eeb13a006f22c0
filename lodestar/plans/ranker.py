"""The ranking pipeline as a function: configuration, ranking, and a ranking's rows with reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import bm25
from lodestar.operators import candidates as C
from lodestar.operators.plan import DEFAULT, Plan
from lodestar.sources import candidates as sources
from lodestar.sources import sinks


@dataclass(frozen=True)
class RankerConfig:
    top_k: int = 100
    candidate_pool_size: int | None = None
    max_candidates: int | None = None
    bm25_backend: str = "auto"
    scoring_profile: str = "main"
    plan: Plan = DEFAULT

    def __post_init__(self) -> None:
        for name in ("top_k", "candidate_pool_size", "max_candidates"):
            value = getattr(self, name)
            if value is None and name != "top_k":
                continue
            if type(value) is not int or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        if self.bm25_backend not in ("auto", "bm25s", "rank_bm25"):
            raise ValueError(f"unknown backend: {self.bm25_backend!r}")
        if self.scoring_profile not in V.PROFILES:
            raise ValueError(f"unknown profile: {self.scoring_profile!r}")
        if not self.plan.default and self.scoring_profile != "main":
            raise ValueError("a plan of one's own needs the main profile")


def query_terms(query: str = V.DEFAULT_QUERY) -> list[str]:
    import re

    low = query.lower()
    return [t for t in re.findall(V.TOKEN, low) if t not in V.STOPWORDS] + [p.replace("/", "_").replace(" ", "_") for p in V.PHRASES if p in low]


def retrieve(rows: DataFrame, config: RankerConfig) -> DataFrame:
    """Rows with retrieval, scaled to 0..1 over the pool; a pool size keeps the best rows only, as it asks for."""
    rows = C.with_text(rows).withColumn("tokens", T.tokens(F.col("doc_text")))
    score = bm25.okapi if config.bm25_backend == "rank_bm25" else bm25.score
    rows = score(rows, query_terms(config.plan.query))
    if config.candidate_pool_size:
        rows = rows.orderBy(F.desc(F.round("bm25", 9)), "candidate_id").limit(config.candidate_pool_size)
    low, high = rows.agg(F.min("bm25"), F.max("bm25")).first()
    return rows.withColumn("retrieval", N.minmax(F.col("bm25"), F.lit(low or 0.0), F.lit(high or 0.0))).drop("tokens")


def rank_candidates(rows: DataFrame, config: RankerConfig = RankerConfig()) -> DataFrame:
    """All rows with features, gates and total."""
    total = C.score(config.scoring_profile) if config.plan.default else C.plan_score(config.plan)
    return C.gates(C.features(retrieve(rows, config), config.plan)).withColumn("total", total)


def reason() -> Column:
    """A sentence on why a row stands where it does, of at most 600 characters; needs rank."""
    ident = F.col("candidate_id")
    openings = [T.words(x) for x in (["Strong match:", "Leading profile:", "Clear fit:"], ["Good match:", "Solid profile:", "Sound fit:"], ["Adjacent match:", "Partial profile:", "Possible fit:"])]
    opening = F.when(F.col("rank") <= 20, F.get(openings[0], T.variant(ident, 1, 3))).when(F.col("rank") <= 70, F.get(openings[1], T.variant(ident, 1, 3))).otherwise(F.get(openings[2], T.variant(ident, 1, 3)))
    title = F.coalesce(F.nullif("profile.current_title", F.lit("")), F.lit("candidate"))
    years = F.concat(F.format_string("%.1f", F.coalesce("x_yoe", F.lit(0.0))), F.lit(" years of experience"))
    good = F.array_compact(F.array(F.when(F.col("ir_ranking_experience") >= 0.5, F.lit("ranking and retrieval work")), F.when(F.col("production_evidence") >= 0.5, F.lit("systems in production")), F.when(F.col("core_skill_match") >= 0.6, F.lit("broad core skills")), F.when(F.col("product_company_ratio") >= 0.5, F.lit("product companies"))))
    bad = F.array_compact(F.array(F.when(F.col("notice_period_score") < 0.5, F.lit("a long notice period")), F.when(F.col("responsiveness_score") < 0.4, F.lit("slow responses")), F.when(F.size("flags") > 0, F.lit("flags to look into"))))
    text = F.concat_ws(" ", opening, T.article(title), title, F.lit("with"), F.concat(years, F.lit(".")), F.when(F.size(good) > 0, F.concat(F.lit("Shows "), F.array_join(good, ", "), F.lit("."))), F.when(F.size(bad) > 0, F.concat(F.lit("Mind "), F.array_join(bad, ", "), F.lit("."))))
    return F.substring(text, 1, 600)


def report(ranked: DataFrame, top_k: int) -> DataFrame:
    """candidate_id, rank, score over the best score in six places, reasoning: the first rows."""
    top = bm25.ranked(ranked, "candidate_id", "total", top_k)
    best = top.agg(F.max("total")).first()[0] or 0.0
    score = F.format_string("%.6f", N.clamp(F.col("total") / best) if best > 0 else F.lit(0.0))
    return top.select("candidate_id", "rank", score.alias("score"), reason().alias("reasoning"))


def run_ranking(spark: SparkSession, source: str, target: str, config: RankerConfig = RankerConfig(), check: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Reads, ranks and writes, if a check finds no rows at fault; returns how many rows were read, ranked, and have a gate below one, in all and in the report."""
    rows = rank_candidates(sources.read_candidates(spark, source, config.max_candidates), config).cache()
    try:
        out = report(rows, config.top_k).cache()
        sinks.write_ranking(out, target, check)
        gated = F.count_if(F.col("honeypot_multiplier") < 1)
        n, k = rows.agg(F.count("*"), gated).first()
        inside = rows.join(F.broadcast(out.select("candidate_id")), "candidate_id", "left_semi").agg(gated).first()[0]
        return {"loaded": n, "ranked": out.count(), "honeypots": k, "honeypots_in_output": inside}
    finally:
        rows.unpersist()


def weights_total(profile: str) -> float:
    factors, _ = V.PROFILES[profile]
    return reduce(lambda a, b: a + b, (w * factors.get(k, 1.0) for k, w in V.WEIGHTS.items()))
