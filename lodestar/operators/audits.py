"""Operators that check and stress rankings: submissions, pairs, panels of reviewers, choices over evaluators, integrity rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.sources.staging import ship, staged

# ---- Fixed values: hints that titles and skills are inferred from, years of technologies, months in a year ----------
TITLE_HINTS = ["senior software engineer", "software engineer", "software developer", "full stack developer", "backend engineer", "java developer", "frontend engineer", "web developer", "business intelligence developer", "bi developer", "data analyst", "data engineer", "analytics engineer", "devops engineer", "site reliability engineer", "cloud engineer", "machine learning engineer", "ml engineer", "ai engineer"]
COMMON_SKILLS = ["python", "java", "javascript", "typescript", "react", "node.js", "nodejs", "c#", ".net", "spring boot", "sql", "power bi", "tableau", "snowflake", "redshift", "etl", "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "fastapi", "flask", "spark", "kafka", "pandas", "numpy", "machine learning", "data warehouse", "rest api", "microservices"]
TECHNOLOGY_YEARS = {"rag": 2023, "retrieval augmented": 2023, "retrieval-augmented": 2023, "langchain": 2022, "llamaindex": 2022, "llama index": 2022, "chatgpt": 2022, "gpt-4": 2023, "gpt4": 2023, "prompt engineering": 2022, "stable diffusion": 2022, "llm": 2019, "large language model": 2019, "gpt-3": 2020, "fine-tuning llm": 2020, "fine tuning llm": 2020, "vector database": 2019, "vector search": 2019, "pinecone": 2019, "weaviate": 2020, "chroma": 2022, "sentence transformer": 2019, "sbert": 2019, "diffusion model": 2021}
HUMAN_TIERS = {"strong_fit": 4.0, "maybe": 2.0, "not_fit": 0.0}
TODAY, THIS_YEAR = "2026-06-07", 2026
HARD_FLAGS = ["experience_timeline_exceeds_claim", "impossible_education_timeline", "multiple_current_jobs", "title_description_contradiction"]
SIDE_TITLES = "advisor|consultant|mentor|lecturer|maintainer|part-time|freelance"
SMALL_SIZES = ["1-10", "11-50", "?"]
FIELD_WEIGHTS = {"career_descriptions": 3.0, "career_titles": 2.5, "verified_skills": 2.0, "assessments": 1.8, "current_title": 1.5, "companies": 1.0, "summary": 0.7, "headline": 0.5}


# ---- submissions and labels ---------------------------------------------------------------------------------------
def strict_submissions(rows: DataFrame, size: int = 100, least_valid: int = 90) -> DataFrame:
    """Of rows (submission, candidate_id, rank), all texts: whether each submission has ranks 1 to size once each, as many unlike ids, and enough ids of the known shape."""
    rank = F.col("rank").try_cast("double").cast("long")
    ident = F.regexp_replace(F.trim("candidate_id"), '^"+|"+$', "")
    facts = rows.select("submission", rank.alias("rank"), ident.alias("ident")).groupBy("submission").agg(
        F.count("*").alias("n_rows"), F.count("rank").alias("n_ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("n_places"), F.countDistinct("ident").alias("n_ids"), F.count_if(F.col("ident").rlike(r"(?i)^CAND[_-]?\d+")).alias("n_valid")
    )
    whole = reduce(lambda a, b: a & b, [F.col(c) == size for c in ("n_rows", "n_ranks", "high", "n_places", "n_ids")], (F.col("low") == 1) & (F.col("n_valid") >= least_valid))
    return facts.select("submission", F.coalesce(whole, F.lit(False)).alias("accepted"), "n_rows", "n_ids", "n_valid")


def ranking_faults(rows: DataFrame, size: int) -> DataFrame:
    """(rank, fault) of a ranking's rows (candidate_id, rank, score, reasoning) that keep it from being published; size is the most it may have."""
    score, w = F.col("score").try_cast("double"), Window.orderBy("rank")  # a report of bounded size
    rows = rows.withColumns({"n": F.row_number().over(w), "before": F.lag(score).over(w), "last": F.lag("candidate_id").over(w), "same": F.count("*").over(Window.partitionBy("candidate_id"))})
    faults = {
        "blank_id": F.coalesce(F.trim("candidate_id") == "", F.lit(True)), "duplicate_id": F.col("same") > 1, "rank_position": ~F.col("rank").eqNullSafe(F.col("n")) | (F.col("n") > size), "score_range": F.coalesce(~score.between(0, 1), F.lit(True)),
        "score_increases": F.coalesce(score > F.col("before"), F.lit(False)), "tie_order": F.coalesce((score == F.col("before")) & (F.col("candidate_id") < F.col("last")), F.lit(False)), "blank_reasoning": F.coalesce(F.trim("reasoning") == "", F.lit(True)),
    }
    return rows.select("rank", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]))).alias("fault"))


def complete_join(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """rows with their records; a row without one fails the job."""
    joined = rows.join(records.withColumn("__met", F.lit(True)), key, "left")
    found = F.when(F.col("__met"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string"))))
    return joined.withColumn(key, found).drop("__met")


def human_tiers(rows: DataFrame, ident: str, label: str) -> DataFrame:
    """(ident, tier, gain) of rows whose label is a known word; the others have none."""
    tiers = F.create_map(*[F.lit(x) for kv in HUMAN_TIERS.items() for x in kv])
    tier = F.try_element_at(tiers, F.lower(F.trim(label)))
    return rows.select(ident, tier.alias("tier"), tier.alias("gain")).where("tier IS NOT NULL")


def pair_verdicts(pairs: DataFrame, labels: DataFrame, ident: str, margin: float = 0.01) -> DataFrame:
    """Of pairs (winner, loser): whether the winner's label is above the loser's by a margin, or one of them has none."""
    side = lambda name: labels.select(F.col(ident).alias(name), F.col("label").alias(f"{name}_label"))
    both = pairs.join(side("winner"), "winner", "left").join(side("loser"), "loser", "left")
    return both.withColumn("verdict", F.when(F.col("winner_label").isNull() | F.col("loser_label").isNull(), "missing").when(F.col("winner_label") > F.col("loser_label") + margin, "pass").otherwise("fail"))


# ---- texts ----------------------------------------------------------------------------------------------------------
def inferred_title(text: Column, otherwise: str = "External Candidate") -> Column:
    """The first hint that stands in the text between spaces, in title case."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(f" {h} "), h.title()) for h in TITLE_HINTS], F.lit(otherwise))


def inferred_skills(text: Column, more: list[str] = (), most: int = 18) -> Column:
    """Aliases that occur in the text, the first so many, as an array."""
    every = list(dict.fromkeys(a.lower() for a in [*COMMON_SKILLS, *more]))
    return F.slice(F.filter(T.words(every), lambda a: F.contains(F.lower(text), a)), 1, most)


def terms_met(text: Column, tokens: Column, terms: list[str], loose: bool = False) -> Column:
    """How many terms a normalised text has: those of several words anywhere in it, single ones as tokens (loose: anywhere too)."""
    one = lambda t: text.contains(t) if loose or " " in t else F.array_contains(tokens, t)
    return reduce(lambda a, b: a + b, [one(t).cast("int") for t in terms])


# ---- integrity ------------------------------------------------------------------------------------------------------
def _date(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def anachronism_factor() -> Column:
    """0.8 for each skill claimed for more months than its technology has existed, a year of slack; the first technology that a skill's name has counts."""
    years = lambda name: reduce(lambda w, kv: w.when(name.contains(kv[0]), kv[1]), TECHNOLOGY_YEARS.items(), F.when(F.lit(False), 0))
    late = F.filter("skills", lambda s: F.coalesce(s["duration_months"] > (THIS_YEAR - years(F.lower(F.coalesce(s["name"], F.lit(""))))) * 12 + 12, F.lit(False)))
    return F.pow(F.lit(0.8), F.size(late))


def overclaim_factor() -> Column:
    """0.7 if the years claimed are over two more than lie between the first start and the last end, else 1."""
    start = F.array_min(F.transform("career_history", lambda j: _date(j["start_date"])))
    end = F.array_max(F.transform("career_history", lambda j: F.when(F.coalesce(j["is_current"], F.lit(False)) | j["end_date"].isNull() | (j["end_date"] == ""), F.to_date(F.lit(TODAY))).otherwise(_date(j["end_date"]))))
    span = F.datediff(end, start) / 365.25
    return F.when((span > 0) & (F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)) > span + 2), 0.7).otherwise(1.0)


def _job_text(j: Column, *fields: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(j[f], F.lit("")) for f in fields])


def integrity_level(anachronistic: Column) -> Column:
    """hard, ambiguous or clean: a zero-month expert skill that career text backs is ambiguous, as is a history too short for its claim."""
    career = F.lower(F.concat_ws(" ", F.transform("career_history", lambda j: T.norm(_job_text(j, "title", "description", "company")))))
    backed = F.exists("skills", lambda s: (F.lower(s["proficiency"]) == "expert") & (F.coalesce(s["duration_months"], F.lit(0)) == 0) & (T.norm(s["name"]) != "") & F.contains(career, T.norm(s["name"])))
    idle = F.array_contains("flags", "expert_skill_zero_duration")
    hard = F.arrays_overlap("flags", T.words(HARD_FLAGS)) | (idle & ~backed) | anachronistic
    soft = F.array_contains("flags", "career_history_too_short_for_claimed_yoe") | idle
    return F.when(hard, "hard").when(soft, "ambiguous").otherwise("clean")


def overlap_months() -> Column:
    """Months by which dated jobs overlap, over all pairs of a record's jobs; an open job ends today."""
    spans = F.filter(F.transform("career_history", lambda j: F.struct(_date(j["start_date"]).alias("a"), F.coalesce(_date(j["end_date"]), F.date_add(F.to_date(F.lit(TODAY)), 1)).alias("b"))), lambda s: s["b"] > s["a"])
    pairs = lambda s: F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.greatest(F.datediff(F.least(x["b"], y["b"]), F.greatest(x["a"], y["a"])), F.lit(0)))))
    return T.let(spans, lambda s: F.aggregate(pairs(s), F.lit(0), lambda total, d: total + F.floor(d / 30).cast("int")))


def verdict(flag: Column) -> Column:
    """AMBIGUOUS if a record's other facts could honestly explain a hard flag, else UPHELD."""
    yoe, months = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)), F.aggregate("career_history", F.lit(0), lambda a, j: a + F.coalesce(j["duration_months"], F.lit(0)))
    overshoot = months - F.floor(yoe * 12)
    graduated = F.coalesce(F.array_max(F.transform("education", lambda e: F.coalesce(e["end_year"], F.lit(0)))), F.lit(0))
    said = F.regexp_extract(F.coalesce("profile.summary", F.lit("")), r"(?i)\bwith\s+(\d+(?:\.\d+)?)\+?\s+years?\s+of\s+(?:hands[- ]on\s+)?experience\b", 1).try_cast("double")
    invented = F.coalesce((F.abs(said - months / 12) <= 1.5) & (yoe - said >= 3), F.lit(False))
    idle = F.filter("skills", lambda s: (F.lower(s["proficiency"]) == "expert") & (F.coalesce(s["duration_months"], F.lit(0)) == 0))
    blob = F.lower(F.concat_ws(" ", F.transform("career_history", lambda j: _job_text(j, "title", "description"))))
    current = F.filter("career_history", lambda j: F.coalesce(j["is_current"], F.lit(False)))
    bad = F.filter("education", lambda e: (F.coalesce(e["start_year"], F.lit(0)) != 0) & (F.coalesce(e["end_year"], F.lit(0)) != 0) & ((e["end_year"] < e["start_year"]) | (e["start_year"] < 1970) | (e["end_year"] > 2035)))
    excused = {
        "experience_timeline_exceeds_claim": (overlap_months() >= overshoot - 30) & (overlap_months() > 0),
        "career_history_too_short_for_claimed_yoe": ~invented & (F.size("career_history") <= 2) & (graduated > 0) & (THIS_YEAR - graduated >= yoe - 1),
        "expert_skill_zero_duration": (F.size(idle) > 0) & (F.forall(idle, lambda s: F.coalesce(s["endorsements"], F.lit(0)) >= 5) | F.exists(idle, lambda s: F.contains(blob, F.lower(s["name"])))),
        "multiple_current_jobs": F.size(current) - F.size(F.filter(current, lambda j: F.lower(j["title"]).rlike(SIDE_TITLES))) <= 1,
        "impossible_education_timeline": (F.size(bad) > 0) & F.forall(bad, lambda e: (e["start_year"] - e["end_year"]).between(2, 6) & (e["end_year"] >= 1970)),
        "title_description_contradiction": F.forall("career_history", lambda j: F.coalesce(j["company_size"], F.lit("?")).isin(SMALL_SIZES)),
    }
    ambiguous = reduce(lambda w, kv: w.when(flag == kv[0], kv[1]), excused.items(), F.when(F.lit(False), F.lit(False)))
    return F.when(F.coalesce(ambiguous, F.lit(False)), "AMBIGUOUS").otherwise("UPHELD")


def regraded(score: Column, honeypot: Column, level: Column, grades: dict[str, float]) -> Column:
    """The score without its honeypot factor, times the grade of the record's class; a blocked record has 0."""
    grade = F.create_map(*[F.lit(x) for kv in grades.items() for x in kv])
    return F.when(honeypot > 0, score / honeypot * F.try_element_at(grade, level)).otherwise(0.0)


# ---- panels, evaluators, worlds ---------------------------------------------------------------------------------------
def recall_by_tier(labels: DataFrame, pool: DataFrame, ident: str, tiers: tuple[int, ...] = (5, 4, 3)) -> DataFrame:
    """How many labelled ids of each least tier a pool holds."""
    met = labels.join(pool.select(ident).distinct().withColumn("__in", F.lit(1)), ident, "left")
    rows = met.withColumn("least", F.explode(F.array(*map(F.lit, tiers)))).where(F.col("tier") >= F.col("least"))
    return rows.groupBy("least").agg(F.count("*").alias("n"), F.count("__in").alias("n_in")).withColumn("recall", F.col("n_in") / F.greatest(F.col("n"), F.lit(1)))


def flagged_win_rate(pairs: DataFrame, flagged: DataFrame, ident: str) -> DataFrame:
    """Over judged pairs (a, b, a_wins) of which one is flagged: how often that one wins."""
    mark = lambda side: flagged.select(F.col(ident).alias(side)).distinct().withColumn(f"{side}_flag", F.lit(1))
    met = pairs.join(mark("a"), "a", "left").join(mark("b"), "b", "left").where(F.col("a_flag").isNull() != F.col("b_flag").isNull())
    won = F.when(F.col("a_flag").isNotNull(), F.col("a_wins")).otherwise(1 - F.col("a_wins"))
    return met.agg(F.coalesce(F.avg(won), F.lit(0.0)).alias("win_rate"), F.count("*").alias("n"))


def panel_agreement(answers: DataFrame) -> DataFrame:
    """Of answers (candidate, reviewer, suitability 0 to 5, selected, remains, issue, confidence): agreement on quality and on the issue's class, reversals, candidates that most call impossible with high confidence."""
    by = answers.groupBy("candidate").agg(F.count("*").alias("n"), F.count("suitability").alias("rated"), F.stddev_pop("suitability").alias("spread"), F.count_if((F.col("issue") == "decisive_impossibility") & (F.col("confidence") == "high")).alias("hard"))
    issues = answers.where("issue <> ''").groupBy("candidate", "issue").agg(F.count("*").alias("k")).groupBy("candidate").agg(F.max("k").alias("most"))
    facts = by.join(issues, "candidate", "left").agg(
        (1 - F.avg(F.when((F.col("n") > 1) & (F.col("rated") == F.col("n")), F.col("spread"))) / 5).alias("quality_agreement"), F.avg(F.col("most") / F.col("n")).alias("issue_agreement"), F.count_if(F.col("hard") > F.col("n") / 2).alias("majority_hard")
    )
    reversed_ = answers.where("selected").agg(F.avg((~F.col("remains")).cast("double")).alias("reversal_rate"), F.count("*").alias("n_selected"))
    return facts.crossJoin(reversed_)  # a row each


def worst_case(values: DataFrame) -> DataFrame:
    """Of rankings judged by evaluators (ranking, evaluator, value): the least and the mean value, and whether a ranking is best by either; ties by name."""
    each = values.groupBy("ranking").agg(F.min("value").alias("worst"), F.avg("value").alias("mean"))
    first = lambda c: F.min_by("ranking", F.struct(-F.col(c), F.col("ranking"))).over(Window.partitionBy())  # noqa: E731 (a row for each ranking)
    return each.withColumns({"best_worst": first("worst") == F.col("ranking"), "best_mean": first("mean") == F.col("ranking")})


def severity_hedge(rows: DataFrame, ident: str, lock: int = 30, size: int = 100, limit: float = 1.0) -> DataFrame:
    """Rows (ident, base, tail, severity): the first by base keep their places; the others follow by tail, without those whose severity is over a limit."""
    by_base, by_tail = [F.desc("base"), F.col(ident).asc()], [F.desc("tail"), F.col(ident).asc()]
    head = rows.orderBy(*by_base).limit(lock).withColumn("place", F.row_number().over(Window.orderBy(*by_base)).cast("long")).withColumn("rank", F.col("place"))
    free = rows.where(F.col("severity") <= limit).orderBy(*by_tail).limit(size + lock)  # what the head takes of these is lock rows at most
    tail = free.join(head.select(ident), ident, "left_anti").select(*rows.columns, F.lit(None).cast("long").alias("place"))
    tail = tail.withColumn("rank", (head.count() + F.row_number().over(Window.orderBy(*by_tail))).cast("long"))
    return head.unionByName(tail).where(F.col("rank") <= size)


def adverse_labels(labels: DataFrame, severity: str, factor: float, tier_floor: float) -> DataFrame:
    """Labels in a world whose reviewers punish severe contradictions: gains shrink with severity, tiers are cut where over half goes."""
    keep = F.when(F.col(severity) > 1, F.greatest(F.lit(0.0), 1 - (F.col(severity) - 1) * factor)).otherwise(1.0)
    return labels.withColumns({"gain": F.col("gain") * keep, "tier": F.when(keep < 0.5, F.least("tier", F.lit(tier_floor))).otherwise(F.col("tier"))})


def unit_draw(*parts: Column, seed: str = "") -> Column:
    """A number in [0, 1) from a digest of columns: the same on any engine and for any partitioning."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return T.digest_mod(text, 1 << 20) / float(1 << 20)


def simulate_reviewers(pairs: DataFrame, reviewers: int, world: float, seed: str = "") -> DataFrame:
    """Reviewers judge pairs (a, b, quality_a, quality_b, integrity_a, integrity_b); each has own weights of quality and integrity, a noise and a leaning to the first shown, drawn by digest; a_wins is drawn from the logistic of the utilities' difference."""
    each = pairs.withColumn("reviewer", F.explode(F.sequence(F.lit(0), F.lit(reviewers - 1))))
    trait = lambda name, low, high: low + (high - low) * unit_draw(F.col("reviewer"), seed=f"{seed}{name}")
    utility = trait("quality", 1.3, 2.7) * (F.col("quality_a") - F.col("quality_b")) - F.greatest(F.lit(0.0), world + trait("integrity", -1.0, 1.0)) * (F.col("integrity_a") - F.col("integrity_b")) + trait("order", -0.25, 0.25)
    chance = 1 / (1 + F.exp(-trait("steady", 0.7, 1.3) * utility))
    return each.withColumn("a_wins", (unit_draw(F.col("reviewer"), F.col("a"), F.col("b"), seed=f"{seed}draw") < chance).cast("int"))


def hard_negatives(rows: DataFrame, likeness: str, reasons: dict[str, Column], low: float = 0.96, high: float = 0.97) -> DataFrame:
    """Rows whose likeness lies between two percentiles of all and that some reason calls a trap, with the reasons."""
    bounds = rows.agg(F.percentile(likeness, F.lit(low)).alias("__low"), F.percentile(likeness, F.lit(high)).alias("__high"))
    inside = rows.crossJoin(bounds).where(F.col(likeness).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")  # bounds: one row
    return inside.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()]))).where(F.size("reasons") > 0)


def safe_variants(deltas: DataFrame) -> DataFrame:
    """Of variants measured by metrics (variant, metric, is_composite, value, main, champion): losses to either base, mean composite, and whether none is lost."""
    lost = lambda base, kind: F.count_if((F.col("value") - F.col(base) < -1e-12) & (F.col("is_composite") == kind))
    out = deltas.groupBy("variant").agg(lost("main", False).alias("component_losses"), lost("main", True).alias("composite_losses"), lost("champion", True).alias("champion_losses"), F.avg(F.when(F.col("is_composite"), F.col("value"))).alias("mean_composite"))
    return out.withColumns({"main_safe": (F.col("component_losses") == 0) & (F.col("composite_losses") == 0), "fully_safe": (F.col("component_losses") == 0) & (F.col("composite_losses") == 0) & (F.col("champion_losses") == 0)})


def nearest_free(drivers: DataFrame, pool: DataFrame, ident: str, score: str, most: int = 5) -> DataFrame:
    """(driver, match): for each of a few drivers, in order of id, the row of the pool nearest by score that no driver before took; ties by id."""
    few = drivers.orderBy(ident).limit(most + 1).collect()  # at most six rows
    if len(few) > most:
        raise ValueError(f"at most {most} drivers: each is a pass over the pool")
    taken = []
    for d in few:
        free = pool.where(~F.col(ident).isin([m for _, m in taken] or [None]) | F.lit(not taken))
        best = free.orderBy(F.abs(F.col(score) - F.lit(d[score])), ident).select(ident).first()
        if best is not None:
            taken.append((d[ident], best[ident]))
    kind = dict(pool.dtypes)[ident]
    return drivers.sparkSession.createDataFrame(taken, f"driver {kind}, match {kind}")


def frontier(utilities: DataFrame, at: float) -> DataFrame:
    """(mix, ranking, utility): the rows of the mix nearest to one, with the ranking preferred there."""
    near = utilities.select("mix").distinct().orderBy(F.abs(F.col("mix") - at), "mix").limit(1)
    rows = utilities.join(F.broadcast(near), "mix")  # one row
    best = F.min_by("ranking", F.struct(-F.col("utility"), F.col("ranking"))).over(Window.partitionBy("mix"))
    return rows.withColumn("preferred", F.col("ranking") == best)


def waterfall(influence: DataFrame, top: int = 5) -> DataFrame:
    """What the most influential rows and all the others add to a gain; neither is below 0."""
    place = F.row_number().over(Window.orderBy(F.desc("influence"), "ident"))
    rows = influence.withColumn("place", place).agg(F.sum("influence").alias("gain"), F.sum(F.when(F.col("place") <= top, F.col("influence"))).alias("head"))
    first = F.greatest(F.lit(0.0), F.least("head", "gain"))
    return rows.select(F.explode(F.array(F.struct(F.lit("top").alias("part"), first.alias("contribution")), F.struct(F.lit("others").alias("part"), F.greatest(F.lit(0.0), F.col("gain") - first).alias("contribution")))).alias("x")).select("x.*")


def logistic_folds(rows: DataFrame, inputs: list[str], target: str, fold: str, folds: int = 5, c: float = 1.0, rounds: int = 12) -> dict[int, list[float]]:
    """For each fold the weights (first the intercept) of a balanced, ridged logistic regression fitted to the other folds.

    Newton's steps of all folds at once. In a round each task tells one vector of sums for each fold, gradient and products
    of inputs, whatever the number of inputs; these are added up by place in the vector.
    """
    spark = rows.sparkSession
    ship(spark.sparkContext)
    n = len(inputs) + 1
    table = staged(rows.select(*[F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(inputs, 1)], F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")), "logistic")
    sizes = {r["fold"]: (r["n1"], r["n0"]) for r in table.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).collect()}  # a row for each fold
    counts = {k: tuple(sum(s[i] for f, s in sizes.items() if f != k) for i in (0, 1)) for k in range(folds)}
    w = {k: np.zeros(n) for k in range(folds)}

    def sums(weights: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, n + n * n))
            for b in batches:
                x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy(zero_copy_only=False) for i in range(n - 1)]]).astype(float)
                y, own = b.column(n - 1).to_numpy(zero_copy_only=False).astype(float), b.column(n).to_numpy(zero_copy_only=False)
                there = ~(np.isnan(x).any(1) | np.isnan(y))  # a row without all its numbers takes no part
                for k, (n1, n0) in counts.items():
                    p = 1 / (1 + np.exp(-(x @ weights[k])))
                    balance = np.where(y == 1, (n1 + n0) / 2 / max(n1, 1), (n1 + n0) / 2 / max(n0, 1)) * ((own != k) & there)
                    seen = np.where(there[:, None], x, 0.0)
                    total[k, :n] += np.nan_to_num(balance * (y - p)) @ seen
                    total[k, n:] += ((np.nan_to_num(balance * p * (1 - p))[:, None] * seen).T @ seen).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(folds), n + n * n), pa.int32()), pa.array(np.tile(np.arange(n + n * n), folds), pa.int32()), pa.array(total.ravel())], names=["fold", "at", "s"])

        return run

    for _ in range(rounds):
        found = np.zeros((folds, n + n * n))
        for r in table.mapInArrow(sums(w), "fold int, at int, s double").groupBy("fold", "at").agg(F.sum("s").alias("s")).collect():  # a number for each fold and product
            found[r["fold"], r["at"]] = r["s"]
        for k in range(folds):
            ridge = np.diag([1e-9] + [1 / c] * (n - 1))
            w[k] = w[k] + np.linalg.solve(found[k, n:].reshape(n, n) + ridge, found[k, :n] - ridge @ w[k])
    return {k: v.tolist() for k, v in w.items()}


def out_of_fold(rows: DataFrame, inputs: list[str], fold: str, weights: dict[int, list[float]]) -> Column:
    """Each row's probability by the weights fitted without its fold."""
    z = lambda w: sum((F.col(c).cast("double") * w[i + 1] for i, c in enumerate(inputs)), F.lit(w[0]))
    return reduce(lambda out, kv: out.when(F.col(fold) == kv[0], 1 / (1 + F.exp(-z(kv[1])))), weights.items(), F.when(F.lit(False), 0.0))
