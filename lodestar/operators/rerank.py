"""Rerankers of a ranking's head. All but the model work on frames of report size (ident, rank, score and a few columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric as N

from . import fusion

# Fixed values of the rerankers.
LOCK, POOL, RRF_K, MODEL_SHARE, BLEND = 100, 3000, 60.0, 0.27, 0.3625
BAND, RETRIEVAL_WEIGHT, YEARS_WEIGHT, YEARS_CENTER, YEARS_WIDTH = 8, 8.0, 4.0, 7.0, 2.0
CLEANUP, SEVERITY = 2, 1.0
BEHAVIOR_BAND, RESPONSE_BAND = (10, 13), (64, 74)


def hedge(rows: DataFrame, heads: list[Column], ident: str = "candidate_id") -> DataFrame:
    """Reorders the first hundred by score with a model's rank: rows (ident, main, score, gate) with columns the heads need.

    The pool of best main scores gets the mean of heads, scaled; it is blended with the scaled ungated score, gated, ranked,
    and fused by reciprocal ranks within the locked hundred. Returns ident, rank, score of the whole frame's pool.
    """
    order = Window.orderBy(F.desc("score"), ident)
    pool = rows.orderBy(F.desc("main"), ident).limit(POOL)
    mean = sum(heads[1:], heads[0]) / len(heads)
    pool = pool.withColumns({"h": mean, "u": F.when(F.col("gate") > 0, F.col("score") / F.col("gate")).otherwise(0.0)})
    stats = pool.agg(F.min("h"), F.max("h"), F.min("u"), F.max("u")).first()
    lo, hi, ulo, uhi = (F.lit(float(x or 0.0)) for x in stats)
    model = ((1 - BLEND) * N.minmax(F.col("u"), ulo, uhi, 0.5) + BLEND * N.minmax(F.col("h"), lo, hi, 0.5)) * F.col("gate")
    third = pool.withColumn("m", model).orderBy(F.desc("m"), ident).limit(LOCK).select(ident, F.row_number().over(Window.orderBy(F.desc("m"), ident)).alias("model_rank"))
    first = rows.orderBy(F.desc("score"), ident).limit(LOCK).withColumn("own_rank", F.row_number().over(order))
    fused = first.join(third, ident, "left").withColumn("fused", (1 - MODEL_SHARE) / (RRF_K + F.col("own_rank")) + F.coalesce(MODEL_SHARE / (RRF_K + F.col("model_rank")), F.lit(0.0)))
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), ident))).withColumn("score", F.col("fused")).drop("fused", "own_rank", "model_rank")


def top_band(top: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """The first rows by rank less retrieval evidence and a band of years."""
    inside = F.col("rank") <= BAND
    cost = F.col("rank") - RETRIEVAL_WEIGHT * F.col("ir_ranking_experience") - YEARS_WEIGHT * N.gaussian(F.coalesce("x_yoe", F.lit(0.0)), YEARS_CENTER, YEARS_WIDTH)
    band = Window.partitionBy(F.when(inside, 0).otherwise(F.col("rank"))).orderBy(F.round(cost, 9), ident)
    return top.withColumn("rank", F.when(inside, F.row_number().over(band)).otherwise(F.col("rank")))


def cleanup(top: DataFrame, tail: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """The lowest rows whose severity is over the cap give their places to the first clean rows of the tail."""
    bad = top.where(F.col("severity") > SEVERITY).withColumn("k", F.row_number().over(Window.orderBy(F.desc("rank")))).where(F.col("k") <= CLEANUP)
    fresh = tail.where(F.col("severity") <= SEVERITY).orderBy("rank").limit(CLEANUP).withColumn("k", F.row_number().over(Window.orderBy("rank")))
    places = bad.select("k", F.col("rank").alias("place"), F.col(ident).alias("gone"))
    new = fresh.join(places, "k").withColumn("rank", F.col("place"))
    kept = top.join(new.select(F.col("gone").alias(ident)), ident, "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def clean_tail(rows: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Of the rows behind the first LOCK by score, the first clean ones, with a rank: all that cleanup takes of them.

    At most LOCK clean rows stand before them, so a report's size of rows is ordered, never all in one task.
    """
    best = [F.desc("score"), ident]
    locked = rows.orderBy(*best).limit(LOCK).select(ident)
    clean = rows.where(F.col("severity") <= SEVERITY).orderBy(*best).limit(LOCK + CLEANUP).join(F.broadcast(locked), ident, "left_anti")
    return clean.withColumn("rank", F.row_number().over(Window.orderBy(*best)) + LOCK)


def rescore(order: DataFrame, scores: DataFrame) -> DataFrame:
    """Keeps the order; the first place gets the largest of scores, and so on."""
    ranked = scores.select(F.col("score").alias("new_score"), F.row_number().over(Window.orderBy(F.desc("score"))).alias("rank"))
    return order.join(ranked, "rank").withColumn("score", F.col("new_score")).drop("new_score")


def final_bands(top: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Two bands of places are sorted by behaviour and by responsiveness."""
    out = fusion.band_sort(top, *BEHAVIOR_BAND, F.col("behavioral_multiplier"), ident)
    return fusion.band_sort(out, *RESPONSE_BAND, F.col("responsiveness_score"), ident)


def lambdamart_rerank(rows: DataFrame, model: str, share: float = 0.75, top: int = 300, ident: str = "candidate_id") -> DataFrame:
    """The first rows by (share of a model's score and the rest of their own) times behaviour; honeypots go to zero, the tail follows.

    Ranks are 1, 2, ... of all rows; only the first top of them change places.
    """
    head = F.col("rank") <= top
    mixed = F.when(F.col("honeypot_multiplier") <= 0, 0.0).otherwise((share * F.col(model) + (1 - share) * F.col("score")) * F.col("behavioral_multiplier"))
    order = Window.orderBy(F.desc(F.round(mixed, 9)), ident, "rank")
    first = rows.where(head).withColumn("rank", F.row_number().over(order))
    return first.unionByName(rows.where(~head).withColumn("rank", F.col("rank").cast("int")))


def parse_trees(text: str) -> list[dict[str, list]]:
    """Trees of a boosted model's text dump, in the form that `fusion.forest` takes; its mean times their number is the sum."""
    trees = []
    for block in text.split("\nTree=")[1:]:
        fields = dict(line.split("=", 1) for line in block.split("\n") if "=" in line)
        leaves = [float(x) for x in fields["leaf_value"].split()]
        n = int(fields["num_leaves"]) - 1
        feature = [int(x) for x in fields.get("split_feature", "").split()][:n]
        at = lambda k: [int(x) if int(x) >= 0 else n + ~int(x) for x in fields.get(k, "").split()][:n]
        trees.append({"feature": feature + [-1] * len(leaves), "threshold": [float(x) for x in fields.get("threshold", "").split()][:n] + [0.0] * len(leaves), "left": at("left_child") + [0] * len(leaves), "right": at("right_child") + [0] * len(leaves), "value": [0.0] * n + leaves})
    return trees
