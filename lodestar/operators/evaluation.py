"""Ranking metrics over long frames: ranking (ident, rank) and labels (ident, tier, gain), by any number of sets.

Every metric is a sum of per-row terms, so sets and policies are evaluated in one pass, grouped by their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import ranks

RELEVANT = 3.0
COMPOSITE = {"ndcg10": 0.50, "ndcg50": 0.30, "map": 0.15, "p10": 0.05}


def gain(g: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), g) - 1) / F.log2(rank + 1)


def dcg(g: Column, rank: Column, k: int) -> Column:
    return F.coalesce(F.sum(F.when(rank <= k, gain(g, rank))), F.lit(0.0))


def overlay(base: DataFrame, extra: DataFrame, ident: str) -> DataFrame:
    """Labels of both; the extra ones win."""
    a, b = base.alias("a"), extra.alias("b")
    return a.join(b, ident, "full_outer").select(ident, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in base.columns if c != ident])


def evaluate(ranking: DataFrame, labels: DataFrame, ident: str, policy: str, sets: tuple[str, ...] = (), relevant: float = RELEVANT) -> DataFrame:
    """Per set: ndcg10, ndcg50, map, p10, composite, coverage, n_scored, n_labels. Unlabelled rows are left out (exclude) or count as 0 (zero).

    The ideal order takes all labels, also of ids that the ranking lacks.
    """
    if policy not in ("exclude", "zero"):
        raise ValueError(f"unknown policy: {policy!r}")
    keys = list(sets)
    by_rank = Window.partitionBy(*keys).orderBy("rank")
    best = Window.partitionBy(*keys).orderBy(F.desc("gain"))
    # A ranking is a report of bounded size; the labels' ideal order needs its first 50 only.
    ideal = labels.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 50)
    ideal = ideal.groupBy(*keys).agg(dcg(F.col("gain"), F.col("place"), 10).alias("ideal10"), dcg(F.col("gain"), F.col("place"), 50).alias("ideal50"))
    counts = labels.groupBy(*keys).agg(F.count("*").alias("n_labels"), F.count_if(F.col("tier") >= relevant).alias("n_relevant"))
    if keys:
        ranking = ranking if set(keys) <= set(ranking.columns) else ranking.join(F.broadcast(counts.select(*keys)))
    joined = ranking.join(labels.withColumn("__labelled", F.lit(1)), [*keys, ident], "left")
    size = joined.groupBy(*keys).agg(F.count("*").alias("n_ranked"), F.count("__labelled").alias("n_found"))
    scored = joined if policy == "zero" else joined.where("__labelled IS NOT NULL")
    scored = scored.withColumns({"tier": F.coalesce("tier", F.lit(0.0)), "gain": F.coalesce("gain", F.lit(0.0))}).withColumn("rank", F.row_number().over(by_rank))
    hit = (F.col("tier") >= relevant).cast("int")
    scored = scored.withColumn("hits", F.sum(hit).over(by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    got = scored.groupBy(*keys).agg(
        dcg(F.col("gain"), F.col("rank"), 10).alias("dcg10"),
        dcg(F.col("gain"), F.col("rank"), 50).alias("dcg50"),
        F.sum(F.when(F.col("tier") >= relevant, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when((F.col("rank") <= 10) & (F.col("tier") >= relevant), 1).otherwise(0)).alias("hits10"),
        F.count("*").alias("n_scored"),
    )
    if keys:
        out = counts.join(ideal, keys).join(size, keys, "left").join(got, keys, "left")
    else:
        out = counts.crossJoin(ideal).crossJoin(size).crossJoin(got)  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns(
        {
            "ndcg10": zero(F.try_divide("dcg10", F.nullif("ideal10", F.lit(0.0)))),
            "ndcg50": zero(F.try_divide("dcg50", F.nullif("ideal50", F.lit(0.0)))),
            "map": zero(F.try_divide("precisions", F.least("n_relevant", F.col("n_scored")))),
            "p10": zero(F.col("hits10") / 10.0),
            "coverage": zero(F.try_divide("n_found", "n_ranked")),
        }
    )
    composite = sum((F.col(c) * w for c, w in COMPOSITE.items()), F.lit(0.0))
    return out.withColumn("composite", composite).select(*keys, "ndcg10", "ndcg50", "map", "p10", "composite", "coverage", "n_scored", "n_labels")


def average_precision(ranking: DataFrame, labels: DataFrame, ident: str, relevant: float = 4.0) -> DataFrame:
    """The other definition: precisions at hits over all relevant labels, found or not."""
    joined = ranking.join(labels, ident, "left").withColumn("hit", F.when(F.col("tier") >= relevant, 1).otherwise(0))
    sums = ranks.running(joined.select("rank", "hit"), [F.col("rank").asc()], {"hits": F.col("hit")}).agg(F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("s"))
    return sums.crossJoin(labels.agg(F.count_if(F.col("tier") >= relevant).alias("n"))).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("average_precision"))


def auc(rows: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """The chance that a positive row scores above a negative one, ties half: from counts of each distinct score.

    Only distinct scores are ordered, with their two counts, not rows.
    """
    counts = rows.groupBy(*keys, score).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q"))
    counts = ranks.running(counts, [F.col(score).asc()], {"upto": F.col("q")}, keys).withColumn("below", F.col("upto") - F.col("q"))
    out = counts.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*keys, F.try_divide("u", F.col("p") * F.col("q")).alias("auc"), F.col("p").cast("long").alias("n_positive"), F.col("q").cast("long").alias("n_negative"))


def tie_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, average rank) of each distinct value: ranks come from counts of values."""
    counts = rows.groupBy(column).agg(F.count("*").alias("__n"))
    counts = ranks.running(counts, [F.col(column).asc()], {"upto": F.col("__n")})
    return counts.select(column, (F.col("upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias("average_rank"))


def quantile_groups(rows: DataFrame, value: str, ident: str, groups: int, name: str) -> DataFrame:
    """rows with the number, from 1, of the equal part that they fall in by value, largest first, ties by id; the first parts have one row more.

    Places are counted by ranges of the order, so that a value which many rows share is dealt over tasks.
    """
    placed = ranks.numbered(rows, [F.desc(value), F.col(ident).asc()], name="__place", size="__all")
    place = F.col("__place") - 1
    small, more = F.floor(F.col("__all") / groups), F.col("__all") % groups
    cut = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.withColumn(name, (cut + 1).cast("long")).drop("__place", "__all")


def weighted_kappa(pairs: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic-weighted kappa, exact and within-one agreement of two raters, from their contingency table."""
    cells = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    n = F.sum("o").over(Window.partitionBy())
    cells = cells.withColumns({"n": n, "row": F.sum("o").over(Window.partitionBy(a)), "column": F.sum("o").over(Window.partitionBy(b))})
    distance = lambda x, y: F.pow(x - y, 2) / float((levels - 1) ** 2)
    rows, columns = cells.select(F.col(a).alias("x"), "row", "n").distinct(), cells.select(F.col(b).alias("y"), "column").distinct()
    expected = rows.crossJoin(F.broadcast(columns)).agg(F.sum(distance(F.col("x"), F.col("y")) * F.col("row") * F.col("column") / F.col("n")).alias("e"))  # levels squared cells
    observed = cells.agg(F.sum(distance(F.col(a), F.col(b)) * F.col("o")).alias("d"), (F.sum(F.when(F.col(a) == F.col(b), F.col("o")).otherwise(0.0)) / F.sum("o")).alias("exact"), (F.sum(F.when(F.abs(F.col(a) - F.col(b)) <= 1, F.col("o")).otherwise(0.0)) / F.sum("o")).alias("within_one"))
    return observed.crossJoin(expected).select((1 - F.col("d") / F.col("e")).alias("kappa"), "exact", "within_one")


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Counts, moments and nearest-rank percentiles of a group's values; exact for groups of any size, as places are counted by ranges."""
    v = F.col(value)
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v != 0).alias("nonzero"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.max(F.abs(v)).alias("max_abs"))
    placed = ranks.numbered(rows.where(v.isNotNull()).select(*keys, v.alias("__v")), [F.col("__v").asc()], keys, "__place", "__size")
    at = lambda p: F.col("__place") == F.bround(F.lit(p) * (F.col("__size") - 1), 0) + 1
    points = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    met = placed.where(at(0.05) | at(0.5) | at(0.95)).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.max(F.when(at(p), F.col("__v"))).alias(name) for name, p in points.items()])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out.join(met, same, "left").drop(*[f"__{k}" for k in keys])  # a row for each group
