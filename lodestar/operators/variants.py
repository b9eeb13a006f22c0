"""Search for an order between two rankings that loses to neither: all variants at once, as rows.

A variant is a rule that places the rows of both rankings: a prefix of one completed by the other, reciprocal ranks or
ranks weighted between the two, a band of the second in the order of the first. The pool is the first `size` rows of
both, so a variant has at most 2 * size rows and the search as many times as there are variants. Variants of equal orders
count once, under the first rule that gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import evaluation as E

#: The grid of the search. Prefixes up to 100, weights in hundredths, smoothing of reciprocal ranks, bands in
#: steps of five, and the place of a row that a band's order lacks.
SIZE, WEIGHTS, SMOOTH, STEP, LAST = 100, 101, (0.0, 10.0, 50.0, 100.0), 5, 10_000
METRICS = ("ndcg10", "ndcg50", "map", "p10", "composite")


def grid(size: int = SIZE, weights: int = WEIGHTS, smooth: tuple[float, ...] = SMOOTH, step: int = STEP) -> list[tuple]:
    """(number, kind, a, b) of the variants: 0 is the first ranking, 1 the second."""
    out: list[tuple] = [("main", 0.0, 0.0), ("champion", 0.0, 0.0)]
    for n in range(1, size + 1):
        out += [("main_prefix", float(n), 0.0), ("champion_prefix", float(n), 0.0)]
    for i in range(weights):
        w = i / (weights - 1)
        out += [*[("rrf", w, k) for k in smooth], ("linear", w, 0.0)]
    out += [("main_order_band", float(start), float(stop)) for start in range(0, size, step) for stop in range(start + step, size + 1, step)]
    return [(k, *v) for k, v in enumerate(out)]


def orders(main: DataFrame, champion: DataFrame, rules: DataFrame, size: int = SIZE) -> DataFrame:
    """(variant, ident, rank) of rules (variant, kind, a, b); main and champion are (ident, rank)."""
    top = lambda frame, name: frame.where(F.col("rank") <= size).select("ident", F.col("rank").cast("double").alias(name))
    pool = top(main, "m").join(top(champion, "c"), "ident", "full_outer")
    pool = pool.crossJoin(F.broadcast(pool.agg((F.count("*") + 100).cast("double").alias("missing"))))  # one row
    rows = F.broadcast(rules).crossJoin(pool)  # rules by at most 2 * size rows
    m, c, a, b = (F.col(x) for x in "mcab")
    far_m, far_c = F.coalesce(m, F.col("missing")), F.coalesce(c, F.col("missing"))

    def prefix(first: Column, then: Column) -> tuple[Column, Column, Column]:
        inside = F.coalesce(first <= a, F.lit(False))
        return F.when(inside, 0.0).otherwise(1.0), F.when(inside, first).otherwise(then), inside | then.isNotNull()

    inside = (c > a) & (c <= b)
    by_kind = {
        "main": (m, F.lit(0.0), m.isNotNull()),
        "champion": (c, F.lit(0.0), c.isNotNull()),
        "main_prefix": prefix(m, c),
        "champion_prefix": prefix(c, m),
        "rrf": (-((1.0 - a) / (b + far_m) + a / (b + far_c)), F.lit(0.0), F.lit(True)),
        "linear": ((1.0 - a) * far_m + a * far_c, F.lit(0.0), F.lit(True)),
        "main_order_band": (F.when(inside, a + 1).otherwise(c), F.when(inside, F.coalesce(m, F.lit(float(LAST)))).otherwise(0.0), c.isNotNull()),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in by_kind.items()])
    keyed = rows.where(pick(2)).select("variant", "ident", pick(0).alias("x"), pick(1).alias("y"))
    place = F.row_number().over(Window.partitionBy("variant").orderBy("x", "y", "ident"))
    return keyed.select("variant", "ident", place.alias("rank")).where(F.col("rank") <= size)


def first_of_equal(placed: DataFrame) -> DataFrame:
    """The variants whose order no variant of a smaller number has; an order is a list of at most the report's size."""
    lists = placed.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("rank", "ident"))).alias("o"))
    return lists.groupBy("o").agg(F.min("variant").alias("variant")).select("variant")


def measured(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """(variant, evaluator, policy, metric, value) against labels (evaluator, ident, tier, gain), without rows that have no label (exclude) or with gain 0 for them (zero)."""
    ideal_place = F.row_number().over(Window.partitionBy("evaluator").orderBy(F.desc("gain")))
    ideal = labels.withColumn("p", ideal_place).where("p <= 50").groupBy("evaluator").agg(E.dcg(F.col("gain"), F.col("p"), 10).alias("i10"), E.dcg(F.col("gain"), F.col("p"), 50).alias("i50"))
    relevant = labels.groupBy("evaluator").agg(F.count_if(F.col("tier") >= E.RELEVANT).alias("relevant"))
    sets = ideal.join(relevant, "evaluator")
    judged = placed.join(F.broadcast(sets.select("evaluator")), F.lit(True)).join(labels, ["evaluator", "ident"], "left")  # a row for each evaluator
    both = judged.withColumn("policy", F.explode(F.when(F.col("tier").isNull(), F.array(F.lit("zero"))).otherwise(F.array(F.lit("exclude"), F.lit("zero")))))
    own = Window.partitionBy("variant", "evaluator", "policy").orderBy("rank")
    both = both.withColumns({"p": F.row_number().over(own), "hit": F.when(F.col("tier") >= E.RELEVANT, 1).otherwise(0), "gain": F.coalesce("gain", F.lit(0.0))})
    both = both.withColumn("hits", F.sum("hit").over(own))
    sums = both.groupBy("variant", "evaluator", "policy").agg(E.dcg(F.col("gain"), F.col("p"), 10).alias("d10"), E.dcg(F.col("gain"), F.col("p"), 50).alias("d50"), F.sum(F.col("hit") * F.col("hits") / F.col("p")).alias("precisions"), F.sum(F.when(F.col("p") <= 10, F.col("hit"))).alias("h10"), F.count("*").alias("scored")).join(F.broadcast(sets), "evaluator")
    share = lambda x, y: F.coalesce(F.try_divide(x, F.nullif(y, F.lit(0.0))), F.lit(0.0))
    values = sums.withColumns({"ndcg10": share(F.col("d10"), F.col("i10")), "ndcg50": share(F.col("d50"), F.col("i50")), "map": share(F.col("precisions"), F.least("relevant", "scored").cast("double")), "p10": F.col("h10") / 10.0})
    values = values.withColumn("composite", sum((F.col(k) * w for k, w in E.COMPOSITE.items()), F.lit(0.0)))
    return values.unpivot(["variant", "evaluator", "policy"], list(METRICS), "metric", "value")


def search(main: DataFrame, champion: DataFrame, labels: DataFrame, rules: list[tuple], size: int = SIZE) -> DataFrame:
    """Of each variant: what it loses to the two rankings, over all evaluators and both policies, and how it differs from the second."""
    spark: SparkSession = main.sparkSession
    frame = spark.createDataFrame(rules, "variant int, kind string, a double, b double")
    placed = orders(main, champion, frame, size)
    placed = placed.join(F.broadcast(first_of_equal(placed)), "variant")
    values = measured(placed, labels).withColumn("value", F.round("value", 9))
    keys = ["evaluator", "policy", "metric"]
    base = lambda number, name: values.where(F.col("variant") == number).select(*keys, F.col("value").alias(name))
    beside = values.join(F.broadcast(base(0, "main")), keys).join(F.broadcast(base(1, "champion")), keys)  # a row for each evaluator, policy and metric
    whole = F.col("metric") == "composite"
    lost = lambda name: F.col("value") - F.col(name) < -1e-12
    facts = beside.groupBy("variant").agg(F.count_if(lost("main") & ~whole).alias("component_losses"), F.count_if(lost("main") & whole).alias("composite_losses"), F.count_if(lost("champion") & whole).alias("champion_losses"), F.avg(F.when(whole, F.col("value"))).alias("mean_composite"), F.min(F.col("value") - F.col("main")).alias("least_delta"))
    second = placed.where("variant = 1").select("ident", F.col("rank").alias("at"))
    changed = placed.join(F.broadcast(second), "ident", "left").groupBy("variant").agg(F.count_if(~F.col("rank").eqNullSafe(F.col("at"))).alias("changed"))
    safe = (F.col("component_losses") == 0) & (F.col("composite_losses") == 0)
    return facts.join(changed, "variant").join(F.broadcast(frame), "variant").withColumns({"main_safe": safe, "fully_safe": safe & (F.col("champion_losses") == 0)})
