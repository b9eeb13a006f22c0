"""Boosted trees that order the rows of a group, learned on the cluster."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.staging import staged


def _vectors(rows: DataFrame, inputs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs}))


def lambdas(rows: DataFrame, group: str, ident: str, target: str, score: str, top: int) -> DataFrame:
    """(ident, pull, weight): how far pairs of a group's rows that a swap would put right pull each row, by what the swap changes in the normalised gain.

    Each pair has a row of one of the first `top` places, so a group of n rows has at most top * n pairs.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), ident))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(target), ident))
    worth, gain = 1 / F.log2(F.col("place") + 1), F.pow(F.lit(2.0), F.col(target)) - 1
    ranked = rows.withColumns({"place": place, "best": best})
    ideal = ranked.groupBy(group).agg(F.sum(F.when(F.col("best") <= top, gain / F.log2(F.col("best") + 1))).alias("ideal"))
    ranked = ranked.join(ideal, group).select(F.col(group).alias("g"), F.col(ident).alias("i"), F.col(score).alias("s"), gain.alias("gain"), worth.alias("worth"), "place", "ideal")
    x, y = ranked.alias("x"), ranked.where(F.col("place") <= top).alias("y")
    # A pair of two first rows is met from both sides; the one from the lower place is left out.
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.place") > F.col("y.place")) & (F.col("x.gain") != F.col("y.gain")))
    swap = F.abs((F.col("x.gain") - F.col("y.gain")) * (F.col("x.worth") - F.col("y.worth"))) / F.greatest(F.col("x.ideal"), F.lit(1e-12))
    up = F.when(F.col("x.gain") > F.col("y.gain"), 1.0).otherwise(-1.0)  # whether x ought to rise
    rho = 1 / (1 + F.exp(up * (F.col("x.s") - F.col("y.s"))))
    pairs = met.select(F.col("x.i").alias("i"), F.col("y.i").alias("j"), (up * rho * swap).alias("pull"), (rho * (1 - rho) * swap).alias("weight"))
    both = pairs.select("i", "pull", "weight").union(pairs.select("j", -F.col("pull"), "weight"))
    return both.groupBy(F.col("i").alias(ident)).agg(F.sum("pull").alias("pull"), F.sum("weight").alias("weight"))


class LambdaTrees:
    """Boosted trees whose steps follow the pairs' pulls; a leaf's value is Newton's step for its rows."""

    def __init__(self, rate: float = 0.1, depth: int = 4) -> None:
        self.rate, self.depth, self.trees, self.inputs = rate, depth, [], []

    def fit(self, rows: DataFrame, group: str, ident: str, inputs: list[str], target: str, rounds: int = 20, top: int = 100) -> LambdaTrees:
        self.inputs = inputs
        table = staged(_vectors(rows, inputs).select(group, ident, F.col(target).cast("double").alias(target), "features", F.lit(0.0).alias("score")), "boosted")
        for k in range(rounds):
            pulls = lambdas(table, group, ident, target, "score", top)
            steps = table.join(pulls.where("weight > 0"), ident).select("features", (F.col("pull") / F.col("weight")).alias("label"), "weight")
            tree = DecisionTreeRegressor(maxDepth=self.depth, weightCol="weight", predictionCol="__step", seed=k).fit(steps)
            self.trees.append(tree)
            table = staged(tree.transform(table).withColumn("score", F.col("score") + self.rate * F.col("__step")).drop("__step"), "boosted")
        return self

    def score(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        out = _vectors(rows, self.inputs).withColumn(name, F.lit(0.0))
        for tree in self.trees:
            out = tree.transform(out).withColumn(name, F.col(name) + self.rate * F.col("__step")).drop("__step")
        return out.drop("features")
