"""Majorities between items without pairs of items, by counting dominance.

An item beats another if at least t voters place it first. Of the voters that do, each set S of j >= t counts with
(-1)^(j-t) * C(j-1, t-1), and these add up to one for a majority and to nothing else; so wins are sums over sets of voters
of how many items an item precedes with all voters of the set. Such a count in j orders is split by ranges: by the
first order items fall into blocks of LEAF; two items of different blocks part at one level of a binary tree over the
blocks, where one is in the left half of a node and the other in the right. In each node the remaining orders are
counted the same way between the halves, a last order by running sums; items of one block are compared there. So n
items make about n * log(n / LEAF) ** (j - 1) rows, and no group has more than LEAF of them but where it is sorted by ranges.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import ranks
from lodestar.sources.staging import ship

#: Items that are compared with each other in one group.
LEAF = 1024

_COUNTS = ["ident", "set", "above", "below"]


def _compared(first: int, kind: pa.DataType):
    """Within a block: how many items of the other side an item precedes, or follows, in all orders from first on."""

    def run(rows: pa.Table) -> pa.Table:
        place = np.array(rows["r"].to_pylist())[:, first:]
        side = rows["side"].to_numpy()
        left, right = (np.flatnonzero(side == s) for s in (0, 1)) if side[0] >= 0 else (np.arange(len(side)),) * 2
        before = np.ones((len(left), len(right)), bool)
        for order in place.T:
            before &= order[left, None] < order[None, right]
        above, below = np.zeros(len(side), np.int64), np.zeros(len(side), np.int64)
        above[left] = before.sum(1)
        below[right] = before.sum(0)
        return pa.table([rows["ident"], rows["set"], pa.array(above), pa.array(below)], names=_COUNTS).cast(pa.schema([("ident", kind), ("set", pa.int32()), ("above", pa.int64()), ("below", pa.int64())]))

    return run


def _counts(rows: DataFrame, orders: int, leaf: int, kinds: tuple[str, pa.DataType], first: int = 0) -> list[DataFrame]:
    """Parts of (ident, set, above, below) for rows (ident, set, g, side, r): pairs within a g, from side 0 to side 1 or, at first, of all."""
    schema = f"ident {kinds[0]}, set int, above long, below long"
    place = F.col("r")[first]
    if first and first == orders - 1:
        sums = {"one": F.when(F.col("side") == 1, 1).otherwise(0), "zero": F.when(F.col("side") == 0, 1).otherwise(0)}
        upto = ranks.running(rows.withColumn("__place", place), [F.col("__place").asc()], sums, ["g"], whole=True)
        return [upto.select("ident", "set", F.when(F.col("side") == 0, F.col("all_one") - F.col("one")).otherwise(0).alias("above"), F.when(F.col("side") == 1, F.col("zero")).otherwise(0).alias("below"))]
    placed = ranks.numbered(rows.withColumn("__place", place), [F.col("__place").asc()], ["g"], "at", "size").drop("__place")
    placed = placed.withColumn("block", F.expr(f"(at - 1) div {leaf}"))
    out = [placed.groupBy("g", "block").applyInArrow(_compared(first, kinds[1]), schema)]
    most = placed.agg(F.max("size")).first()[0] or 0
    levels = ((most - 1) // leaf).bit_length() if most else 0
    if not levels:
        return out
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    split = placed.select("ident", "set", "g", "side", "r", "block", "size", level.alias("level")).where(f"shiftleft(1L, level) <= (size - 1) div {leaf}")
    half = F.expr("cast(shiftright(block, level) & 1 AS int)")
    node = F.concat("g", F.array(F.col("level").cast("long"), F.expr("shiftright(block, level + 1)")))
    apart = split.where((F.col("side") < 0) | (F.col("side") == half)).select("ident", "set", node.alias("g"), half.alias("side"), "r")
    return out + _counts(apart, orders, leaf, kinds, first + 1)


def majorities(votes: DataFrame, voters: list[str], leaf: int | None = None) -> DataFrame:
    """(ident, wins, losses): how many items most voters place behind an item, and before it.

    votes (voter, ident, rank) have at most one rank for each voter and item and no rank twice with a voter (refused
    otherwise). A voter that leaves out an item has no say in its pairs; a majority is of all voters. The number of
    voters is small: there are as many counts as sets of a majority of them.
    """
    ship(votes.sparkSession.sparkContext)
    leaf = leaf or LEAF
    least = len(voters) // 2 + 1
    votes = votes.where(F.col("voter").isin(voters))
    again = votes.groupBy("voter", "rank").count().where("count > 1").limit(1).count() + votes.groupBy("voter", "ident").count().where("count > 1").limit(1).count()
    if again:
        raise ValueError("a voter gives a rank, or ranks an item, more than once")
    wide = votes.groupBy("ident").pivot("voter", voters).agg(F.min("rank").cast("long"))
    kinds = dict(votes.dtypes)["ident"], votes.select("ident").limit(0).toArrow().schema.field(0).type
    parts, weight = [], {}
    for size in range(least, len(voters) + 1):
        sets = list(combinations(voters, size))
        rows = None
        for names in sets:
            weight[len(weight)] = (-1) ** (size - least) * comb(size - 1, least - 1)
            there = wide.where(" AND ".join(f"`{v}` IS NOT NULL" for v in names))
            own = there.select("ident", F.lit(len(weight) - 1).alias("set"), F.array(F.lit(len(weight) - 1).cast("long")).alias("g"), F.lit(-1).alias("side"), F.array(*[F.col(f"`{v}`") for v in names]).alias("r"))
            rows = own if rows is None else rows.union(own)
        if size == 1:
            of = ranks.numbered(rows.withColumn("__place", F.col("r")[0]), [F.col("__place").asc()], ["g"], "at", "n")
            parts.append(of.select("ident", "set", (F.col("n") - F.col("at")).alias("above"), (F.col("at") - 1).alias("below")))
        else:
            parts += _counts(rows, size, leaf, kinds)
    by = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])[F.col("set")]
    every = votes.select("ident", F.lit(0).alias("set"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("below"))
    for part in parts:
        every = every.union(part)
    return every.groupBy("ident").agg(F.sum(by * F.col("above")).alias("wins"), F.sum(by * F.col("below")).alias("losses"))
