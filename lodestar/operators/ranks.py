"""Exact numbers of rows and running sums in a total order, by many tasks.

A window without a partition puts all rows into one task, one with a hot partition a third of them. Here rows are dealt
by ranges of the order instead: each task sorts one range, a small table of counts by range gives what comes before a
range, and a row's number is its place in the range plus that. Rows that tie are dealt by their place in the input, so
a value that a third of the rows share is split as well.

The order's ties are broken by the input's layout; name enough columns in it where that matters. The input should be a
file or a staged table, whose rows come in the same order if a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.staging import staged

_PLACE = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition


def ranged(df: DataFrame, order: list[Column], by: list[str] = ()) -> DataFrame:
    """df staged in ranges of (by, order), with __range and __place: the number of a row's range, and its place there."""
    keys = [F.col(c) for c in by] + list(order)
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").withColumn("__at", F.monotonically_increasing_id())
    at = F.col("__at")
    return staged(dealt.withColumns({"__range": F.shiftright(at, 33).cast("int"), "__place": at.bitwiseAND(F.lit(_PLACE))}).drop("__tie", "__at"), "ranges")


def _before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """By (by, __range): the first place, sums over earlier ranges (before_<name>) and over all (all_<name>). As many rows as ranges and groups."""
    parts = rows.groupBy(*by, "__range").agg(F.min("__place").alias("__first"), *[F.sum(v).alias(k) for k, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return parts.select(
        *[F.col(c).alias(f"__of_{c}") for c in by], F.col("__range").alias("__of"), "__first",
        *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in sums],
        *[F.sum(k).over(whole).alias(f"all_{k}") for k in sums],
    )


def _joined(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    same = F.col("__range") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(parts, same)


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "row_number", size: str | None = None) -> DataFrame:
    """df with the number of each row from 1 on, in each group of by; with size, also with the rows of its group."""
    by = list(by)
    rows = ranged(df, order, by)
    parts = _before(rows, by, {"__n": F.lit(1)})
    out = _joined(rows, parts, by).withColumn(name, F.col("before___n") + F.col("__place") - F.col("__first") + 1)
    if size:
        out = out.withColumn(size, F.col("all___n"))
    return out.select(*df.columns, name, *[size] * bool(size))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = (), whole: bool = False) -> DataFrame:
    """df with running sums up to and including each row, in each group of by: a column for each name in sums, and row_number; with whole, also the group's sums as all_<name>."""
    by = list(by)
    rows = ranged(df.withColumns({f"__{k}": v for k, v in sums.items()}), order, by)
    values = {f"__{k}": F.col(f"__{k}") for k in sums}
    parts = _before(rows, by, {"__n": F.lit(1)} | values)
    upto = Window.partitionBy("__range", *by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__upto_{k}": F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)) for k in sums})
    out = _joined(local, parts, by).withColumn("row_number", F.col("before___n") + F.col("__place") - F.col("__first") + 1)
    out = out.withColumns({k: F.col(f"before___{k}") + F.col(f"__upto_{k}") for k in sums})
    if whole:
        out = out.withColumns({f"all_{k}": F.col(f"all___{k}") for k in sums})
    return out.select(*df.columns, "row_number", *sums, *[f"all_{k}" for k in sums] * whole)
