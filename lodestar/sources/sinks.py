"""Writers: one-file CSV with atomic replacement, JSON lines with sorted keys, tables of which the latest row counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import ranks


class _Store:
    """The file system that a path lives on, through Hadoop."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def move(self, source, target) -> None:
        """A rename that tells of failure: Hadoop's says so by its result."""
        if not self.fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")

    def replace(self, source, target) -> None:
        """Puts source in target's place; if that fails, what was there is put back."""
        old = self.path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.old")
        held = self.fs.exists(target)
        if held:
            self.move(target, old)
        try:
            self.move(source, target)
        except Exception:
            if held:
                self.move(old, target)
            raise
        if held:
            self.fs.delete(old, True)


def write_ranking(rows: DataFrame, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes a ranking (a report of bounded size) as one CSV file in rank order; a failure leaves what was there.

    Works on any store Hadoop reaches: a staging folder beside the target, then a rename. A check gets the rows as they
    read from the written file and gives those at fault: if there are any, nothing is published.
    """
    spark = rows.sparkSession
    store = _Store(spark, path)
    target = store.path(path)
    staging = store.path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        rows.orderBy("rank").coalesce(1).write.csv(staging.toString(), header=True, escape='"')
        part = next(s.getPath() for s in store.fs.listStatus(staging) if s.getPath().getName().startswith("part-"))
        if check is not None:
            faults = check(spark.read.schema(rows.schema).csv(part.toString(), header=True, escape='"')).limit(5).collect()
            if faults:
                raise ValueError(f"not published, at fault: {[f.asDict() for f in faults]}")
        store.replace(part, target)
    finally:
        store.fs.delete(staging, True)


def write_report(tables: dict[str, DataFrame], path: str, title: str, most: int = 1000) -> None:
    """Writes small tables as one Markdown file; a table of more than `most` rows is refused."""
    lines = [f"# {title}"]
    for name, table in tables.items():
        found = table.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has over {most} rows, too many for a report")
        cell = lambda x: "" if x is None else str(x).replace("|", r"\|").replace("\n", " ")
        lines += ["", f"## {name}", "", f"| {' | '.join(table.columns)} |", "|" + "-|" * len(table.columns)]
        lines += [f"| {' | '.join(map(cell, r))} |" for r in found]
    spark = next(iter(tables.values())).sparkSession
    store = _Store(spark, path)
    target = store.path(path)
    draft = store.path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.fs.create(draft)
    try:
        out.write(bytearray("\n".join([*lines, ""]).encode()))
    finally:
        out.close()
    store.replace(draft, target)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of states; nothing is changed in place."""
    rows.write.mode("append").parquet(path)


def latest(states: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key: an upsert's or update's view of appended rows."""
    columns = [c for c in states.columns if c != key]
    best = F.max_by(F.struct(*columns), F.struct(time, *[c for c in columns if c != time]))
    return states.groupBy(key).agg(best.alias("s")).select(key, "s.*")


def oldest(states: DataFrame, order: str, n: int) -> DataFrame:
    """All rows but the n oldest."""
    return ranks.numbered(states, [F.col(order).asc()], name="__n").where(F.col("__n") > n).drop("__n")
