"""What the corpus operators share: reading, materialising, graph components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.staging import ship, staged

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: int | None = None) -> None:
    """Bounds the rows of an Arrow batch, and its bytes where size is given, and so a Python worker's memory when texts are long; sends the package to executors."""
    ship(spark.sparkContext)
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_caches: dict[str, list] = {}
_tenant = ""


def tenant(name: str, *caches: dict) -> None:
    """Called by a task of an operator: caches that other operators' tasks left in this worker process are emptied.

    Workers live on from stage to stage, and what one stage remembers would take the memory of the next.
    """
    global _tenant
    if name != _tenant:
        for other, held in _caches.items():
            if other != name:
                for cache in held:
                    cache.clear()
        _tenant = name
    if caches:
        _caches[name] = list(caches)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    return staged(df, name)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of docs: as given, with as many underscores before them as it takes."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


#: Bits of a bitmap that spares rows a join.
SPARED = 1 << 23


def parted(df: DataFrame, code: str, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose code (a column of longs) may be among codes (a column named code), and those that surely have no match.

    A bitmap of at most SPARED bits is broadcast. It only spares rows a join: where it is full, all rows go the first way.
    """
    place, held = free(df, "__at", "__bits")
    at = lambda c: F.shiftright(F.expr(f"{c} & {SPARED - 1}"), 6)
    bits = codes.groupBy(at("code").alias(place)).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 AS int))")).alias(held))
    marked = df.join(F.broadcast(bits), at(code) == F.col(place), "left")
    hit = F.expr(f"coalesce(shiftright({held}, cast({code} & 63 AS int)) & 1, 0) = 1")
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


#: Parts that a node's neighbours are dealt into.
SALT = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of their u. A node's edges meet in SALT parts, of which each tells its least."""
    keyed = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    parts = keyed.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.select("u", "s").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u")
    return keyed.join(least, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs, by alternating large-star and small-star steps.

    Returns (node, root), root the smallest node reachable. A step takes minima with map-side combining and joins them
    back by parts of a node's edges, so no neighbour list is ever collected; each step is written to the shared folder.
    """
    edges = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        large = _with_least(both).selectExpr("u", "v", "least(u, m) AS m").where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        stars = _with_least(large)
        edges = stars.where("v <> m").selectExpr("v AS u", "m AS v").union(stars.selectExpr("u", "m AS v"))
        edges = materialize(edges.distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.selectExpr("u AS node", "v AS root")
        before = now


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
