"""Nearest neighbours by an inverted file of cells.

Centres are fitted (spherical k-means) on at most about SAMPLE rows, chosen by hash; every row belongs to the cell of its
nearest centre, and a row asks the cells whose centres are nearest to it. How many it asks is measured: for ASKED rows
the true neighbours among all rows are found in one pass, and the least number of cells that holds `recall` of them is
taken. Cells that lie together form blocks of BLOCK rows (a larger cell is split by hash), and a row goes once to each
block that holds a cell it asks, in groups of GROUP rows. So rows that ask few cells travel little, and no group grows
with the table. Scores are products in single precision; those that can be among the best are worked out again in double.

How much that saves depends on the vectors: where they cluster, a row asks a few cells however many rows there are; where
they have no structure, neighbours lie in many cells and a large share of them must be asked for a recall of 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.staging import ship, staged

#: Rows that centres are fitted on, rows of a cell, cells at most, rows whose neighbours are looked up to find how many cells to ask.
SAMPLE, CELL, CELLS, ASKED = 20_000, 50, 4096, 256
#: Rows compared with all centres at once, bytes of a batch that tasks give on, and products held at once.
ROWS, GIVEN, PRODUCTS = 512, 8 << 20, 1 << 20
#: Rows of a block, rows of a group that asks it, and what a group keeps beyond k for rounding.
BLOCK, GROUP, SPARE = 32_768, 8192, 8


def unit(column: pa.Array, dtype: type = np.float32) -> np.ndarray:
    """Vectors of a list column, of length one; a zero vector stays."""
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(dtype)


def centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors that rows of the sample are near to; starts from evenly spaced rows."""
    out = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ out.T).argmax(1)
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        mean = np.add.reduceat(sample[order], starts, axis=0)
        out[used] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-30)
    return out


def blocks(middle: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """For each cell the blocks it is in: cells are halved across their widest direction until a part has at most so many rows."""
    out: list[list[int]] = [[] for _ in sizes]
    todo, made = [np.arange(len(sizes))], 0
    while todo:
        part = todo.pop()
        total = int(sizes[part].sum())
        if total <= most or len(part) == 1:
            pieces = max(1, -(-total // most))
            for c in part:
                out[c] = list(range(made, made + pieces))
            made += pieces
            continue
        spread = middle[part] - middle[part].mean(0)
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
        part = part[np.argsort(spread @ axis, kind="stable")]
        cut = int(np.searchsorted(np.cumsum(sizes[part]), total / 2)) + 1
        cut = min(max(cut, 1), len(part) - 1)
        todo += [part[:cut], part[cut:]]
    return out


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, none empty: what a task makes of one is bounded, however many cells and blocks there are."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def _vectors(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1)


def _binary(v: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(v, np.float32)], pa.binary())


def _best(row: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the keep best scores of each row, rows in order, best first."""
    order = np.argsort(row * 4.0 - score, kind="stable")
    ordered = row[order]
    first = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - first < keep]


def _assigned(middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, ROWS):
            v = unit(b.column(1))
            there = v.any(1)
            if there.any():
                v = v[there]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(there)), pa.array((v @ middle.T).argmax(1), pa.int32()), _binary(v)], names=["ident", "cell", "v"])

    return run


def _true_cells(asked: np.ndarray, own: list, k: int):
    """The k rows nearest to each asked row among a task's, with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, int), np.empty(0, np.int32), np.empty(0, np.float32))
        for b in batches:
            if not b.num_rows:
                continue
            score = asked @ _vectors(b.column(2)).T
            ids = b.column(0).to_pylist()
            at = {x: k for k, x in enumerate(ids)}
            for i, x in enumerate(own):
                if x in at:
                    score[i, at[x]] = -np.inf
            keep = min(k, score.shape[1])
            near = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            cells = b.column(1).to_numpy()
            rows = np.repeat(np.arange(len(asked)), keep)
            both = [np.concatenate(x) for x in zip(held, (rows, cells[near.ravel()], np.take_along_axis(score, near, 1).ravel()))]
            best = _best(both[0], both[2], k)
            held = tuple(x[best] for x in both)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1], pa.int32()), pa.array(held[2], pa.float32())], names=["asked", "cell", "score"])

    return run


def _probed(v: np.ndarray, middle: np.ndarray, probes: int) -> np.ndarray:
    score = v @ middle.T
    if probes >= len(middle):
        return np.broadcast_to(np.arange(len(middle)), score.shape)
    return np.argpartition(-score, probes - 1, axis=1)[:, :probes]


def _reached(v: np.ndarray, middle: np.ndarray, probes: int, where: list[list[int]], made: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that rows ask (rows by cells, as booleans), and the blocks that hold them (rows by blocks)."""
    asks = np.zeros((len(v), len(middle)), bool)
    np.put_along_axis(asks, _probed(v, middle, probes), True, 1)
    holds = np.zeros((len(middle), made), np.float32)
    for c, own in enumerate(where):
        holds[c, own] = 1
    return asks, asks.astype(np.float32) @ holds > 0


def _counted(middle: np.ndarray, probes: int, where: list[list[int]], made: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(made, np.int64)
        for b in _few(batches, ROWS):
            n += _reached(_vectors(b.column(2)), middle, probes, where, made)[1].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(made), pa.int32()), pa.array(n)], names=["block", "n"])

    return run


def _asking(middle: np.ndarray, probes: int, where: list[list[int]], made: int, parts: np.ndarray):
    """A row for each block that a row reaches, with the cells it asks there as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, ROWS):
            asks, reach = _reached(_vectors(b.column(2)), middle, probes, where, made)
            bits = np.packbits(asks, axis=1)
            every, bits = np.nonzero(reach), pa.array([x.tobytes() for x in bits], pa.binary())
            step = max(1, GIVEN * len(asks) // (b.nbytes + bits.nbytes + 1))
            for start in range(0, len(every[0]), step):
                row, block = (x[start : start + step] for x in every)
                part = b.column(3).to_numpy()[row] % parts[block]
                take = pa.array(row)
                cols = [pa.array(block, pa.int32()), pa.array(part, pa.int32()), b.column(0).take(take), b.column(2).take(take), bits.take(take)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "part", "ident", "v", "asks"])

    return run


def _held(where: list[list[int]], parts: np.ndarray):
    """A row for each group of askers that may ask a row's block."""
    many, first = np.array([len(x) for x in where]), np.array([x[0] for x in where])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, ROWS):
            cell = b.column(1).to_numpy()
            block = first[cell] + b.column(3).to_numpy() % many[cell]
            rows = np.repeat(np.arange(len(cell)), parts[block])
            every = np.arange(len(rows)) - np.repeat(np.cumsum(parts[block]) - parts[block], parts[block])
            step = max(1, GIVEN * len(cell) // (b.nbytes + 1))
            for start in range(0, len(rows), step):
                row, part = rows[start : start + step], every[start : start + step]
                take = pa.array(row)
                cols = [pa.array(block[row], pa.int32()), pa.array(part, pa.int32()), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "part", "ident", "cell", "v"])

    return run


def _met(k: int, cells: int, kind: pa.DataType):
    """The k rows of a block nearest to each row of a group among those in the cells it asks."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        names = ["ident", "other", "likeness"]
        if not asking.num_rows or not held.num_rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names=names)
        held = held.sort_by([("cell", "ascending"), ("ident", "ascending")])
        q, m = _vectors(asking["v"].combine_chunks()), _vectors(held["v"].combine_chunks())
        bits = np.frombuffer(b"".join(asking["asks"].to_pylist()), np.uint8).reshape(len(q), -1)
        asks = np.unpackbits(bits, axis=1, count=cells).astype(bool)
        cell = held["cell"].to_numpy()
        edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        least = np.full(len(q), -np.inf, np.float32)
        rows: list = []
        seen = 0

        def fewer() -> list:
            row, other, score = (np.concatenate(x) for x in zip(*rows))
            best = _best(row, score, k + SPARE)
            row, other, score = row[best], other[best], score[best]
            full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k + SPARE)
            last = np.searchsorted(row, full, "right") - 1
            least[full] = score[last]
            return [(row, other, score)]

        for start, stop in zip(edges[:-1], edges[1:]):
            who = np.flatnonzero(asks[:, cell[start]])
            if not len(who):
                continue
            step = max(1, PRODUCTS // len(who))
            for low in range(start, stop, step):  # a cell grows with the table, what is held at once doesn't
                score = q[who] @ m[low : min(low + step, stop)].T
                i, j = np.nonzero(score > least[who][:, None])  # of equal ones the first, which have the smaller ids
                rows.append((who[i], low + j, score[i, j]))
                seen += len(i)
                if seen > PRODUCTS + len(q) * (k + SPARE):
                    rows = fewer()
                    seen = len(rows[0][0])
        if not rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names=names)
        row, other, _ = fewer()[0]
        one, two = asking["ident"].combine_chunks().take(pa.array(row)), held["ident"].combine_chunks().take(pa.array(other))
        likeness = np.round(np.einsum("ij,ij->i", q[row].astype(float), m[other].astype(float)), 9)
        apart = np.array([a != b for a, b in zip(one.to_pylist(), two.to_pylist())], bool)
        row, likeness = row[apart], likeness[apart]
        best = _best(row, likeness, k)
        return pa.table([one, two], names=names[:2]).filter(pa.array(apart)).append_column(names[2], pa.array(likeness)).take(pa.array(best))

    return run


def nearest_indexed(items: DataFrame, k: int = 10, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """(ident, other, likeness, place): k of the items most like each, by cosine, ties by id.

    Items (ident, vector) have ids of their own; a null or zero vector has no neighbours and is nobody's. probes is the
    number of cells asked; if it isn't given, as many as hold `recall` of the true neighbours of a bounded number of rows.
    Of equal vectors the k + 1 smallest ids take part: further copies are nobody's neighbours, and their own are the first k.
    """
    spark = items.sparkSession
    ship(spark.sparkContext)
    kind = dict(items.dtypes)["ident"]
    rows = items.where("vector IS NOT NULL AND ident IS NOT NULL").select("ident", F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"ident {kind}, other {kind}, likeness double, place int")
    drawn = rows.where(F.pmod(F.xxhash64("ident"), F.lit(-(-n // SAMPLE))) == 0).select("vector").toArrow()["vector"].combine_chunks()
    drawn = unit(drawn) if len(drawn) else unit(rows.select("vector").limit(1).toArrow()["vector"].combine_chunks())
    middle = centres(drawn, min(CELLS, max(1, n // CELL), len(drawn)))
    index = staged(rows.mapInArrow(_assigned(middle), f"ident {kind}, cell int, v binary"), "cells")
    if probes is None:
        asked = index.orderBy(F.xxhash64("ident")).select("ident", "v").limit(ASKED).toArrow()
        vectors = _vectors(asked["v"].combine_chunks())
        true = index.mapInArrow(_true_cells(vectors, asked["ident"].to_pylist(), k), "asked int, cell int, score float")
        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "cell"))
        found = true.withColumn("p", place).where(F.col("p") <= k).select("asked", "cell").toArrow()
        order = np.argsort(np.argsort(-(vectors @ middle.T), axis=1, kind="stable"), axis=1)
        needed = order[found["asked"].to_numpy(), found["cell"].to_numpy()]
        probes = int(np.quantile(needed, recall, method="higher")) + 1 if len(needed) else 1
    copy = F.row_number().over(Window.partitionBy("v").orderBy("ident"))
    every, index = index, staged(index.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    sizes = np.zeros(len(middle), np.int64)
    for r in index.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    where = blocks(middle, sizes, BLOCK)
    made = max(max(x) for x in where) + 1
    reached = index.mapInArrow(_counted(middle, probes, where, made), "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))
    parts = np.ones(made, np.int64)
    for r in reached.collect():
        parts[r["block"]] = max(1, -(-r["n"] // GROUP))
    salted = index.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(1 << 30)))
    asking = salted.mapInArrow(_asking(middle, probes, where, made, parts), f"block int, part int, ident {kind}, v binary, asks binary")
    held = salted.mapInArrow(_held(where, parts), f"block int, part int, ident {kind}, cell int, v binary")
    arrow = index.select("ident").limit(0).toArrow().schema.field(0).type
    met = asking.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_met(k, len(middle), arrow), f"ident {kind}, other {kind}, likeness double")
    place = F.row_number().over(Window.partitionBy("ident").orderBy(F.desc("likeness"), "other"))
    near = met.withColumn("place", place).where(F.col("place") <= k)
    crowded = index.groupBy("v").agg(F.array_sort(F.collect_list("ident")).alias("ids")).where(F.size("ids") == k + 1)
    more = every.join(crowded, "v").where(F.col("ident") > F.col("ids")[k])
    return near.union(more.select("ident", F.posexplode(F.slice("ids", 1, k)).alias("p", "other")).select("ident", "other", F.lit(1.0), F.col("p") + 1))
