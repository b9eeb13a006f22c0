"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made per document; equal ones are one node of the link graph. Two fingerprints that differ in at most
3 of 64 bits agree in at least one of four 16-bit blocks, so each distinct fingerprint goes to four (block, value)
buckets and every linked pair meets in one. In a task, a bucket's fingerprints are sorted by Gray rank and built into
a tree: a node keeps the bits on which all below it agree, its mask without its parent's. A query walks down with the
differences met so far, masked bit by masked bit, and a whole group is left out once they exceed the limit, or once it
is in the query's component already. What leaves a bucket is a spanning forest, never its pairs. Components of the
forests' edges come from alternating star steps on DataFrames. A bucket larger than BLOCK is indexed as several trees
of which each pair is walked, so memory is bounded and nothing is dropped.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other. Null
ids have a component with the smallest id that their fingerprint reaches, null if there is none. Rows that repeat an
id are given back each. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS, LIMIT, WORDS, SEED = 64, 3, 3, 42
#: Fan-out of the index, fingerprints in one tree, and (query, node) pairs held at once.
FAN, BLOCK, FRONT = 16, 1 << 16, 1 << 20


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # both keep to ASCII, as the contract does
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    if n == 1:
        h = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(whole[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist())]
    bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("simhash")
    for batch in batches:
        fps = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["ident", "content", "fp"])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code word in the order of the Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (pattern, own mask) over fingerprints in Gray order; level 0 holds the fingerprints."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        agree = [(self.fps, np.full(len(fps), ~np.uint64(0)))]
        while len(agree[-1][0]) > FAN:
            pattern, mask = agree[-1]
            at = np.arange(0, len(pattern), FAN)
            differ = np.bitwise_or.reduceat((pattern ^ np.repeat(pattern[at], FAN)[: len(pattern)]) | ~mask, at)
            agree.append((pattern[at] & ~differ, ~differ))
        self.levels = []
        for k, (pattern, mask) in enumerate(agree):
            above = np.repeat(agree[k + 1][1], FAN)[: len(mask)] if k + 1 < len(agree) else np.zeros(len(mask), np.uint64)
            self.levels.append((pattern, mask & ~above))

    def spans(self, level: int, labels: np.ndarray) -> np.ndarray:
        """The one label below each node of the level, or -1."""
        at = np.arange(0, len(labels), FAN**level)
        low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
        return np.where(low == high, low, -1)


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _flat(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up
    return parent


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges between distinct fingerprints that span each of their components under LIMIT differing bits."""
    blocks = [GrayIndex(fps[i : i + BLOCK]) for i in range(0, len(fps), BLOCK)]
    base = np.cumsum([0, *(len(b.fps) for b in blocks)])
    every = np.concatenate([b.fps for b in blocks])
    parent = np.arange(len(every))
    edges = []

    def walk(index: GrayIndex, at: int, queries: np.ndarray) -> None:
        """Links queries, as places in every, with the index that starts at place at."""
        labels = _flat(parent)
        under = [index.spans(k, labels[at : at + len(index.fps)]) for k in range(len(index.levels))]
        top = len(index.levels) - 1
        n = len(index.levels[top][0])
        todo = [(top, np.repeat(queries, n), np.tile(np.arange(n), len(queries)), np.zeros(n * len(queries), np.int64))]
        while todo:
            level, q, node, far = todo.pop()
            if len(q) > FRONT:
                todo += [(level, q[i : i + FRONT], node[i : i + FRONT], far[i : i + FRONT]) for i in range(0, len(q), FRONT)]
                continue
            pattern, mask = index.levels[level]
            far = far + np.bitwise_count((every[q] ^ pattern[node]) & mask[node])
            ok = (far <= LIMIT) & (under[level][node] != labels[q])
            q, node, far = q[ok], node[ok], far[ok]
            if level:
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = child < len(index.levels[level - 1][0])
                todo.append((level - 1, np.repeat(q, FAN)[inside], child[inside], np.repeat(far, FAN)[inside]))
                continue
            for a, b in zip(q.tolist(), (node + at).tolist()):
                x, y = _root(parent, a), _root(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((every[a], every[b]))

    for k, index in enumerate(blocks):
        for start in range(0, int(base[k + 1]), 1024):  # labels are renewed for each run of queries
            walk(index, int(base[k]), np.arange(start, min(start + 1024, int(base[k + 1]))))
    return edges


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for block in range(4):
            key = (fp.view(np.uint64) >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64) | block << 16
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["bucket", "fp"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket."""
    common.tenant("simhash")

    def done(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        fps = np.concatenate(parts).view(np.uint64) if parts else np.empty(0, np.uint64)
        return forest(fps) if len(fps) > 1 else []

    def out(edges: list) -> pa.RecordBatch:
        e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    bucket, parts, edges = None, [], []
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if j > i:
                if keys[i] != bucket:
                    edges += done(parts)
                    bucket, parts = keys[i], []
                parts.append(fps[i:j])
        if len(edges) > 1 << 16:
            yield out(edges)
            edges = []
    yield out(edges + done(parts))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint, component_id (the smallest id reachable); also component, the same for all rows linked, and content, a hash of the text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    prints = common.materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).mapInArrow(_fingerprints, "ident long, content long, fp long"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("ident").alias("least"))
    common.small_batches(spark, 10_000)
    edges = nodes.select("fp").mapInArrow(_spread, "bucket long, fp long").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link, "a long, b long")
    roots = common.components(edges)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = prints.join(rooted.join(heads, "root").select("fp", "component_id", F.col("root").alias("component")), "fp")
    return found.select(F.col("ident").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", "content")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
