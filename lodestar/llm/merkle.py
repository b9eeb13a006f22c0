"""Merkle manifest of a dataset, built by superblocks.

Each row is a leaf: the hash of its fields, each with its length. The leaves of a source, in order of id, are folded in
runs of FANOUT into a subroot; the subroots, in order of source, into the root. Indices are bucketed by
FANOUT ** LEVELS: one call of applyInPandas collapses LEVELS levels of a bucket, tells its root and, for each node in it,
the lower part of the proof. The buckets' roots are nodes of the next round, until each source has one; a round makes
the table FANOUT ** LEVELS times smaller. Proofs are put together on the way back: a node's part before its bucket's.

Numbers within a source come from `ranks.numbered`, so a source with a third of all rows is sorted by many tasks, and a
bucket never has more than FANOUT ** LEVELS rows. Texts are hashed where they are read and aren't shuffled.

A proof is kept as bytes: for each level one byte, place in the run times 16 plus length of the run, then the digests of
the run's other nodes.

Defined results: a null field is hashed as `-`; a null source is a group of its own and comes first; null ids come first
in their source; rows that repeat an id are leaves of their own, ordered by their leaf; equal rows have equal leaves and
places next to each other. A null id counts as the empty text where its crc32 is asked for. A source with one row has its
leaf as subroot and no siblings below it. An empty table has no rows and no root. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import ranks

from . import common

#: Nodes of a run (at most 15), and levels that one call collapses: 729 nodes in a bucket.
FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """The digest of fields, 32 bytes: `-` for a null, else the bytes of its text, a colon, the text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def collapse(nodes: list[str], total: int, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[str, list[bytes]]:
    """The root of a bucket of a level with total nodes, and each node's proof within it. Folds levels times, or until the level is one node."""
    paths = [bytearray() for _ in nodes]
    level = 0
    while level < levels and total > 1:
        above = []
        heads = []
        for s in range(0, len(nodes), fanout):
            run = nodes[s : s + fanout]
            above.append(node_hash(run))
            raw = [bytes.fromhex(x) for x in run]
            heads += [bytes([k << 4 | len(run)]) + b"".join(raw[:k] + raw[k + 1 :]) for k in range(len(run))]
        for k, path in enumerate(paths):
            path += heads[k // fanout**level]
        nodes, total, level = above, -(-total // fanout), level + 1
    return nodes[0], [bytes(p) for p in paths]


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    while at < len(path):
        place, size = path[at] >> 4, path[at] & 15
        run = [path[k : k + 32].hex() for k in range(at + 1, at + 1 + 32 * (size - 1), 32)]
        run.insert(place, leaf)
        leaf, at = node_hash(run), at + 1 + 32 * (size - 1)
    return leaf


def siblings(path: bytes) -> list[str]:
    """The digests in a proof, from the leaf's run to the root's."""
    out, at = [], 0
    while at < len(path):
        end = at + 1 + 32 * ((path[at] & 15) - 1)
        out += [path[k : k + 32].hex() for k in range(at + 1, end, 32)]
        at = end
    return out


def _round(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """nodes (group, idx, n, node, ...) with path, their proof in their bucket, and above, its root; staged."""
    width = fanout**levels

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        root, paths = collapse([x.hex() for x in frame["node"]], int(frame["n"].iloc[0]), fanout, levels)
        return frame.drop(columns="bucket").assign(path=paths, above=bytes.fromhex(root))

    keyed = nodes.withColumn("bucket", F.expr(f"idx div {width}"))
    return common.materialize(keyed.groupBy(group, "bucket").applyInPandas(bucket, _schema(nodes)), "superblocks")


def _schema(nodes: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", path binary, above binary"


def _tree(nodes: DataFrame, group: str, most: int, fanout: int, levels: int) -> DataFrame:
    """nodes (group, idx, n, node, ...), idx from 0, with path, their whole proof in their group, and root, the group's.

    most: the nodes of the largest group, which says how many rounds there are.
    """
    width, made, now = fanout**levels, [], nodes
    while True:
        made.append(_round(now, group, fanout, levels))
        if most <= width:
            break
        now = made[-1].where(F.col("idx") % width == 0).select(group, F.expr(f"idx div {width} AS idx"), F.expr(f"(n + {width - 1}) div {width} AS n"), F.col("above").alias("node"))
        most = -(-most // width)
    upper = None
    for level in reversed(made):
        if upper is None:
            upper = level.withColumnRenamed("above", "root")
            continue
        over = upper.select(F.col(group).alias("__group"), F.col("idx").alias("__idx"), F.col("path").alias("__path"), "root")
        met = level.join(over, level[group].eqNullSafe(F.col("__group")) & (F.expr(f"idx div {width}") == F.col("__idx")))
        upper = met.withColumn("path", F.concat("path", "__path")).drop("__group", "__idx", "__path", "above")
    return upper


def build(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of leaves (source, doc_id, leaf, ...): their columns, path (the proof to the root), subroot and root."""
    common.small_batches(leaves.sparkSession, 10_000)
    placed = ranks.numbered(leaves.withColumnRenamed("leaf", "node"), [F.col("doc_id").asc_nulls_first(), F.col("node").asc()], ["source"], "idx", "n")
    placed = common.materialize(placed.withColumn("idx", F.col("idx") - 1), "leaves")
    most = placed.agg(F.max("n")).first()[0] or 0
    below = _tree(placed, "source", most, fanout, levels)
    tops = below.where("idx = 0").select("source", F.col("root").alias("node"))
    tops = ranks.numbered(tops, [F.col("source").asc_nulls_first()], [], "idx", "n")
    tops = common.materialize(tops.select(F.lit(0).alias("all"), "source", F.col("idx") - 1, "n", "node").toDF("all", "source", "idx", "n", "node"), "subroots")
    above = _tree(tops, "all", tops.count(), fanout, levels)
    return _with_sources(below, above, fanout**levels)


def _with_sources(below: DataFrame, above: DataFrame, width: int) -> DataFrame:
    over = above.select(F.col("source").alias("__source"), F.col("path").alias("__path"), F.col("root").alias("__root"))
    # A source's part of the proof meets the source's leaves by bucket, so that a source with a third of the rows is dealt out.
    heads = below.where(f"idx % {width} = 0").select("source", F.expr(f"idx div {width} AS bucket"))
    dealt = heads.join(over, F.col("source").eqNullSafe(F.col("__source"))).select(F.col("bucket").alias("__bucket"), "__source", "__path", "__root")
    met = below.join(dealt, F.col("source").eqNullSafe(F.col("__source")) & (F.expr(f"idx div {width}") == F.col("__bucket")))
    out = met.withColumn("path", F.concat("path", "__path")).withColumnRenamed("root", "subroot").withColumnRenamed("__root", "root")
    return out.drop("__source", "__path", "__bucket", "idx", "n").withColumnRenamed("node", "leaf")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *kept, now, path = [b.column(i).to_pylist() for i in range(b.num_columns)]
        ident, leaf, subroot, root = kept
        hexed = [[x.hex() for x in c] for c in (leaf, subroot, root)]
        proofs = [node_hash(siblings(p)) for p in path]
        folded = [fold(x.hex(), p) for x, p in zip(now, path)]
        same = [f == r for f, r in zip(folded, hexed[2])]
        cols = [pa.array(ident, pa.int64()), *[pa.array(c, pa.string()) for c in (*hexed, proofs, folded)], pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(manifest: DataFrame, now: str) -> DataFrame:
    """Folds the digests in column now, the leaves as they are found, with the manifest's proofs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = manifest.select(F.col("doc_id").cast("long"), "leaf", "subroot", "root", now, "path")
    return rows.mapInArrow(_folded, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    cut = F.when(common.crc_mod(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select(F.col("source").cast("string"), F.col("doc_id").cast("long"), leaf_hash(fields).alias("leaf"), leaf_hash([*fields[:-1], cut]).alias("found"))
    return verify(build(leaves), "found")


def _oracle(deep: int = 16, wide: int = 6) -> str:
    """Both trees level by level: deep levels for leaves, wide for sources."""

    def tree(name: str, group: str, levels: int) -> list[str]:
        out = []
        for k in range(levels):
            out.append(
                f"{name}{k + 1} AS (SELECT {group}, idx // 3 AS idx, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node, list(node ORDER BY idx) AS run FROM {name}{k} GROUP BY {group}, idx // 3)"
            )
        return out

    def climb(name: str, tree_name: str, group: str, levels: int, cols: str) -> list[str]:
        out = []
        for k in range(levels):
            before, after = f"array_to_string(run[1 : (p.idx % 3)::INT], '')", f"array_to_string(run[(p.idx % 3)::INT + 2 : 3], '')"
            alone = "p.n = 1"
            out.append(
                f"{name}{k + 1} AS (SELECT {cols}, p.idx // 3 AS idx, (p.n + 2) // 3 AS n, CASE WHEN {alone} THEN proof ELSE concat(proof, {before}, {after}) END AS proof, "
                f"CASE WHEN {alone} THEN cur ELSE sha256(concat({before}, cur, {after})) END AS cur FROM {name}{k} p JOIN {tree_name}{k + 1} t ON p.{group} IS NOT DISTINCT FROM t.{group} AND p.idx // 3 = t.idx)"
            )
        return out

    def part(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode({c}::VARCHAR))::VARCHAR, ':', {c}::VARCHAR) END"

    fixed = ", ".join(part(c) for c in FIELDS[:-1])
    ctes = [
        "z AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text FROM documents)",
        f"l AS (SELECT r, doc_id, source, sha256(concat({fixed}, {part('text')})) AS leaf, CASE WHEN c.even THEN sha256(concat({fixed}, {part('cut')})) ELSE sha256(concat({fixed}, {part('text')})) END AS found FROM (SELECT *, replace(text, chr(10), '') AS cut, {_CRC_EVEN} AS even FROM z) c)",
        "t0 AS (SELECT r, source, doc_id, found, leaf AS node, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l)",
        *tree("t", "source", deep),
        f"s0 AS (SELECT 0 AS g, source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t{deep})",
        *tree("s", "g", wide),
        "p0 AS (SELECT r, source, idx, n, '' AS proof, found AS cur FROM t0)",
        *climb("p", "t", "source", deep, "p.r, p.source"),
        f"q0 AS (SELECT p{deep}.r, 0 AS g, s0.idx, s0.n, proof, cur FROM p{deep} JOIN s0 ON p{deep}.source IS NOT DISTINCT FROM s0.source)",
        *climb("q", "s", "g", wide, "p.r, p.g"),
    ]
    return f"WITH {', '.join(ctes)} SELECT t0.doc_id, t0.node AS leaf, t{deep}.node AS subroot, s{wide}.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = s{wide}.node AS verified FROM q{wide} JOIN t0 USING (r) JOIN t{deep} ON t0.source IS NOT DISTINCT FROM t{deep}.source, s{wide}"


#: crc32 bit by bit over the id's characters; its complement is even where the register is odd.
_CRC_EVEN = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
  lambda c: CASE WHEN c = '' THEN []::BIGINT[] ELSE [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) & 1 = 1"""
ORACLE = {"op13_merkle_manifest": _oracle()}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
