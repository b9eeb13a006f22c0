"""Exact dedup by Patricia-trie owners.

Texts are partitioned by length class (LENGTHS bytes wide) and content hash. Each task inserts the full byte strings
of its rows into compressed radix tries, one for each length class; a terminal node stores the smallest identifier and
the number of rows, and equality is the trie's verdict alone. A task first builds tries over what it reads, so a text
with any number of copies leaves it once; where they hold more than BUDGET bytes the largest tries are written out.
The terminals then meet by length class and hash bits, in order of their bytes: a subtree is complete once the order
has passed it, and complete subtrees are spilled as soon as a trie holds BUDGET bytes. The hash bits deal a class,
however many rows it has, over all tasks; the SHA-256 names a terminal in the join that gives each row its owner.

Defined results: a null text counts as empty, and empty texts equal each other. A null id is larger than any other
and owns a group only if all its ids are null. Rows that repeat an id are rows of their own: they count in
group_size, and all rows that carry keep_id are marked as kept. An empty table gives an empty result. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text that a task's tries hold before subtrees are written out, and the width of a length class.
BUDGET, LENGTHS = 24 << 20, 256
#: What a terminal costs besides its bytes.
_NODE = 512
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")

Own = list  # smallest id, rows, bytes, digest


class Patricia:
    """A compressed radix trie over byte strings."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.held = 0

    def insert(self, key: bytes, ident: int | None, rows: int, digest: bytes = b"") -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
            edge = child[0]
            if not key.startswith(edge, at):
                low, high = 1, min(len(edge), len(key) - at)  # the first low bytes agree
                while low < high:
                    mid = (low + high + 1) // 2
                    if key.startswith(edge[:mid], at):
                        low = mid
                    else:
                        high = mid - 1
                upper = [edge[:low], {edge[low]: child}, None]
                child[0] = edge[low:]
                node[1][key[at]] = child = upper
            node, at = child, at + len(child[0])
        own = node[2]
        if own is None:
            node[2] = [ident, rows, len(key), digest]
            self.held += len(key) + _NODE
            return
        if ident is not None and (own[0] is None or ident < own[0]):
            own[0] = ident
        own[1] += rows

    def terminals(self) -> Iterator[tuple[bytes, Own]]:
        todo = [(b"", self.root)]
        while todo:
            prefix, (edge, children, own) = todo.pop()
            whole = prefix + edge
            if own is not None:
                yield whole, own
            todo.extend((whole, x) for x in children.values())

    def before(self, key: bytes) -> list[Own]:
        """Takes out all that doesn't begin with key and isn't reached any more if keys come in order: the subtrees left of its path."""
        out: list[Own] = []

        def take(node: list) -> None:
            todo = [node]
            while todo:
                _, children, own = todo.pop()
                if own is not None:
                    out.append(own)
                todo.extend(children.values())

        node, at = self.root, 0
        while node is not None and at < len(key):
            if node[2] is not None:
                out.append(node[2])
                node[2] = None
            onward = None
            for first, child in list(node[1].items()):
                if first == key[at] and key.startswith(child[0], at):
                    onward = child
                else:
                    take(child)
                    del node[1][first]
            if onward is not None:
                at += len(onward[0])
            node = onward
        self.held -= sum(own[2] + _NODE for own in out)
        return out

    def rest(self) -> list[Own]:
        return [own for _, own in self.terminals()]


_READ = pa.schema([("ident", pa.int64()), ("nbytes", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("body", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def _terminals(trie: Patricia) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for body, (ident, n, nbytes, sha) in trie.terminals():
        out.append((ident, nbytes, sha, n, body))
        held += nbytes + 64
        if held > 4 << 20:
            yield _batch(out, _READ)
            out, held = [], 0
    if out:
        yield _batch(out, _READ)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (ident, bytes): a row without body for each row read, and the terminals of the task's tries."""
    common.tenant("exact_dedup")
    tries: dict[int, Patricia] = {}
    for batch in batches:
        read = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = _SPACE.sub(b" ", text)
            sha = hashlib.sha256(body).digest()
            read.append((ident, len(body), sha, None, None))
            trie = tries.get(len(body) // LENGTHS)
            if trie is None:
                trie = tries[len(body) // LENGTHS] = Patricia()
            trie.insert(body, ident, 1, sha)
        if read:
            yield _batch(read, _READ)
        held = sum(t.held for t in tries.values())
        if held > BUDGET:
            for k in sorted(tries, key=lambda k: tries[k].held, reverse=True):
                trie = tries.pop(k)
                held -= trie.held
                yield from _terminals(trie)
                if held <= BUDGET // 2:
                    break
    for trie in tries.values():
        yield from _terminals(trie)


_OWNED = pa.schema([("nbytes", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, body, ident, n, sha) come in order of class and body."""
    common.tenant("exact_dedup")
    current, trie, out = None, Patricia(), []

    def owned(found: list[Own]) -> None:
        out.extend((nbytes, sha, ident, n) for ident, n, nbytes, sha in found)

    for batch in batches:
        for size, body, ident, n, sha in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size != current:
                owned(trie.rest())
                current, trie = size, Patricia()
            elif trie.held > BUDGET:
                owned(trie.before(body))
            trie.insert(body, ident, n, sha)
        if out:
            yield _batch(out, _OWNED)
            out.clear()
    owned(trie.rest())
    if out:
        yield _batch(out, _OWNED)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    read = common.materialize(rows.mapInArrow(_local, "ident long, nbytes long, sha binary, n long, body binary"), "exact")
    size = F.expr(f"nbytes div {LENGTHS}").alias("size")
    bits = F.conv(F.hex(F.expr("substring(sha, 1, 2)")), 16, 10).cast("int").alias("bits")
    met = read.where("body IS NOT NULL").select(size, "body", "ident", "n", "sha", bits).repartition("size", "bits")
    kept = met.drop("bits").sortWithinPartitions("size", "body").mapInArrow(_merge, "nbytes long, sha binary, keep_id long, group_size long")
    out = read.where("body IS NULL").select("ident", "nbytes", "sha").join(kept, ["nbytes", "sha"])
    return out.select(F.col("ident").alias("doc_id"), "keep_id", "group_size", F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(common.read(spark, sf_dir, "documents"))


ORACLE = {
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body"""
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
