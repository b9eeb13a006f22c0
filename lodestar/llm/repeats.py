"""Repeated passages by merging Burrows-Wheeler transforms of shards.

Two equal strings of LENGTH bytes have their least K-byte hash at the same place. Each run of windows that share that
place, their anchor, is a segment; equal windows are in segments of equal anchor hash, so only those with an anchor
hash met twice go on. Segments equal as a whole are counted together and known to be repeated. The segments left, one
of each content, are dealt by anchor hash. In a task, they form shards; each shard's Burrows-Wheeler transform is
built over symbols of STEP bytes (all phases of a segment, so every position is a row), and the transforms are merged
by refining their interleave: each pass deals the rows in their present order by the symbol before them, after which
they are in order of one symbol more. Borders of blocks never move once they appear, and the pass that first shows a
border gives the common prefix there. After LENGTH / STEP passes the blocks are the repeated intervals: no suffix of
one shard is ever compared with one of another, and nothing is sorted again.

An anchor whose distinct segments exceed HOT bytes isn't brought together. Its windows are halved by their place
relative to the anchor: windows of a half share a middle part, whose hash joins the key; halves with a middle of their
own are done, halves equal as a whole are repeated, small groups go to the merge, others are halved again, to single
windows at most. Only counts by hash meet in this, so no group is too large.

Defined results: a null text counts as empty; texts of under LENGTH bytes lose nothing by themselves. Rows that repeat
an id are documents of their own, so a repeated row is a copy. Null ids are kept. An empty table gives no rows.
Columns other than id and text are handed through by `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a window unless a caller gives another length (a multiple of STEP, over K), of a hash, and of a symbol.
LENGTH, K, STEP = 400, 32, 40
SPAN = LENGTH - K + 1
#: Bytes of segments merged at once, in one shard, and of one anchor before its windows are halved.
BATCH, SHARD, HOT = 1 << 18, 1 << 17, 1 << 20
#: Windows of a long text looked at together.
CHUNK = 1 << 19
#: Places of windows, relative to their anchor, that are looked at together before the merge.
CELL = 24
_NONE = -(1 << 63)

_u = np.uint64
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = _u(0x9E3779B97F4A7C15 | 1)
_BACK = _u(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((_BASE, _BACK)):
            steps = np.full(size, b)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _u(32))) * _u(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _u(29))) * _u(0xBF58476D1CE4E5B9)
    return h ^ (h >> _u(32))


class Hasher:
    """Hashes of substrings of s by prefix sums."""

    def __init__(self, s: np.ndarray) -> None:
        up, self.down = _power(len(s))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[s] * up[:-1])))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def segments(s: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Per segment of a text of length bytes or more: first window, windows, anchor's place after it, anchor hash, content hash."""
    hasher = Hasher(s)
    value = hasher.grams(K)
    n, span = len(s) - length + 1, length - K + 1
    place = np.arange(len(value))
    width = 1
    while 2 * width <= span:
        left = value[:-width] <= value[width:]
        place = np.where(left, place[:-width], place[width:])
        value = np.where(left, value[:-width], value[width:])
        width *= 2
    rest = span - width
    if rest:
        left = value[:-rest] <= value[rest:]
        place = np.where(left, place[:-rest], place[rest:])
        value = np.where(left, value[:-rest], value[rest:])
    start = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    end = np.append(start[1:], n)
    return start, end - start, place[start] - start, value[start].view(np.int64), hasher(start, end + length - 1).view(np.int64)


_SEGMENT = "ident long, hash long, start int, windows int, offset int, anchor long, content long"


def _anchors(length: int):
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("repeats")
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in names]
            for ident, key, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for at in range(0, max(0, len(body) - length + 1), CHUNK):
                    found = segments(np.frombuffer(body, np.uint8)[at : at + CHUNK + length - 1], length)
                    size = len(found[0])
                    for column, values in zip(out, (np.full(size, ident), np.full(size, key), found[0] + at, *found[1:])):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, types)], names=names)

    return run


def _order(codes: np.ndarray) -> np.ndarray:
    """A stable argsort of codes under 2 ** 32, by two digits."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if len(codes) > 1 << 16 or high.any() else low


class Transform:
    """The Burrows-Wheeler transform of a shard: rows in order of suffixes, and the symbol before each (0: none)."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray) -> None:
        """codes: for each position 0..size of each segment, its symbol from 1 on; 0 within the last STEP, which end the suffix."""
        n = len(codes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = first + np.repeat(sizes, sizes) - 1
        ends = codes == 0
        rank = np.where(ends, np.cumsum(ends) - 1, codes + n)  # ends are unlike each other, in order of segments
        rank = np.unique(rank, return_inverse=True)[1]
        step = STEP
        while True:  # doubling; each suffix has an end of its own, so ranks become unique
            pair = rank.astype(np.int64) << 32 | rank[np.minimum(np.arange(n) + step, last)]
            pair[ends] = rank[ends].astype(np.int64) << 32
            order = np.argsort(pair, kind="stable")
            fresh = np.concatenate(([True], pair[order[1:]] != pair[order[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            if fresh.all():
                break
            step *= 2
        self.rows = order
        before = order - STEP
        self.symbols = np.where(before >= first[order], codes[np.maximum(before, 0)], 0)
        self.ends = int(ends.sum())


def merge(transforms: list[Transform], passes: int = LENGTH // STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleaves transforms in order of their suffixes' first symbols: the shard and the row of each place, and the common prefix, in symbols, with the place before."""
    sizes = [len(t.rows) for t in transforms]
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), sizes)
    ends = np.repeat(np.arange(len(transforms), dtype=np.uint16), [t.ends for t in transforms])
    symbols = np.concatenate([t.symbols for t in transforms])
    block = np.zeros(len(shard), np.int64)
    common_prefix = np.full(len(shard), passes)
    for done in range(passes):
        read = np.empty(len(shard), np.int64)
        read[np.argsort(shard, kind="stable")] = symbols  # each shard is read in its own order
        order = _order(read)
        read, block, shard = read[order], block[order], shard[order]
        border = np.concatenate(([True], (read[1:] != read[:-1]) | (block[1:] != block[:-1])))
        border[: len(ends)] = True
        shard[: len(ends)] = ends  # rows with nothing before them stand for the ends, which come first
        common_prefix[border & (common_prefix == passes)] = done
        block = np.cumsum(border)
    rows = np.empty(len(shard), np.int64)
    rows[np.argsort(shard, kind="stable")] = np.concatenate([t.rows for t in transforms])
    return shard, rows, common_prefix


def repeated_windows(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per segment, for each of its windows, whether it is also elsewhere in the segments."""
    sizes = np.array([len(b) for b in bodies])
    s = np.frombuffer(b"".join(bodies), np.uint8)
    grams = Hasher(s).grams(STEP)
    starts = np.cumsum(sizes) - sizes
    # Positions 0..size of each segment; those in the last STEP have no symbol.
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    has = inner + STEP <= sizes[owner]
    codes = np.zeros(len(owner), np.int64)
    codes[has] = np.unique(grams[(starts[owner] + inner)[has]], return_inverse=True)[1] + 1
    shards, held = [[0]], 0
    for k in range(1, len(bodies)):
        held += len(bodies[k])
        if held > SHARD:
            shards.append([])
            held = 0
        shards[-1].append(k)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    transforms = [Transform(sizes[x[0] : x[-1] + 1] + 1, codes[bounds[x[0]] : bounds[x[-1] + 1]]) for x in shards]
    shard, rows, prefix = merge(transforms, length // STEP)
    again = prefix == length // STEP
    again[:-1] |= again[1:]  # a block is a run of places of which each but the first shares all symbols with the one before
    flat = np.zeros(len(owner), bool)
    flat[np.array([bounds[x[0]] for x in shards])[shard] + rows] = again
    return [flat[bounds[k] : bounds[k] + sizes[k] - length + 1] for k in range(len(bodies))]


def likely_parts(keys: np.ndarray, lows: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """Of segments, those runs of windows that can have an equal: (segment, first window, bytes).

    Windows are parted by their place relative to the anchor into cells of CELL places. All windows of a cell share a
    middle, so equal ones are in segments of equal key that agree in it; cells alone in theirs are left out.
    """
    sizes = np.array([len(b) for b in bodies])
    n = sizes - length + 1
    s = np.frombuffer(b"".join(bodies), np.uint8)
    first = lows // CELL
    cells = (lows + n - 1) // CELL - first + 1
    owner = np.repeat(np.arange(len(bodies)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells) + first[owner]
    anchor = (np.cumsum(sizes) - sizes + lows + n - 1)[owner]
    middle = Hasher(s)(anchor - cell * CELL, anchor - (cell + 1) * CELL + 1 + length)
    name = _mix(keys.astype(np.int64).view(np.uint64)[owner] * _u(3) + cell.astype(np.uint64)) ^ middle
    place, count = np.unique(name, return_inverse=True, return_counts=True)[1:]
    width = np.minimum((lows + n)[owner], (cell + 1) * CELL) - np.maximum(lows[owner], cell * CELL)
    flags = np.repeat(count[place] > 1, width)  # of each segment's windows, by place, the last window first
    out, bounds = [], np.concatenate(([0], np.cumsum(n))).tolist()
    for k, body in enumerate(bodies):
        for i, j in _runs(flags[bounds[k] : bounds[k + 1]]):
            skip = int(n[k]) - j
            out.append((k, skip, body if j - i == n[k] else body[skip : skip + j - i + length - 1]))
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_SPAN = "ident long, hash long, first int, last int"


def _spans(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names=["ident", "hash", "first", "last"])


def _merge_groups(length: int):
    """Rows (key, ident, hash, start, known, body, low) come in order of key; a key's rows are judged together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("repeats")
        held, size, group, key = [], 0, [], None

        def judged(rows: list) -> list[tuple[int, int, int, int]]:
            if len(rows) < 2:
                return []
            parts = likely_parts(np.array([r[0] for r in rows]), np.array([r[6] for r in rows]), [r[5] for r in rows], length)
            out = []
            for (k, skip, _), flags in zip(parts, repeated_windows([p[2] for p in parts], length) if parts else []):
                _, ident, h, start, known, _, _ = rows[k]
                if not known:
                    out += [(ident, h, start + skip + i, start + skip + j + length - 1) for i, j in _runs(flags)]
            return out

        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[0] != key:
                    if size > BATCH:
                        found += judged(held + group)
                        held, group, size = [], [], 0
                    held.extend(group)
                    group, key = [], row[0]
                group.append(row)
                size += len(row[5])
            if found:
                yield _spans(found)
        yield _spans(judged(held + group))

    return run


def _cut_segments(length: int):
    """Rows (ident, hash, body, list of (anchor, start, windows, offset, known)): the segments' bytes."""
    names = ["key", "ident", "hash", "start", "low", "windows", "known", "body"]
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, key, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for w in wanted:
                    first, n = w["start"], w["windows"]
                    out.append((w["anchor"], ident, key, first, w["offset"] - n + 1, n, w["known"], body[first : first + n + length - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return run


_PART = "key long, ident long, hash long, start int, low int, windows int, known boolean, body binary"


def _halve(length: int):
    """Cuts parts into those of windows by a grid of places relative to the anchor, half as wide as before.

    A window whose first byte lies d before the anchor has place d; a part holds places low .. low + windows - 1. The
    key of a part is hashed from its cell and the bytes that all windows of that cell share with it.
    """
    names = ["key", "ident", "hash", "start", "low", "windows", "known", "body", "content", "width"]
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, ident, h, start, low, windows, known, body, width in zip(*(batch.column(i).to_pylist() for i in range(9))):
                width //= 2
                for cell in range(low // width, (low + windows - 1) // width + 1):
                    a, b = max(low, cell * width), min(low + windows, (cell + 1) * width)
                    skip = low + windows - b  # larger places come first in the text
                    part = body[skip : skip + b - a + length - 1]
                    at = b - 1  # the anchor's place in the part
                    middle = part[at - cell * width : at - ((cell + 1) * width - 1) + length]  # of which any window of the cell has all
                    whole = xxhash.xxh64_intdigest(part, 11)
                    name = xxhash.xxh64_intdigest(b"%d %d %d " % (key, cell, width) + middle, 12)
                    out.append((name - (1 << 63), ident, h, start + skip, a, b - a, known, part, whole - (1 << 63), width))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return run


def _halved(parts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of parts with hot keys: spans known to be repeated, and parts small enough to merge."""
    spans, small, width = [], [], 1 << (length - K + 1).bit_length()  # the first cells' windows share K bytes at least
    parts = parts.withColumn("width", F.lit(width))
    while True:
        parts = common.materialize(parts.mapInArrow(_halve(length), _PART + ", content long, width int"), "halves")
        width //= 2
        alike = parts.groupBy("key", "content", "low", "windows").agg(F.count("*").alias("copies"), F.bool_or("known").alias("any_known"))
        keys = alike.groupBy("key").agg(F.sum("copies").alias("rows"), F.sum(F.col("windows") + length - 1).alias("bytes"))
        rows = parts.join(alike, ["key", "content", "low", "windows"]).join(keys.where("rows > 1"), "key")
        rows = common.materialize(rows, "judged")
        spans.append(rows.where("NOT known AND copies > 1").select("ident", "hash", F.col("start").alias("first"), (F.col("start") + F.col("windows") + length - 1).alias("last")))
        # One of each content goes on, as known if it is known or has copies.
        one = rows.where("copies = 1 OR known OR NOT any_known").withColumn("known", F.expr("known OR copies > 1"))
        one = one.dropDuplicates(["key", "content", "low", "windows"])
        columns = [x.split()[0] for x in _PART.split(", ")]
        if width == 1:
            return spans, small
        small.append(one.where(F.col("bytes") <= HOT).select(*columns))
        parts = one.where(F.col("bytes") > HOT).select(*columns, "width")
        if parts.isEmpty():
            return spans, small


def repeated_spans(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (ident, hash, body): spans (ident, hash, first, last) of bytes that windows found elsewhere too cover."""
    found = common.materialize(bodies.mapInArrow(_anchors(length), _SEGMENT), "segments")
    same = ["anchor", "content", "windows", "offset"]
    alike = found.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("ident", "hash", "start")).alias("one"))
    alike = common.materialize(alike, "alike")
    anchors = alike.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"), F.sum(F.col("windows") + length - 1).alias("bytes"))
    known = found.join(alike.where("copies > 1").select(*same), same).select("ident", "hash", F.col("start").alias("first"), (F.col("start") + F.col("windows") + length - 1).alias("last"))
    # An anchor all of whose segments have copies, or with one alone, is settled.
    open_ = alike.join(anchors.where("kinds > 1 AND least = 1"), "anchor")
    wanted = open_.select(F.col("one.ident").alias("ident"), F.col("one.hash").alias("hash"), F.struct("anchor", F.col("one.start").alias("start"), "windows", "offset", (F.col("copies") > 1).alias("known")).alias("w"))
    wanted = common.materialize(wanted.groupBy("ident", "hash").agg(F.collect_list("w").alias("wanted")), "wanted")  # no more than a document has
    asked, _ = common.parted(bodies, "hash", wanted.select(F.col("hash").alias("code")))
    parts = asked.join(wanted, ["ident", "hash"]).select("ident", "hash", "body", "wanted").mapInArrow(_cut_segments(length), _PART)
    hot = anchors.where((F.col("kinds") > 1) & (F.col("least") == 1) & (F.col("bytes") > HOT)).select(F.col("anchor").alias("key"))
    spans = [known]
    if not (hot := common.materialize(hot, "hot")).isEmpty():
        parts = common.materialize(parts, "parts")
        more, small = _halved(parts.join(hot, "key", "left_semi"), length)
        spans += more
        parts = common.union_all([parts.join(hot, "key", "left_anti"), *small])
    dealt = parts.select("key", "ident", "hash", "start", "known", "body", "low").repartition("key").sortWithinPartitions("key")
    spans.append(dealt.mapInArrow(_merge_groups(length), _SPAN))
    return common.union_all(spans)


def _keep(body: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    if not spans:
        return body, 0, 0
    parts, at, runs, removed = [], 0, 0, 0
    end = -1
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if first > end:
            runs += 1
            parts.append(body[max(end, 0) : first])
            removed += last - first
            end = last
        elif last > end:
            removed += last - end
            end = last
    parts.append(body[end:])
    return b"".join(parts), removed, runs


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """docs and two columns more, the text's bytes and its spans."""
    ident, key, held, found = common.free(docs, "__ident", "__hash", "__body", "__spans")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumns({held: body, ident: F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), key: F.xxhash64(body)})
    bodies = keyed.select(F.col(ident).alias("ident"), F.col(key).alias("hash"), F.col(held).alias("body"))
    spans = repeated_spans(bodies, length).groupBy(F.col("ident").alias(ident), F.col("hash").alias(key)).agg(F.collect_set(F.struct("first", "last")).alias(found))
    spans = common.materialize(spans, "spans")
    met, whole = common.parted(keyed, key, spans.select(F.col(key).alias("code")))
    columns = [*docs.columns, held, found]
    none = F.lit(None).cast(spans.schema[found].dataType)
    return met.join(spans, [ident, key], "left").select(*columns).union(whole.withColumn(found, none).select(*columns))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            kept = [_keep(*x) for x in zip(bodies, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, bodies)), pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", length)
    return rows.select("doc_id", *rows.columns[-2:]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages taken out of the text; a character cut in part goes whole. Null texts stay null."""
    common.small_batches(docs.sparkSession)

    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("repeats")
        for batch in batches:
            columns = batch.columns
            spans, body = columns.pop().to_pylist(), columns.pop().to_pylist()
            texts = [t if t is None or s is None else _keep(b, s)[0].decode("utf-8", "ignore") for t, b, s in zip(columns[at].to_pylist(), body, spans)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _with_spans(docs, id_col, text_col, length)
    return rows.mapInArrow(run, docs.schema)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(common.read(spark, sf_dir, "documents"))


QUERIES = {"op4_repeats": op4_repeats}
ORACLE: dict[str, str] = {}
