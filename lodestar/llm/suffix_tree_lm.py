"""LM scoring with probabilistic suffix trees.

Symbols are the tokens of a text. Contexts of one to DEPTH tokens grow level by level: a context is counted if it was
met LEAST times, whatever the size of the corpus, and any word may be what it predicts; next words met fewer than SEEN
times after it are counted together and left to its suffix. A context is retained if its smoothed next-symbol
distribution, each use left out in turn, predicts the uses better than that of its suffix, by a least gain for each
use. The probability of a token is interpolated along the retained suffixes of what comes before it, from the root up
to the longest. The root gives each known token its share less an absolute discount; what is discounted is divided
evenly among as many unknown words as the counts of words seen once and twice lead to expect (Chao's estimate).

Counts cover all training rows. States and next-symbol counts are a table by 64-bit code, partitioned like any other.
Tasks send the counts of contexts as packed arrays, dealt into buckets by the context's last word, so that a bucket has
a context's counts and what its suffix predicts, and settles it. Contexts whose last word is so frequent that one bucket
would hold too much (`_hot`) are dealt by next word as well; their sums meet in joins. A settled bucket leaves packed
arrays too: chances for the level above, and what scoring needs. To score, rows are taken in
ROUNDS, so that questions and answers of one are gone before the next. Rows are dealt in compressed chunks into groups of
about GROUP characters; a group asks once for each code it needs, questions and table meet in these buckets, a
bucket's part of the table is held while its questions stream by, and the answers, a bit for each question and the
values found, meet the group's rows. Questions name a code by 48 of its bits within a bucket of some ANSWERS codes, and
values travel in single precision, in which counts of words below HEAVY of all are exact up to 16 million. What a worker
holds besides is bounded: tokens with at least HEAVY of all tokens, and a bitmap of BITS contexts that only spares
questions: it lets some through in vain but hides no state.

Defined results: a null text counts as empty and is its end alone. With no training rows, no token is known, the end
and any word have probability 1/2. Null ids fall in the same remainder as the empty id. Rows
that repeat an id are documents of their own. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.staging import discard, released

from . import common

HEAVY = 1e-6
#: A context is retained if it gains at least so many nats for each use.
GAIN = 0.002
END = b"\n"  # no word has white space
FLUSH = 300_000
#: Uses that a context has at least, that a next word after it has to be told apart, and tokens of a context at most.
LEAST, SEEN, DEPTH = 10, 1, 3
#: Bits of a bitmap (a power of two), characters of a group of rows and of a chunk, tokens counted and codes answered in a bucket.
BITS, GROUP, CHUNK, BUCKET, ANSWERS = 1 << 27, 16 << 20, 1 << 20, 1 << 20, 1 << 20
#: Bytes of a next word's hash that tell it from the others after its context.
WIDTH = 5
#: Rounds in which rows are scored, codes of a packed row, and parts that a bitmap is made in.
ROUNDS, SLICE, PARTS = 3, 1 << 16, 64
_LOW = np.uint64((1 << 8 * WIDTH) - 1)
_u = np.uint64


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # both keep to ASCII, as the contract does


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(tokens(text))
        found[END] += batch.num_rows
        if len(found) > FLUSH:
            yield rows()
    yield rows()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a + _u(0x9E3779B97F4A7C15)) * _u(0xBF58476D1CE4E5B9) ^ b * _u(0x94D049BB133111EB)
    x = (x ^ x >> _u(29)) * _u(0xD6E8FEB86659FD93)
    return x ^ x >> _u(32)


def _followed_by(context: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The code of a context with its next word."""
    return _mix(~context, h & _LOW)


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.fromiter(map(xxhash.xxh64_intdigest, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), batch.column(1)], names=["word", "code", "c"])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of codes, and where in it each distinct one starts."""
    order = np.argsort(codes)
    ordered = codes[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), ordered[1:] != ordered[:-1])))


def _set(codes: np.ndarray) -> np.ndarray:
    """Distinct codes in order; np.unique hashes them, which takes many times as long for millions."""
    ordered = np.sort(codes)
    return ordered[np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The first bytes of each item, compressed byte by byte."""
    whole = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _items(packed: bytes, width: int, kind: str) -> np.ndarray:
    size = int.from_bytes(packed[:4], "little")
    out = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    if size:
        out[:, :width] = np.frombuffer(pa.decompress(packed[4:], size * width, codec="zstd"), np.uint8).reshape(width, size).T
    return out.reshape(-1).view(kind)


def _packed(codes: np.ndarray, width: int = 6) -> bytes:
    """The first bytes of ascending codes, as steps."""
    return _planes(np.diff(codes >> _u(64 - 8 * width), prepend=_u(0)).astype("<u8"), width)


def _codes(packed: bytes, width: int = 6) -> np.ndarray:
    """The codes again, what was cut off zero."""
    return np.cumsum(_items(packed, width, "<u8"), dtype=np.uint64) << _u(64 - 8 * width)


def _packed_values(values: np.ndarray) -> bytes:
    return _planes(values.astype("<f4"), 4)


def _values(packed: bytes) -> np.ndarray:
    return _items(packed, 4, "<f4")


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """A stable order by bucket; few buckets are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")


def _places(codes: np.ndarray, size: int) -> tuple[list[int], list[bytes]]:
    """Of a bitmap of codes: its parts that have one, and the places there, packed."""
    at = _set(codes & _u(size - 1))
    part = at // _u(size // PARTS)
    cut = _slices(part)
    return [int(part[i]) for i, _ in cut], [_packed(at[i:j], 8) for i, j in cut]


def _placed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, codes = _places(batch.column(0).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(codes, pa.binary())], names=["part", "codes"])

    return run


def _part(size: int):
    def run(rows: pa.Table) -> pa.Table:
        held = np.zeros(size // PARTS, bool)
        for codes in rows.column("codes").to_pylist():
            held[(_codes(codes, 8) % _u(size // PARTS)).astype(np.int64)] = True
        bits = np.packbits(held, bitorder="little").tobytes()
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    return run


class Bits:
    """A bitmap of codes."""

    def __init__(self, places: DataFrame) -> None:
        """Places in columns named part and codes; tasks put the parts together."""
        t = places.groupBy("part").applyInArrow(_part(BITS), "part long, bits binary").toArrow()
        self.words = np.zeros((PARTS, BITS // PARTS // 8), np.uint8)
        for part, bits in zip(t.column("part").to_pylist(), t.column("bits").to_pylist()):
            self.words[part] = np.frombuffer(bits, np.uint8)
        self.words = self.words.reshape(-1).view("<u8")
        self.any, self.mask = t.num_rows > 0, _u(BITS - 1)

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes & self.mask
        return (self.words[(at >> _u(6)).astype(np.int64)] >> (at & _u(63)) & _u(1)).astype(bool)


class Codes:
    """Values by code: codes are hashes, so their first bits say where to look."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        if (codes[1:] < codes[:-1]).any():
            order = np.argsort(codes)
            codes, values = codes[order], values[order]
        bits = max(1, len(codes).bit_length() - 1)
        self.shift, self.size = _u(64 - bits), len(codes)
        self.first = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32 if len(codes) < 1 << 31 else np.int64)
        self.codes, self.values = np.append(codes, _u(0)), np.append(values, values.dtype.type(0))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each, -1 for those not held."""
        at, out = self.first[(asked >> self.shift).astype(np.int64)], np.full(len(asked), -1, self.first.dtype)
        left = np.arange(len(asked))
        while len(left := left[at[left] < self.size]):
            here, want = self.codes[at[left]], asked[left]
            met = here == want
            out[left[met]] = at[left[met]]
            left = left[here < want]
            at[left] += 1
        return out

    def get(self, asked: np.ndarray, otherwise: float) -> np.ndarray:
        at = self.find(asked)
        return np.where(at >= 0, self.values[at].astype(np.float64), otherwise)  # double precision from here on


class Tree:
    """What every worker holds of the model; bounded by HEAVY and BITS."""

    def __init__(self, words: list[tuple[bytes, int]], n: int, v: int, once: int, twice: int) -> None:
        """words: the heavy ones with their counts, the end among them; once, twice: how many words occur so often."""
        self.n, self.v = n, v
        self.discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        self.unknown = self.discount * v / n / max(1, v, once * once / (2 * twice + 1)) if n else 0.5
        words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.ids = {w: k for k, (w, _) in enumerate(words)}
        self.counts = np.array([k for _, k in words], float)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in words), np.uint64, len(words))
        self.base = np.log10(self.counts + 0.1)
        self.root = (self.counts - self.discount) / n if n else np.full(len(words), 0.5)
        self.end = self.hashes[self.ids[END]]
        self.depth, self.states = 0, None  # of the contexts in the table: levels and a bitmap
        self.buckets, self.bits = n // min(BUCKET, ANSWERS) + 1, BITS  # of counts and of the table; of a bitmap
        self.hot = np.empty(0, np.uint64)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' tokens, one after the other: places among the heavy words (-1: not heavy), hashes, place in the text; and where texts start."""
        words: list[bytes] = []
        starts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            starts[k] = len(words)
            words += tokens(text)
            words.append(END)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        h = self.hashes[ids]
        rare = np.flatnonzero(ids < 0)
        h[rare] = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in rare.tolist()), np.uint64, len(rare))
        return ids, h, np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words)))), starts

    def grams(self, h: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By depth: codes of the contexts, and of them with their next token. A text's first token comes after an end; places before depth - 1 have no context so long."""
        before = np.concatenate(([self.end], h[:-1]))  # the end of the text before stands there for any
        c = np.full(len(h), 0x51ED27, np.uint64)
        for j in range(depth):
            c = _mix(c, np.concatenate((np.zeros(min(j, len(h)), np.uint64), before[: max(0, len(h) - j)])))
            yield c, _followed_by(c, h)

    def often(self, words: np.ndarray) -> np.ndarray:
        """Whether they are hot."""
        return self.hot[np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)] == words if len(self.hot) else np.zeros(len(words), bool)

    def keys(self, codes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Buckets of the table, then the first bits of codes: at least 48 up to 65,535 buckets."""
        bits = _u(self.buckets.bit_length())
        return bucket << (_u(64) - bits) | codes >> bits

    def alone(self, codes: np.ndarray) -> np.ndarray:
        """Keys of codes that are dealt by themselves."""
        return self.keys(codes, _mix(codes, _u(3)) % _u(self.buckets))

    def lookups(self, h: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: places whose context the bitmap lets through, the keys of context and of it with its next; they are dealt by the context's last word."""
        last = np.concatenate(([self.end], h[:-1]))
        often, bucket = self.often(last), _mix(last, _u(1)) % _u(self.buckets)
        for j, (c, t) in enumerate(self.grams(h, self.depth)):
            at = np.flatnonzero(self.states.has(c) & (pos >= j))
            hot = np.flatnonzero(often[at])
            keys = []
            for codes in (c[at], t[at]):
                keys.append(self.keys(codes, bucket[at]))
                keys[-1][hot] = self.alone(codes[hot])
            yield at, *keys

    def asks(self, ids: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Keys that scoring needs from the table."""
        found = [self.alone(h[ids < 0])]
        for _, c, t in self.lookups(h, pos):
            found += [c, t]
        return _set(np.concatenate(found))

    def chances(self, ids: np.ndarray, h: np.ndarray, pos: np.ndarray, known: Codes) -> tuple[np.ndarray, ...]:
        """Of each token its probability, count and log10 of count + 0.1."""
        rare = np.flatnonzero(ids < 0)
        c = known.get(self.alone(h[rare]), 0.0)
        p, base, count = self.root[ids], self.base[ids], self.counts[ids]
        p[rare] = np.where(c > 0, np.maximum(c - self.discount, 1e-300) / max(1, self.n), self.unknown)
        base[rare], count[rare] = np.log10(c + 0.1), c
        for at, context, t in self.lookups(h, pos):
            p[at] = p[at] * known.get(context, 1.0) + known.get(t, 0.0)
        return p, count, base


_PACKED = pa.schema([("bucket", pa.int64()), ("c", pa.binary()), ("s", pa.binary()), ("k", pa.binary()), ("x", pa.binary()), ("n", pa.binary())])


def _slices(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)])) if len(keys) else []


def _followed(tree_of, bits_of, level: int):
    """By bucket, packed: contexts of a level, those of their suffixes, numbers of next words (the top bit set if hot), and the next words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bits, held, size = tree_of.value, bits_of.value, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            t, c, s, h, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first = _distinct(t)
            n, order = np.diff(np.append(first, len(t))), order[first]
            t, c, s, h, w = t[order], c[order], s[order], h[order], w[order]
            often = tree.often(w)
            bucket = np.where(often, t, _mix(w, _u(1))) % _u(tree.buckets)
            order = np.argsort(c)
            order = order[_by_bucket(bucket[order], tree.buckets)]
            bucket, c, s, h, n, often = bucket[order], c[order], s[order], h[order], n[order], often[order]
            out = []
            for i, j in _slices(bucket):
                first = np.flatnonzero(np.concatenate(([True], c[i + 1 : j] != c[i : j - 1])))
                k = np.diff(np.append(first, j - i)).astype("<u4") | often[i:j][first].astype("<u4") << np.uint32(31)
                words = np.ascontiguousarray(h[i:j].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                out.append((int(bucket[i]), _packed(c[i:j][first], 8), s[i:j][first].tobytes(), _planes(k, 4), words.tobytes(), _planes(n[i:j].astype("<u4"), 4)))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out[i : i + 64]), _PACKED)], schema=_PACKED)

        for batch in batches:
            if not batch.num_rows:
                continue
            _, h, pos, _ = tree.read(batch.column(0).to_pylist())
            grams = list(tree.grams(h, level))
            # A context is what its last token followed, one level up.
            word = np.concatenate(([tree.end], h[:-1]))
            last = word if level == 1 else np.concatenate(([_u(0)], grams[level - 2][1][:-1]))
            at = np.flatnonzero(bits.has(last) & (pos >= level - 1))
            if len(at):
                c, t = grams[level - 1]
                held.append((t[at], c[at], grams[level - 2][0][at] if level > 1 else np.zeros(len(at), np.uint64), h[at], word[at]))
                size += len(at)
            if size > 6 * FLUSH:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    return run


_COUNTED = "kind int, bucket long, c long, t long, s long, n long, kinds long, low long, v float, codes binary, x binary"
_FIELDS = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in ("bucket", "c", "t", "s", "n", "kinds", "low")), ("v", pa.float32()), ("codes", pa.binary()), ("x", pa.binary())])
#: Kinds of rows: parts of hot contexts (n uses, kinds of next words, low uses by rare ones), their next words (v: the
#: root's chance), packed next words of settled contexts of two words or more (codes, x: chances), packed facts (codes,
#: x: what a retained context keeps, and what it adds to a next word; after one word the chances follow from them), places in bitmaps (bucket: the part) of
#: retained contexts, of next words met LEAST times.
PART, HOT_NEXT, NEXT, FACT, KEPT, OFTEN = range(6)


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    def one(field: pa.Field) -> pa.Array:
        x = columns.get(field.name)
        if x is None:
            return pa.nulls(size, field.type)
        if isinstance(x, list):
            return pa.array(x, field.type)
        x = x.view(np.int64) if x.dtype == np.uint64 else x
        return pa.array(x.astype(np.float32), field.type, mask=np.isnan(x)) if x.dtype == np.float64 else pa.array(x, field.type)

    columns["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays([one(f) for f in _FIELDS], schema=_FIELDS)


def _bits_rows(kind: int, codes: np.ndarray, size: int) -> pa.RecordBatch:
    part, packed = _places(codes, size)
    return _rows(kind, len(part), bucket=np.array(part, np.int64), codes=packed)


def _sliced(kind: int, bucket: int, codes: np.ndarray, values: np.ndarray, width: int) -> pa.RecordBatch:
    order = np.argsort(codes)
    parts = [order[i : i + SLICE] for i in range(0, len(order), SLICE)]
    return _rows(kind, len(parts), bucket=np.full(len(parts), bucket, np.int64), codes=[_packed(codes[x], width) for x in parts], x=[_packed_values(values[x]) for x in parts])


def _rest(kinds: np.ndarray, low: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What the uses by rare next words gain, each left out in turn."""
    return np.where(low > 0, low * np.log(np.maximum(kinds + low - 2, 1e-300) / np.maximum(total + kinds - 2, 1)), 0.0)


def _dealt(codes: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """Facts by their bucket of the table, packed."""
    order = np.argsort(codes)
    codes, values = codes[order], values[order]
    bucket = _mix(codes, _u(3)) % _u(buckets)
    order = _by_bucket(bucket, buckets)
    bucket, codes, values = bucket[order], codes[order], values[order]
    return [(int(bucket[i]), _packed(codes[i:j]), _packed_values(values[i:j])) for i, j in _slices(bucket)]


def _counted(tree_of, level: int):
    """A bucket's counts, with the chances that it settled one level below."""

    def run(rows: pa.Table, below: pa.Table) -> pa.Table:
        tree = tree_of.value
        if not rows.num_rows:
            return pa.Table.from_batches([], _FIELDS)
        take = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        unpacked = lambda name, read: np.concatenate(list(map(read, rows.column(name).to_pylist())))
        k, n = (unpacked(name, lambda x: _items(x, 4, "<u4")) for name in ("k", "n"))
        often, k = k >> np.uint32(31) == 1, (k & np.uint32((1 << 31) - 1)).astype(np.int64)
        x = np.zeros((int(k.sum()), 8), np.uint8)
        x[:, :WIDTH] = take("x", np.uint8).reshape(-1, WIDTH)
        x = x.reshape(-1).view("<u8")
        c = np.repeat(unpacked("c", lambda x: _codes(x, 8)), k)
        t = _followed_by(c, x)
        order, first = _distinct(t)
        n = np.add.reduceat(n.astype(np.int64)[order], first)
        at = order[first]
        order = np.argsort(c[at])
        n, at = n[order], at[order]
        t, c, x, owner = t[at], c[at], x[at], np.repeat(np.arange(len(k)), k)[at]
        starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        total, low = np.add.reduceat(n, starts), np.add.reduceat(np.where(n < SEEN, n, 0), starts)
        kinds = np.diff(np.append(starts, len(c)))
        hot = often[owner[starts]]
        live = (total >= LEAST) | hot
        told = np.flatnonzero((n >= SEEN) & np.repeat(live, kinds))
        heavy = tree.hashes & _LOW
        by = np.argsort(heavy)
        near = by[np.minimum(np.searchsorted(heavy[by], x[told]), len(by) - 1)]
        q = np.where(heavy[near] == x[told], np.maximum(tree.root[near], 1e-300), HEAVY)  # of a rare word, at least its chance
        s = _followed_by(take("s", np.uint64)[owner[told]], x[told]) if level > 1 else np.zeros(len(told), np.uint64)
        of = np.repeat(np.arange(len(starts)), kinds)[told]  # each one's context
        out = []
        if hot.any():
            w = hot[of]
            out += [_rows(PART, int(hot.sum()), c=c[starts][hot], n=total[hot], kinds=kinds[hot], low=low[hot]), _rows(HOT_NEXT, int(w.sum()), c=c[told][w], t=t[told][w], s=s[w], n=n[told][w], v=q[w])]
        cold = ~hot[of]
        told, of, q, s = told[cold], of[cold], q[cold], s[cold]
        if len(told):
            if level > 1:
                width = 6 if level == 2 else 8
                parts = [(_codes(c, width), _values(v)) for c, v in zip(below.column("codes").to_pylist(), below.column("x").to_pylist())]
                known = Codes(*map(np.concatenate, zip(*parts))) if parts else Codes(np.empty(0, np.uint64), np.empty(0))
                if level == 2:  # from what contexts of one word keep and gain
                    suffix = take("s", np.uint64)[owner[told]]
                    gain, keep = (known.get(x >> _u(16) << _u(16), otherwise) for x, otherwise in ((s, 0.0), (suffix, 1.0)))
                    q = gain + keep * q
                else:
                    q = known.get(s, np.nan)
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            mine = of[first]  # contexts that something is told of
            whole, keep = (total + kinds)[mine], ((kinds + low) / (total + kinds))[mine]
            at = np.repeat(np.arange(len(mine)), np.diff(np.append(first, len(of))))
            without = (n[told] - 1 + (kinds + low)[of] * q) / (total + kinds - 1)[of]  # of a use, itself left out
            gained = np.add.reduceat(n[told] * np.log(np.maximum(without, 1e-300) / q), first) + _rest(kinds, low, total)[mine]
            kept = gained > GAIN * total[mine]
            gain = np.where(kept[at], n[told] / whole[at], np.nan)
            t, often, bucket = t[told], n[told] >= LEAST, rows.column("bucket")[0].as_py()
            if level < DEPTH:
                out.append(_bits_rows(OFTEN, t[often], tree.bits))
                if level > 1:
                    out.append(_sliced(NEXT, bucket, t, np.where(kept[at], gain + keep[at] * q, q), 8))
            if kept.any():
                c, w = c[starts][mine][kept], kept[at]
                out += [_bits_rows(KEPT, c, tree.bits), _sliced(FACT, bucket, np.concatenate((c, t[w])), np.concatenate((keep[kept], gain[w])), 6)]
        return pa.Table.from_batches(out, _FIELDS)

    return run


class Level:
    """Contexts of a level and their next words: packed facts for scoring (bucket, codes, x), places in bitmaps (part, codes) of retained contexts and of next words met LEAST times, and chances for the level above, by buckets of settled contexts (bucket, codes, x) and hot (t, p)."""

    def __init__(self, texts: DataFrame, tree: Tree, bits: Bits, level: int, below: Level | None) -> None:
        spark = texts.sparkSession
        shared = [spark.sparkContext.broadcast(x) for x in (tree, bits)]
        packed = texts.mapInArrow(_followed(*shared, level), "bucket long, c binary, s binary, k binary, x binary, n binary")
        under = (below.settled if level > 2 else below.facts_dealt) if below else spark.range(0).selectExpr("id AS bucket", "cast(NULL AS binary) AS codes", "cast(NULL AS binary) AS x")
        counted = packed.groupBy("bucket").cogroup(under.groupBy("bucket")).applyInArrow(_counted(shared[0], level), _COUNTED)
        counted = common.materialize(counted, f"counted{level}")
        for x in shared:
            x.destroy()  # of copies on disks too: the level is written
        self.settled = counted.where(F.col("kind") == NEXT).select("bucket", "codes", "x")
        self.often = counted.where(F.col("kind") == OFTEN).select(F.col("bucket").alias("part"), "codes")
        self.facts = self.facts_dealt = counted.where(F.col("kind") == FACT).select("bucket", "codes", "x")
        self.kept = counted.where(F.col("kind") == KEPT).select(F.col("bucket").alias("part"), "codes")
        self.hot, self.tables = None, [counted]
        if len(tree.hot) and not counted.where(F.col("kind") == PART).isEmpty():
            self._add_hot(counted, below, level, tree.buckets)

    def _add_hot(self, counted: DataFrame, below: Level | None, level: int, buckets: int) -> None:
        """The same for contexts of which each bucket has a part."""
        parts = counted.where(F.col("kind") == PART).groupBy("c").agg(F.sum("n").alias("total"), F.sum("kinds").alias("kinds"), F.sum("low").alias("low")).where(F.col("total") >= LEAST)
        nexts = counted.where(F.col("kind") == HOT_NEXT).select("c", "t", "s", "n", F.col("v").alias("q"))
        if below is not None:
            nexts = nexts.drop("q").join(below.hot.select(F.col("t").alias("s"), F.col("p").alias("q")), "s")
        nexts = common.materialize(nexts.select("c", "t", "n", "q").join(parts, "c"), f"hot{level}")
        without = F.expr("(n - 1 + (kinds + low) * q) / (total - 1 + kinds)")
        seen = F.sum(F.col("n") * F.log(F.greatest(without, F.lit(1e-300)) / F.col("q")))
        rest = F.expr("if(low = 0, 0D, low * ln(greatest(kinds + low - 2, 1e-300) / (total + kinds - 2)))")
        states = nexts.groupBy("c", "total", "kinds", "low").agg(seen.alias("seen"))
        states = common.materialize(states.select("c", F.expr("(kinds + low) / (total + kinds)").alias("keep"), (F.col("seen") + rest > GAIN * F.col("total")).alias("kept")), f"states{level}")
        told = nexts.join(states.select("c", "kept", "keep"), "c")
        told = told.select("t", "n", F.expr("if(kept, n / (total + kinds) + keep * q, q)").alias("p"), F.expr("if(kept, n / (total + kinds), NULL)").alias("v"))
        told = common.materialize(told, f"nexts{level}")
        discard(nexts)
        self.hot = told.select("t", "p")
        self.tables += [states, told]
        self.often = self.often.union(told.where(F.col("n") >= LEAST).select("t").mapInArrow(_placed(BITS), _PLACES))
        self.kept = self.kept.union(states.where("kept").select("c").mapInArrow(_placed(BITS), _PLACES))
        found = told.where("v IS NOT NULL").select("t", F.col("v").cast("double")).union(states.where("kept").select("c", F.col("keep").cast("double")))
        self.facts = self.facts.union(found.mapInArrow(_facts(buckets), _FACTS))

    def slim(self) -> None:
        """Once the level above is settled: what scoring needs stays, the rest is deleted."""
        kept = self.facts.select("*", F.lit(None).cast("long").alias("part")).unionByName(self.kept, allowMissingColumns=True)
        kept = common.materialize(kept, "level")
        for table in self.tables:
            discard(table)
        self.tables, self.settled, self.facts_dealt, self.often, self.hot = [kept], None, None, None, None
        self.facts, self.kept = kept.where("part IS NULL").drop("part"), kept.where("part IS NOT NULL").select("part", "codes")


def _hot(words: DataFrame, n: int) -> np.ndarray:
    """Sorted codes of words met so often that contexts which end in one are dealt by next word: at most a million, whatever the size of the corpus."""
    least = max(BUCKET >> 2, n >> 20)
    return np.sort(words.where(F.col("v") >= least).select("code").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def train(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """From a column of training texts: the tree, and the table (packed codes and values by bucket) of counts of words and of what contexts keep and gain."""
    vocab = texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    vocab = common.materialize(vocab.where("c > 0").mapInArrow(_word_codes, "word binary, code long, c long"), "vocab")
    n, v, n1, n2 = vocab.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n = n or 0
    heavy = vocab.where((F.col("c") >= HEAVY * n) | (F.col("word") == F.lit(END))).collect() if n else []
    tree = Tree([(bytes(r["word"]), r["c"]) for r in heavy] or [(END, 0)], n, v, n1, n2)
    words = vocab.selectExpr("code", "cast(c AS double) AS v")
    facts = common.materialize(words.mapInArrow(_facts(tree.buckets), _FACTS), "facts")
    if not n:
        discard(vocab)
        return tree, facts
    released(texts.sparkSession)
    tree.hot, levels = _hot(words, n), []
    bits = Bits(words.where(F.col("v") >= LEAST).select("code").mapInArrow(_placed(BITS), _PLACES))
    discard(vocab)
    while len(levels) < DEPTH and bits.any:
        levels.append(Level(texts, tree, bits, len(levels) + 1, levels[-1] if levels else None))
        bits = Bits(levels[-1].often)
        released(texts.sparkSession)
        if len(levels) > 1:
            levels[-2].slim()
    if levels:
        levels[-1].slim()
        tree.depth, tree.states = len(levels), Bits(common.union_all([x.kept for x in levels]))
        facts = common.union_all([facts, *(x.facts for x in levels)])
        released(texts.sparkSession)
    return tree, facts


_CHUNKS = pa.schema([("number", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())])
_PLACES = "part long, codes binary"
_FACTS = "bucket long, codes binary, x binary"
_MEETING = "bucket long, kind int, number long, codes binary, v binary"
_MET = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("number", pa.int64()), ("codes", pa.binary()), ("v", pa.binary())])
_PACKED_FACTS = pa.schema([("bucket", pa.int64()), ("codes", pa.binary()), ("x", pa.binary())])
_FOUND = pa.schema([("number", pa.int64()), ("bucket", pa.int64()), ("met", pa.binary()), ("v", pa.binary())])


def _chunked(groups: int):
    """Rows (id, text) in compressed chunks, each of one group. Chunks follow a partition's order, so a lost one is made again as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            whole = b"".join(texts)
            number = int(_mix(np.array([made], np.uint64), _u(9))[0] % _u(groups))
            body = pa.compress(whole, codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([number], [ids], [list(map(len, texts))], [body]), _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(ident)
                texts.append((text or "").encode())
                size += len(texts[-1]) + 64
                if size > CHUNK:
                    yield chunk()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield chunk()

    return run


def _unpacked(sizes: list[int], body: bytes) -> list[str]:
    whole = pa.decompress(body, sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b].decode() for a, b in zip([0, *ends], ends)]


def _read(tree: Tree, chunks: list[tuple[list[int], bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    for sizes, body in chunks:
        ids, h, pos, starts = tree.read(_unpacked(sizes, body))
        yield ids.astype(np.int32), h, pos.astype(np.int32), starts


def _asked(tree: Tree, read: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """A group's keys in order, and their buckets."""
    keys = _set(np.concatenate([np.empty(0, np.uint64), *(tree.asks(ids, h, pos) for ids, h, pos, _ in read)]))
    return keys, keys >> _u(64 - tree.buckets.bit_length())


def _met(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[i : i + 64]), _MET)], schema=_MET)


def _facts(buckets: int):
    """Packs rows (code, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            rows = _dealt(*map(np.concatenate, zip(*held)), buckets)
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[i : i + 64]), _PACKED_FACTS)], schema=_PACKED_FACTS)

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 4 * FLUSH:
                yield from dealt()
                held, size = [], 0
        if size:
            yield from dealt()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, its part of the table first: answers questions one by one."""
    bucket, parts, known = None, [], None
    for batch in batches:
        out = []
        for own, kind, number, codes, v in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if own != bucket:
                bucket, parts, known = own, [], None
            if kind == 0:
                parts.append((_codes(codes), _values(v)))
                continue
            if known is None:
                known = Codes(*(np.concatenate(x) for x in zip(*parts))) if parts else Codes(np.empty(0, np.uint64), np.empty(0, np.float32))
                parts = []
            at = known.find(_codes(codes))
            met = at >= 0
            out.append((number, own, np.packbits(met).tobytes(), _packed_values(known.values[at[met]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _FOUND)], schema=_FOUND)


def score(docs: DataFrame, tree: Tree, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = (texts.agg(F.sum(F.length("text") + 64)).first()[0] or 0) // (GROUP * ROUNDS) + 1
    table = facts.selectExpr("bucket", "0 AS kind", "0L AS number", "codes", "x AS v")
    done = []
    for k in range(ROUNDS):
        mine = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k)
        done.append(common.materialize(_judged(mine, shared, table, groups), "scores"))
        released(docs.sparkSession)
        time.sleep(1)  # listeners may have held the plan
        released(docs.sparkSession)
    scale = float(np.log10(tree.n + 0.1 * (tree.v + 1)))
    return common.union_all(done).select("doc_id", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score")


def _judged(texts: DataFrame, shared, table: DataFrame, groups: int) -> DataFrame:
    """Rows (id, text) dealt into groups: doc_id, n_tokens, n_known, base (the sum of logs of counts), score."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, number = shared.value, [], None

        def asked() -> Iterator[pa.RecordBatch]:
            keys, bucket = _asked(tree, _read(tree, held))
            codes = keys << _u(tree.buckets.bit_length())
            return _met([(int(bucket[i]), 1, number, _packed(codes[i:j]), None) for i, j in _slices(bucket)])

        for batch in batches:
            for own, sizes, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if held and own != number:
                    yield from asked()
                    held = []
                number = own
                held.append((sizes, body))
        if held:
            yield from asked()

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        tree, out = shared.value, []
        read = list(_read(tree, list(zip(rows.column("sizes").to_pylist(), rows.column("body").to_pylist()))))
        keys, bucket = _asked(tree, read)  # as it was asked
        met, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        place = {int(bucket[i]): (i, j) for i, j in _slices(bucket)}
        for own, bits, v in zip(*(found.column(c).to_pylist() for c in ("bucket", "met", "v"))):
            i, j = place[own]
            met[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
            values[i:j][met[i:j]] = _values(v)
        known = Codes(keys[met], values[met])
        del keys, bucket, met, values, found
        for ids, h, pos, starts in read:
            p, count, base = tree.chances(ids, h, pos, known)
            out.append((np.diff(np.append(starts, len(p))), np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
        ids = [i for x in rows.column("ids").to_pylist() for i in x]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base", "score"])

    # Questions and judgment share the exchange of chunks.
    rows = texts.mapInArrow(_chunked(groups), "number long, ids array<long>, sizes array<long>, body binary").repartition("number")
    asked = rows.sortWithinPartitions("number").mapInArrow(ask, _MEETING)
    found = table.union(asked).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, "number long, bucket long, met binary, v binary")
    return rows.groupBy("number").cogroup(found.groupBy("number")).applyInArrow(judge, "doc_id long, n_tokens long, n_known long, base double, score double")


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark, size=32 << 20)
    docs = common.read(spark, sf_dir, "documents")
    held = common.crc_mod(F.col("doc_id"), 10) == 0
    tree, facts = train(docs.where(~held).select("text"))
    return score(docs, tree, facts).withColumn("held_out", held)


QUERIES = {"op3_suffix_tree_lm": op3_suffix_tree_lm}
ORACLE: dict[str, str] = {}
