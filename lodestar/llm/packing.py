"""Best-fit-decreasing packing of token sequences.

Documents are tokenised in parallel and cut into pieces. The packing itself needs the pieces' lengths only, and
there are at most CAPACITY different ones: the driver takes the histogram of lengths (at most CAPACITY rows,
whatever the input) and runs best-fit decreasing over it, with a segment tree over remaining capacities that finds
the tightest open bin in logarithmic time. Bins of equal remaining capacity are handled as ranges of bin numbers,
so all documents of one length are placed together and the work doesn't grow with the input. The result is a list
of placements (length, range of ordinals -> range of bins, offset). Pieces get their ordinals among those of equal
length from counts by (length, bucket), no group being ordered as a whole, and look their bin up in it.

Defined results: a null text counts as empty and gives one piece, [0]. Rows that repeat an id are documents of their
own. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_symbols

CAPACITY = 2048
#: Pieces that share a bucket are ordered together; the number of buckets grows with the input.
BUCKET_ROWS = 20_000
#: Words whose ids a worker remembers, of at most LONG characters; as many again stay until the next that many are met.
CACHE, LONG = 400_000, 256
#: Signs after a word that are split from it.
_TAIL = ".,!?;:"
#: A comma or full stop that other signs stand before belongs to them.
_SIGNS = re.compile(r"(?:[^\w\s]|_)[,.]\s")
#: Texts of these characters alone are split at white space and looked up word by word; others go to the library whole.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7EÀ-ɏß¡¿«»]*")

_state: dict = {}


def _encoder(path: str):
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        table = {b: c for c, b in byte_symbols().items()}  # how the vocabulary writes bytes
        _state.update(path=path, tokenizer=tokenizer, table=table, cache={}, old={})
    return _state["tokenizer"], _state["cache"]


def _words(text: str) -> list[str]:
    """Pieces of a plain text that are encoded by themselves; commas and full stops after a word are parted from it."""
    low = text.lower()
    if not _SIGNS.search(low):
        low = low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").replace(",\n", " ,\n")
    return low.split()


def _learn(words: list[str], tokenizer, cache: dict[str, bytes], old: dict[str, bytes]) -> None:
    """Puts the ids of new words into the cache. Words of letters go to the merges at once, past the library's splitting."""
    whole, odd, tailed = set(), [], []  # whole: words of letters, which the splits keep whole
    for w in words:
        if w in old:
            cache[w] = old[w]
            continue
        core = w.rstrip(_TAIL)
        if core.isalpha():
            if core not in cache:
                if core in old:
                    cache[core] = old[core]
                else:
                    whole.add(core)
            if len(core) < len(w):
                tailed.append((w, core, w[len(core) :]))
        else:
            odd.append(w)
    odd += list({t for _, _, t in tailed if t not in cache})
    tokenize, table = tokenizer.model.tokenize, _state["table"]
    for w in whole:
        cache[w] = np.array([t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(table))], "<u4").tobytes()
    for i in range(0, len(odd), 10_000):
        part = odd[i : i + 10_000]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            cache[w] = np.array(e.ids, "<u4").tobytes()
    for w, core, tail in tailed:
        cache[w] = cache[core] + cache[tail]


def _joined(words: list[str], cache: dict[str, bytes]) -> bytes:
    if len(words) < 2:
        return cache[words[0]] if words else b""
    return b"".join(itemgetter(*words)(cache))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; equal to the library's encoding of the whole text.

    The vocabulary's splits never cross white space, so plain texts are looked up word by word.
    """
    tokenizer, cache = _encoder(path)
    words = [_words(t) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
    if len(cache) > CACHE:
        _state["old"], cache = cache, {}
        _state["cache"] = cache
    missing = set().union(*filter(None, words)).difference(cache)
    if missing:
        _learn(list(missing), tokenizer, cache, _state["old"])
    out = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else _joined(ws, cache) for t, ws in zip(texts, words)]
    for w in [w for w in missing if len(w) > LONG]:
        cache.pop(w)
        cache.pop(w.rstrip(_TAIL), None)
    return out


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        common.tenant("packing", _state)
        tokenizer, _ = _encoder(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            out = []
            for ident, ids in zip(batch.column(0).to_pylist(), encode_texts([t or "" for t in batch.column(1).to_pylist()], path)):
                ids += b"\0\0\0\0"
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    out.append((ident, k, start, len(piece) // 4, zlib.crc32(piece)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return cut


class CapacityTree:
    """A segment tree over remaining capacities 0..n: finds the smallest non-empty one that is at least a given value."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.full = np.zeros(2 * self.size, np.int8)

    def set(self, at: int, full: bool) -> None:
        at += self.size
        self.full[at] = full
        at >>= 1
        while at:
            self.full[at] = self.full[2 * at] | self.full[2 * at + 1]
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest full leaf at or after least; -1 if there is none."""
        at = least + self.size
        if self.full[at]:
            return least
        while at > 1:
            if not at & 1 and self.full[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first ordinal, how many, first bin, offset) of counts[length] items each, longest first."""
    tree, bins, placed, opened = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        ordinal, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:  # every bin opened now holds as many items of this length as fit
                per = capacity // length
                if left >= per:
                    many = left // per
                    for k in range(per):
                        placed.append((length, ordinal + k * many, many, opened, k * length))
                    used, taken = per * length, many * per
                else:
                    many, used, taken = 1, length, 1
                    placed.append((length, ordinal, 1, opened, 0))
                first = opened
                opened += many
            else:
                first, many = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
                # A bin just filled is now the tightest, and takes items of this length while they fit.
                per = min(room // length, left)
                rest = many - min(many, left // per)
                many -= rest
                if rest:
                    bins.setdefault(room, []).append((first + many, rest))
                    tree.set(room, True)
                for k in range(per):
                    placed.append((length, ordinal + k * many, many, first, capacity - room + k * length))
                used, taken = capacity - room + per * length, many * per
            ordinal, left = ordinal + taken, left - taken
            if used < capacity:
                bins.setdefault(capacity - used, []).append((first, many))
                tree.set(capacity - used, True)
    return placed


def _assign(placed: list[tuple[int, int, int, int, int]]):
    table = np.array(placed, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = table[:, 0] << 48 | table[:, 1]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ordinal = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = table[np.searchsorted(keys, length << 48 | ordinal, "right") - 1] if len(length) else table[:0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(row[:, 3] + ordinal - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return look


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.small_batches(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = common.materialize(pieces, "pieces")
    buckets = max(1, pieces.count() // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    # At most capacity times buckets rows, of which each is a count.
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("ordinal", F.row_number().over(order) - 1).join(before.drop("n"), ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("ordinal")).alias("ordinal"))
    return numbered.mapInArrow(_assign(best_fit_decreasing(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE: dict[str, str] = {}
