"""Byte-level BPE encoding and decoding by speculation and verification.

For each new word a greedy longest match over the vocabulary proposes tokens. Proposals are checked together: each
token must be what merging makes of its own bytes, and each adjacent pair must be what merging makes of the two
joined; all pairs of a batch are looked up as arrays in the sorted arrays of pairs judged before, and only pairs never
met are judged by merging. A sequence of which every pair is compatible is the encoding; a word with a failing pair
undergoes the exact merges. Words already met are looked up.

Defined results: a null text counts as empty (no ids, the digests of nothing). Special tokens in a text are special
tokens, as in the library. Rows that repeat an id are given back each. An empty table gives no rows. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words whose ids a worker remembers, of at most LONG characters; as many again stay until the next that many are met.
CACHE, LONG = 500_000, 256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters are split here; the library's own splitter takes the others, whose classes may differ by Unicode version.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-ɏ‐-‧€]*")


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        raw = lambda s: bytes(symbol[c] for c in s)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.longest = max(map(len, self.ids))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (k, self.ids[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.size = 1 + max(self.bytes)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.good = np.empty(0, np.int64)  # codes of compatible pairs, sorted; a token alone is a pair with size
        self.bad = np.empty(0, np.int64)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.library, self.path = None, path

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding of one word: the pair of least rank is joined, leftmost first, until none is left."""
        if len(word) > LONG:
            return self._merge_long(word)
        get, none = self.ranks.get, (1 << 60, 0)
        parts = [self.single[b] for b in word]
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for a word of any length: pairs wait in a heap by rank and place, and parts know their neighbours."""
        get, n = self.ranks.get, len(word)
        parts: list[int | None] = [self.single[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(found[0], i) for i, pair in enumerate(zip(parts, parts[1:])) if (found := get(pair))]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if parts[i] is None or j >= n:
                continue
            found = get((parts[i], parts[j]))
            if found is None or found[0] != rank:  # one of the two was joined to another since
                continue
            parts[i], parts[j] = found[1], None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if found := get((parts[i], parts[j])):
                    heapq.heappush(waiting, (found[0], i))
            if (h := before[i]) >= 0 and (found := get((parts[h], parts[i]))):
                heapq.heappush(waiting, (found[0], h))
        return [p for p in parts if p is not None]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, ids, longest = [], 0, self.ids, self.longest
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                found = ids.get(word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        codes = np.concatenate((flat * (self.size + 1) + self.size, (flat[:-1] * (self.size + 1) + flat[1:])[inner]))
        owners = np.concatenate((owner, owner[1:][inner]))
        unique, place = np.unique(codes, return_inverse=True)
        known_good, known_bad = np.isin(unique, self.good, assume_unique=True), np.isin(unique, self.bad, assume_unique=True)
        for k in np.flatnonzero(~known_good & ~known_bad):
            a, b = divmod(int(unique[k]), self.size + 1)
            pair = [a] if b == self.size else [a, b]
            known_good[k] = self.merge(b"".join(self.bytes[t] for t in pair)) == pair
        self.good, self.bad = np.union1d(self.good, unique[known_good]), np.union1d(self.bad, unique[~known_good])
        failing = np.unique(owners[~known_good[place]])
        for k in failing.tolist():
            proposed[k] = self.merge(words[k])
        return proposed

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.split.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        cache, split = self.cache, []
        for t in texts:
            parts = self.special.split(t) if self.special and any(s in t for s in self.added) else [t]
            split.append([(p, None) if p in self.added else (p, self.pieces(p)) for p in parts if p])
        missing = {w for ps in split for _, ws in ps if ws for w in ws}.difference(cache)
        cache.update({w: self.old[w] for w in missing if w in self.old})
        missing = list(missing.difference(self.old))
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            for w, ids in zip(part, self.encode_words([w.encode() for w in part])):
                cache[w] = np.array(ids, "<u4").tobytes()
        get = cache.__getitem__
        out = [b"".join(b"".join(map(get, ws)) if ws is not None else np.array([self.added[p]], "<u4").tobytes() for p, ws in ps) for ps in split]
        for w in [w for w in missing if len(w) > LONG]:
            del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, SpeculativeBpe] = {}


def load(path: str) -> SpeculativeBpe:
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("bpe", _loaded)
        coder = load(path)
        for batch in batches:
            ids = coder.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            sha = lambda b: hashlib.sha256(b).hexdigest()
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(coder.decode(x).encode()) for x in ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("bpe", _loaded)
        coder = load(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode_texts([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_both(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_speculative_bpe": op9_speculative_bpe}
ORACLE: dict[str, str] = {}
