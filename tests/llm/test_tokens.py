import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n x", "a<|endoftext|>b <|endoftext|>", "it's we'LL  don't\t\tx\x1c\x1dy\x85z w", "日本語テキスト 😀😀 é İstanbul ΣΑΣ ΟΔΟΣ", "aaaa" * 3000, "   leading\r\n trailing   ", "123456 1,000.50 ½ ²", "<|startoftext|>hi", "ﬁ ǅ ß ſ 　 x", "‘quoted’ — dash…", "\x00\x01", "end., next. then,, last.", "word.\nword,\nx ?. y", "naïve café Straße ÀÉ ƒoo"]
library = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(max_size=40) | st.text("abz AZ.,!'\n\t0é", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encodings_equal_the_library(texts):
    coder = bpe.load(BYTES)
    for t, mine, other in zip(texts, coder.encode_texts(texts), packing.encode_texts(texts, WORDS)):
        assert np.frombuffer(mine, "<u4").tolist() == ids_of(BYTES, t)
        assert coder.decode(mine) == library[BYTES].decode(ids_of(BYTES, t), skip_special_tokens=False)
        assert np.frombuffer(other, "<u4").tolist() == ids_of(WORDS, t)


def test_signs_before_commas_and_full_stops():
    signs = [chr(k) for k in range(33, 127)] + list("À¡¿«»ß")
    texts = ["for _, x in y", "a_, b", "(_, b)", "hello __,\nworld"]
    for a in signs:
        for end in (", b", ".\nb", ",\tb", ". b"):
            texts += [f"{a}{end}", f"w{a}{end}", f"{a}w{end}", f"_{a}{end}", f"{a}_{end}"]
    for t, mine in zip(texts, packing.encode_texts(texts, WORDS)):
        assert np.frombuffer(mine, "<u4").tolist() == ids_of(WORDS, t), t


def test_long_words():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("etaoinshrdlcumwfgypbvk") for _ in range(n))
    coder = bpe.SpeculativeBpe(BYTES)
    for n in (257, 1000, 5000):
        for word in (letters(n), "ab" * n, "a" * n):
            short = coder._merge_long(word.encode())
            assert short == ids_of(BYTES, word)
    start = time.monotonic()
    for word in (letters(300_000), "a" * 300_000, "=" * 100_000):
        assert np.frombuffer(coder.encode_texts([word])[0], "<u4").tolist() == ids_of(BYTES, word)
        assert np.frombuffer(packing.encode_texts([word], WORDS)[0], "<u4").tolist() == ids_of(WORDS, word)
    assert time.monotonic() - start < 90
    assert not any(len(w) > bpe.LONG for w in coder.cache)


def test_round_trip(table):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x"), (1, "again"), (1, "again")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t in rows:
        ids = ids_of(BYTES, t)
        want.append((k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library[BYTES].decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.round_trip(table(rows), BYTES).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(table(rows).limit(0), BYTES).collect() == []


def test_failing_words_are_merged_exactly():
    coder = bpe.SpeculativeBpe(BYTES)
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdeinrstho ") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    made = coder.encode_words(words)
    assert made == [coder.merge(w) for w in words]
    assert any(coder.propose(w) != m for w, m in zip(words, made)) and any(coder.propose(w) == m for w, m in zip(words, made))


def naive(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        best = min(fit, key=lambda b: b[0]) if fit else None
        if best is None:
            bins.append([capacity - x])
        else:
            best[0] -= x
    return len(bins)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=150, deadline=None)
def test_best_fit_decreasing(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed = packing.best_fit_decreasing(counts, 40)
    fill, seen = {}, set()
    for length, ordinal, many, first, offset in placed:
        for k in range(many):
            assert (length, ordinal + k) not in seen
            seen.add((length, ordinal + k))
            fill.setdefault(first + k, []).append((offset, length))
    assert seen == {(x, k) for x, n in counts.items() for k in range(n)}
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40
    assert len(fill) == naive(lengths, 40)


def test_capacity_tree():
    tree, rng, full = packing.CapacityTree(50), random.Random(2), set()
    for _ in range(500):
        x = rng.randint(0, 50)
        on = rng.random() < 0.5
        tree.set(x, on)
        (full.add if on else full.discard)(x)
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((f for f in full if f >= least), default=-1)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(table, monkeypatch, capacity):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x y z"), (1, "again and again"), (1, "again and again")] + [(100 + k, "w " * (k % 23)) for k in range(80)]
    got = [r.asDict() for r in packing.pack(table(rows), WORDS, capacity).collect()]
    want = []
    for k, t in rows:
        ids = [*ids_of(WORDS, t), 0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            piece = ids[s : s + capacity]
            want.append((k, p, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted(((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got), key=str) == sorted(want, key=str)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == naive([w[3] for w in want], capacity)
    assert packing.pack(table(rows).limit(0), WORDS, capacity).collect() == []


def test_rooms_are_those_of_best_fit():
    """Bins' rooms don't depend on how ties between bins of equal room are broken."""
    rng = random.Random(8)
    for _ in range(300):
        capacity = rng.randint(5, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 6))}
        rooms: list[int] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [r for r in rooms if r >= length]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else capacity) - length)
        filled: dict[int, list[tuple[int, int]]] = {}
        seen = Counter()
        for length, ordinal, many, first, offset in packing.best_fit_decreasing(counts, capacity):
            for k in range(many):
                filled.setdefault(first + k, []).append((offset, length))
                seen[length, ordinal + k] += 1
        assert len(seen) == sum(counts.values()) and set(seen.values()) == {1}
        for items in filled.values():
            items.sort()
            assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
        assert sorted(capacity - sum(n for _, n in items) for items in filled.values()) == sorted(rooms)
