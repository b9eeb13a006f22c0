import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import repeats


def brute(texts, n=repeats.LENGTH):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, size=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "é", "ion", "st", "ê", "re"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.choice([40, 80, 150])) for _ in range(5)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "d" * 1500, "abc" * 500, "xyz" * 200 + prose(30) + "xyz" * 200]
    for _ in range(size):
        parts = [prose(rng.randint(0, 90)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        texts.append(" ".join(parts))
    whole = prose(400)
    texts += [whole, whole, whole[:700] + "!" + whole[700:], whole[:1000] + prose(50), whole[100:-100], shared[2][:420] + "Q" + shared[2][380:]]
    return texts


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 1 << 20, 1 << 19), (2, 0, 1 << 19), (3, 3000, 1 << 19)])
def test_brute_force(spark, table, monkeypatch, seed, hot, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(seed)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.measure(table(rows)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


@pytest.mark.parametrize(("length", "hot"), [(200, 1 << 20), (200, 3000), (80, 1 << 20)])
def test_other_lengths(table, monkeypatch, length, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(9, 40)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.measure(table(list(enumerate(texts))), length=length).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_repeated_windows_over_shards(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 3000)
    bodies = [t.encode() for t in corpus(4, 20) if t and len(t.encode()) >= repeats.LENGTH]
    seen = Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
    for b, flags in zip(bodies, repeats.repeated_windows(bodies)):
        assert flags.tolist() == [seen[b[i : i + 400]] > 1 for i in range(len(b) - 399)]


def test_long_texts_are_cut_at_any_place(monkeypatch):
    body = np.frombuffer(corpus(5)[12].encode() * 2, np.uint8)
    first = repeats.segments(body)
    assert int(first[1].sum()) == len(body) - repeats.LENGTH + 1
    for start, windows, offset in zip(*(x.tolist() for x in first[:3])):
        assert windows <= repeats.SPAN and 0 <= offset - windows + 1 <= offset < repeats.SPAN


def test_odd_rows(table):
    text = "e" + "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    rows = [(None, text), (7, text), (7, text), (8, "unlike " * 3), (9, None)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.measure(table(rows)).collect())
    n = len(text)
    assert got == [(-1, n, n, 1), (7, n, n, 1), (7, n, n, 1), (8, 21, 0, 0), (9, 0, 0, 0)]
    assert repeats.measure(table([(1, "x")]).limit(0)).collect() == []
    out = repeats.remove(table(rows))
    assert out.columns == table(rows).columns
    assert sorted((r["doc_id"] or -1, r["text"] or "~") for r in out.collect()) == [(-1, "~"), (7, "~"), (7, "~"), (8, "unlike " * 3), (9, "~")]


def test_characters_cut_in_part_go_whole(table):
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    rows = [(1, "Ä" + passage + "Ö tail one"), (2, "ä" + passage + "ö tail two")]  # the letters share their first byte
    texts = sorted(r["text"] for r in repeats.remove(table(rows)).collect())
    assert texts == ["Ä tail one", "ä tail two"]
