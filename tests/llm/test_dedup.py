import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lodestar.llm import exact_dedup, simhash

ODD = [(None, None), (None, "x"), (5, None), (5, None), (6, ""), (7, "a  b"), (7, "a  b"), (8, " A\tb \n"), (9, "long " * 60000), (10, "\x85 not\xa0space"), (11, "x")]


def test_trie():
    rng = random.Random(1)
    trie, want = exact_dedup.Patricia(), {}
    for _ in range(2000):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))
        i = rng.choice([None, *range(50)])
        trie.insert(s, i, 1)
        old = want.get(s, (None, 0))
        want[s] = (i if old[0] is None else old[0] if i is None else min(i, old[0]), old[1] + 1)
    assert {k: (own[0], own[1]) for k, own in trie.terminals()} == want
    assert any(children and own for _, children, own in trie.root[1].values())  # strings that others begin with


def test_subtrees_are_spilled_in_order():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    trie, got = exact_dedup.Patricia(), []
    for k, s in enumerate(sorted(keys)):
        if k % 7 == 0:
            got += trie.before(s)
            held = list(trie.terminals())
            assert all(s.startswith(x) or x.startswith(s) for x, _ in held)
            assert trie.held == sum(len(x) + exact_dedup._NODE for x, _ in held)
        trie.insert(s, k, 1, s)
    got += trie.rest()
    assert {own[3]: own[1] for own in got} == Counter(keys) and len(got) == len(set(keys))


@pytest.mark.parametrize("budget", [0, 3000])
def test_spilled_groups(table, monkeypatch, budget):
    monkeypatch.setattr(exact_dedup, "BUDGET", budget)
    rng = random.Random(3)
    rows = [(k % 97, "".join(rng.choice("ab \t") for _ in range(rng.choice([3, 4, 600])))) for k in range(600)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    got = Counter((r["text_sha256"], r["keep_id"], r["group_size"]) for r in exact_dedup.owners(table(rows)).collect())
    assert got == {(hashlib.sha256(t.encode()).hexdigest(), min(ids), len(ids)): len(ids) for t, ids in groups.items()}


@pytest.mark.parametrize("rows", [ODD, []])
def test_exact_groups(table, rows):
    got = exact_dedup.owners(table(rows or [(1, "x")]).limit(len(rows))).collect()
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    want = []
    for i, t in normal:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints):
    n = len(ids)
    seen, out = [False] * n, [None] * n
    for s in range(n):
        if not seen[s]:
            group, todo = [], [s]
            seen[s] = True
            while todo:
                x = todo.pop()
                group.append(x)
                for y in range(n):
                    if not seen[y] and (prints[x] ^ prints[y]).bit_count() <= 3:
                        seen[y] = True
                        todo.append(y)
            least = min((ids[g] for g in group if ids[g] is not None), default=None)
            for g in group:
                out[g] = least
    return out


def test_near_groups(table):
    rng = random.Random(2)
    prose = lambda n: [rng.choice(["alpha", "beta", "Gamma", "delta", "é", "omega"]) + str(rng.randint(0, 30)) for _ in range(n)]
    texts = [t for _, t in ODD]
    for _ in range(12):
        base = prose(rng.randint(3, 200))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    ids = [i for i, _ in ODD] + list(range(100, 100 + len(texts) - len(ODD)))
    prints = [brute_print(t) for t in texts]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(table(list(zip(ids, texts)))).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert simhash.near_duplicates(table([(1, "x")]).limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 16, 37])
def test_gray_index_finds_every_link(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)]
    fps = np.unique(np.array(near, np.uint64))
    label = {int(f): int(f) for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in simhash.forest(fps.copy()):
        assert (int(a) ^ int(b)).bit_count() <= 3
        label[max(root(int(a)), root(int(b)))] = min(root(int(a)), root(int(b)))
    want = brute_components([int(f) for f in fps], [int(f) for f in fps])
    assert [root(int(f)) for f in fps] == want
    ranks = simhash.gray_rank(fps)
    assert ((ranks ^ (ranks >> np.uint64(1))) == fps).all()


def test_components(spark):
    from lodestar.llm import common

    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(-5, 2000)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == r for x, r in label.items())
    assert Counter(got.values()) == Counter(label[x] for x in got)
