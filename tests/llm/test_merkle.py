import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, fanout=3):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, at, found, fanout=3):
    """Siblings from a node to the root, and the root that found gives in its place."""
    proof = []
    for nodes in levels[:-1]:
        start = at - at % fanout
        run = nodes[start : start + fanout]
        proof += run[: at - start] + run[at - start + 1 :]
        run[at - start] = found
        found, at = h(*run), at // fanout
    return proof, found


def brute(rows):
    """From (doc_id, source, lang, n_chars, text), the query's rows."""
    def cut(r):
        even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
        return r[4].replace("\n", "") if even and r[4] is not None else r[4]

    made = [(r[1], r[0], leaf(*r), leaf(*r[:4], cut(r))) for r in rows]
    groups = {}
    for x in sorted(made, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        groups.setdefault(x[0], []).append(x)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[2] for x in groups[s]]) for s in order}
    above = tree([below[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, ident, whole, found) in enumerate(groups[s]):
            lower, sub = climb(below[s], i, found)
            upper, root = climb(above, k, sub)
            out.append((ident, whole, below[s][-1][0], above[-1][0], h(*lower, *upper), root, root == above[-1][0]))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(spark, rows, tmp_path, **clash):
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({k: F.lit(v) for k, v in clash.items()})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r[n] for n in NAMES) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_all_rows(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle.build, "__defaults__", (3, levels))
    rng = random.Random(levels)
    rows = [(k, rng.choice(["hot", "hot", "a", "é", None, "", "one" if k == 5 else "hot"]), rng.choice(["en", None]), rng.choice([None, k]), "line\n" * rng.randint(0, 3) + "é") for k in range(130)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "x\ny"), (7, "a", "en", 1, "x\ny"), (7, "a", "en", 1, "x\ny"), (-3, "a", "", 0, ""), (999, "long", "en", 1, "word\n" * 300_000)]
    got = manifest(spark, rows, tmp_path, n=1, idx=2, path="p", node=b"x", leaf="l", root="r", __tie=3)
    assert got == brute(rows)
    assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("rows", [[], [(4, "s", "en", 1, "a\nb")], [(4, None, None, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    got = manifest(spark, rows, tmp_path)
    assert got == brute(rows) if rows else got == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82])
def test_proofs_fold_to_the_root(n):
    nodes = [h(str(k)) for k in range(n)]
    root, paths = merkle.collapse(nodes, n, 3, 9)
    levels = tree(nodes)
    assert root == levels[-1][0]
    for k, path in enumerate(paths):
        assert merkle.fold(nodes[k], path) == root
        assert merkle.siblings(path) == climb(levels, k, nodes[k])[0]
        assert n == 1 or merkle.fold(h("other"), path) != root
