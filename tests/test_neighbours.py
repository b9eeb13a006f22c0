"""The index of cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import fusion, neighbours


def true(ids, vectors, k):
    """The k nearest of each, by likeness to nine places and id."""
    v = np.array(vectors, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(v @ v.T, 9)
    out = {}
    for i, one in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[i, j], ids[j]))[:k]
        out[one] = [ids[j] for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["ident"], r["place"])):
        out.setdefault(r["ident"], []).append(r["other"])
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], "ident long, vector array<double>").repartition(6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("ident"), F.col("embedding").alias("vector"))
    rows = e.collect()
    want = true([r["ident"] for r in rows], [r["vector"] for r in rows], 10)
    got = found(fusion.nearest(e, recall=0.95))
    asked = [i for i in want if i % 20 == 0]
    assert sum(len(set(want[i]) & set(got[i])) for i in asked) >= 0.9 * 10 * len(asked)
    assert all(len(x) == 10 for x in got.values()) and len(got) == len(want)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16))
    return (middle[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))).tolist()


@pytest.mark.parametrize("block", [8192, 150])
def test_clusters_need_few_cells(spark, monkeypatch, clustered, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "GROUP", block)
    ids = list(range(3000))
    want, got = true(ids, clustered, 5), found(neighbours.nearest_indexed(frame(spark, ids, clustered), 5, probes=6))
    assert sum(len(set(want[i]) & set(got[i])) for i in ids) >= 0.95 * 5 * len(ids)


def test_all_cells_give_all_neighbours(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "BLOCK", 90)
    monkeypatch.setattr(neighbours, "GROUP", 70)
    monkeypatch.setattr(neighbours, "CELL", 20)
    ids, vectors = [k * 3 - 50 for k in range(400)], clustered[:400]
    assert found(neighbours.nearest_indexed(frame(spark, ids, vectors), 4, probes=1 << 20)) == true(ids, vectors, 4)


def test_copies_nulls_and_zeros(spark, clustered):
    vectors = clustered[:60] + [clustered[0]] * 200 + [None, [0.0] * 16]
    ids = list(range(len(vectors)))
    got = found(neighbours.nearest_indexed(frame(spark, ids, vectors), 5, probes=1 << 20))
    want = true(ids[:260], vectors[:260], 5)
    assert got == want
    assert got[3] == want[3] and got[250] == [0, 60, 61, 62, 63]


def test_few_rows(spark):
    assert found(neighbours.nearest_indexed(frame(spark, [1], [[1.0, 2.0]]))) == {}
    assert found(neighbours.nearest_indexed(frame(spark, [1, 5], [[1.0, 2.0], [1.0, 0.0]]))) == {1: [5], 5: [1]}
    assert neighbours.nearest_indexed(frame(spark, [1], [[1.0]]).limit(0)).collect() == []


def test_a_large_cell_is_in_many_blocks():
    where = neighbours.blocks(np.eye(4, dtype=np.float32), np.array([1000, 3, 4, 5]), 100)
    assert len(where[0]) == 10 and not set(where[0]) & {x for w in where[1:] for x in w}


def test_what_a_task_gives_on_is_bounded():
    """With a block for each cell and many groups, in batches of bounded size, and all of it."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    middle, where = v[:64], [[c] for c in range(64)]
    cell = (v @ middle.T).argmax(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(cell, pa.int32()), neighbours._binary(v), pa.array(range(3000))], names=["ident", "cell", "v", "salt"])
    parts = np.full(64, 90)
    for made, n in ((neighbours._asking(middle, 64, where, 64, parts), 3000 * 64), (neighbours._held(where, parts), 3000 * 90)):
        out = list(made(iter([batch])))
        assert sum(b.num_rows for b in out) == n
        assert max(b.nbytes for b in out) < 2 * neighbours.GIVEN
        assert len({tuple(x) for b in out for x in zip(*(b.column(i).to_pylist() for i in range(3)))}) == n


@pytest.mark.parametrize(("width", "copies"), [(16, 0), (16, 900), (3, 0)])
def test_closest_works_out_few_pairs_and_finds_all(monkeypatch, width, copies):
    """Of all pairs only those that can count are worked out in double, also where a vector stands very often; ties go by id."""
    rng = np.random.default_rng(8)
    n, k, worked = 2000, 10, []
    v = rng.normal(size=(n, width)).astype(np.float32)
    v[:copies] = v[0]
    v[-2] = 0
    v, ids = v[rng.permutation(n)], rng.permutation(n)
    monkeypatch.setattr(fusion, "OTHERS", 256)
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda form, a, b: worked.append(len(a)) or plain(form, a, b))
    row, at, likeness = fusion.closest(v, ids, v, ids, k)
    assert len(row) == n * k and sum(worked) < n * 100
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    score = np.round(u @ u.T, 9)
    for i, best in enumerate(at.reshape(n, k)):
        assert [ids[j] for j in best] == [ids[j] for j in sorted((j for j in range(n) if j != i), key=lambda j: (-score[i, j], ids[j]))[:k]]
    assert (row == np.repeat(np.arange(n), k)).all()


def test_nearest_refuses_what_has_no_vector(spark):
    with pytest.raises(Exception, match="vectors must have one length"):
        fusion.nearest(frame(spark, range(4), [[1, 0], [0, 1], None, [1, 1]]), 2).collect()


def test_nearest_deals_small_tables_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fusion, "LEAST", 40)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 6)).tolist()
    ids = [f"n{i}" for i in range(150)]
    assert found(fusion.nearest(frame(spark, range(150), v), 4)) == true(list(range(150)), v, 4)
    named = spark.createDataFrame([(i, x) for i, x in zip(ids, v)], "ident string, vector array<double>")
    assert found(fusion.nearest(named, 4)) == true(ids, v, 4)
