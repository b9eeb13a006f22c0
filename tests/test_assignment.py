"""Assignments by trying all."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import assignment as H


def slow(gain):
    """Best sum, by permutations over columns and places for rows that stay without."""
    r, u = gain.shape
    wide = np.concatenate((gain, np.zeros((r, r), gain.dtype)), axis=1)
    return max(sum(wide[i, p[i]] for i in range(r)) for p in permutations(range(u + r), r))


def test_best_sums():
    rng = np.random.default_rng(2)
    for _ in range(150):
        r, u = rng.integers(1, 4), rng.integers(1, 5)
        for gain in (rng.random((r, u)), rng.integers(0, 3, (r, u)), rng.normal(size=(r, u))):
            at = H.assigned(gain)
            held = at[at >= 0]
            assert len(set(held.tolist())) == len(held)
            assert abs(sum(gain[i, c] for i, c in enumerate(at) if c >= 0) - slow(gain)) < 1e-9


def by_sets(hits, sizes):
    """The best assignment that comes first by units, by dynamic programming over sets of requirements."""
    from fractions import Fraction

    r, u = hits.shape
    best = {0: (Fraction(0), (u,) * r)}
    for unit in range(u):
        for mask, (total, at) in list(best.items()):
            for i in range(r):
                if not mask >> i & 1:
                    new = mask | 1 << i
                    value = (total + Fraction(int(hits[i, unit]), sizes[i]), (*at[:i], unit, *at[i + 1 :]))
                    old = best.get(new)
                    if old is None or value[0] > old[0] or value[0] == old[0] and value[1] < old[1]:
                        best[new] = value
    return min(best.values(), key=lambda v: (-v[0], v[1]))[1]


@pytest.mark.parametrize("u", [1, 3, 7, 15])
def test_seven_by_fifteen(u):
    rng = np.random.default_rng(u)
    sizes = [len(x) for x in H.REQUIREMENTS.values()]
    for _ in range(25):
        hits = rng.integers(0, rng.integers(1, 5), (7, u)).astype(np.int64)
        at = H.assigned(H.ordered_gain(hits, sizes))
        assert tuple(u if c < 0 else c for c in at.tolist()) == by_sets(hits, sizes)


def test_many_units_are_refused():
    with pytest.raises(ValueError, match="too many"):
        H.ordered_gain(np.zeros((7, 200), np.int64), [9, 7, 8, 10, 9, 7, 7])


def test_records(spark):
    schema = "candidate_id string, profile struct<current_title: string, summary: string>, career_history array<struct<title: string, description: string, company: string, start_date: string, end_date: string>>, skills array<struct<name: string, proficiency: string, duration_months: int>>"
    rows = [("none", None, None, None), ("blank", (None, " "), [(None, None, None, "2020", None)], []), ("one", ("Lead", "senior staff principal"), [("x", "search vector index semantic", None, None, None)], [("Milvus", "Beginner", 3), ("Python", "EXPERT", 0)])]
    got = {r["candidate_id"]: r for r in H.evidence(spark.createDataFrame(rows, schema)).collect()}
    assert tuple(got["none"])[1:] == tuple(got["blank"])[1:] == (0.0, 0, 0.0, 0, 7, 0.0, 4, 0.0)
    one = got["one"]
    assert abs(one["coverage"] - (4 / 9 + 1 / 8 + 4 / 7)) < 1e-9 and (one["n_covered"], one["diversity"], one["undated_only"]) == (2, 3, 1)
    assert H.evidence(spark.createDataFrame(rows, schema).where(F.lit(False))).collect() == []
