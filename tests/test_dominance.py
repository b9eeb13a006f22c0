"""Majorities by dominance counts against all pairs."""

import random

import pytest

from lodestar.operators import dominance, fusion


def votes_of(rng, n, voters, missing):
    out = []
    for v in voters:
        ids = [k for k in range(n) if rng.random() >= missing]
        rng.shuffle(ids)
        out += [(v, i, 3 * r + 1) for r, i in enumerate(ids)]
    return out


def brute(votes, voters):
    rank = {(v, i): r for v, i, r in votes}
    ids = sorted({i for _, i, _ in votes})
    out = {}
    for a in ids:
        wins = losses = 0
        for b in ids:
            both = [(rank[v, a], rank[v, b]) for v in voters if a != b and (v, a) in rank and (v, b) in rank]
            wins += 2 * sum(x < y for x, y in both) > len(voters)
            losses += 2 * sum(x > y for x, y in both) > len(voters)
        out[a] = (wins, losses)
    return out


@pytest.mark.parametrize("n,voters,missing,leaf", [(70, "abc", 0, 4), (40, "abcd", 0.2, 5), (30, "abcde", 0.1, 6), (90, "ab", 0.1, 3), (50, "a", 0, 4), (60, "abc", 0, None)])
def test_majorities(spark, n, voters, missing, leaf):
    votes = votes_of(random.Random(n), n, voters, missing)
    frame = spark.createDataFrame(votes, "voter string, ident long, rank long")
    got = {r["ident"]: (r["wins"], r["losses"]) for r in dominance.majorities(frame, list(voters), leaf).collect()}
    assert got == brute(votes, voters)


def test_ranks_given_twice_are_refused(spark):
    frame = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "voter string, ident long, rank long")
    with pytest.raises(ValueError):
        fusion.copeland(frame, ["a"])


def test_no_votes(spark):
    assert fusion.copeland(spark.createDataFrame([], "voter string, ident long, rank long"), ["a", "b", "c"]).collect() == []
