"""The walk over majorities by ranges against the dense matrix of all pairs."""

import numpy as np
import pytest

from lodestar.operators import fusion, walks


@pytest.mark.parametrize("ranges", [1, 2, 5, 9, None])
@pytest.mark.parametrize(("n", "voters", "tied", "left_out"), [(203, 4, False, False), (150, 4, True, True), (150, 3, False, True), (120, 5, True, False), (90, 1, False, False), (120, 2, True, True)])
def test_ranges_tell_of_all_pairs(n, voters, tied, left_out, ranges):
    rng = np.random.default_rng(n + voters)
    places = np.array([rng.permutation(n) for _ in range(voters)], float).T
    if tied:
        places = np.floor(places / 3)
    if left_out:
        places[rng.random((n, voters)) < 0.15] = np.nan
    most = (sum((p[None, :] > p[:, None]).astype(int) for p in places.T) >= voters // 2 + 1).astype(float)
    mass, got, better = rng.random(n), np.zeros(n), np.zeros(n)
    cells = walks.Cells(places, ranges)
    for voter, part, low, high in cells.work():
        at = cells.members(max(voter, 0), part)
        if voter < 0:
            got[at] += cells.by_cells(part, mass / n)
            better[at] += cells.by_cells(part, np.ones(n), turned=True)
        else:
            bits, before = cells.bits(voter, part, low, high)
            got[at[low:high]] += walks.received(bits, mass[at], n)
            better[at] += before
    assert np.allclose(got, most @ mass / n, atol=1e-12) and (better == most.sum(0)).all()


def test_mc4_of_more_items_than_one_task_holds(spark, monkeypatch):
    """The number of items that one task holds is no limit for many tasks; pairs that share a range are."""
    rng = np.random.default_rng(12)
    names = ["a", "b", "c", "d"]
    votes = spark.createDataFrame([(v, int(i), r + 1) for v in names for r, i in enumerate(rng.permutation(203))], "voter string, ident long, rank int")
    want = {r["ident"]: r["score"] for r in fusion.mc4(votes, names, 6, alone=1000).collect()}
    monkeypatch.setattr(fusion.Majorities, "MOST", 100)
    monkeypatch.setattr(walks, "HELD", 100)  # a range's items in several rows
    got = {r["ident"]: r["score"] for r in fusion.mc4(votes, names, 6, alone=10).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    by_ranges = {r["ident"]: r["score"] for r in fusion.mc4(votes, names, 6, alone=10, ranges=8).collect()}
    assert all(abs(by_ranges[i] - want[i]) < 1e-12 for i in want)
    monkeypatch.setattr(walks, "MOST", 1000)
    with pytest.raises(ValueError, match="at most"):
        fusion.mc4(votes, names, 6, alone=10)
