"""Assignment of many records: without a group of each in pandas, equal to each record's own."""

import random

from lodestar.operators import fusion
from lodestar.operators.assignment import assigned
from lodestar.plans import registry

import numpy as np


def test_requirements_are_not_grouped_by_record(spark):
    text = registry.QUERIES["r07_requirement_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in text and "hashpartitioning" not in text


def test_both_ways_equal_a_record_alone(spark, monkeypatch):
    monkeypatch.setattr(fusion, "REMEMBERED", 3)
    rng = random.Random(1)
    tables = {k: [(f"q{i}", rng.choice([7, 9, 40]) * j, rng.randint(0, 4) / 4) for i in range(rng.randint(1, 4)) for j in range(1, rng.randint(2, 5))] for k in range(60)}
    want = {}
    for k, rows in tables.items():
        need, units = sorted({r for r, _, _ in rows}), sorted({u for _, u, _ in rows})
        w = np.zeros((len(need), len(units)))
        for r, u, x in rows:
            w[need.index(r), units.index(u)] = x
        at = assigned(w)
        want[k] = (w[np.flatnonzero(at >= 0), at[at >= 0]].sum(), (w.max(1) > 0).mean(), w.max(1).min())
    flat = spark.createDataFrame([(k, *x) for k, rows in tables.items() for x in rows], "ident long, requirement string, unit int, weight double")
    held = spark.createDataFrame([(k, v) for k, v in tables.items()] + [(99, [])], "ident long, weights array<struct<requirement: string, unit: int, weight: double>>")
    for out in (fusion.assignment(flat), fusion.assignment_within(held)):
        got = {r["ident"]: tuple(r)[1:] for r in out.collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
