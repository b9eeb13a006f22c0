"""Extremely randomised trees, recomputed in full by recursion over lists."""

import random

import pytest

from lodestar.operators import extra_trees as X


def slow(rows, head, tree, node, depth, inputs, features, least, seed, numbers):
    """The tree below a node as nested tuples. numbers: the number of each node, as levels are grown."""
    ys = [r[1] for r in rows]
    leaf = ("leaf", sum(round(y * 2**30) for y in ys) / 2**30 / len(ys))
    if depth == 0:
        return leaf
    best = None
    for f in X.tried(seed, head, tree, node, inputs, features):
        low, high = min(r[0][f] for r in rows), max(r[0][f] for r in rows)
        if high <= low:
            continue
        cut = low + (high - low) * X.draw(seed, head, tree, node, "cut", f)
        left, right = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
        if len(left) < least or len(right) < least:
            continue
        error = lambda v: sum((y - sum(v) / len(v)) ** 2 for y in v)
        gain = error(ys) - error(left) - error(right)
        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
            best = gain, f, cut
    return leaf if best is None else ("split", best[1], best[2])


def walked(rows, head, tree, inputs, features, depth, least, seed):
    """All nodes of a tree, level by level, with the numbers that they get."""
    out, level, after = {}, [(0, rows)], 1
    for d in range(depth, -1, -1):
        following = []
        for node, own in level:
            out[node] = slow(own, head, tree, node, d, inputs, features, least, seed, None)
            if out[node][0] == "split":
                _, f, cut = out[node]
                following += [(after, [r for r in own if r[0][f] <= cut]), (after + 1, [r for r in own if r[0][f] > cut])]
                out[node] += (after, after + 1)
                after += 2
        level = following
    return out


@pytest.mark.parametrize("held", [1 << 21, 10])
def test_all_nodes(spark, monkeypatch, held):
    monkeypatch.setattr(X, "HELD", held)
    rng = random.Random(6)
    data = []
    for k in range(240):
        x = [rng.random(), float(rng.randint(0, 3)), rng.gauss(0, 1), 1.0]
        data.append((*x, round(2 * x[0] + x[1], 3), None if k % 3 else round(x[2], 3)))
    frame = spark.createDataFrame(data, "a double, b double, c double, d double, y double, z double").repartition(5)
    grown = X.fit(frame, ["a", "b", "c", "d"], ["y", "z"], trees=3, depth=4, least=4, features=2, seed=7)
    for h in range(2):
        rows = [(r[:4], r[4 + h]) for r in data if r[4 + h] is not None]
        for t in range(3):
            want = walked(rows, h, t, 4, 2, 4, 4, 7)
            assert len(want) == len(grown.feature[h][t])
            for node, what in want.items():
                if what[0] == "leaf":
                    assert grown.feature[h][t][node] == -1 and abs(grown.value[h][t][node] - what[1]) < 1e-12
                else:
                    assert (grown.feature[h][t][node], grown.threshold[h][t][node], grown.left[h][t][node], grown.right[h][t][node]) == what[1:]
    got = X.predicted(frame, ["a", "b", "c", "d"], grown, ["p", "q"]).collect()
    assert sum((r["p"] - r["y"]) ** 2 for r in got) / 240 < 0.3
    again = X.fit(frame.repartition(2), ["a", "b", "c", "d"], ["y", "z"], trees=3, depth=4, least=4, features=2, seed=7)
    assert again.__dict__ == grown.__dict__


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None)], "a double, y double")
    grown = X.fit(frame, ["a"], ["y"], trees=2, depth=3, least=1)
    assert [r["p"] for r in X.predicted(frame, ["a"], grown, ["p"]).collect()] == [2.0, 2.0, 2.0]
    empty = X.fit(frame.limit(0), ["a"], ["y"], trees=1)
    assert empty.feature == [[[-1]]]


def test_trees_in_the_form_of_a_forest(spark):
    from pyspark.sql import functions as F

    from lodestar.operators import fusion

    frame = spark.createDataFrame([(float(k), float(k > 9)) for k in range(30)], "a double, y double")
    grown = X.fit(frame, ["a"], ["y"], trees=4, depth=3, least=2)
    both = fusion.forest(X.predicted(frame, ["a"], grown, ["p"]), F.array("a"), grown.flat(0)).collect()
    assert all(abs(r["p"] - r["prediction"]) < 1e-12 for r in both)
