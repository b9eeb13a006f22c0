"""All heads of a forest are asked in one pass over the rows."""

import re

from lodestar.operators import extra_trees


def test_heads_share_one_pass(spark):
    grown = extra_trees.Trees(3, 2)
    for h in range(3):
        for t in range(2):
            left, right = grown.split(h, t, 0, t, 0.5 * h)
            grown.value[h][t][left], grown.value[h][t][right] = 1.0 + h, 5.0 + t
    rows = spark.createDataFrame([(0.0, 1.0, 7), (0.6, None, 8), (2.0, 0.2, 9)], "a double, b double, __told int")
    out = extra_trees.predicted(rows, ["a", "b"], grown, ["p0", "p1", "p2"])
    assert len(set(re.findall(r"pythonUDF\d+", out._jdf.queryExecution().toString()))) <= 1
    leaf = lambda h, t, x: 1.0 + h if x <= 0.5 * h else 5.0 + t
    for r in out.collect():
        assert [r[f"p{h}"] for h in range(3)] == [(leaf(h, 0, r["a"]) + leaf(h, 1, r["b"] or 0.0)) / 2 for h in range(3)]
        assert r["__told"] in (7, 8, 9)
