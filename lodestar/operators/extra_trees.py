"""Extremely randomised regression trees, grown level by level on the cluster.

Each node tries `features` inputs drawn at random, each at one cut drawn evenly between the least and the greatest value
that the node's rows have there, and takes the cut that lowers the squared error most; rows aren't resampled. All trees
of all heads grow at once. A level takes two passes over the rows: one finds the ranges of the drawn inputs in each node,
the other, once cuts are drawn from them, the counts and sums on their left sides. What comes to the driver in a pass is a
row for each open node and drawn input. Draws are digests of (seed, head, tree, node, input), so a model doesn't depend on
how rows are dealt. Targets are summed in whole numbers of 2 ** -30, so not
on their order either; a task's sum of a node is below 2 ** 33.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.staging import ship, spread, staged

#: Numbers from a pass that are held for open nodes: with more, a level is grown by parts of its trees.
HELD = 1 << 21
#: Rows that a task looks at together: what a node costs besides its rows is paid for each of its chunks.
CHUNK = 1 << 17
_UNIT = float(1 << 30)


def draw(*parts) -> float:
    """A number in [0, 1)."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:6], "big") / float(1 << 48)


def tried(seed: int, head: int, tree: int, node: int, inputs: int, features: int) -> list[int]:
    """The inputs that a node tries."""
    return sorted(range(inputs), key=lambda f: (draw(seed, head, tree, node, "input", f), f))[:features]


class Trees:
    """Trees of several heads as arrays; node numbers are places, -1 in feature marks a leaf."""

    def __init__(self, heads: int, trees: int) -> None:
        self.heads, self.trees = heads, trees
        self.feature = [[[-1] for _ in range(trees)] for _ in range(heads)]
        self.threshold = [[[0.0] for _ in range(trees)] for _ in range(heads)]
        self.left = [[[0] for _ in range(trees)] for _ in range(heads)]
        self.right = [[[0] for _ in range(trees)] for _ in range(heads)]
        self.value = [[[0.0] for _ in range(trees)] for _ in range(heads)]

    def split(self, h: int, t: int, node: int, feature: int, threshold: float) -> tuple[int, int]:
        below = len(self.feature[h][t])
        for table, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            table[h][t] += [empty, empty]
        self.feature[h][t][node], self.threshold[h][t][node] = feature, threshold
        self.left[h][t][node], self.right[h][t][node] = below, below + 1
        return below, below + 1

    def flat(self, h: int) -> list[dict[str, list]]:
        """A head's trees in the form that `fusion.forest` takes."""
        return [{k: getattr(self, k)[h][t] for k in ("feature", "threshold", "left", "right", "value")} for t in range(self.trees)]

    def place(self, h: int, t: int, x: np.ndarray) -> np.ndarray:
        """The node that each row of x has come to."""
        feature, threshold = np.array(self.feature[h][t]), np.array(self.threshold[h][t])
        below = np.column_stack((self.right[h][t], self.left[h][t]))
        leaf = feature < 0
        below[leaf] = np.flatnonzero(leaf)[:, None]  # a row stays in its leaf
        feature, below, values = np.where(leaf, 0, feature), below.ravel(), np.ascontiguousarray(x).ravel()
        node, first = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1]
        while not leaf.take(node).all():
            node = below.take(2 * node + (values.take(first + feature.take(node)) <= threshold.take(node)))
        return node


def _chunks(batches: Iterator[pa.RecordBatch], inputs: int, heads: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of CHUNK rows or a few more at a time."""
    held: list[pa.RecordBatch] = []

    def stacked() -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        held.clear()
        both = [np.column_stack([table.column(k).to_numpy() for k in range(low, high)]).astype(float) for low, high in ((0, inputs), (inputs, inputs + heads))]
        return both[0], both[1]

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield stacked()
    if sum(x.num_rows for x in held):
        yield stacked()


def _by_node(grown: Trees, x: np.ndarray, y: np.ndarray, h: int, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that take part in a head, by the node that they have come to in a tree."""
    there = np.flatnonzero(~np.isnan(y[:, h]))
    at = grown.place(h, t, x[there])
    order = np.argsort(at.astype(np.uint16) if len(grown.feature[h][t]) <= 1 << 16 else at, kind="stable")  # few nodes are sorted by radix
    ordered = at[order]
    starts = np.flatnonzero(np.concatenate((ordered[:1] >= 0, ordered[1:] != ordered[:-1])))
    yield from zip(ordered[starts].tolist(), np.split(there[order], starts[1:]))


def _told(rows: dict[tuple, list], kinds: tuple[pa.DataType, pa.DataType], names: list[str]) -> pa.RecordBatch:
    keys = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], *[pa.array([v[i] for v in rows.values()], kinds[i]) for i in range(2)]], names=["h", "t", "node", "f", *names])


def _stretches(grown: Trees, inputs: int, todo: dict[tuple[int, int], dict[int, list[int]]]):
    """By open node and tried input: the least and the greatest value of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[float]] = {}
        for x, y in _chunks(batches, inputs, grown.heads):
            columns = np.ascontiguousarray(x.T)
            for (h, t), nodes in todo.items():
                for node, own in _by_node(grown, x, y, h, t):
                    for f in nodes.get(node, ()):
                        values = columns[f].take(own)
                        low, high = float(values.min()), float(values.max())
                        held = found.setdefault((h, t, node, f), [low, high])
                        held[:] = min(held[0], low), max(held[1], high)
        yield _told(found, (pa.float64(), pa.float64()), ["low", "high"])

    return run


def _sides(grown: Trees, inputs: int, cuts: dict[tuple[int, int], dict[int, dict[int, float]]]):
    """By open node and cut: rows and sums of targets, of all rows (input -1) and of those left of the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for x, y in _chunks(batches, inputs, grown.heads):
            columns = np.ascontiguousarray(x.T)
            for (h, t), nodes in cuts.items():
                for node, own in _by_node(grown, x, y, h, t):
                    if (by := nodes.get(node)) is None:
                        continue
                    units = np.rint(y[own, h] * _UNIT).astype(np.int64)
                    for f in (-1, *by):
                        left = columns[f].take(own) <= by[f] if f >= 0 else np.ones(len(own), bool)
                        held = sums.setdefault((h, t, node, f), [0, 0])
                        held[0] += int(np.count_nonzero(left))
                        held[1] += int(units @ left)
        yield _told(sums, (pa.int64(), pa.int64()), ["n", "total"])

    return run


def _better(whole: tuple[int, int], left: tuple[int, int], least: int) -> float | None:
    """By how much a cut lowers the squared error, or None if a side is too small."""
    (n, total), (m, part) = whole, left
    if m < max(least, 1) or n - m < max(least, 1):
        return None
    total, part = total / _UNIT, part / _UNIT
    return part**2 / m + (total - part) ** 2 / (n - m) - total**2 / n


def fit(rows: DataFrame, inputs: list[str], targets: list[str], trees: int = 30, depth: int = 6, least: int = 5, features: int | None = None, seed: int = 100) -> Trees:
    """Trees for each target; a row whose target is null takes no part in that head, a null input counts as 0.

    least: rows of a leaf at least. features: inputs that a node tries, a third of them if not given. A node of which no
    tried cut leaves enough rows on both sides, or none lowers the error, is a leaf, with the mean of its rows.
    """
    spark = rows.sparkSession
    ship(spark.sparkContext)
    features = min(len(inputs), features or max(1, len(inputs) // 3))
    table = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(inputs)], *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(targets)])
    table = spread(staged(table, "training"))
    grown = Trees(len(targets), trees)
    open_nodes = {(h, t): [0] for h in range(len(targets)) for t in range(trees)}
    for level in range(depth + 1):
        following: dict[tuple[int, int], list[int]] = {}
        part: dict[tuple[int, int], list[int]] = {}
        held = 0
        for k, (tree, nodes) in enumerate(list(open_nodes.items())):
            part[tree] = nodes
            held += len(nodes) * features * 4
            if held > HELD or k == len(open_nodes) - 1:
                following |= _level(table, grown, part, len(inputs), features, least, seed, level == depth)
                part, held = {}, 0
        open_nodes = {k: v for k, v in following.items() if v}
        if not open_nodes:
            break
    return grown


def _level(table: DataFrame, grown: Trees, nodes: dict[tuple[int, int], list[int]], inputs: int, features: int, least: int, seed: int, last: bool) -> dict[tuple[int, int], list[int]]:
    """Splits open nodes or makes leaves of them; gives the nodes that are open then."""
    cuts: dict[tuple[int, int], dict[int, dict[int, float]]] = {k: {n: {} for n in v} for k, v in nodes.items()}
    if not last:
        todo = {(h, t): {n: tried(seed, h, t, n, inputs, features) for n in own} for (h, t), own in nodes.items()}
        found = table.mapInArrow(_stretches(grown, inputs, todo), "h int, t int, node int, f int, low double, high double")
        for r in found.groupBy("h", "t", "node", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("high > low").collect():
            h, t, n, f = r["h"], r["t"], r["node"], r["f"]
            cuts[h, t][n][f] = r["low"] + (r["high"] - r["low"]) * draw(seed, h, t, n, "cut", f)
    sums = table.mapInArrow(_sides(grown, inputs, cuts), "h int, t int, node int, f int, n long, total long")
    by: dict[tuple, dict[int, tuple[int, int]]] = {}
    for r in sums.groupBy("h", "t", "node", "f").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        by.setdefault((r["h"], r["t"], r["node"]), {})[r["f"]] = r["n"], int(r["total"])
    following: dict[tuple[int, int], list[int]] = {k: [] for k in nodes}
    for (h, t, node), found in sorted(by.items()):
        whole = found.pop(-1)
        gains = [(_better(whole, left, least), -f) for f, left in found.items()]
        gain, f = max(((g, f) for g, f in gains if g is not None and g > 1e-12), default=(None, 0))
        if gain is None:
            grown.value[h][t][node] = whole[1] / _UNIT / whole[0]
        else:
            following[h, t] += grown.split(h, t, node, -f, cuts[h, t][node][-f])
    return following


def predicted(rows: DataFrame, inputs: list[str], grown: Trees, names: list[str]) -> DataFrame:
    """rows with each head's mean over its trees."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs]

    @F.pandas_udf("array<double>")
    def predict(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        means = np.zeros((len(x), grown.heads))
        for h in range(grown.heads):
            for t in range(grown.trees):
                means[:, h] += np.array(grown.value[h][t])[grown.place(h, t, x)]
        return pd.Series(list(means / grown.trees))

    told = free(rows, "__told")
    return rows.withColumn(told, predict(*columns)).withColumns({name: F.col(told)[h] for h, name in enumerate(names)}).drop(told)


def free(rows: DataFrame, name: str) -> str:
    """A name for a column beside those of rows."""
    while name in rows.columns:
        name = f"_{name}"
    return name
