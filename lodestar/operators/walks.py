"""A walk over majorities of many items without all pairs of them.

Each voter's order is cut into ranges, and an item's cell tells its range by every voter. Two items that share no range
are compared by their cells alone: what a range of the first voter gets from other cells is found by tables of mass over
the cells of the other voters, voter by voter. Pairs that share a range are compared themselves, at the first voter where
they do, and leave a bit each, kept by the executors in memory or on disk. With n items, v voters and r ranges that is about
v * n**2 / r bits, and r**v cells in a step; r is chosen so that neither outweighs the other, so for four voters work
and bits grow with about n**(5/3). A voter that leaves out an item has no say in its pairs; such items form a range more.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import SparkSession

from lodestar.sources.staging import ship

#: Cells of all voters at most.
CELLS = 1 << 24
#: Pairs that leave bits, 2 GB of bits over all tasks; where there would be more, the items are refused, none are left out.
MOST = 16_000_000_000
#: Bytes of bits in a row, and givers that are compared at once.
HELD, GIVERS = 1 << 23, 256


def received(bits: np.ndarray, mass: np.ndarray, n: int) -> np.ndarray:
    """What items get in one step: an n-th of the mass of each giver. For eight givers, a row of bits, all sums are made once."""
    eights = np.zeros((len(bits), 8))
    eights.reshape(-1)[: len(mass)] = mass / n
    sums = eights @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(float)
    out = np.zeros(bits.shape[1])
    for row, byte in zip(sums, bits):
        out += row.take(byte)
    return out


class Cells:
    """Places of items (by voters, NaN: left out) as numbers and ranges, and what each tells of majorities."""

    def __init__(self, places: np.ndarray, ranges: int | None = None) -> None:
        self.n, self.voters = places.shape
        self.least = self.voters // 2 + 1
        if ranges is None:
            ranges = int(min((self.n**2 / 3) ** (1 / (self.voters + 2)), CELLS ** (1 / self.voters)))
            ranges = 1 if ranges < 2 * self.voters else ranges
        there = ~np.isnan(places)
        self.number = np.full(places.shape, -1, np.int32)  # equal places have one
        self.range = np.full(places.shape, ranges if ranges > 1 else 0, np.int16)
        for v in range(self.voters):
            at = np.flatnonzero(there[:, v])
            if len(at):
                _, number, counts = np.unique(places[at, v], return_inverse=True, return_counts=True)
                self.number[at, v] = number
                self.range[at, v] = ((counts.cumsum() - counts) * ranges // len(at))[number]
        self.size = ranges + (ranges > 1 and not there.all())
        #: Items' cells by all voters but the first.
        self.cell = np.zeros(self.n, np.int32)
        for v in range(1, self.voters):
            self.cell = self.cell * np.int32(self.size) + self.range[:, v]
        x, y = np.indices((self.size, self.size))
        #: By range of an item and of a giver: whether the giver is behind, and whether it is elsewhere but not behind.
        self.behind = ((y > x) & (y < ranges)).astype(float)
        self.other = (x != y) - self.behind

    def members(self, voter: int, part: int) -> np.ndarray:
        return np.flatnonzero(self.range[:, voter] == part)

    def work(self) -> list[tuple[int, int, int, int]]:
        """(voter, range, low, high) for items low to high of a range that are compared in it; voter -1: by cells."""
        counts = [np.bincount(self.range[:, v], minlength=self.size).tolist() for v in range(self.voters)]
        if (pairs := sum(c * c for each in counts for c in each)) > MOST:
            raise ValueError(f"majorities of {self.n} items need a bit for each of {pairs} pairs; at most {MOST}")
        out = [(-1, part, 0, c) for part, c in enumerate(counts[0]) if c and self.size > 1]
        for v, each in enumerate(counts):
            for part, c in enumerate(each):
                wide = max(1, HELD * 8 // max(1, c))
                out += [(v, part, low, min(c, low + wide)) for low in range(0, c, wide)]
        return out

    def bits(self, voter: int, part: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits (by eight givers of the range, then item low to high of it), and how many of these items stand before each giver."""
        givers = self.members(voter, part)
        items = givers[low:high]
        better, out = np.zeros(len(givers), np.int64), np.empty((-(-len(givers) // 8), len(items)), np.uint8)
        to = np.where(self.number[items] < 0, np.iinfo(np.int32).max, self.number[items]).T.copy()
        ranges = self.range[items, :voter].T.copy()
        for start in range(0, len(givers), GIVERS):
            own = givers[start : start + GIVERS]
            count = np.zeros((len(own), len(items)), np.int8 if self.voters < 128 else np.int32)
            for giver, item in zip(self.number[own].T, to):
                count += giver[:, None] > item[None, :]
            most = count >= self.least
            for giver, item in zip(self.range[own, :voter].T, ranges):
                most &= giver[:, None] != item[None, :]
            better[start : start + len(own)] = most.sum(1)
            out[start // 8 : start // 8 + -(-len(own) // 8)] = np.packbits(most, axis=0)
        return out, better

    def by_cells(self, part: int, mass: np.ndarray, turned: bool = False) -> np.ndarray:
        """Mass that items of a range of the first voter get from those that share no range with them; turned: from those before, not behind, them."""
        behind, other = (m.T if turned else m for m in (self.behind, self.other))
        shape = (self.size,) * (self.voters - 1)
        cell, first, cells = self.cell, self.range[:, 0], self.size ** len(shape)
        #: Tables by how many voters so far have the giver behind, as many as needed or more counting as one.
        tables = {}
        for count, told in ((0, other), (1, behind)):
            if count + len(shape) >= self.least:
                at = (told[part] > 0)[first]
                tables[min(count, self.least)] = np.bincount(cell[at], mass[at], cells)

        def along(matrix: np.ndarray, table: np.ndarray, axis: int) -> np.ndarray:
            after = self.size ** (len(shape) - 1 - axis)
            if after == 1:
                return (table.reshape(-1, self.size) @ matrix.T).ravel()
            return (matrix @ table.reshape(-1, self.size, after)).ravel()

        for axis in range(len(shape)):
            new: dict[int, np.ndarray] = {}
            for count, table in tables.items():
                for to, matrix in [(count, other + behind)] if count == self.least else [(count, other), (count + 1, behind)]:
                    if to + len(shape) - 1 - axis >= self.least:
                        new[to] = new.get(to, 0) + along(matrix, table, axis)
            tables = new
        return tables[self.least][cell[first == part]]


class Walk:
    """Steps of mass: an item gives an n-th of its own to each item that most voters place before it, and keeps the rest."""

    def __init__(self, spark: SparkSession, places: np.ndarray, ranges: int | None = None) -> None:
        context = spark.sparkContext
        ship(context)
        self.context, self.n, cells = context, len(places), Cells(places, ranges)
        work, parts = cells.work(), context.defaultParallelism
        self.work = work = [w for k in range(parts) for w in work[k::parts]]  # each task gets a share of all kinds
        self.at = [cells.members(max(voter, 0), part) for voter, part, _, _ in work]
        shared = self.shared = context.broadcast((cells, work))

        def compare(k: int) -> tuple[int, bytes, np.ndarray]:
            cells, work = shared.value
            voter, part, low, high = work[k]
            if voter < 0:
                return k, b"", cells.by_cells(part, np.ones(cells.n), turned=True)
            bits, better = cells.bits(voter, part, low, high)
            return k, bits.tobytes(), better

        self.pairs = context.parallelize(range(len(work)), min(parts, len(work))).map(compare).persist(StorageLevel.MEMORY_AND_DISK)
        self.better = np.zeros(self.n)
        for k, better in self.pairs.map(lambda row: (row[0], row[2])).collect():  # of all items of a range, before some of which they stand
            self.better[self.at[k]] += better

    def step(self, mass: np.ndarray) -> np.ndarray:
        given, shared = self.context.broadcast(mass), self.shared

        def got(row: tuple[int, bytes, np.ndarray]) -> tuple[int, np.ndarray]:
            (cells, work), k = shared.value, row[0]
            voter, part, low, high = work[k]
            if voter < 0:
                return k, cells.by_cells(part, given.value / cells.n)
            held = np.frombuffer(row[1], np.uint8).reshape(-1, high - low)
            return k, received(held, given.value[cells.members(voter, part)], cells.n)

        out = mass * (1 - self.better / self.n)
        for k, values in self.pairs.map(got).collect():
            _, _, low, high = self.work[k]
            out[self.at[k][low:high]] += values
        given.destroy()
        return out

    def close(self) -> None:
        self.pairs.unpersist()
        self.shared.destroy()
