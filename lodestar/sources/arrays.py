"""The elements of large JSON arrays, read by many tasks.

A file is split by bytes as text is, its pieces ending at closing braces. Where an element begins depends on what stands
before a split: whether it starts within a string, and at which depth. So a first pass tells for each split, from each
state in which it may begin, the state in which it ends and by how much the depth changes; put together in order
they give each split's beginning (a row for each split and state comes to the driver). A second pass cuts elements at
the commas of depth one. An element that crosses splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.staging import ship, staged

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_REST = r'[^"\\]*(?:\\.[^"\\]*)*'
_SIGN = re.compile(rf'"{_REST}(?:"|\\?\Z)|[\[\]{{}},]', re.S)
_STRING = re.compile(rf'{_REST}("|\\?\Z)', re.S)
_WRONG = "the file must hold a JSON array of objects"


def _after_string(text: str, at: int) -> tuple[int, int]:
    """From within a string: where it ends, and the state there."""
    m = _STRING.match(text, at)
    return m.end(), OUTSIDE if m[1] == '"' else ESCAPED if m[1] else INSIDE


def signs(text: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(place, sign, state after it) of brackets and commas outside strings, and at last (length, "", state at the end)."""
    at = 0
    if state == ESCAPED and text:
        at, state = 1, INSIDE
    if state == INSIDE and text[at:]:
        at, state = _after_string(text, at)
    if state == OUTSIDE:
        for m in _SIGN.finditer(text, at):
            if m[0][0] == '"':
                _, state = _after_string(text, m.start() + 1)
                if state != OUTSIDE:
                    break
            else:
                yield m.start(), m[0], OUTSIDE
    yield len(text), "", state


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By split and state at its start: the state at its end and the change of depth."""
    found: dict[tuple[str, int], list[list[int]]] = {}
    for b in batches:
        for text, file, block in zip(*(b.column(k).to_pylist() for k in range(3))):
            ends = found.setdefault((file, block), [[s, 0] for s in range(3)])
            for end in ends:
                for _, sign, state in signs(text + "}", end[0]):
                    if sign in "[{":
                        end[1] += bool(sign)
                    elif sign in "]}":
                        end[1] -= 1
                end[0] = state
    rows = [(file, block, s, *end) for (file, block), ends in found.items() for s, end in enumerate(ends)]
    cols = list(zip(*rows)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["file", "block", "start", "stop", "depth"])


def _cut(begins: dict[tuple[str, int], tuple[int, int]]):
    """Parts of elements: file, block, number within the split, text, and whether the part begins and ends its element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, depth, number, opened, held = None, OUTSIDE, 0, 0, False, []

        def closed(whole: bool) -> tuple:
            text = "".join(held)
            held.clear()
            return *split, number, text, opened, whole

        for b in batches:
            out = []
            for text, file, block in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (file, block) != split:
                    if split and held:
                        out.append(closed(False))
                    split, number = (file, block), 0
                    state, depth = begins[split]
                    opened = False
                    if block == 0:
                        text = text.removeprefix("﻿")
                        if not text.lstrip().startswith("["):
                            raise ValueError(_WRONG)
                text += "}"
                start = 0
                for at, sign, state in signs(text, state):
                    if sign and sign in "[{":
                        depth += 1
                        if depth == 1 and sign == "[":
                            start, opened = at + 1, True
                    elif depth == 1 and sign and sign in ",]":
                        held.append(text[start:at])
                        out.append(closed(True))
                        number, start, opened = number + 1, at + 1, True
                        depth -= sign == "]"
                    elif sign and sign in "]}":
                        depth -= 1
                if depth > 0:
                    held.append(text[start:])
            yield _parts(out)
        if split and held:
            yield _parts([closed(False)])

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "block", "number", "text", "opened", "whole"])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of the elements of a JSON array, or of arrays in several files in order of path; a file that isn't one whole array fails."""
    ship(spark.sparkContext)
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = text.mapInArrow(_changed, "file string, block long, start int, stop int, depth long").collect()
    change = {(r["file"], r["block"], r["start"]): (r["stop"], r["depth"]) for r in rows}
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    file, state, depth = None, OUTSIDE, 0
    for split in [*sorted({k[:2] for k in change}), (None, 0)]:
        if split[0] != file:
            if file is not None and (state != OUTSIDE or depth != -1):  # the last piece has a brace too many
                raise ValueError(_WRONG)
            file, state, depth = split[0], OUTSIDE, 0
        if file is not None:
            begins[split] = state, depth
            state, more = change[(*split, state)]
            depth += more
    parts = text.mapInArrow(_cut(begins), "file string, block long, number long, text string, opened boolean, whole boolean")
    parts = staged(parts, "elements")
    # A split's count of elements that end in it gives the number of the first that ends in the next one.
    ends = parts.groupBy("file", "block").agg(F.count_if("whole").alias("n")).collect()  # a row for each split
    upto, before = 0, {}
    for r in sorted(ends, key=lambda r: (r["file"], r["block"])):
        before[r["file"], r["block"]] = upto
        upto += r["n"]
    if not before:
        return spark.createDataFrame([], "ordinal long, value string")
    first = spark.createDataFrame([(*k, n) for k, n in before.items()], "file string, block long, before long")
    placed = parts.join(F.broadcast(first), ["file", "block"]).withColumn("at", F.col("before") + F.col("number"))  # a row for each split
    inner = placed.where("opened AND whole").select("at", _stripped(F.col("text")).alias("value"))
    crossing = placed.where("NOT (opened AND whole)").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("file", "block", "text"))).alias("p")).select("at", _stripped(F.concat_ws("", F.transform("p", lambda x: x["text"]))).alias("value"))
    every = inner.union(crossing)
    blank = every.where("value = ''").limit(2).collect()  # an array without elements has one blank part
    if blank:
        if upto > 1:
            raise ValueError(_WRONG)
        return spark.createDataFrame([], "ordinal long, value string")
    return every.withColumnRenamed("at", "ordinal")
