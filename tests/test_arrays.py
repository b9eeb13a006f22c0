"""Elements of JSON arrays cut by bytes, against the standard parser."""

import json
import random

import pytest

from lodestar.sources import arrays, candidates


def odd_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "x", "\n", "日"]) for _ in range(rng.randint(0, 12)))
    if kind == 1:
        return rng.choice([None, True, 1.5, -3])
    if kind in (2, 3):
        return "plain " * rng.randint(0, 4)
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b}", 'c"', "d,"]) + str(k): odd_value(rng, depth + 1) for k in range(rng.randint(0, 3))}


def read(spark, path):
    rows = sorted((r["ordinal"], r["value"]) for r in arrays.elements(spark, str(path)).collect())
    assert [o for o, _ in rows] == list(range(len(rows)))
    return [json.loads(v) for _, v in rows]


@pytest.mark.parametrize("size", [150, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_split(spark, tmp_path, size, indent):
    rng = random.Random(size)
    want = [{"k": odd_value(rng), "n": k} for k in range(12)] + [{}, {"text": "z" * 700}]
    path = tmp_path / "a.json"
    path.write_text("﻿ " + json.dumps(want, indent=indent, ensure_ascii=bool(indent)) + "\n ")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert read(spark, path) == want
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("text,want", [("[]", []), (" [ \n ] ", []), ("[{}]", [{}]), ('[1, "a}b", [2, {"c": 3}]]', [1, "a}b", [2, {"c": 3}]])])
def test_small_arrays(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    assert read(spark, tmp_path / "a.json") == want


@pytest.mark.parametrize("text", ['{"a": 1}', "", "x", "[{}", '[{"a": "b]', "[{}, ]", "[,{}]", "[{}]]", "[{}"])
def test_what_isnt_an_array_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    if text:
        with pytest.raises(Exception):
            read(spark, tmp_path / "a.json")
    else:
        assert read(spark, tmp_path / "a.json") == []


def test_splits_are_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"candidate_id": f"c{k}", "pad": "x" * 1000} for k in range(2000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = candidates.read_candidates(spark, str(path))
        assert [r["candidate_id"] for r in rows.orderBy("ordinal").collect()] == [f"c{k}" for k in range(2000)]
        assert [r["ordinal"] for r in candidates.read_candidates(spark, str(path), 3).orderBy("ordinal").collect()] == [0, 1, 2]
        parts = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 15
