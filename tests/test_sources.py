"""Readers of labelled pairs and folders, and the writer of JSON lines."""

import csv
import json

from lodestar.sources import candidates, sinks


def test_labelled_pairs(spark, tmp_path):
    rows = [("a, b", 'said "yes"', "Good Fit"), ("two\nlines", "", "No Fit")]
    with (tmp_path / "pairs.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["label", "resume_text", "extra", "job_description_text"])
        out.writerows((label, one, "x", other) for one, other, label in rows)
    got = sorted((r["resume_text"], r["job_description_text"] or "", r["label"]) for r in candidates.read_pairs(spark, str(tmp_path / "pairs.csv")).collect())
    assert got == sorted(rows)


def test_folders_of_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f'{k},"two, {k}"\n' for k in range(9)))
    (tmp_path / "in" / "b.csv").write_text("x\n1\n")
    (tmp_path / "in" / "large.csv").write_text("x\n" + "1\n" * 5000)
    (tmp_path / "c.txt").write_text("x\n1\n")
    got = {}
    for r in candidates.read_folder(spark, str(tmp_path), 1000, 4).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["text"].split())
    assert {k: sorted(v) for k, v in got.items()} == {"a.csv": [[str(k), "two", str(k)] for k in range(4)], "b.csv": [["1"]]}


def test_json_lines_have_sorted_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, 'q"', 3)], "z long, a string, m long")
    sinks.write_json_lines(rows, str(tmp_path / "out"))
    lines = sorted(line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())
    assert [list(json.loads(x)) for x in lines] == [["a", "z"], ["a", "m", "z"]] or [list(json.loads(x)) for x in lines] == [["a", "m", "z"], ["a", "z"]]
    assert {tuple(json.loads(x).items()) for x in lines} == {(("a", "é"), ("z", 1)), (("a", 'q"'), ("m", 3), ("z", 2))}
