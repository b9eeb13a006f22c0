"""Submissions, pools, matching, learning in folds, writers and streams: what the queries' SQL doesn't show."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.operators import audits as A
from lodestar.operators import studies as S
from lodestar.sources import candidates as sources
from lodestar.sources import sinks, staging
from lodestar.streaming import jobs


def test_a_missing_record_fails(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    assert A.complete_join(rows, rows.withColumn("x", F.lit(5)), "k").count() == 2
    with pytest.raises(PySparkException, match="no record for 2"):
        A.complete_join(rows, rows.where("k = 1").withColumn("x", F.lit(5)), "k").collect()


def test_submission_files(spark, tmp_path):
    good = [f"CAND_{k:07d},{k + 1},why" for k in range(100)]
    (tmp_path / "one.csv").write_text("\ufeffCandidate_ID,RANK,reasoning\n" + "\n".join(good))
    (tmp_path / "two.csv").write_text("candidate_id,rank,reasoning\n" + "\n".join(good[:99]))
    for name, accepted in (("one", True), ("two", False)):
        (row,) = A.strict_submissions(sources.read_submissions(spark, str(tmp_path / f"{name}.csv"))).collect()
        assert row["accepted"] is accepted
    (tmp_path / "bad.csv").write_text("id,rank\n1,1\n")
    with pytest.raises(ValueError, match="needs the columns"):
        sources.read_submissions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "human.csv").write_text("candidate_id,verdict\na, Strong_Fit\nb,maybe\nc,\nd,other\n")
    got = {r["candidate_id"]: r["tier"] for r in sources.read_human_labels(spark, str(tmp_path / "human.csv"), "verdict").collect()}
    assert got == {"a": 4.0, "b": 2.0}


def test_uploads_are_checked(spark, tmp_path):
    lines = "\n".join(json.dumps({"candidate_id": f"c{k}"}) for k in range(5))
    path = tmp_path / "people.jsonl"
    path.write_text(lines)
    assert sources.checked_upload(spark, str(path)).count() == 5
    assert sources.pool_ids(spark, str(path)).count() == 5
    for limits, what in (({"max_bytes": 10}, "size"), ({"max_expanded": 10}, "expanded"), ({"max_record": 10}, "record")):
        with pytest.raises(ValueError, match=what):
            sources.checked_upload(spark, str(path), **limits)
    with pytest.raises(ValueError, match="must be"):
        sources.checked_upload(spark, str(tmp_path / "people.txt"))
    array = tmp_path / "people.json"
    array.write_text(json.dumps([{"candidate_id": "a"}, {"candidate_id": "b"}]))
    assert sources.checked_upload(spark, str(array)).count() == 2
    with pytest.raises(ValueError, match="record"):
        sources.checked_upload(spark, str(array), max_record=5)
    (tmp_path / "role.txt").write_text("\ufeffSenior engineer\nPune")
    assert sources.read_role(spark, str(tmp_path / "role.txt")) == "Senior engineer\nPune"


def test_a_failed_write_leaves_what_was_there(spark, tmp_path, monkeypatch):
    path = tmp_path / "out.csv"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, rank int")
    sinks.write_ranking(rows, str(path))
    before = path.read_text()
    with pytest.raises(ValueError, match="not published"):
        sinks.write_ranking(rows.limit(1), str(path), check=lambda r: r.where("rank < 2"))
    assert path.read_text() == before
    move = sinks._Store.move

    def fails(self, source, target):
        if "part-" in source.toString():
            raise OSError("no")
        move(self, source, target)

    monkeypatch.setattr(sinks._Store, "move", fails)
    with pytest.raises(OSError, match="no"):
        sinks.write_ranking(rows.limit(1), str(path))
    assert path.read_text() == before and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.csv"]
    monkeypatch.undo()
    sinks.write_ranking(rows.limit(1), str(path), check=lambda r: r.where("rank > 5"))
    assert path.read_text().splitlines()[1:] == ["a,1"]


def test_report(spark, tmp_path):
    table = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int").orderBy("n")
    sinks.write_report({"Counts": table}, str(tmp_path / "r.md"), "A report")
    assert (tmp_path / "r.md").read_text() == "# A report\n\n## Counts\n\n| k | n |\n|-|-|\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError, match="over 1 rows"):
        sinks.write_report({"Counts": table}, str(tmp_path / "r.md"), "A report", most=1)


def test_streams_refuse_what_files_refuse(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"candidate_id": "c1"}\n{"profile": {}}\n')
    jobs.watch_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["candidate_id"][:11] for r in got.collect()} == {"c1", "UNKNOWN_ROW"}
    (folder / "b.jsonl").write_text("42\n")
    with pytest.raises(PySparkException):
        jobs.watch_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()


def test_nearest_free(spark):
    pool = spark.createDataFrame([(10, 1.0), (11, 1.1), (12, 5.0)], "k long, s double")
    drivers = spark.createDataFrame([(1, 1.04), (2, 1.0), (3, 1.0), (4, 1.0)], "k long, s double")
    assert {r["driver"]: r["match"] for r in A.nearest_free(drivers, pool, "k", "s").collect()} == {1: 10, 2: 11, 3: 12}
    with pytest.raises(ValueError, match="at most"):
        A.nearest_free(drivers, pool, "k", "s", most=3)


def test_logistic_folds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.5, -1.0] + rng.logistic(size=400) > 0.5).astype(int)
    fold = np.arange(400) % 5
    rows = spark.createDataFrame([(float(a), float(b), int(t), int(f)) for (a, b), t, f in zip(x, y, fold)], "a double, b double, y int, fold int")
    weights = A.logistic_folds(rows, ["a", "b"], "y", "fold")
    for k, w in weights.items():
        z, t = np.column_stack((np.ones(400), x))[fold != k], y[fold != k]
        balance = np.where(t == 1, len(t) / 2 / t.sum(), len(t) / 2 / (len(t) - t.sum()))
        gradient = z.T @ (balance * (t - 1 / (1 + np.exp(-z @ w)))) - np.array([0, w[1], w[2]])
        assert np.abs(gradient).max() < 1e-5  # at the optimum
    got = rows.select("y", A.out_of_fold(rows, ["a", "b"], "fold", weights).alias("p")).collect()
    assert np.mean([(r["p"] > 0.5) == r["y"] for r in got]) > 0.7


def test_strengths_at_the_optimum(spark):
    """The ridged log likelihood of judged pairs has no slope at the strengths."""
    pairs = [(0, 1, 8, 2), (1, 2, 6, 4), (0, 2, 9, 1), (2, 3, 0, 5)]
    got = {r["ident"]: r["strength"] for r in S.bradley_terry(spark.createDataFrame(pairs, "a long, b long, wins_a long, wins_b long")).collect()}
    slope = {i: -s for i, s in got.items()}
    for a, b, wa, wb in pairs:
        p = 1 / (1 + np.exp(got[b] - got[a]))
        slope[a] += wa * (1 - p) - wb * p
        slope[b] -= wa * (1 - p) - wb * p
    assert all(abs(x) < 1e-4 for x in slope.values())


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k, float(k % 3)) for k in range(200)], "k long, v double")
    one, many = (S.bootstrap(rows.repartition(n), "k", "v", 20).first() for n in (1, 7))
    assert all(abs(a - b) < 1e-9 for a, b in zip(one, many))
    assert one["low"] < one["mean"] < one["high"] and abs(one["mean"] - 1) < 0.1


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Conf(dict):
        pass

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_path(Session, "x")


def test_discarded_tables_are_gone(spark):
    df = staging.staged(spark.range(3), "gone")
    path = Path(df.staged_path.removeprefix("file:"))
    assert path.exists()
    staging.discard(df)
    assert not path.exists()


def test_quantile_groups_are_ntiles(spark):
    from pyspark.sql import Window

    from lodestar.operators import evaluation as E

    for n in (3, 10, 47):
        rows = spark.createDataFrame([(k, k * 7 % 5) for k in range(n)], "k long, v long")
        want = {r["k"]: r["t"] for r in rows.withColumn("t", F.ntile(10).over(Window.orderBy(F.desc("v"), "k"))).collect()}
        assert {r["k"]: r["q"] for r in E.quantile_groups(rows, "v", "k", 10, "q").collect()} == want


def test_pulls_by_brute_force(spark):
    from lodestar.operators import learning as L

    rng = np.random.default_rng(9)
    rows = [(g, 100 * g + i, float(rng.integers(0, 4)), float(rng.normal())) for g in range(2) for i in range(8)]
    df = spark.createDataFrame(rows, "g long, i long, y double, s double")
    for top in (3, 100):
        want = {}
        for g in range(2):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
            best = sorted((r[2] for r in mine), reverse=True)[:top]
            ideal = sum((2**y - 1) / np.log2(k + 2) for k, y in enumerate(best))
            for a in range(8):
                for b in range(8):
                    x, y = mine[a], mine[b]
                    if x[2] > y[2] and min(a, b) < top:
                        swap = abs((2 ** x[2] - 2 ** y[2]) * (1 / np.log2(a + 2) - 1 / np.log2(b + 2))) / ideal
                        rho = 1 / (1 + np.exp(x[3] - y[3]))
                        want[x[1]] = want.get(x[1], 0) + rho * swap
                        want[y[1]] = want.get(y[1], 0) - rho * swap
        got = {r["i"]: r["pull"] for r in L.lambdas(df, "g", "i", "y", "s", top).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_models_learn(spark):
    from lodestar.operators import learning as L

    rng = np.random.default_rng(10)
    x = rng.random((200, 2))
    rows = spark.createDataFrame([(k % 4, k, float(a), float(b), float(round(3 * a))) for k, (a, b) in enumerate(x)], "g long, i long, a double, b double, y double")
    score = {r["i"]: r["prediction"] for r in L.LambdaTrees(0.3, 3).fit(rows, "g", "i", ["a", "b"], "y", rounds=3, top=20).score(rows).collect()}
    right = [score[i] > score[j] for i in range(200) for j in range(200) if i % 4 == j % 4 and x[i, 0] > x[j, 0] + 0.35]
    assert np.mean(right) > 0.85


def _people(path, n):
    path.write_text("\n".join(json.dumps({"candidate_id": f"CAND_{k:07d}", "profile": {"current_title": "ML Engineer", "years_of_experience": float(k)}, "skills": [{"name": "Python", "proficiency": "expert"}]}) for k in range(n)))
    return path


def test_command_line(spark, tmp_path, capsys):
    from lodestar.__main__ import main

    out = tmp_path / "out.csv"
    assert main(["rank", "--candidates", str(_people(tmp_path / "a.jsonl", 6)), "--out", str(out), "--top-k", "4", "--release"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ranked"] == 4
    assert len(out.read_text().splitlines()) == 5
    rows = spark.createDataFrame([("a", 1, "0.5", "x"), ("a", 3, "0.7", " ")], "candidate_id string, rank int, score string, reasoning string")
    assert {(r["rank"], r["fault"]) for r in A.ranking_faults(rows, 5).collect()} == {(1, "duplicate_id"), (3, "duplicate_id"), (3, "rank_position"), (3, "score_increases"), (3, "blank_reasoning")}


def test_service(spark, tmp_path):
    from lodestar.service import Service

    service = Service(spark, str(tmp_path / "shared"))
    body = _people(tmp_path / "a.jsonl", 5).read_bytes()
    assert service.answer("GET", "/api/health")[0] == 200 and service.answer("GET", "/nothing")[0] == 404
    status, _, out = service.answer("POST", "/api/rank", {"top_k": "3"}, body)
    assert status == 200 and [r["rank"] for r in json.loads(out)["rows"]] == [1, 2, 3]
    for query, wrong, code in (({"name": "x.txt"}, body, 415), ({"top_k": "0"}, body, 422), ({}, b"42\n", 422)):
        assert service.answer("POST", "/api/rank", query, wrong)[0] == code
    job = json.loads(service.answer("POST", "/api/batch", {"top_k": "2"}, body)[2])["job_id"]
    events = list(service.answer("GET", f"/api/stream/{job}")[2])
    assert json.loads(events[-1][6:])["status"] == "done"
    assert json.loads(service.answer("GET", f"/api/batch/{job}")[2])["status"] == "done"
    assert len(json.loads(service.answer("GET", f"/api/batch/{job}/results")[2])["rows"]) == 2
    assert len(service.answer("GET", f"/api/batch/{job}/download")[2].strip().splitlines()) == 3
    assert service.answer("GET", "/api/batch/" + "0" * 32)[0] == 404
    text = service.answer("GET", "/metrics")[2]
    assert 'requests_total{route="api/rank",status="200"} 1' in text and 'jobs{status="done"} 1' in text
