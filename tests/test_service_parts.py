"""Rate limits, states and progress."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestar.sources import states
from lodestar.sources.states import StateTable
from lodestar.streaming import limits
from lodestar.streaming.limits import Limiter, Rate
from lodestar.streaming.progress import Board, StreamProgress


# ---- rate limits ----------------------------------------------------------------------------------------------------
def slow(events, rate):
    """From (ident, key, time): (ident, allowed, retry_after) by looking at all earlier allowed ones."""
    out, allowed = [], {}
    for ident, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        inside = [t for t in allowed.get(key, []) if t >= at - rate.window]
        if len(inside) < rate.limit or rate.limit <= 0:
            allowed.setdefault(key, []).append(at)
            out.append((ident, True, 0))
        else:
            out.append((ident, False, max(1, int(inside[0] + rate.window - at))))
    return sorted(out)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c"]), 1_700_000_000 + rng.randint(0, 4000)) for k in range(900)]
    return rows, spark.createDataFrame(rows, "event_id long, client string, s long").select("event_id", "client", F.timestamp_seconds("s").alias("ts"))


def test_limits_of_a_table(events):
    rows, frame = events
    for rate in (Rate(3, 60.0), Rate(1, 500.0), Rate(50, 30.0), Rate(0, 30.0)):
        assert sorted(tuple(r) for r in limits.limited(frame.repartition(5), rate, ["client"]).select("event_id", "allowed", "retry_after").collect()) == slow(rows, rate)
    assert limits.limited(frame.limit(0), Rate(1, 1.0), ["client"]).collect() == []


def test_a_stream_that_comes_shuffled_agrees(spark, events, tmp_path):
    rows, frame = events
    rate, rng = Rate(3, 60.0), random.Random(4)
    parts = sorted(rows, key=lambda r: r[2] + rng.randint(0, 500))  # up to 500 seconds out of order
    for k in range(6):
        part = spark.createDataFrame(parts[k * 150 : k * 150 + 150], "event_id long, client string, s long")
        part.select("event_id", "client", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(10_000, "z", 1_700_100_000), (10_001, "z", 1_700_200_000)], "event_id long, client string, s long")
    last.select("event_id", "client", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    board = Board(spark)
    listener = StreamProgress(board)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        decided = limits.limited_stream(stream, rate, ["client"], late="20 minutes")
        query = decided.writeStream.format("parquet").queryName("limits").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        said = board.wait("limits", 0, 20)
        while not said.get("ended"):
            said = board.wait("limits", said["version"], 20)
    finally:
        spark.streams.removeListener(listener)
    got = sorted((r["event_id"], r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["event_id"] < 10_000)
    assert got == slow(rows, rate)
    assert said["status"] == "done" and said["rows"] == 902 and said["batches"] >= 7


def test_limiter_by_key():
    asks = Limiter(Rate(2, 10.0))
    assert [asks.ask(("a", "x"), t) for t in (0, 1, 2, 9, 10.5, 12)] == [None, None, 8, 1, None, None]
    assert asks.ask(("b", "x"), 2) is None and asks.ask(("c", "y"), 200) is None
    assert set(asks.held) == {("c", "y")}
    assert Rate(2, 10.0).decide(deque([1, 5]), 6) == 5


# ---- states ---------------------------------------------------------------------------------------------------------
SCHEMA = "job_id string, ts double, status string"


def rows_of(table):
    return {r["job_id"]: r["status"] for r in table.read().collect()}


def test_states_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(states, "COMPACT", 5)
    table, want = StateTable(spark, str(tmp_path / "t"), SCHEMA, "job_id", "ts"), {}
    assert rows_of(table) == {} and table.get("x") is None
    rng = random.Random(1)
    for k in range(33):
        job = f"j{rng.randint(0, 6)}"
        if k % 7 == 6:
            table.delete(job, float(k))
            want.pop(job, None)
        else:
            table.put(job_id=job, ts=float(k), status=f"s{k}")
            want[job] = f"s{k}"
    assert rows_of(table) == want
    assert rows_of(StateTable(spark, str(tmp_path / "t"), SCHEMA, "job_id", "ts")) == want
    assert len(table._names("log")) <= 10 and len(table._names("snapshots")) <= 2 and len(table._names("manifests")) <= 2
    table.put(job_id="old", ts=-1.0, status="late")
    table.put(job_id="j0", ts=-5.0, status="late")  # a change that is older than what is there
    assert rows_of(table) == want | {"old": "late"} | ({} if "j0" in want else {"j0": "late"})


def test_the_oldest_states_go(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, "job_id", "ts", most=2)
    for k in range(4):
        table.put(job_id=f"j{k}", ts=float(k), status="x")
    table.compact()
    assert set(rows_of(table)) == {"j2", "j3"}


@pytest.mark.parametrize("method,call", [(m, n) for m in ("move", "create", "delete", "write") for n in range(1, 5)])
def test_a_crash_between_steps_leaves_the_table_readable(spark, tmp_path, monkeypatch, method, call):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, "job_id", "ts")
    for k in range(6):
        table.put(job_id=f"j{k % 4}", ts=float(k), status=f"s{k}")
        if k == 3:
            table.compact()
    table.delete("j1", 9.0)
    want, left = rows_of(table), [call]

    class Stop(Exception):
        pass

    def count(f):
        def run(*a, **k):
            left[0] -= 1
            if left[0] == 0:
                raise Stop
            return f(*a, **k)

        return run

    class Fs:
        def __getattr__(self, name):
            f = getattr(inner, name)
            return count(f) if name == method else f

    inner, table.fs = table.fs, Fs()
    if method == "move":
        monkeypatch.setattr(table.store, "move", count(table.store.move))
    if method == "write":
        monkeypatch.setattr(table, "_write", count(table._write))
    try:
        table.compact()
    except Stop:
        pass
    again = StateTable(spark, str(tmp_path / "t"), SCHEMA, "job_id", "ts")
    assert rows_of(again) == want
    again.compact()
    again.compact()
    assert rows_of(again) == want and len(again._names("log")) == 0 and len(again._names("snapshots")) <= 2


# ---- service --------------------------------------------------------------------------------------------------------
def test_service_limits_and_faults(spark, tmp_path, monkeypatch):
    from lodestar import service as S

    service = S.Service(spark, str(tmp_path / "shared"), rate=Rate(2, 1000.0))
    ask = lambda path, query=None, body=b"", **k: service.answer("POST", path, query, body, **k)
    assert ask("/api/rank", {"top_k": str(S.TOP_ROWS + 1)})[0] == 422

    def never():
        raise AssertionError("read")

    assert ask("/api/rank", {}, never, client="b", size=S.UPLOAD_BYTES + 1)[0] == 413
    assert ask("/api/rank", {"name": "a.json"}, b'{"not": "an array"}')[0] == 422
    status, _, out = ask("/api/rank", {}, never, size=3)
    assert status == 429 and 990 <= json.loads(out)["retry_after"] <= 1000
    monkeypatch.setattr(service, "rank", lambda *a: 1 / 0)
    assert ask("/api/rank", client="c")[0] == 500
    text = service.answer("GET", "/metrics")[2]
    assert 'requests_total{route="api/rank",status="500"} 1' in text and 'status="429"} 1' in text


def test_listeners_cost_no_job(spark, tmp_path):
    from lodestar.service import Service

    service = Service(spark, str(tmp_path / "shared"))
    service.tell("a" * 32, "running")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    events = service.stream("a" * 32, pause=0.01)
    first = [json.loads(next(events)[6:]) for _ in range(5)]
    assert all(e["status"] == "running" and e["tasks"] == 0 for e in first)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    service.tell("a" * 32, "done")
    assert json.loads(list(events)[-1][6:])["status"] == "done"
    other = Service(spark, str(tmp_path / "shared"))  # another process: from the table
    assert json.loads(list(other.stream("a" * 32))[-1][6:])["status"] == "done"
