"""Rankings over HTTP: small uploads at once, others as jobs that run in the background; states, counters, downloads.

`Service.answer` takes a request apart from any socket; `serve` puts it behind the standard library's server. Jobs'
states are rows of a table that is compacted (`sources.states`), so another process sees them; this process's jobs are
followed on a board that Spark's counters fill (`streaming.progress`), so listeners cost no Spark job. Rankings and
batches are limited by client and route; what is too large is refused before it is read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans import ranker
from lodestar.sources import candidates as sources
from lodestar.sources import sinks
from lodestar.sources.states import StateTable
from lodestar.streaming.limits import Limiter, Rate
from lodestar.streaming.progress import Board

ENDED = ("done", "failed")
_STATE = "job_id string, ts double, status string, detail string"
#: Rows that are ranked while the caller waits, bytes of an upload, rows of a report, jobs that are remembered, and how
#: many rankings and batches a client may ask for in so many seconds.
LIVE_ROWS, UPLOAD_BYTES, TOP_ROWS, JOBS, RATE = 500, 64 << 20, 10_000, 10_000, Rate(30, 60.0)
LIMITED = ("api/rank", "api/batch")


class Refused(Exception):
    def __init__(self, status: int, why: str, retry_after: int | None = None) -> None:
        super().__init__(why)
        self.status, self.retry_after = status, retry_after


class Service:
    def __init__(self, spark: SparkSession, folder: str, workers: int = 1, rate: Rate = RATE) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = sinks._Store(spark, self.folder)
        self.table = StateTable(spark, f"{self.folder}/states", _STATE, "job_id", "ts", JOBS)
        self.board, self.limiter = Board(spark), Limiter(rate)
        self.jobs = ThreadPoolExecutor(workers)
        self.counts: Counter[tuple[str, int]] = Counter()
        self.lock = Lock()

    # ---- states and files -------------------------------------------------------------------------------------------
    def tell(self, job: str, status: str, detail: str = "") -> None:
        self.table.put(job_id=job, ts=time.time(), status=status, detail=detail)
        self.board.tell(job, status=status, detail=detail, ended=status in ENDED)

    def states(self) -> DataFrame:
        return self.table.read()

    def state(self, job: str) -> dict:
        """From the board if the job is this process's, else from the table."""
        found = self.board.wait(job, -1, 0) or self.table.get(job)
        if found is None:
            raise Refused(404, "no such job")
        return {"job_id": job, "status": found["status"], "detail": found["detail"]}

    def admit(self, route: str, client: str, size: int) -> None:
        """Refuses a request by its route, client and size, before its body is read."""
        if size > UPLOAD_BYTES:
            raise Refused(413, f"an upload has at most {UPLOAD_BYTES} bytes")
        wait = self.limiter.ask((client, route), time.monotonic()) if route in LIMITED else None
        if wait is not None:
            raise Refused(429, f"too many requests; try again in {wait} seconds", wait)

    def keep(self, body: bytes, name: str) -> str:
        """Writes an upload into the folder; its name decides how it is read."""
        if len(body) > UPLOAD_BYTES:
            raise Refused(413, f"an upload has at most {UPLOAD_BYTES} bytes")
        name = name.replace("\\", "/").rsplit("/", 1)[-1] or "candidates.jsonl"
        if not name.lower().endswith((".jsonl", ".json", ".jsonl.gz", ".gz")):
            raise Refused(415, "an upload must be .jsonl, .json, .jsonl.gz or .gz")
        path = f"{self.folder}/uploads/{uuid.uuid4().hex}/{name}"
        out = self.store.fs.create(self.store.path(path))
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        return path

    # ---- what requests ask for --------------------------------------------------------------------------------------
    def config(self, query: dict[str, str]) -> ranker.RankerConfig:
        try:
            top_k = int(query.get("top_k", 100))
            if top_k > TOP_ROWS:
                raise ValueError(f"top_k is at most {TOP_ROWS}")
            return ranker.RankerConfig(top_k=top_k, scoring_profile=query.get("profile", "main"))
        except ValueError as e:
            raise Refused(422, str(e)) from e

    def rows(self, path: str) -> DataFrame:
        try:
            return sources.checked_upload(self.spark, path, UPLOAD_BYTES)
        except sources.TooLarge as e:
            raise Refused(413, str(e)) from e
        except Exception as e:  # what the upload holds makes the read fail
            raise Refused(422, str(e).splitlines()[0]) from e

    def rank(self, body: bytes, query: dict[str, str]) -> dict:
        """Ranks a small upload at once."""
        config = self.config(query)
        rows = self.rows(self.keep(body, query.get("name", "")))
        try:
            n = rows.limit(LIVE_ROWS + 1).count()
            if n > LIVE_ROWS:
                raise Refused(413, f"at most {LIVE_ROWS} rows are ranked at once; send a batch")
            found = ranker.report(ranker.rank_candidates(rows, config), config.top_k).orderBy("rank").collect() if n else []
        except Refused:
            raise
        except Exception as e:
            raise Refused(422, str(e).splitlines()[0]) from e
        return {"rows": [r.asDict() for r in found], "loaded": n}

    def batch(self, body: bytes, query: dict[str, str]) -> dict:
        config = self.config(query)
        path, job = self.keep(body, query.get("name", "")), uuid.uuid4().hex
        self.tell(job, "queued")

        def run() -> None:
            self.tell(job, "running")
            self.spark.sparkContext.setJobGroup(job, "ranking of an upload")
            try:
                self.rows(path)
                summary = ranker.run_ranking(self.spark, path, f"{self.folder}/results/{job}.csv", config)
                self.tell(job, "done", json.dumps(summary, sort_keys=True))
            except Exception as e:  # the job's state tells of it
                self.tell(job, "failed", str(e).splitlines()[0])

        self.jobs.submit(run)
        return {"job_id": job, "status": "queued"}

    def result(self, job: str) -> str:
        if self.state(job)["status"] != "done":
            raise Refused(409, "the job has no results yet")
        return f"{self.folder}/results/{job}.csv"

    def stream(self, job: str, pause: float = 0.5, other: float = 10.0) -> Iterator[str]:
        """Events of a job until it has ended, with the tasks done and known of; of another process's job, its state from the table, seldom."""
        version = -1
        while True:
            said = self.board.wait(job, version, pause)
            if said is None:
                state = self.state(job)
            else:
                version = said["version"]
                state = {"job_id": job, "status": said["status"], "detail": said["detail"], **self.board.tasks(job)}
            yield f"data: {json.dumps(state, sort_keys=True)}\n\n"
            if state["status"] in ENDED:
                return
            if said is None:
                time.sleep(other)

    def metrics(self) -> str:
        with self.lock:
            lines = [f'requests_total{{route="{route}",status="{status}"}} {n}' for (route, status), n in sorted(self.counts.items())]
        by = {r["status"]: r["n"] for r in self.states().groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row for each status
        return "\n".join([*lines, *(f'jobs{{status="{s}"}} {n}' for s, n in sorted(by.items())), ""])

    def answer(self, method: str, path: str, query: dict[str, str] | None = None, body: bytes | Callable[[], bytes] = b"", client: str = "", size: int | None = None) -> tuple[int, str, str | Iterator[str]]:
        """Status, kind and text of the answer to a request; a body that is yet to be read is a function and has a size."""
        query, parts = query or {}, [p for p in path.split("/") if p]
        route = "/".join(p if len(p) != 32 else "{id}" for p in parts)
        text = lambda path: "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())  # noqa: E731 (a report)
        try:
            kind: str = "application/json"
            if method == "POST":
                self.admit(route, client, len(body) if size is None else size)
                body = body() if callable(body) else body
            match (method, parts):
                case ("GET", ["api", "health"] | ["healthz"] | ["readyz"] | ["api", "readyz"] | ["api", "healthz"]):
                    out = json.dumps({"status": "ok"})
                case ("GET", ["metrics"] | ["api", "metrics"]):
                    kind, out = "text/plain", self.metrics()
                case ("POST", ["api", "rank"]):
                    out = json.dumps(self.rank(body, query))
                case ("POST", ["api", "batch"]):
                    out = json.dumps(self.batch(body, query))
                case ("GET", ["api", "batch", job]):
                    out = json.dumps(self.state(job))
                case ("GET", ["api", "batch", job, "results"] | ["api", "results", job]):
                    rows = sources.read_ranking(self.spark, self.result(job)).orderBy("rank").collect()  # a report
                    out = json.dumps({"rows": [r.asDict() for r in rows]})
                case ("GET", ["api", "batch", job, "download"]):
                    kind, out = "text/csv", text(self.result(job))
                case ("GET", ["api", "stream", job]):
                    self.state(job)
                    kind, out = "text/event-stream", self.stream(job)
                case _:
                    raise Refused(404, "no such page")
            status = 200
        except Refused as e:
            more = {"retry_after": e.retry_after} if e.retry_after else {}
            status, kind, out = e.status, "application/json", json.dumps({"detail": str(e)} | more)
        except Exception as e:  # any other fault is answered and counted too
            status, kind, out = 500, "application/json", json.dumps({"detail": type(e).__name__})
        with self.lock:
            self.counts[route, status] += 1
        return status, kind, out


def serve(spark: SparkSession, folder: str, host: str, port: int) -> None:
    """Answers until it is stopped."""
    service = Service(spark, folder)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            from urllib.parse import parse_qsl, urlsplit

            url = urlsplit(self.path)
            given = self.headers.get("Content-Length") or "0"
            size = int(given) if given.isdigit() else UPLOAD_BYTES + 1
            status, kind, out = service.answer(self.command, url.path, dict(parse_qsl(url.query)), lambda: self.rfile.read(size), self.client_address[0], size)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if status == 429:
                self.send_header("Retry-After", str(json.loads(out)["retry_after"]))
            self.close_connection |= status in (413, 429)  # the body wasn't read
            self.end_headers()
            for part in [out] if isinstance(out, str) else out:
                self.wfile.write(part.encode())
                self.wfile.flush()

        do_GET = do_POST = _do  # noqa: N815

    ThreadingHTTPServer((host, port), Handler).serve_forever()
