"""How far jobs have come, from Spark's own counters and events; asking runs no job."""

from __future__ import annotations

from threading import Condition

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Board:
    """The last word on each job, and who waits for a newer one; the words of at most `most` ended jobs are kept."""

    def __init__(self, spark: SparkSession, most: int = 1000) -> None:
        self.context, self.most = spark.sparkContext, most
        self.said: dict[str, dict] = {}
        self.news = Condition()

    def tell(self, job: str, **words) -> None:
        with self.news:
            now = self.said.pop(job, {"version": 0})
            self.said[job] = now | words | {"version": now["version"] + 1}
            ended = [k for k, x in self.said.items() if x.get("ended")]
            for old in ended[: max(0, len(ended) - self.most)]:
                del self.said[old]
            self.news.notify_all()

    def tasks(self, job: str) -> dict[str, int]:
        """Tasks done and in all of the stages of a job group that run or have run; counters of the driver."""
        tracker, done, total = self.context.statusTracker(), 0, 0
        for number in tracker.getJobIdsForGroup(job):
            info = tracker.getJobInfo(number)
            for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
                if stage:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return {"tasks": total, "tasks_done": done}

    def wait(self, job: str, version: int, pause: float) -> dict | None:
        """The word on a job, when there is a newer one than version or after a pause."""
        with self.news:
            self.news.wait_for(lambda: self.said.get(job, {}).get("version", 0) > version, pause)
            return dict(self.said[job]) if job in self.said else None


class StreamProgress(StreamingQueryListener):
    """Tells a board of each batch of the session's streams, by name or else by id."""

    def __init__(self, board: Board) -> None:
        self.board = board
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name or str(event.id)
        self.board.tell(self.names[str(event.id)], status="running", rows=0, batches=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        job = p.name or str(p.id)
        before = self.board.said.get(job, {})
        self.board.tell(job, status="running", rows=before.get("rows", 0) + p.numInputRows, batches=p.batchId + 1)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        job = self.names.pop(str(event.id), str(event.id))
        self.board.tell(job, status="failed" if event.exception else "done", ended=True)
