"""Micro-batch ranking: files dropped in a folder are ranked as they come; events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.plans import ranker
from lodestar.sources import candidates as sources


def watch_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, top_k: int = 100, files_per_batch: int = 1) -> StreamingQuery:
    """Ranks each batch of new JSON-lines files and appends its report with the batch's number.

    The batch number makes a repeated batch recognisable: it replaces its own rows. Lines are checked as those of a file
    are: one that isn't an object fails the batch, a missing id is filled with the line's number within the batch.
    """
    lines = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", files_per_batch).text(folder)

    def rank(batch: DataFrame, number: int) -> None:
        lines = batch.select(F.regexp_replace("value", "^\\uFEFF", "").alias("value")).where(F.length(F.trim("value")) > 0)
        numbered = lines.select(F.monotonically_increasing_id().alias("ordinal"), "value")
        out = ranker.report(ranker.rank_candidates(sources.parsed(numbered).drop("ordinal")), top_k)
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, time: str = "ts", key: str = "user_id", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events of a key in each window, as a stream or a table; events later than the watermark are left out of a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def states(jobs: DataFrame) -> DataFrame:
    """The present state of each job from appended state rows (job_id, ts, status)."""
    return jobs.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.count("*").alias("n_events"))
