"""Readers of candidate, label and ranking files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.audits import human_tiers
from lodestar.sources import arrays

SCHEMA = """candidate_id STRING,
profile STRUCT<anonymized_name: STRING, headline: STRING, summary: STRING, current_title: STRING, current_company: STRING,
  current_company_size: STRING, current_industry: STRING, location: STRING, country: STRING, years_of_experience: DOUBLE>,
career_history ARRAY<STRUCT<company: STRING, title: STRING, industry: STRING, company_size: STRING, description: STRING,
  start_date: STRING, end_date: STRING, is_current: BOOLEAN, duration_months: INT>>,
education ARRAY<STRUCT<institution: STRING, degree: STRING, field_of_study: STRING, tier: STRING, grade: STRING, start_year: INT, end_year: INT>>,
skills ARRAY<STRUCT<name: STRING, proficiency: STRING, endorsements: INT, duration_months: INT>>,
certifications ARRAY<STRUCT<name: STRING>>,
signals STRUCT<open_to_work_flag: BOOLEAN, verified_email: BOOLEAN, verified_phone: BOOLEAN, linkedin_connected: BOOLEAN,
  willing_to_relocate: BOOLEAN, recruiter_response_rate: DOUBLE, avg_response_time_hours: DOUBLE, interview_completion_rate: DOUBLE,
  offer_acceptance_rate: DOUBLE, profile_completeness_score: DOUBLE, github_activity_score: DOUBLE, profile_views_received_30d: INT,
  applications_submitted_30d: INT, saved_by_recruiters_30d: INT, search_appearance_30d: INT, notice_period_days: INT,
  endorsements_received: INT, connection_count: INT, last_active_date: STRING, preferred_work_mode: STRING,
  skill_assessment_scores: MAP<STRING, DOUBLE>, expected_salary_range_inr_lpa: STRUCT<min: DOUBLE, max: DOUBLE>>"""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, without a byte order mark, with their place in file order.

    The place is exact and needs no exchange of lines: counts of each input split come first (a row for each split).
    """
    text = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    text = text.where(F.length(F.trim("value")) > 0)
    splits = text.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))).select("file", "block", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return text.withColumn("within", within).join(before, ["file", "block"]).select("value", (F.col("before") + F.col("within")).alias("ordinal"))


def read_candidates(spark: SparkSession, path: str, max_candidates: int | None = None) -> DataFrame:
    """Candidates of JSON lines (plain or gzip) or of one JSON array (.json), in SCHEMA with ordinal.

    A line that isn't an object, or an id that isn't a string, fails the read; a missing id becomes UNKNOWN_ROW_<ordinal>.
    """
    if max_candidates is not None and (type(max_candidates) is not int or max_candidates < 1):
        raise ValueError("max_candidates must be a positive integer when provided")
    if path.lower().endswith(".json"):
        rows = arrays.elements(spark, path)
    else:
        rows = _lines(spark, path)
    if max_candidates:
        rows = rows.where(F.col("ordinal") < max_candidates)
    return parsed(rows)


def parsed(rows: DataFrame) -> DataFrame:
    """Candidates of rows (ordinal, value), checked as `read_candidates` says."""
    # Any key that ends in _signals holds the signals.
    named = rows.withColumn("value", F.regexp_replace("value", '"[a-z]+_signals"\\s*:', '"signals":'))
    shape = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("row "), F.col("ordinal").cast("string"), F.lit(" must be a JSON object"))))
    named = named.withColumn("value", shape)
    bad_id = F.get_json_object("value", "$.candidate_id").isNotNull() & F.col("value").rlike('"candidate_id"\\s*:\\s*[^"\\sn]')
    out = named.select("ordinal", bad_id.alias("bad"), F.from_json("value", SCHEMA).alias("c")).select("ordinal", "bad", "c.*")
    ident = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("row "), F.col("ordinal").cast("string"), F.lit(": candidate_id must be a string")))).otherwise(F.coalesce(F.nullif("candidate_id", F.lit("")), F.concat(F.lit("UNKNOWN_ROW_"), F.col("ordinal").cast("string"))))
    return out.withColumn("candidate_id", ident).drop("bad")


class TooLarge(ValueError):
    """An upload is over a limit of size."""


def checked_upload(spark: SparkSession, path: str, max_bytes: int = 64 << 20, max_expanded: int = 512 << 20, max_record: int = 2 << 20) -> DataFrame:
    """Candidates of an upload whose name, size, size when expanded and longest record are within limits; else the read fails."""
    name = path.rsplit("/", 1)[-1].lower()
    if not name.endswith((".jsonl", ".json", ".jsonl.gz", ".gz")):
        raise ValueError("an upload must be .jsonl, .json, .jsonl.gz or .gz")
    whole = name.endswith(".json")
    lines = spark.read.text(path, wholetext=whole).select(F.octet_length("value").alias("n"), F.col("_metadata.file_size").alias("size"))
    facts = lines.agg(F.max("size").alias("size"), F.sum(F.col("n") + 1).alias("expanded"), F.max("n").alias("record")).first()  # one row
    for what, limit in (("size", max_bytes), ("expanded", max_expanded), ("record", max_expanded if whole else max_record)):
        if (facts[what] or 0) > limit:
            raise TooLarge(f"{what} of the upload is over {limit} bytes")
    rows = read_candidates(spark, path)
    if whole:  # an array's records are seen once it is taken apart
        longest = rows.select(F.max(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0]
        if (longest or 0) > max_record:
            raise TooLarge(f"record of the upload is over {max_record} bytes")
    return rows


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(submission, candidate_id, rank), all texts, of CSV files: the file's path, and two columns by names in any case."""
    rows = spark.read.option("enforceSchema", False).csv(path, header=True, multiLine=True, escape='"').withColumn("submission", F.col("_metadata.file_path"))
    by = {c.lstrip("\ufeff").strip().lower(): c for c in rows.columns}
    if not {"candidate_id", "rank"} <= by.keys():
        raise ValueError("a submission needs the columns candidate_id and rank")
    return rows.select("submission", F.col(by["candidate_id"]).alias("candidate_id"), F.col(by["rank"]).alias("rank"))


def pool_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a file of candidates."""
    return read_candidates(spark, path).select("candidate_id").distinct()


def read_human_labels(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(candidate_id, tier, gain) of a CSV file whose column holds strong_fit, maybe or not_fit; other rows have no label."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    return human_tiers(rows, "candidate_id", column)


def read_role(spark: SparkSession, path: str) -> str:
    """A role's text of a plain text file, which the driver compiles."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "")).first()[0]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, tier, gain) of JSON lines; the last row of an id counts."""
    rows = _lines(spark, path).select("ordinal", F.from_json("value", "candidate_id STRING, tier DOUBLE, silver_label DOUBLE, relevance DOUBLE").alias("l")).select("ordinal", "l.*")
    tier = F.coalesce("tier", "silver_label", F.lit(0.0))
    rows = rows.select("candidate_id", "ordinal", tier.alias("tier"), F.coalesce("relevance", tier).alias("gain"))
    return rows.groupBy("candidate_id").agg(F.max_by("tier", "ordinal").alias("tier"), F.max_by("gain", "ordinal").alias("gain"))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, rank, score, reasoning) of a CSV file; header names in any case."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    return rows.withColumn("rank", F.col("rank").cast("int"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(resume_text, job_description_text, label) of a CSV file."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("resume_text", "job_description_text", "label")


def read_folder(spark: SparkSession, path: str, max_bytes: int, max_rows: int) -> DataFrame:
    """(file, text): rows of the CSV files below a folder that aren't larger than a limit, at most so many of each file, columns joined.

    Both limits are the feature: a sample of each of many files.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"))
    w = Window.partitionBy("file").orderBy("id")
    rows = rows.where(F.col("size") <= max_bytes).withColumn("n", F.row_number().over(w)).where((F.col("n") > 1) & (F.col("n") <= max_rows + 1))
    return rows.select("file", F.regexp_replace("value", '[",]+', " ").alias("text"))
