"""Quality rules with cross-document line frequency.

Base rules look at one text. The method then hashes each normalised line (A-Z lower-cased, white space as one space),
counts for each host (the documents' source) the distinct document contents that hold the line, and takes lines above
the host's limit out of every document. A document that this leaves with too little of its own is rejected. Exact
copies of a text are one content, so a text isn't rejected for being copied.

Defined results: a null text counts as empty, a null source as a host of its own; a text without words fails the
base rules. Rows that repeat an id are documents of their own. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line is boilerplate of its host if more than this many contents hold it, and more than this share of the host's.
LINE_DOCS = 10
LINE_SHARE = 0.01
#: A document is depleted if fewer words than this are left, or less than this share.
LEFT_WORDS = 5
LEFT_SHARE = 0.25

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SCHEMA = "doc_id long, source string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of width words that are found twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    code, size = ids[:n], len(seen)
    for k in range(1, width):
        code = code * size + ids[k : k + n]
        if k == width - 1 or size * (int(code.max()) + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def content_hash(text: Column) -> Column:
    """What tells contents apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    digest = xxhash.xxh64_intdigest
    common.tenant("quality")
    for batch in batches:
        out = []
        for ident, text, source, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            raw = text.encode()
            words = raw.split()  # bytes.split knows just the white space of the contract
            seen: set[bytes] = set()
            lines: dict[bytes, int] = {}
            dups = 0
            for line in raw.split(b"\n"):
                own = line.split()
                if own:
                    dups += line in seen
                    seen.add(line)
                    key = b" ".join(own).lower()
                    lines[key] = lines.get(key, 0) + len(own)
            chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
            out.append((ident, source, content, len(words), chars, len(_SYMBOLS.findall(text)), dups, repeated_words(words), [digest(x) - (1 << 63) for x in lines], list(lines.values())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept; also content, a hash of the text, and row, a number of the row."""
    common.small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(host_col).cast("string"), content_hash(F.col(text_col))).mapInArrow(_measure, _SCHEMA)
    base = common.materialize(base.withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = base.select("row", "source", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "source", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    # A line in k contents of a host leaves a task once for each content at most; counts, not rows, meet.
    held = lines.groupBy("source", "line", "content").agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count("*").alias("n"))
    held = held.where(F.col("n") > LINE_DOCS)
    hosts = base.groupBy("source", "content").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("contents"))
    hot = held.alias("h").join(hosts.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).where(F.col("n") > F.col("contents") * F.lit(LINE_SHARE)).select("h.source", "line")
    taken = lines.alias("l").join(hot.alias("h"), (F.col("l.line") == F.col("h.line")) & F.col("l.source").eqNullSafe(F.col("h.source"))).groupBy("row").agg(F.sum("words").alias("taken"))
    out = base.drop("lines", "line_words", "source").join(taken, "row", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("taken", F.lit(0))
    out = out.withColumn("base_failed", failed).withColumn("left_words", left)
    kept = ~F.col("base_failed") & (F.col("left_words") >= LEFT_WORDS) & (F.col("left_words") >= F.lit(LEFT_SHARE) * F.col("n_words"))
    return out.withColumn("kept", kept).drop("taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents")).drop("row", "content")


ORACLE = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
five AS (SELECT r, i, ws[i : i + 4] AS g FROM w, range(1, len(ws) - 3) x(i)),
again AS (SELECT r, i FROM five QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 5) y(k) GROUP BY r),
ln AS (SELECT r, source, md5(text) AS content, l, count(*) AS k FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT r, sum(k - 1)::BIGINT AS n_dup_lines FROM ln GROUP BY r),
norm AS (SELECT r, source, content, k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw,
  translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM ln),
held AS (SELECT source, line, count(DISTINCT content) AS n FROM norm GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS contents FROM d GROUP BY source),
hot AS (SELECT held.source, line FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > {LINE_DOCS} AND n > contents * {LINE_SHARE}),
taken AS (SELECT r, sum(k * nw)::BIGINT AS taken FROM norm JOIN hot ON norm.line = hot.line AND norm.source IS NOT DISTINCT FROM hot.source GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) - coalesce(taken, 0) AS left_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN taken USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND left_words >= {LEFT_WORDS} AND left_words >= {LEFT_SHARE} * n_words AS kept FROM f"""
}
QUERIES = {"op6_quality_rules": op6_quality_rules}
