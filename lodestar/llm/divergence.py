"""How the sources of a language differ in their use of terms, by sorted streams of runs.

Terms are matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A first task counts what it reads, so that a
term that stands in a third of all documents leaves the task as one segment for each source: the number of documents
and of occurrences in a stretch of documents. Segments are repartitioned by (lang, term) and sorted by (lang, term,
source, document); one scan over the runs of a sorted partition yields document frequencies and counts and lets go of
terms below MIN_DOCS documents. A second scan, over the terms' runs dealt by (lang, bucket of terms), has the sums of
the language's sources at the head of each bucket and emits, run by run, the terms that a source uses more than the
language does, and what the run adds to the divergence of pairs. A pair's sum starts from what it would be if neither
source had any term, so a run only adds for the sources that it holds, and a bucket emits a pair once.

A share is p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), worked out by long division in 64-bit integers, which is exact
while N + 5 * V is below 9 * 10^15.

Defined results: a null text, lang or source counts as the empty text, which is a language or a source like any other.
Rows that repeat an id are documents of their own. A source without terms has its pairs, with a count of 0 for all
terms. A language with one source has no pairs, one without kept terms has pairs of value 0. An empty table gives no
rows. Other columns don't matter. A scan holds one language's sources, never its terms or documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents of its language that a term is kept from, what is added to each count, the shares' scale as thousands, and
#: the ranks reported for terms.
MIN_DOCS, ADDED, THOUSANDS, RANKS = 30, 5, 3, 50
#: Entries that a task counts before it emits segments, numbers that a scan holds for pairs, and rows of a bucket at least.
HELD, PAIRS, BUCKET = 800_000, 1 << 22, 8192

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SEGMENTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("count", pa.int64())])
_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("lead", pa.int64())])
_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _counted(lang: str, source: str, document: int, docs: Counter, counts: Counter) -> Iterator[pa.RecordBatch]:
    """The segments of one source in a stretch of documents; the empty term tells that the source is there."""
    names = pa.array([b"", *counts], pa.binary()).cast(pa.string())
    seen = np.fromiter(map(docs.__getitem__, counts), np.int64, len(counts))
    columns = [names, pa.array(np.append(0, seen)), pa.array(np.append(0, np.fromiter(counts.values(), np.int64, len(counts))))]
    for at in range(0, len(names), 1 << 15):
        term, held, count = (c.slice(at, 1 << 15) for c in columns)
        same = [pa.repeat(pa.scalar(x, t), len(term)) for x, t in ((lang, pa.string()), (source, pa.string()), (document, pa.int64()))]
        yield pa.RecordBatch.from_arrays([same[0], term, same[1], same[2], held, count], schema=_SEGMENTS)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, text) by stretches of documents."""
    common.tenant("divergence")
    task = TaskContext.get().partitionId() << 33
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    first = read = 0
    for lang, source, text in _columns(batches):
        own = held.get((lang, source))
        if own is None:
            own = held[lang, source] = Counter(), Counter()
        words = terms(text)
        own[0].update(set(words))
        own[1].update(words)
        read += 1
        if not read & 63 and sum(len(c) for _, c in held.values()) > HELD:
            for of, own in held.items():
                yield from _counted(*of, task + first, *own)
            held, first = {}, read
    for of, own in held.items():
        yield from _counted(*of, task + first, *own)


def _starts(table: pa.RecordBatch, columns: tuple[int, ...]) -> np.ndarray:
    """Which rows differ from the row before in one of the columns; the first does."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        apart = [pc.not_equal(table.column(k).slice(1), table.column(k).slice(0, table.num_rows - 1)) for k in columns]
        new[1:] = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in apart])
    return new


def _scanned(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Whole runs of (lang, term), sorted by source in them."""
    run = np.flatnonzero(_starts(rows, (0, 1)))
    own = np.flatnonzero(_starts(rows, (0, 1, 2)))
    seen = np.add.reduceat(rows.column(4).to_numpy(), run)
    told = (seen >= least) | (pc.binary_length(rows.column(1)).to_numpy(zero_copy_only=False)[run] == 0)
    kept = told[np.searchsorted(run, own, "right") - 1]
    count = np.add.reduceat(rows.column(5).to_numpy(), own)[kept]
    lead = np.isin(own, run)[kept]
    out = rows.take(pa.array(own[kept]))
    lead &= pc.binary_length(out.column(1)).to_numpy(zero_copy_only=False) > 0
    return pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(2), pa.array(count), pa.array(lead.astype(np.int64))], schema=_RUNS)


def _runs(least: int):
    """From sorted segments: each source's count of each term in at least so many documents of its language.

    The last run of a batch waits for the next one; of a run that goes on, what has come is summed up by source.
    """

    def summed(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = np.flatnonzero(_starts(rows, (0, 1, 2)))
        out = rows.take(pa.array(own))
        sums = [pa.array(np.add.reduceat(rows.column(k).to_numpy(), own)) for k in (4, 5)]
        return pa.RecordBatch.from_arrays([*out.columns[:4], *sums], schema=_SEGMENTS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _SEGMENTS)], schema=_SEGMENTS)
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            last = int(np.flatnonzero(_starts(rows, (0, 1)))[-1])
            waiting = summed(rows.slice(last))
            if last:
                yield _scanned(rows.slice(0, last), least)
        if waiting is not None:
            yield _scanned(waiting, least)

    return scan


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1000 ** THOUSANDS * (counts + ADDED) / whole), exactly; whole is at least counts + ADDED."""
    out, rest = np.divmod(counts + ADDED, whole)
    for _ in range(THOUSANDS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _bucket(lang: str, bucket: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (part, lang, source, item, value) of one bucket of terms: heads, with an empty term and V and N, then runs."""
    names, sums, vocabulary, total = [], [], 0, 0
    body = iter(())
    for row in rows:
        if row[0]:
            body = chain([row], rows)
            break
        _, source, n, vocabulary, total = row
        names.append(source)
        sums.append(n)
    place = {s: k for k, s in enumerate(names)}
    whole = np.array(sums, np.int64) + ADDED * vocabulary
    none = shares(np.zeros(len(names), np.int64), whole) if vocabulary else np.zeros(len(names), np.int64)
    if not bucket:
        for k, source in enumerate(names):
            apart = vocabulary * np.abs(none - none[k])
            yield from (("pair", lang, source, other, v) for j, (other, v) in enumerate(zip(names, apart.tolist())) if j != k)
    held: dict[int, np.ndarray] = {}

    def added() -> Iterator[tuple]:
        for k, row in held.items():
            for j in np.flatnonzero(row).tolist():
                yield "pair", lang, names[k], names[j], int(row[j])
                yield "pair", lang, names[j], names[k], int(row[j])

    for term, run in groupby(body, itemgetter(0)):
        at, counts = zip(*((place[r[1]], r[2]) for r in run))
        at, counts = np.array(at), np.array(counts, np.int64)
        own = shares(counts, whole[at])
        usual = int(shares(np.array([counts.sum()]), np.array([total + ADDED * vocabulary]))[0])
        for k, p, n in zip(at.tolist(), own.tolist(), counts.tolist()):
            if n and p > usual:
                yield "term", lang, names[k], term, p - usual
        now = none.copy()
        now[at] = own
        for i, k in enumerate(at.tolist()):
            more = np.abs(now - own[i]) - np.abs(none - none[k])
            more[at[: i + 1]] = 0  # two sources of the run meet once
            if k in held:
                held[k] += more
            else:
                held[k] = more
        if len(held) * len(names) > PAIRS:
            yield from added()
            held.clear()
    yield from added()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("divergence")
    rows = groupby(_columns(batches), itemgetter(0, 1))
    return _batches(chain.from_iterable(_bucket(lang, bucket, (r[2:] for r in own)) for (lang, bucket), own in rows), _PARTS)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language (part pair), and the terms that a source uses more than its language, up to so many ranks (part term)."""
    spark = docs.sparkSession
    common.small_batches(spark, 20_000, 4 << 20)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)], F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    segments = read.mapInArrow(_segments, "lang string, term string, source string, document long, docs long, count long")
    # Rows are told apart by a number before their strings are compared; equal terms stay together.
    order = [F.xxhash64("lang", "term"), "lang", "term", "source", "document"]
    runs = segments.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(_runs(least), "lang string, term string, source string, count long, lead long")
    runs = common.materialize(runs, "runs")
    sources = runs.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("rows"))
    langs = runs.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("count").alias("total"))
    size = sources.groupBy("lang").agg(F.sum("rows").alias("rows"), F.count("*").alias("sources")).agg(F.sum("rows"), F.max("sources")).first()
    # A bucket has at least as many rows as pairs, so that pairs don't outgrow what they are summed from.
    buckets = 1 + (size[0] or 0) // max(BUCKET, (size[1] or 0) ** 2)
    heads = sources.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit("").alias("term"), "source", F.col("n").alias("count"), "v", "total")
    body = runs.where("term <> ''").select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "source", "count", F.lit(0).alias("v"), F.lit(0).alias("total"))
    dealt = heads.union(body).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "term", "source")
    parts = common.materialize(dealt.mapInArrow(_parts, "part string, lang string, source string, item string, value long"), "parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    top = parts.where("part = 'term'").select("lang", "source", "item", "value", ranked).where(F.col("rank") <= ranks)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select("lang", "source", "item", "value", ranked).select(columns("pair")).union(top.select(columns("term")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.read(spark, sf_dir, "documents"))


ORACLE = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT t.lang, source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
sums AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT sums.lang, sums.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + {ADDED}) // (total + {ADDED} * v) AS p
  FROM sums JOIN kept ON sums.lang = kept.lang JOIN v ON v.lang = kept.lang LEFT JOIN c ON c.lang = sums.lang AND c.source = sums.source AND c.term = kept.term),
q AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + {ADDED}) // ((SELECT sum(total)::HUGEINT FROM sums WHERE sums.lang = c.lang) + {ADDED} * any_value(v)) AS q
  FROM c JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
found AS (SELECT p.lang, p.source, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM found) WHERE rank <= {RANKS}"""
}
QUERIES = {"op11_source_divergence": op11_source_divergence}
