"""One-to-one assignment of requirements to the units of evidence of a record, in polynomial time.

Shortest augmenting paths with potentials: each requirement in turn is placed along the cheapest path of reassignments,
so a record of r requirements and u units takes r * r * u steps. Records are arrays in a row; nothing is shuffled. Of
equally good assignments the one counts whose units come first for the first requirement, then the second, and so on:
weights are whole numbers, and what a place costs is added below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.sources.staging import ship

#: What a role asks for and the phrases that show it, which of these must be there, the share of phrases
#: that counts as evidence, and how many jobs and skills are looked at, and at which levels.
REQUIREMENTS = {
    "R1_retrieval_prod": ["embedding", "embeddings", "retrieval", "vector", "search", "rag", "semantic", "faiss", "index"],
    "R2_vector_db": ["vector database", "milvus", "qdrant", "pinecone", "weaviate", "hybrid search", "ann"],
    "R3_python_eng": ["python", "pytorch", "tensorflow", "api", "backend", "microservice", "engineering", "pipeline"],
    "R4_ranking_eval": ["ranking", "ranker", "rerank", "ndcg", "mrr", "map", "a/b", "evaluation", "relevance", "learning to rank"],
    "R5_prod_ownership": ["production", "deployed", "shipped", "scale", "millions", "users", "latency", "serving", "throughput"],
    "R6_seniority": ["senior", "lead", "staff", "principal", "architect", "mentor", "ownership"],
    "R7_ml_nlp": ["machine learning", "nlp", "deep learning", "transformer", "llm", "recommendation", "personalization"],
}
MANDATORY = ("R1_retrieval_prod", "R3_python_eng", "R4_ranking_eval", "R5_prod_ownership")
COVERED, JOBS, SKILLS, LEVELS = 0.34, 6, 8, ("expert", "advanced")


def assigned(gain: np.ndarray) -> np.ndarray:
    """For each row of gain (rows by columns, whole numbers or not) its column in an assignment of the greatest sum; -1 where columns run out. A column left free gains nothing, nor does a row."""
    r, u = gain.shape
    cost = np.concatenate((-gain, np.zeros((r, r), gain.dtype)), axis=1)  # a column of its own for each row that stays without
    own, other = np.zeros(r, gain.dtype), np.zeros(u + r, gain.dtype)
    holder = np.full(u + r, -1)
    for row in range(r):
        far = np.full(u + r, np.iinfo(np.int64).max if gain.dtype.kind == "i" else np.inf, gain.dtype)
        via, done = np.full(u + r, -1), np.zeros(u + r, bool)
        at, column, length = row, -1, gain.dtype.type(0)
        while True:  # grows a tree of shortest paths until it meets a free column
            step = cost[at] - own[at] - other + length
            nearer = ~done & (step < far)
            far[nearer], via[nearer] = step[nearer], column
            column = int(np.flatnonzero(~done)[far[~done].argmin()])
            length, done[column] = far[column], True
            if holder[column] < 0:
                break
            at = holder[column]
        inner = np.flatnonzero(done & (holder >= 0))
        own[row] += length
        own[holder[inner]] += length - far[inner]
        other[inner] -= length - far[inner]
        while column >= 0:  # rows along the path move up
            before = via[column]
            holder[column] = holder[before] if before >= 0 else row
            column = before
    out = np.full(r, -1)
    for column in np.flatnonzero(holder[:u] >= 0):
        out[holder[column]] = column
    return out


def ordered_gain(hits: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Whole numbers whose greatest sum is the assignment of the greatest sum of hits / sizes that comes first by units."""
    r, u = hits.shape
    base, whole = u + 1, lcm(*sizes)
    if whole * base**r * r >= 1 << 62:
        raise ValueError(f"{r} requirements and {u} units are too many to be told apart in 64 bits")
    place = np.array([base ** (r - 1 - i) for i in range(r)], np.int64)
    # A unit is worth more than none, an earlier one more than a later one.
    return hits * (whole // np.array(sizes, np.int64))[:, None] * base**r + place[:, None] * (u - np.arange(u, dtype=np.int64))[None, :]


def units(records: DataFrame) -> Column:
    """The units of evidence of a record as (text, dated): its first jobs, its strong skills among the first, its profile."""
    blank = lambda *c: F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c])
    struct = lambda text, dated: F.struct(text.alias("text"), dated.alias("dated"))
    there = lambda x: F.coalesce(x != "", F.lit(False))
    listed = lambda x: F.coalesce(x, F.expr("cast(array() AS array<struct<text: string, dated: boolean>>)"))
    jobs = F.transform(F.slice("career_history", 1, JOBS), lambda j: struct(blank(j["title"], j["description"], j["company"]), there(j["start_date"]) | there(j["end_date"])))
    strong = F.filter(F.slice("skills", 1, SKILLS), lambda s: F.lower(s["proficiency"]).isin(*LEVELS))
    skills = F.transform(strong, lambda s: struct(F.coalesce(s["name"], F.lit("")), F.coalesce(s["duration_months"], F.lit(0)) > 0))
    profile = F.array(struct(blank(F.col("profile.current_title"), F.col("profile.summary")), F.lit(False)))
    return F.filter(F.concat(listed(jobs), listed(skills), profile), lambda u: F.trim(u["text"]) != "")


def _hits(text: Column, phrases: list[str]) -> Column:
    return sum((text.contains(p).cast("int") for p in phrases), F.lit(0))


_NUMBERS = ["coverage", "n_covered", "weakest_mandatory", "diversity", "unsupported", "confidence", "undated_only", "redundancy"]


def evidence(records: DataFrame, ident: str = "candidate_id", requirements: dict[str, list[str]] | None = None, mandatory: tuple[str, ...] = MANDATORY) -> DataFrame:
    """How a record's units meet requirements, each unit for one at most.

    coverage: sum of the assigned shares of phrases; n_covered: requirements whose share is at least COVERED, unsupported
    the others; weakest_mandatory: the least of the best shares of mandatory ones; diversity: units that are assigned;
    confidence: mean of the assigned shares; undated_only: mandatory ones covered by a unit without dates; redundancy: units
    beyond the assigned one that would cover a requirement too, on average. A record without units covers nothing.
    """
    requirements = requirements or REQUIREMENTS
    ship(records.sparkSession.sparkContext)
    sizes, must = [len(x) for x in requirements.values()], [list(requirements).index(m) for m in mandatory]
    found = records.select(F.col(ident), units(records).alias("u"))
    lowered = lambda u: T.let(F.lower(u["text"]), lambda t: F.array(*[_hits(t, phrases) for phrases in requirements.values()]))
    table = found.select(ident, F.transform("u", lowered).alias("hits"), F.transform("u", lambda u: u["dated"]).alias("dated"))
    kind = dict(records.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for hits, dated in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not hits:
                    out.append((0.0, 0, 0.0, 0, len(sizes), 0.0, len(must), 0.0))
                    continue
                m = np.array(hits, np.int64).T
                share = m / np.array(sizes)[:, None]
                at = assigned(ordered_gain(m, sizes))
                met = np.where(at >= 0, share[np.arange(len(sizes)), at], 0.0)
                covered = met >= COVERED
                undated = sum(bool(covered[i]) and not dated[at[i]] for i in must)
                spare = (share >= COVERED).sum(1) - covered
                n = int((at >= 0).sum())
                out.append((float(met.sum()), int(covered.sum()), float(share[must].max(1).min()) if must else 0.0, n, int((~covered).sum()), float(met.sum() / n), undated, float(spare.mean())))
            kinds = [pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=[ident, *_NUMBERS])

    types = ["double", "long", "double", "long", "long", "double", "long", "double"]
    return table.mapInArrow(run, f"{ident} {kind}, " + ", ".join(f"{c} {t}" for c, t in zip(_NUMBERS, types)))
