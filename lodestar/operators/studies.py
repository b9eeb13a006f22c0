"""Operators of studies on rankings: sampling, splits, selection, resampling, learned blends, agreement of judges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import ranks
from lodestar.sources.staging import bounded, ship

#: Rows that a task takes in order, one after the other.
MOST = 1_000_000


def draw(rows: DataFrame, ident: str, seed: str, n: int, *strata: str) -> DataFrame:
    """n rows of each stratum by the order of a digest: the same draw on any engine. The number is the sample's size."""
    order = F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.lit(seed)).cast("binary"))
    w = Window.partitionBy(*strata).orderBy(order, ident)
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def panel(ident: Column) -> Column:
    """discovery (60 of 100), calibration (20) or lockbox (20), by digest."""
    d = T.digest_mod(ident, 100)
    return F.when(d < 60, "discovery").when(d < 80, "calibration").otherwise("lockbox")


def split(ident: Column) -> Column:
    """train (70), validation (15) or test (15), by digest."""
    d = T.digest_mod(ident, 100)
    return F.when(d < 70, "train").when(d < 85, "validation").otherwise("test")


def ordered_union(first: DataFrame, second: DataFrame, ident: str) -> DataFrame:
    """Rows of the first ranking, then those of the second that it lacks, ranked anew."""
    both = first.select(ident, F.lit(0).alias("part"), "rank").unionByName(second.select(ident, F.lit(1).alias("part"), "rank"))
    once = both.groupBy(ident).agg(F.min(F.struct("part", "rank")).alias("at"))
    return ranks.numbered(once, [F.col("at.part").asc(), F.col("at.rank").asc(), F.col(ident).asc()], name="rank").select(ident, "rank")


def bands(orders: list[tuple[DataFrame, int]], ident: str) -> DataFrame:
    """Places filled from several rankings in turn: each up to a place, with ids that aren't taken yet."""
    taken, place = None, 0
    for ranking, upto in orders:
        free = ranking if taken is None else ranking.join(taken.select(ident), ident, "left_anti")
        first = free.select(ident, "rank").orderBy("rank", ident).limit(max(0, upto - place))  # a band's rows
        next_ = first.select(ident, (place + F.row_number().over(Window.orderBy("rank", ident))).alias("rank"))
        taken = next_ if taken is None else taken.unionByName(next_)
        place = upto
    return taken


def greedy_disjoint(swaps: DataFrame) -> DataFrame:
    """Of swaps (a, b, gain), best first, those that touch no id twice. Sequential over a report: one task, which refuses over MOST rows."""
    swaps = bounded(swaps, MOST, "swaps")
    ship(swaps.sparkSession.sparkContext)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gain", "a", "b"], ascending=[False, True, True])
        used: set = set()
        keep = []
        for a, b in zip(frame["a"], frame["b"]):
            keep.append(a not in used and b not in used)
            if keep[-1]:
                used |= {a, b}
        return frame[np.array(keep, bool)]

    return swaps.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: pick(f)[["a", "b", "gain"]], "a long, b long, gain double")


def claim_quotes(rows: DataFrame) -> DataFrame:
    """Rows (rank, quotes) of a report: each rank takes its first quote that no better rank took. Sequential over a report: one task, which refuses over MOST rows."""
    rows = bounded(rows, MOST, "quotes")
    ship(rows.sparkSession.sparkContext)

    def claim(frame: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for rank, quotes in sorted(zip(frame["rank"], frame["quotes"])):
            free = next((q for q in quotes if q not in used), None)
            used.add(free)
            out.append((rank, free))
        return pd.DataFrame(out, columns=["rank", "quote"])

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: claim(f[["rank", "quotes"]]), "rank long, quote string")


def soft_accuracy(pairs: DataFrame, ahead: Column, gap: Column) -> DataFrame:
    """Share of pairs in the judged order, weighted by the gap of utilities."""
    return pairs.agg(F.try_divide(F.sum(F.when(ahead, gap).otherwise(0.0)), F.sum(gap)).alias("accuracy"), F.count("*").alias("n"))


def effective_judges(scores: DataFrame, judges: list[str]) -> float:
    """The participation ratio of the judges' correlations: as many independent judges say as much."""
    pairs = [(i, j) for i in range(len(judges)) for j in range(i)]
    row = scores.agg(*[F.corr(judges[i], judges[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()  # one row
    c = np.eye(len(judges))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    values = np.linalg.eigvalsh(c)
    values = values[values > 0]
    return float(values.sum() ** 2 / (values**2).sum())


#: Chances that a Poisson weight of mean 1 is at most 0, 1, 2, 3, 4.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)


def bootstrap(rows: DataFrame, ident: str, value: str, resamples: int, seed: str = "") -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles of the mean over resamples: each row has a Poisson weight in each, drawn by a digest of its id and the resample, so any partitioning gives the same."""
    each = rows.select(ident, value).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = T.digest_mod(F.concat_ws("|", F.lit(seed), F.col(ident).cast("string"), F.col("resample").cast("string")), 1 << 20) / float(1 << 20)
    weight = sum(((u >= p).cast("int") for p in POISSON), F.lit(0))
    means = each.groupBy("resample").agg(F.try_divide(F.sum(weight * F.col(value)), F.sum(weight)).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_ndcg(rows: DataFrame, ident: str, score: str, gain: str, k: int, resamples: int, seed: str = "") -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles of the normalised gain at k over resamples of rows ordered by score.

    A row stands in a resample as often as its Poisson weight says, its copies next to each other; what a resample would
    gain at best is the same sum in the order of gains. Places are counted by ranges, ties go by id; a resample without
    any gain counts as 0.
    """
    each = rows.select(F.col(ident).alias("i"), F.col(score).alias("s"), F.col(gain).cast("double").alias("g")).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = T.digest_mod(F.concat_ws("|", F.lit(seed), F.col("i").cast("string"), F.col("resample").cast("string")), 1 << 20) / float(1 << 20)
    drawn = each.withColumn("w", sum(((u >= p).cast("int") for p in POISSON), F.lit(0))).where("w > 0")
    worth = F.aggregate(F.sequence(F.col("upto") - F.col("w") + 1, F.least("upto", F.lit(k).cast("long"))), F.lit(0.0), lambda t, p: t + 1 / F.log2(p + 1))

    def total(order: str, name: str) -> DataFrame:
        placed = ranks.running(drawn, [F.desc(order), F.col("i").asc()], {"upto": F.col("w").cast("long")}, ["resample"])
        return placed.where(F.col("upto") - F.col("w") < k).groupBy("resample").agg(F.sum((F.pow(F.lit(2.0), F.col("g")) - 1) * worth).alias(name))

    means = total("s", "got").join(total("g", "best"), "resample").select(F.coalesce(F.try_divide("got", F.nullif("best", F.lit(0.0))), F.lit(0.0)).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def stack(rows: DataFrame, voters: list[str], target: str) -> dict[str, float]:
    """Least-squares weights of voters: their products are summed in one pass, a small system is solved."""
    columns = ["1", *voters]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    sums = rows.agg(*[F.sum(value(a) * value(b)).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)], *[F.sum(value(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(columns)]).first()
    n = len(columns)
    x = np.array([[sums[f"x{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)])
    y = np.array([sums[f"y{i}"] or 0.0 for i in range(n)])
    return dict(zip(columns, np.linalg.lstsq(x, y, rcond=None)[0].tolist()))


def bradley_terry(pairs: DataFrame, ident: str = "long", rounds: int = 100, ridge: float = 1.0) -> DataFrame:
    """Strengths of a pool from judged pairs (a, b, wins_a, wins_b), drawn to 0 by a ridge; the pool's pairs are one task's, which refuses over MOST of them."""
    pairs = bounded(pairs, MOST, "pairs")
    ship(pairs.sparkSession.sparkContext)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((frame["a"], frame["b"])))
        a, b = np.searchsorted(ids, frame["a"]), np.searchsorted(ids, frame["b"])
        wa, wb = frame["wins_a"].to_numpy(float), frame["wins_b"].to_numpy(float)
        s = np.zeros(len(ids))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(s[b] - s[a]))
            g = wa * (1 - p) - wb * p
            h = (wa + wb) * p * (1 - p)
            gradient = np.bincount(a, g, len(ids)) - np.bincount(b, g, len(ids)) - ridge * s
            curvature = np.bincount(a, h, len(ids)) + np.bincount(b, h, len(ids)) + ridge
            s += gradient / curvature / 2
        return pd.DataFrame({"ident": ids, "strength": s})

    return pairs.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: fit(f), f"ident {ident}, strength double")


def network(rows: DataFrame, inputs: list[str], w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> DataFrame:
    """Adds expert: a two-layer network as an expression."""
    return rows.withColumn("expert", _network(inputs, w1, b1, w2, b2))


def _network(inputs: list[str], w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    hidden = [F.greatest(F.lit(0.0), sum((F.col(c) * w1[i][k] for i, c in enumerate(inputs)), F.lit(float(b1[k])))) for k in range(len(b1))]
    return sum((h * w2[k] for k, h in enumerate(hidden)), F.lit(float(b2)))


#: Role families and the phrases that tell of them, and the family of a text that tells of none.
ROLE_HINTS = {
    "AI/ML Engineer": ["machine learning", "deep learning", "pytorch", "nlp", "llm", "ai"],
    "Backend Engineer": ["backend", "django", "fastapi", "microservices", "api"],
    "DevOps Engineer": ["kubernetes", "docker", "terraform", "ci/cd", "devops", "sre"],
    "Data/BI Engineer": ["sql", "etl", "snowflake", "redshift", "dbt", "data engineer"],
    "Search Engineer": ["elasticsearch", "opensearch", "solr", "information retrieval", "ranking"],
}
DEFAULT_ROLE = "Backend Engineer"


def role_of(text: Column) -> Column:
    """The role family of which a text has most phrases, of equal ones the first; a null text has the default one."""

    def pick(t: Column) -> Column:
        counts = F.array(*[sum((t.contains(p).cast("int") for p in phrases), F.lit(0)) for phrases in ROLE_HINTS.values()])
        most = F.array_max(counts)
        return F.when(most > 0, F.element_at(T.words(list(ROLE_HINTS)), F.array_position(counts, most).cast("int"))).otherwise(DEFAULT_ROLE)

    return T.let(F.coalesce(F.lower(text), F.lit("")), pick)


def routed(rows: DataFrame, role: str, inputs: list[str], experts: dict[str, tuple], otherwise: str) -> DataFrame:
    """Adds expert: each row's score by the network (w1, b1, w2, b2) of its role, or a feature where its role has none."""
    value = F.col(otherwise)
    for name, (w1, b1, w2, b2) in experts.items():
        value = F.when(F.col(role) == name, _network(inputs, w1, b1, w2, b2)).otherwise(value)
    return rows.withColumn("expert", value)


def role_points(rows: DataFrame, roles: dict[str, dict[str, list[str]]], text: str = "x_full", tokens: str = "x_tokens") -> DataFrame:
    """(role, points) of each row against each role's titles, skills and evidence; roles are a plan's few."""
    cells = []
    for role, terms in roles.items():
        points = 2.0 * F.least(T.count_terms(terms["titles"], F.col(text), F.col(tokens)), F.lit(2)) + 1.0 * F.least(T.count_terms(terms["skills"], F.col(text), F.col(tokens)), F.lit(6)) + 0.5 * F.least(T.count_terms(terms["evidence"], F.col(text), F.col(tokens)), F.lit(4))
        cells.append(F.struct(F.lit(role).alias("role"), points.alias("points")))
    return rows.withColumn("__roles", F.explode(F.array(*cells))).withColumns({"role": F.col("__roles.role"), "points": F.col("__roles.points")}).drop("__roles")
