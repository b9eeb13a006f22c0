"""Queries: ranking metrics, agreement, splits, rank aggregation, joins, windows, set operations and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric as N
from lodestar.functions import text as T
from lodestar.operators import evaluation as E
from lodestar.operators import fusion as G
from lodestar.streaming.limits import Rate, limited

SIX = N.six


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    tier = F.greatest(F.lit(0), 4 * F.col("quality") - 3 * F.col("toxic")).cast("double")
    return _read(spark, d, "labels").select("doc_id", tier.alias("tier"), (tier / 2 + F.col("doc_id") % 3).alias("gain"))


def _ranking(spark: SparkSession, d: str, n: int = 100) -> DataFrame:
    """The hundred longest documents."""
    top = _read(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(n)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


LABELS = "labels_ AS (SELECT doc_id, greatest(0, 4 * quality - 3 * toxic)::DOUBLE AS tier, greatest(0, 4 * quality - 3 * toxic)::DOUBLE / 2 + doc_id % 3 AS gain FROM labels)"
RANKING = "ranking_ AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100)"


def _evaluate(policy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = E.evaluate(_ranking(spark, d), _labels(spark, d), "doc_id", policy)
        return out.select(*[SIX(F.col(c)).alias(c) for c in ("ndcg10", "ndcg50", "map", "p10", "composite", "coverage")], "n_scored", "n_labels")

    return run


def _evaluate_sql(policy: str) -> str:
    return f"""
WITH {LABELS}, {RANKING},
s AS (SELECT doc_id, coalesce(tier, 0) AS tier, coalesce(gain, 0) AS gain, row_number() OVER (ORDER BY rank) AS rank FROM ranking_ {"LEFT" if policy == "zero" else ""} JOIN labels_ USING (doc_id)),
h AS (SELECT *, sum(CASE WHEN tier >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS hits FROM s),
i AS (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS rank FROM labels_),
m AS (SELECT sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 10) / (SELECT sum((2 ^ gain - 1) / log2(rank + 1)) FROM i WHERE rank <= 10) AS ndcg10,
 sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 50) / (SELECT sum((2 ^ gain - 1) / log2(rank + 1)) FROM i WHERE rank <= 50) AS ndcg50,
 sum(CASE WHEN tier >= 3 THEN hits / rank ELSE 0 END) / least((SELECT count(*) FROM labels_ WHERE tier >= 3), count(*)) AS map,
 count(*) FILTER (rank <= 10 AND tier >= 3) / 10 AS p10, (SELECT count(*) FROM ranking_ JOIN labels_ USING (doc_id)) / (SELECT count(*) FROM ranking_) AS coverage, count(*) AS n_scored FROM h)
SELECT round(ndcg10, 6) AS ndcg10, round(ndcg50, 6) AS ndcg50, round(map, 6) AS map, round(p10, 6) AS p10, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6)::DOUBLE AS composite, round(coverage, 6) AS coverage, n_scored, (SELECT count(*) FROM labels_) AS n_labels FROM m"""


def sets_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """One pass over a set of labels for each language, with the mean of composites beside each."""
    langs = _read(spark, d, "documents").select("doc_id", "lang")
    labels = _labels(spark, d).join(langs, "doc_id")
    out = E.evaluate(_ranking(spark, d), labels, "doc_id", "zero", ("lang",))
    mean = F.avg("composite").over(Window.partitionBy())  # a row for each set
    return out.select("lang", SIX(F.col("ndcg50")).alias("ndcg50"), SIX(F.col("composite")).alias("composite"), SIX(mean).alias("mean_composite"), "n_labels")


SETS_SQL = f"""
WITH {LABELS}, {RANKING}, l AS (SELECT lang, labels_.* FROM labels_ JOIN documents USING (doc_id)), sets AS (SELECT DISTINCT lang FROM l),
s AS (SELECT sets.lang, rank, coalesce(tier, 0) AS tier, coalesce(gain, 0) AS gain FROM ranking_ CROSS JOIN sets LEFT JOIN l ON l.doc_id = ranking_.doc_id AND l.lang = sets.lang),
h AS (SELECT *, sum(CASE WHEN tier >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY rank) AS hits FROM s),
i AS (SELECT lang, gain, row_number() OVER (PARTITION BY lang ORDER BY gain DESC) AS rank FROM l),
j AS (SELECT lang, sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 10) AS i10, sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 50) AS i50 FROM i GROUP BY lang),
n AS (SELECT lang, count(*) AS n_labels, count(*) FILTER (tier >= 3) AS rel FROM l GROUP BY lang),
m AS (SELECT lang, sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 10) AS d10, sum((2 ^ gain - 1) / log2(rank + 1)) FILTER (rank <= 50) AS d50, sum(CASE WHEN tier >= 3 THEN hits / rank ELSE 0 END) AS ps, count(*) FILTER (rank <= 10 AND tier >= 3) / 10 AS p10, count(*) AS c FROM h GROUP BY lang),
r AS (SELECT lang, coalesce(d50 / nullif(i50, 0), 0) AS ndcg50, 0.5 * coalesce(d10 / nullif(i10, 0), 0) + 0.3 * coalesce(d50 / nullif(i50, 0), 0) + 0.15 * coalesce(ps / nullif(least(rel, c), 0), 0) + 0.05 * p10 AS composite, n_labels FROM m JOIN j USING (lang) JOIN n USING (lang))
SELECT lang, round(ndcg50, 6) AS ndcg50, round(composite, 6)::DOUBLE AS composite, round(avg(composite) OVER (), 6)::DOUBLE AS mean_composite, n_labels FROM r"""


def other_precision(spark: SparkSession, d: str) -> DataFrame:
    return E.average_precision(_ranking(spark, d), _labels(spark, d), "doc_id").select(SIX(F.col("average_precision")).alias("average_precision"))


OTHER_SQL = f"""
WITH {LABELS}, {RANKING}, h AS (SELECT rank, coalesce(tier, 0) >= 4 AS hit, sum((coalesce(tier, 0) >= 4)::INT) OVER (ORDER BY rank) AS hits FROM ranking_ LEFT JOIN labels_ USING (doc_id))
SELECT round(coalesce(sum(CASE WHEN hit THEN hits / rank ELSE 0 END) / nullif((SELECT count(*) FROM labels_ WHERE tier >= 4), 0), 0), 6)::DOUBLE AS average_precision FROM h"""


def label_overlay(spark: SparkSession, d: str) -> DataFrame:
    extra = _read(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(2.0).alias("tier"), F.lit(1.5).alias("gain"))
    return E.overlay(_labels(spark, d), extra, "doc_id")


OVERLAY_SQL = f"WITH {LABELS}, e AS (SELECT doc_id, 2.0::DOUBLE AS tier, 1.5::DOUBLE AS gain FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, coalesce(e.tier, l.tier) AS tier, coalesce(e.gain, l.gain) AS gain FROM labels_ l FULL JOIN e USING (doc_id)"


def auc_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """How well length tells good documents from others; scores are cut so that many tie."""
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents"), "doc_id").select("lang", F.floor(F.col("n_chars") / 100).alias("score"), "quality")
    out = E.auc(rows, "score", F.col("quality") == 1, "lang")
    return out.select("lang", SIX(F.col("auc")).alias("auc"), "n_positive", "n_negative")


AUC_SQL = """
WITH r AS (SELECT lang, n_chars // 100 AS s, quality FROM labels JOIN documents USING (doc_id)),
p AS (SELECT lang, s FROM r WHERE quality = 1), q AS (SELECT lang, s FROM r WHERE quality = 0),
u AS (SELECT p.lang, sum(CASE WHEN p.s > q.s THEN 1.0::DOUBLE WHEN p.s = q.s THEN 0.5 ELSE 0 END) AS u FROM p JOIN q ON p.lang = q.lang GROUP BY 1)
SELECT lang, round(u / nullif(n_positive * n_negative, 0), 6) AS auc, n_positive, n_negative FROM (SELECT lang, count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative FROM r GROUP BY lang) LEFT JOIN u USING (lang)"""


def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's and Spearman's correlation of balance and number of orders; ties share their mean rank."""
    orders = _read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))
    rows = _read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_acctbal", "n")
    a = E.tie_ranks(rows, "c_acctbal").withColumnRenamed("average_rank", "ra")
    b = E.tie_ranks(rows, "n").withColumnRenamed("average_rank", "rb")
    return rows.join(a, "c_acctbal").join(b, "n").agg(SIX(F.corr("c_acctbal", "n")).alias("pearson"), SIX(F.corr("ra", "rb")).alias("spearman"), F.count("*").alias("n"))


CORRELATION_SQL = """
WITH r AS (SELECT c_acctbal AS a, n FROM customer JOIN (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey),
k AS (SELECT a, n, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rb FROM r)
SELECT round(corr(a, n), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k"""


def decile_lift(spark: SparkSession, d: str) -> DataFrame:
    """Share of good documents in each tenth by length over the share in all."""
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    cut = E.quantile_groups(rows, "n_chars", "doc_id", 10, "decile")
    overall = F.sum("s").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())  # ten rows
    return cut.groupBy("decile").agg(F.count("*").alias("n"), F.sum("quality").alias("s")).select("decile", "n", SIX(F.col("s") / F.col("n")).alias("share"), SIX(F.col("s") / F.col("n") / overall).alias("lift"))


DECILE_SQL = "WITH c AS (SELECT quality, ntile(10) OVER (ORDER BY n_chars DESC, doc_id) AS decile FROM labels JOIN documents USING (doc_id)) SELECT decile, count(*) AS n, round(avg(quality), 6) AS share, round(avg(quality) / (SELECT avg(quality) FROM c), 6) AS lift FROM c GROUP BY decile"


def agreement(spark: SparkSession, d: str) -> DataFrame:
    pairs = _labels(spark, d).join(_read(spark, d, "documents"), "doc_id").select(F.col("tier").cast("int").alias("a"), (F.col("doc_id") % 5).cast("int").alias("b"))
    return E.weighted_kappa(pairs, "a", "b", 5).select(*[SIX(F.col(c)).alias(c) for c in ("kappa", "exact", "within_one")])


AGREEMENT_SQL = f"""
WITH {LABELS}, p AS (SELECT tier::INT AS a, (doc_id % 5)::INT AS b FROM labels_ JOIN documents USING (doc_id)), n AS (SELECT count(*)::DOUBLE AS n FROM p),
a AS (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY a), b AS (SELECT b, count(*)::DOUBLE AS c FROM p GROUP BY b)
SELECT round(1 - (SELECT sum((a - b) ^ 2 / 16) FROM p) / (SELECT sum((a.a - b.b) ^ 2 / 16 * a.c * b.c / n) FROM a, b, n), 6) AS kappa, round((SELECT avg((a = b)::INT) FROM p), 6) AS exact, round((SELECT avg((abs(a - b) <= 1)::INT) FROM p), 6) AS within_one"""


def holdout(spark: SparkSession, d: str) -> DataFrame:
    """The ranking's dcg at 50 on a digest half, for each of ten seeds; mean, deviation, least and most."""
    rows = _ranking(spark, d).join(_labels(spark, d), "doc_id").withColumn("seed", F.explode(F.array(*map(F.lit, range(10)))))
    half = rows.where(T.digest_mod(F.concat_ws("|", "doc_id", "seed"), 2) == 0).withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("rank")))
    each = half.groupBy("seed").agg(E.dcg(F.col("gain"), F.col("place"), 50).alias("v"))
    return each.agg(SIX(F.avg("v")).alias("mean"), SIX(F.stddev_pop("v")).alias("deviation"), SIX(F.min("v")).alias("least"), SIX(F.max("v")).alias("most"), F.count("*").alias("n"))


def _digest2(x: str) -> str:
    return f"(strpos('0123456789abcdef', md5({x})[32]) - 1) % 2"


HOLDOUT_SQL = f"""
WITH {LABELS}, {RANKING}, h AS (SELECT seed, gain, row_number() OVER (PARTITION BY seed ORDER BY rank) AS p FROM ranking_ JOIN labels_ USING (doc_id), range(10) s(seed) WHERE {_digest2("doc_id || '|' || seed")} = 0),
v AS (SELECT seed, coalesce(sum((2 ^ gain - 1) / log2(p + 1)) FILTER (p <= 50), 0) AS v FROM h GROUP BY seed)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(min(v), 6) AS least, round(max(v), 6) AS most, count(*) AS n FROM v"""


def nested_select(spark: SparkSession, d: str) -> DataFrame:
    """For each of five folds, the length cut that does best on the other folds, with its score on the fold."""
    rows = _labels(spark, d).join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("fold", T.digest_mod(F.col("doc_id").cast("string"), 5)).withColumn("cut", F.explode(F.array(*map(F.lit, (300, 800, 2000)))))
    cells = rows.groupBy("cut", "fold").agg(F.sum(F.when((F.col("n_chars") >= F.col("cut")) == (F.col("tier") >= 3), 1).otherwise(0)).alias("right"), F.count("*").alias("n"))
    w = Window.partitionBy("cut")
    cells = cells.withColumns({"train": (F.sum("right").over(w) - F.col("right")) / (F.sum("n").over(w) - F.col("n")), "test": F.col("right") / F.col("n")})
    best = F.max_by(F.struct("cut", "train", "test"), F.struct("train", -F.col("cut")))
    return cells.groupBy("fold").agg(best.alias("b")).select(F.col("fold").cast("long").alias("fold"), F.col("b.cut").cast("long").alias("cut"), SIX(F.col("b.train")).alias("train"), SIX(F.col("b.test")).alias("test"))


def _md5_mod(x: str, n: int) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5({x}), ''), lambda h: strpos('0123456789abcdef', h) - 1)), lambda a, c: (a * 16 + c) % {n})::BIGINT"


NESTED_SQL = f"""
WITH {LABELS}, r AS (SELECT {_md5_mod("doc_id::VARCHAR", 5)} AS fold, cut, (n_chars >= cut) = (tier >= 3) AS ok FROM labels_ JOIN documents USING (doc_id), (SELECT unnest([300, 800, 2000]) AS cut)),
c AS (SELECT cut, fold, sum(ok::INT) AS good, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT *, (sum(good) OVER (PARTITION BY cut) - good) / (sum(n) OVER (PARTITION BY cut) - n) AS train FROM c)
SELECT fold, cut::BIGINT AS cut, round(train, 6) AS train, round(good / n, 6) AS test FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train DESC, cut) = 1"""


def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    """Spread of signed balances by segment."""
    rows = _read(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("v"))
    out = E.summary(rows, "v", "c_mktsegment")
    return out.select("c_mktsegment", "n", "nonzero", "positive", "negative", *[SIX(F.col(c)).alias(c) for c in ("mean", "min", "max", "max_abs", "p05", "median", "p95")])


DELTA_SQL = """
WITH r AS (SELECT c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_acctbal END AS v FROM customer), g AS (SELECT c_mktsegment, list_sort(list(v)) AS l FROM r GROUP BY 1)
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (v <> 0) AS nonzero, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(abs(v)), 6) AS max_abs,
 round(any_value(l[round_even(0.05::DOUBLE * (len(l) - 1), 0)::INT + 1]), 6) AS p05, round(any_value(l[round_even(0.5::DOUBLE * (len(l) - 1), 0)::INT + 1]), 6) AS median, round(any_value(l[round_even(0.95::DOUBLE * (len(l) - 1), 0)::INT + 1]), 6) AS p95 FROM r JOIN g USING (c_mktsegment) GROUP BY c_mktsegment"""

# ---- rank aggregation: voters over the suppliers --------------------------------------------------------------------
VOTERS = ["balance", "lines", "quantity", "name"]


def _votes(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "supplier")
    lines = _read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    rows = s.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("ident"), F.col("s_acctbal").alias("balance"), F.coalesce("lines", F.lit(0)).cast("double").alias("lines"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"), (F.col("s_suppkey") * 7919 % 1009).cast("double").alias("name"))
    long = rows.unpivot("ident", VOTERS, "voter", "value")
    return long.select("voter", "ident", F.row_number().over(Window.partitionBy("voter").orderBy(F.desc("value"), "ident")).alias("rank"))


VOTES = """l AS (SELECT l_suppkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
wide AS (SELECT s_suppkey AS ident, s_acctbal AS balance, coalesce(lines, 0)::DOUBLE AS lines, round(coalesce(quantity, 0), 2) AS quantity, (s_suppkey * 7919 % 1009)::DOUBLE AS name FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey),
votes AS (SELECT voter, ident, row_number() OVER (PARTITION BY voter ORDER BY value DESC, ident) AS rank FROM (UNPIVOT wide ON balance, lines, quantity, name INTO NAME voter VALUE value))"""


def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks, plain and weighted, Borda counts, mean ranks and a linear blend."""
    v = _votes(spark, d)
    n = v.where("voter = 'name'").count()
    weights = {"balance": 1.0, "lines": 0.5, "quantity": 0.5, "name": 0.1}
    one = lambda df, c: df.select("ident", SIX(F.col("score")).alias(c))
    blend = v.groupBy("ident").agg((-(0.7 * F.max(F.when(F.col("voter") == "balance", F.col("rank"))) + 0.3 * F.max(F.when(F.col("voter") == "lines", F.col("rank"))))).alias("score"))
    out = one(G.rrf(v), "rrf").join(one(G.rrf(v, 30.0, weights), "weighted"), "ident").join(one(G.borda(v, n), "borda"), "ident").join(one(G.rank_average(v), "mean"), "ident").join(one(blend, "blend"), "ident")
    return out


FUSED_SQL = f"""
WITH {VOTES} SELECT ident, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS rrf, round(sum(CASE voter WHEN 'balance' THEN 1.0::DOUBLE WHEN 'name' THEN 0.1 ELSE 0.5 END / (30.0::DOUBLE + rank)), 6) AS weighted,
 sum((SELECT count(*) FROM supplier) - rank)::DOUBLE AS borda, round(-avg(rank), 6) AS mean, round(-(0.7::DOUBLE * max(rank) FILTER (voter = 'balance') + 0.3::DOUBLE * max(rank) FILTER (voter = 'lines')), 6) AS blend FROM votes GROUP BY ident"""


def unique_weights(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks weighted by what a voter says that no other does, with a bonus for being in many top twenties."""
    v = _votes(spark, d)
    x, y = v.alias("x"), v.alias("y")
    like = x.join(y, (F.col("x.ident") == F.col("y.ident")) & (F.col("x.voter") != F.col("y.voter"))).groupBy(F.col("x.voter").alias("voter"), F.col("y.voter").alias("other")).agg(F.abs(F.corr("x.rank", "y.rank")).alias("r"))
    w = like.groupBy("voter").agg((1 - F.max("r")).alias("u"))
    w = w.withColumn("w", F.col("u") / F.sum("u").over(Window.partitionBy())).select("voter", "w")
    n = F.count_if(F.col("rank") <= 20).over(Window.partitionBy("ident"))
    return v.withColumn("n", n).join(F.broadcast(w), "voter").groupBy("ident").agg(SIX(F.sum((F.col("w") + F.col("n") / 10.0) / (30 + F.col("rank")))).alias("score"))


UNIQUE_SQL = f"""
WITH {VOTES}, r AS (SELECT x.voter, y.voter AS other, abs(corr(x.rank, y.rank)) AS r FROM votes x JOIN votes y ON x.ident = y.ident AND x.voter <> y.voter GROUP BY ALL),
u AS (SELECT voter, 1 - max(r) AS u FROM r GROUP BY voter), w AS (SELECT voter, u / sum(u) OVER () AS w FROM u), n AS (SELECT *, count(*) FILTER (rank <= 20) OVER (PARTITION BY ident) AS n FROM votes)
SELECT ident, round(sum((w + n / 10) / (30 + rank)), 6) AS score FROM n JOIN w USING (voter) GROUP BY ident"""


def copeland(spark: SparkSession, d: str) -> DataFrame:
    return G.copeland(_votes(spark, d), VOTERS)


COPELAND_SQL = f"""
WITH {VOTES}, m AS (SELECT x.ident AS a, y.ident AS b FROM votes x JOIN votes y ON x.voter = y.voter AND x.rank < y.rank GROUP BY ALL HAVING count(*) >= 3)
SELECT ident, ((SELECT count(*) FROM m WHERE a = ident) - (SELECT count(*) FROM m WHERE b = ident))::DOUBLE AS score FROM (SELECT DISTINCT ident FROM votes)"""


def locks_and_bands(spark: SparkSession, d: str) -> DataFrame:
    """The first ten by balance stay, the rest follow by fused rank up to sixty, one band is sorted by another key."""
    v = _votes(spark, d)
    base = v.where("voter = 'balance'").select("ident", "rank")
    fused = G.ranked(G.rrf(v))
    out = G.locked(base, fused, 10, 60)
    keyed = out.join(v.where("voter = 'lines'").select("ident", F.col("rank").alias("key")), "ident")
    return G.band_sort(keyed, 20, 30, F.col("key")).select("ident", F.col("rank").cast("long").alias("rank"))


LOCKS_SQL = f"""
WITH {VOTES}, f AS (SELECT ident, row_number() OVER (ORDER BY score DESC, ident) AS fr FROM (SELECT ident, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM votes GROUP BY ident)),
o AS (SELECT ident, row_number() OVER (ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN rank ELSE fr END, ident) AS rank FROM votes JOIN f USING (ident) WHERE voter = 'balance' QUALIFY row_number() OVER (ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN rank ELSE fr END, ident) <= 60),
k AS (SELECT o.ident, o.rank, votes.rank AS key FROM o JOIN votes ON o.ident = votes.ident AND voter = 'lines')
SELECT ident, CASE WHEN rank > 20 AND rank <= 30 THEN 20 + row_number() OVER (PARTITION BY rank > 20 AND rank <= 30 ORDER BY key DESC, ident) ELSE rank END AS rank FROM k"""


def rank_difference(spark: SparkSession, d: str) -> DataFrame:
    """Two top fifties: who entered, left, and how far the others moved."""
    v = _votes(spark, d)
    a, b = (v.where((F.col("voter") == x) & (F.col("rank") <= 50)).select("ident", F.col("rank").alias(c)) for x, c in (("balance", "before"), ("lines", "after")))
    status = F.when(F.col("before").isNull(), "entered").when(F.col("after").isNull(), "left").otherwise("stayed")
    return a.join(b, "ident", "full_outer").select("ident", status.alias("status"), F.coalesce(F.col("before") - F.col("after"), F.lit(0)).cast("long").alias("moved"))


DIFFERENCE_SQL = f"WITH {VOTES}, a AS (SELECT ident, rank FROM votes WHERE voter = 'balance' AND rank <= 50), b AS (SELECT ident, rank FROM votes WHERE voter = 'lines' AND rank <= 50) SELECT ident, CASE WHEN a.rank IS NULL THEN 'entered' WHEN b.rank IS NULL THEN 'left' ELSE 'stayed' END AS status, coalesce(a.rank - b.rank, 0) AS moved FROM a FULL JOIN b USING (ident)"


def regret(spark: SparkSession, d: str) -> DataFrame:
    """The voter whose top twenty has the least worst-case regret over mixes of two utilities."""
    v = _votes(spark, d).where("rank <= 20")
    u = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("ident"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_suppkey") % 10).cast("double").alias("b"))
    mixed = v.join(u, "ident").withColumn("mix", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    utility = mixed.groupBy("voter", "mix").agg(F.sum((F.col("mix") * F.col("a") + (1 - F.col("mix")) * F.col("b")) / F.log2(F.col("rank") + 1)).alias("u"))
    lost = utility.withColumn("r", F.max("u").over(Window.partitionBy("mix")) - F.col("u"))
    return lost.groupBy("voter").agg(SIX(F.max("r")).alias("worst"), SIX(F.avg("r")).alias("mean"))


REGRET_SQL = f"""
WITH {VOTES}, m AS (SELECT voter, mix, sum((mix * s_acctbal / 1000 + (1 - mix) * (s_suppkey % 10)) / log2(rank + 1)) AS u FROM votes JOIN supplier ON ident = s_suppkey, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS mix) WHERE rank <= 20 GROUP BY ALL),
r AS (SELECT voter, max(u) OVER (PARTITION BY mix) - u AS r FROM m) SELECT voter, round(max(r), 6) AS worst, round(avg(r), 6) AS mean FROM r GROUP BY voter"""


def influence(spark: SparkSession, d: str) -> DataFrame:
    """What each row of a top thirty adds to its dcg: the row goes, the rest move up, the next one fills."""
    v = _votes(spark, d).where("voter = 'balance' AND rank <= 31").join(_read(spark, d, "supplier").select(F.col("s_suppkey").alias("ident"), (F.col("s_suppkey") % 4).cast("double").alias("gain")), "ident")
    dropped = v.where("rank <= 30").select(F.col("ident").alias("dropped"), F.col("rank").alias("at"))
    rest = v.join(F.broadcast(dropped), F.col("ident") != F.col("dropped"))  # thirty-one by thirty rows, the report's size
    place = F.when(F.col("rank") > F.col("at"), F.col("rank") - 1).otherwise(F.col("rank"))
    without = rest.groupBy("dropped").agg(E.dcg(F.col("gain"), place, 30).alias("w"))
    whole = v.agg(E.dcg(F.col("gain"), F.col("rank"), 30).alias("whole"))
    return without.crossJoin(whole).select(F.col("dropped").alias("ident"), SIX(F.col("whole") - F.col("w")).alias("influence"))


INFLUENCE_SQL = f"""
WITH {VOTES}, v AS (SELECT ident, rank, (ident % 4)::DOUBLE AS g FROM votes WHERE voter = 'balance' AND rank <= 31),
w AS (SELECT d.ident, sum((2 ^ v.g - 1) / log2(CASE WHEN v.rank > d.rank THEN v.rank ELSE v.rank + 1 END)) FILTER ((CASE WHEN v.rank > d.rank THEN v.rank - 1 ELSE v.rank END) <= 30) AS w FROM v d JOIN v ON v.ident <> d.ident WHERE d.rank <= 30 GROUP BY d.ident)
SELECT ident, round((SELECT sum((2 ^ g - 1) / log2(rank + 1)) FROM v WHERE rank <= 30) - w, 6) + 0.0::DOUBLE AS influence FROM w"""


def _iterative(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        scores = getattr(G, method)(_votes(spark, d), VOTERS)
        return G.ranked(scores).select("ident", SIX(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))

    return run


def diverse(spark: SparkSession, d: str) -> DataFrame:
    items = _read(spark, d, "embeddings").select(F.col("vec_id").alias("ident"), (1 + F.col("label") / 10).alias("quality"), F.col("embedding").alias("vector"))
    return G.dpp(items, 20)


# ---- windows, sets, joins -------------------------------------------------------------------------------------------
def first_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Strata drawn by hash; a row in two strata counts in the first; ten of each."""
    docs = _read(spark, d, "documents").select("doc_id", "lang", "n_chars", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("draw"))
    strata = [docs.where("n_chars > 5000").withColumn("stratum", F.lit(1)), docs.where("lang = 'fr'").withColumn("stratum", F.lit(2)), docs.where("n_chars < 400").withColumn("stratum", F.lit(3))]
    every = strata[0].unionByName(strata[1]).unionByName(strata[2])
    first = every.groupBy("doc_id", "draw").agg(F.min("stratum").alias("stratum"))
    w = Window.partitionBy("stratum").orderBy("draw")
    return first.withColumn("place", F.row_number().over(w)).where("place <= 10").select("doc_id", F.col("stratum").cast("long").alias("stratum"), F.col("place").cast("long").alias("place"))


BUCKET_SQL = """
WITH e AS (SELECT doc_id, 1 AS s FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 3 FROM documents WHERE n_chars < 400)
SELECT doc_id, min(s)::BIGINT AS stratum, row_number() OVER (PARTITION BY min(s) ORDER BY md5(doc_id::VARCHAR)) AS place FROM e GROUP BY doc_id QUALIFY place <= 10"""


def pair_generation(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in a ranking, and the top row with the bottom row."""
    r = _ranking(spark, d, 40)
    n = r.withColumn("next", F.lead("doc_id").over(Window.orderBy("rank"))).where("next IS NOT NULL").select(F.lit("adjacent").alias("kind"), F.col("doc_id").alias("a"), F.col("next").alias("b"))
    x, y = r.alias("x"), r.alias("y")
    ends = x.join(y, F.col("x.rank") == 41 - F.col("y.rank")).where("x.rank <= 5").select(F.lit("ends"), F.col("x.doc_id"), F.col("y.doc_id"))
    return n.union(ends)


PAIR_SQL = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40)
SELECT 'adjacent' AS kind, x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON y.rank = x.rank + 1 UNION ALL SELECT 'ends', x.doc_id, y.doc_id FROM r x JOIN r y ON x.rank = 41 - y.rank WHERE x.rank <= 5"""


def validation(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a ranking that has some: ids, ranks, scores out of order, ties out of order, blanks."""
    r = _ranking(spark, d, 100)
    rows = r.select(F.concat(F.lit("CAND_"), F.lpad(F.col("doc_id").cast("string"), F.when(F.col("rank") == 9, 6).otherwise(7), "0")).alias("candidate_id"), F.when(F.col("rank") == 50, 49).otherwise(F.col("rank")).alias("rank"), F.when(F.col("rank") == 30, 1.5).otherwise(F.round(1 - F.floor((F.col("rank") - 1) / 3) / 50, 6)).alias("score"), F.when(F.col("rank") == 70, " ").otherwise("fits").alias("reasoning"), F.col("rank").alias("position"))
    w = Window.orderBy("position")
    last, before = F.lag("score").over(w), F.lag("candidate_id").over(w)
    faults = {
        "invalid_id": ~F.col("candidate_id").rlike("^CAND_[0-9]{7}$"),
        "duplicate_id": F.count("*").over(Window.partitionBy("candidate_id")) > 1,
        "duplicate_rank": (F.row_number().over(Window.partitionBy("rank").orderBy("position")) > 1),
        "rank_position": F.col("rank") != F.col("position"),
        "score_range": (F.col("score") < 0) | (F.col("score") > 1),
        "score_increases": F.coalesce(F.col("score") > last, F.lit(False)),
        "tie_order": F.coalesce((F.col("score") == last) & (F.col("candidate_id") < before), F.lit(False)),
        "blank_reasoning": F.trim("reasoning") == "",
    }
    found = rows.withColumn("faults", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]))).select("position", F.explode("faults").alias("fault"))
    return found.select(F.col("position").cast("long").alias("position"), "fault")


VALIDATION_SQL = r"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM documents QUALIFY p <= 100),
x AS (SELECT p, 'CAND_' || lpad(doc_id::VARCHAR, CASE WHEN p = 9 THEN 6 ELSE 7 END, '0') AS id, CASE WHEN p = 50 THEN 49 ELSE p END AS rank, CASE WHEN p = 30 THEN 1.5::DOUBLE ELSE round(1 - ((p - 1) // 3)::DOUBLE / 50, 6) END AS score, CASE WHEN p = 70 THEN ' ' ELSE 'fits' END AS why FROM r),
y AS (SELECT *, lag(score) OVER (ORDER BY p) AS ls, lag(id) OVER (ORDER BY p) AS li, count(*) OVER (PARTITION BY id) AS ni, row_number() OVER (PARTITION BY rank ORDER BY p) AS nr FROM x)
SELECT p AS position, fault FROM (SELECT p, unnest([CASE WHEN NOT regexp_matches(id, '^CAND_[0-9]{7}$') THEN 'invalid_id' END, CASE WHEN ni > 1 THEN 'duplicate_id' END, CASE WHEN nr > 1 THEN 'duplicate_rank' END, CASE WHEN rank <> p THEN 'rank_position' END,
 CASE WHEN score < 0 OR score > 1 THEN 'score_range' END, CASE WHEN score > ls THEN 'score_increases' END, CASE WHEN score = ls AND id < li THEN 'tie_order' END, CASE WHEN trim(why) = '' THEN 'blank_reasoning' END]) AS fault FROM y) WHERE fault IS NOT NULL"""


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents that aren't there, and those without a label: anti and semi joins."""
    docs, labels = _read(spark, d, "documents").select("doc_id"), _read(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10_000_000).otherwise(0)).alias("doc_id"))
    return labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("unknown").alias("kind")).union(docs.join(labels, "doc_id", "left_semi").where("doc_id % 3 = 0").select("doc_id", F.lit("labelled")))


MEMBERSHIP_SQL = "WITH l AS (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 10000000 ELSE 0 END AS doc_id FROM labels) SELECT doc_id, 'unknown' AS kind FROM l ANTI JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'labelled' FROM documents SEMI JOIN l USING (doc_id) WHERE doc_id % 3 = 0"


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events beyond three of a user within a day."""
    # Seconds are rounded to the nearest, halves to even, as the SQL's cast of a double does.
    e = _read(spark, d, "events").withColumn("s", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86399, 0)
    return e.withColumn("n", F.count("*").over(w)).where("n > 3").select("event_id", "user_id", "n")


RATE_SQL = "SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3"


def retry_hints(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user that a limit of three in a day lets through, and when to try again with the others."""
    return limited(_read(spark, d, "events"), Rate(3, 86400.0), ["user_id"]).select("event_id", "user_id", "allowed", "retry_after")


RETRY_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, event_id, true AS allowed, 0::BIGINT AS retry_after, [s] AS held FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, len(l) < 3, CASE WHEN len(l) < 3 THEN 0 ELSE greatest(1, floor(l[1] + 86400 - s)::BIGINT) END, CASE WHEN len(l) < 3 THEN list_append(l, s) ELSE l END
 FROM (SELECT e.user_id, e.k, e.event_id, e.s, list_filter(r.held, lambda t: t >= e.s - 86400) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, user_id, allowed, retry_after FROM r"""


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Days that orders of one customer, each of sixty days, overlap: intervals met by the months they touch."""
    o = _read(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", 60))
    # Orders that overlap share a bin of sixty days or lie in neighbouring ones; the first bin both touch counts.
    day = F.datediff(F.col("a"), F.lit("1970-01-01").cast("date"))
    bins = o.withColumn("bin", F.explode(F.sequence(F.floor(day / 61), F.floor((day + 60) / 61))))
    x, y = bins.alias("x"), bins.alias("y")
    shared = F.greatest(F.col("x.a"), F.col("y.a"))
    hit = x.join(y, (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")) & (shared < F.least(F.col("x.b"), F.col("y.b"))))
    hit = hit.where(F.col("x.bin") == F.floor(F.datediff(shared, F.lit("1970-01-01").cast("date")) / 61))
    return hit.groupBy(F.col("x.o_custkey").alias("o_custkey")).agg(F.count("*").alias("pairs"), F.sum(F.datediff(F.least(F.col("x.b"), F.col("y.b")), shared)).alias("days"))


OVERLAP_SQL = "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + 60 AS b FROM orders) SELECT x.o_custkey, count(*) AS pairs, sum(least(x.b, y.b) - greatest(x.a, y.a))::BIGINT AS days FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND greatest(x.a, y.a) < least(x.b, y.b) GROUP BY 1"


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty vectors most like the first one, likeness moved to 0..1."""
    e = _read(spark, d, "embeddings")
    first = e.orderBy("vec_id").first()["embedding"]  # one row: the query
    q = F.array(*[F.lit(float(x)) for x in first])
    out = e.select("vec_id", SIX((N.cosine(F.col("embedding"), q) + 1) / 2).alias("likeness"))
    return out.orderBy(F.desc("likeness"), "vec_id").limit(20)


COSINE_SQL = "WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round((list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1) / 2, 6) AS likeness FROM embeddings, q ORDER BY likeness DESC, vec_id LIMIT 20"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's label smoothed by the mean of its ten nearest among all others."""
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("ident"), F.col("embedding").alias("vector"), F.col("label").cast("double").alias("s"))
    near = G.nearest(e.select("ident", "vector")).join(e.select(F.col("ident").alias("other"), F.col("s").alias("t")), "other")
    mean = near.groupBy("ident").agg(F.avg("t").alias("t"))
    return e.join(mean, "ident").select(F.col("ident").alias("vec_id"), SIX(0.6 * F.col("s") + 0.4 * F.col("t")).alias("score"))


_DOT = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
NEIGHBOUR_SQL = f"""
WITH n AS (SELECT x.vec_id, x.label AS s, y.label AS t, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_DOT("x.embedding", "y.embedding")} / (sqrt({_DOT("x.embedding", "x.embedding")}) * sqrt({_DOT("y.embedding", "y.embedding")})), 9) DESC, y.vec_id) AS k FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)
SELECT vec_id, round(0.6::DOUBLE * any_value(s) + 0.4::DOUBLE * avg(t), 6) AS score FROM n WHERE k <= 10 GROUP BY vec_id"""


def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each vector as an index of cells finds them."""
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("ident"), F.col("embedding").alias("vector"))
    near = G.nearest(e, recall=0.95)
    return near.select(F.col("ident").alias("vec_id"), "other", SIX(F.col("likeness")).alias("likeness"), F.col("place").cast("long").alias("place"))


def threads(spark: SparkSession, d: str) -> DataFrame:
    """Turns and characters by conversation and role, one column for each role."""
    c = _read(spark, d, "conversations")
    return c.groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.count("turn")).na.fill(0).join(c.groupBy("conv_id").agg(F.max_by("role", F.struct("turn", "role")).alias("last_role"), F.sum(F.length("text")).alias("n_chars")), "conv_id")


THREAD_SQL = "SELECT conv_id, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, arg_max(role, (turn, role)) AS last_role, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id"


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Min-max, both ways to treat constants, z-scores and bands by segment."""
    c = _read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", 5.0).otherwise(F.col("c_acctbal")).alias("v"))
    stats = c.groupBy("c_mktsegment").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    r = c.join(F.broadcast(stats), "c_mktsegment")  # a row for each segment
    v = F.col("v")
    return r.select("c_custkey", SIX(N.minmax(v, F.col("lo"), F.col("hi"))).alias("zero"), SIX(N.minmax(v, F.col("lo"), F.col("hi"), 0.5)).alias("half"), SIX(N.zscore(v, F.col("m"), F.col("s"))).alias("z"), SIX(N.gaussian(v / 1000, 7.0, 2.0)).alias("band"), SIX(N.sigmoid(v / 5000)).alias("sigmoid"), SIX(N.saturation(F.greatest(v, F.lit(0.0)))).alias("saturation"), N.steps(v, [(0, 1.0), (2500, 0.85), (5000, 0.45)], 0.2).alias("step"), F.format_string("%.6f", N.clamp(v / 10000)).alias("printed"))


NORMALISED_SQL = """
WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 5.0::DOUBLE ELSE c_acctbal END AS v FROM customer), s AS (SELECT c_mktsegment, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY 1)
SELECT c_custkey, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS zero, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS half, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0::DOUBLE AS z, round(exp(-((v / 1000 - 7) ^ 2) / 8), 6) AS band, round(1 / (1 + exp(-v / 5000)), 6) AS sigmoid,
 round(ln(1 + greatest(v, 0)) / ln(61), 6) AS saturation, CASE WHEN v <= 0 THEN 1.0::DOUBLE WHEN v <= 2500 THEN 0.85::DOUBLE WHEN v <= 5000 THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END AS step, printf('%.6f', least(greatest(v / 10000, 0), 1)) AS printed FROM c JOIN s USING (c_mktsegment)"""

QUERIES = {
    "a01_evaluate_exclude": _evaluate("exclude"),
    "a01_evaluate_zero": _evaluate("zero"),
    "a06_label_sets": sets_evaluation,
    "a04_average_precision": other_precision,
    "j03_label_overlay": label_overlay,
    "a09_auc": auc_by_lang,
    "a10_correlations": correlations,
    "a11_decile_lift": decile_lift,
    "a12_agreement": agreement,
    "a15_repeated_holdout": holdout,
    "a16_nested_select": nested_select,
    "a17_delta_summary": delta_summary,
    "g01_fused_scores": fused_scores,
    "g05_unique_weights": unique_weights,
    "g06_copeland": copeland,
    "g07_local_kemeny": _iterative("local_kemeny"),
    "g08_mc4": _iterative("mc4"),
    "g09_plackett_luce": _iterative("plackett_luce"),
    "g10_dpp": diverse,
    "g17_regret": regret,
    "g19_influence": influence,
    "u03_locks_and_bands": locks_and_bands,
    "j05_rank_difference": rank_difference,
    "j04_membership": membership,
    "u05_first_bucket": first_bucket,
    "w11_pair_generation": pair_generation,
    "w05_validation": validation,
    "w14_rate_limit": rate_limit,
    "w14_retry_hints": retry_hints,
    "j12_interval_overlap": overlaps,
    "n12_cosine_topk": cosine_topk,
    "g11_neighbour_scores": neighbours,
    "j10_indexed_neighbours": indexed_neighbours,
    "a20_thread_pivot": threads,
    "n02_normalised": normalised,
}
ORACLE = {
    "a01_evaluate_exclude": _evaluate_sql("exclude"),
    "a01_evaluate_zero": _evaluate_sql("zero"),
    "a06_label_sets": SETS_SQL,
    "a04_average_precision": OTHER_SQL,
    "j03_label_overlay": OVERLAY_SQL,
    "a09_auc": AUC_SQL,
    "a10_correlations": CORRELATION_SQL,
    "a11_decile_lift": DECILE_SQL,
    "a12_agreement": AGREEMENT_SQL,
    "a15_repeated_holdout": HOLDOUT_SQL,
    "a16_nested_select": NESTED_SQL,
    "a17_delta_summary": DELTA_SQL,
    "g01_fused_scores": FUSED_SQL,
    "g05_unique_weights": UNIQUE_SQL,
    "g06_copeland": COPELAND_SQL,
    "g17_regret": REGRET_SQL,
    "g19_influence": INFLUENCE_SQL,
    "u03_locks_and_bands": LOCKS_SQL,
    "j05_rank_difference": DIFFERENCE_SQL,
    "j04_membership": MEMBERSHIP_SQL,
    "u05_first_bucket": BUCKET_SQL,
    "w11_pair_generation": PAIR_SQL,
    "w05_validation": VALIDATION_SQL,
    "w14_rate_limit": RATE_SQL,
    "w14_retry_hints": RETRY_SQL,
    "j12_interval_overlap": OVERLAP_SQL,
    "n12_cosine_topk": COSINE_SQL,
    "g11_neighbour_scores": NEIGHBOUR_SQL,
    "a20_thread_pivot": THREAD_SQL,
    "n02_normalised": NORMALISED_SQL,
}
