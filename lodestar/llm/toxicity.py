"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms and homoglyphs of other scripts become Latin letters, digits and signs that
stand for letters inside a word become those letters, zero-width characters go, letters become lower case, all else a
space. An Aho-Corasick automaton finds the lexicon's stems at word starts; hits inside an exception phrase don't
count. The weights' sum, alone and per word, gives the score by a logistic function.

The lexicon is learned: word-initial stems of 3 to 10 letters whose presence differs between labels by a likelihood
ratio beyond what the number of stems tried would give by chance; each weighs its log odds. Exception phrases are
learned likewise: a hit with its neighbour word that is found mostly in rows with label 0. Training takes a bounded
sample of about SAMPLE labelled rows, chosen by a hash of the id, of whole texts; scoring reads every row. All stems and
phrases that pass their tests are taken: what the sample holds bounds them, no count does.

Defined results: null and empty texts get the score of a text without hits. Several labels of one id: the largest
counts; null labels don't. Without labels of both kinds nothing is learned and all scores are 0. Rows that repeat an id
are given back each. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
STEM_LETTERS = (3, 10)

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_ODD = re.compile("[^\x00-ɏ‘’“”—–…]")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_MIXED = re.compile(r"(?<=[^\W\d_])[0134579@$!|+]+(?=[^\W\d_])|(?<![^\W_])[0134579@$!|+]+(?=[^\W\d_])|(?<=[^\W\d_])[0134579]+")
_GAP = re.compile(r"[\W\d_]+")
_look = str.maketrans(HOMOGLYPHS)
_sub = str.maketrans(DIGITS)


def fold(text: str | None) -> str:
    """Words of letters, one space before, between and after."""
    text = text or ""
    if _ODD.search(text) or "­" in text:
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    text = text.lower().translate(_look) if not text.isascii() else text.lower()
    return " " + _GAP.sub(" ", _MIXED.sub(lambda m: m[0].translate(_sub), text)).strip() + " "


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label by stem, summed within the task; '' counts all documents."""
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def rows():
        keys = list(found)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], names=["stem", "n0", "n1"])
        found.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stems = {w[:k] for w in set(fold(text).split()) for k in range(STEM_LETTERS[0], min(len(w), STEM_LETTERS[1]) + 1)}
            stems.add("")
            for s in stems:
                found[s][toxic] += 1
        if len(found) > 300_000:
            yield rows()
    yield rows()


def _gain(n0: int, n1: int, all0: int, all1: int) -> float:
    """Twice the log likelihood ratio of presence given the label."""
    total, n = all0 + all1, n0 + n1
    cells = ((n0, n * all0), (n1, n * all1), (all0 - n0, (total - n) * all0), (all1 - n1, (total - n) * all1))
    return 2 * sum(o * log(o * total / e) for o, e in cells if o)


def choose(counts: list[tuple[str, int, int]], all0: int, all1: int, tried: int) -> dict[str, float]:
    """The lexicon: of stems that continue each other, the longest that loses no more than a tenth of the documents."""
    odds = lambda n0, n1: log((n1 + 0.5) / (all1 + 1)) - log((n0 + 0.5) / (all0 + 1))
    strong = {s: (n0, n1) for s, n0, n1 in counts if odds(n0, n1) > 1.5 and n1 > n0 and _gain(n0, n1, all0, all1) > 2 * (log(max(2, tried)) + 3)}
    longer: dict[str, list[str]] = defaultdict(list)
    for t in strong:
        longer[t[:-1]].append(t)
    taken: dict[str, float] = {}
    for s in sorted(strong, key=lambda s: (len(s), s)):
        if any(s[:k] in taken for k in range(1, len(s))):
            continue
        best = s
        while grown := [t for t in longer[best] if strong[t][1] >= 0.9 * strong[s][1]]:
            best = max(grown, key=lambda t: strong[t][1])
        taken[best] = odds(*strong[best])
    return dict(sorted(taken.items(), key=lambda x: (-x[1], x[0])))


class Scorer:
    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] = frozenset(), weights: tuple[float, ...] = ()) -> None:
        self.lexicon, self.exceptions, self.weights, self.automaton = lexicon, exceptions, weights, None

    def __getstate__(self):
        return self.lexicon, self.exceptions, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, folded: str) -> list[tuple[str, float, str, str]]:
        """Stem, weight, and the phrases that the hit's word makes with the words before and after it."""
        if not self.lexicon:
            return []
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for s in self.lexicon:
                self.automaton.add_word(" " + s, s)
            self.automaton.make_automaton()
        best: dict[int, str] = {}
        for end, s in self.automaton.iter(folded):
            at = end - len(s)
            if len(s) > len(best.get(at, "")):
                best[at] = s
        out = []
        for at, s in best.items():
            end = folded.index(" ", at + 1)
            before = folded.rfind(" ", 0, at) + 1 if at else 0
            after = folded.find(" ", end + 1)
            out.append((s, self.lexicon[s], f"{folded[before:at]} {s}" if at else "", f"{s} {folded[end + 1 : after]}" if after > 0 else ""))
        return out

    def measure(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w, before, after in self.hits(folded) if before not in self.exceptions and after not in self.exceptions)
        return total, total / max(1, folded.count(" ") - 1)

    def score(self, total: float, density: float) -> float:
        if not self.weights:
            return 0.0
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(100 * density)))))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, slightly ridged; neither slope is let below 0."""
    z = np.column_stack((np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(100 * x[:, 1])))
    free = [0, 1, 2]
    while True:
        w = np.zeros(3)
        ridge = np.diag([1e-6, 0.05, 0.05])[np.ix_(free, free)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z[:, free].T * (p * (1 - p))) @ z[:, free] + ridge, z[:, free].T @ (y - p) - ridge @ w[free])
            w[free] += np.clip(step, -2, 2)
        low = [k for k in free if k and w[k] < 0]
        if not low:
            return tuple(map(float, w))
        free.remove(low[0])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    one = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("ident")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    n = one.count()
    sample = one.where(F.pmod(F.xxhash64("ident", F.lit(5)), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE / max(1, n)))).limit(2 * SAMPLE)
    # At most 2 * SAMPLE rows of two numbers, so the side that is broadcast is bounded.
    rows = docs.select(F.col(id_col).alias("ident"), F.col(text_col).alias("body")).join(F.broadcast(sample), "ident").select("body", "y")
    rows = common.materialize(rows, "labelled")
    counts = rows.mapInArrow(_counts, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = common.materialize(counts, "stems")
    whole = counts.where("stem = ''").first()
    if whole is None or not whole["n0"] or not whole["n1"]:
        return Scorer({})
    tried = counts.count()
    prior = whole["n1"] / (whole["n0"] + whole["n1"])
    likely = counts.where(F.col("stem") != "").where(F.col("n1") >= 3).where(F.col("n1") > F.col("n0") * (prior / (1 - prior)) * 4)
    lexicon = choose([(r["stem"], r["n0"], r["n1"]) for r in likely.collect()], whole["n0"], whole["n1"], tried)
    scorer = Scorer(lexicon)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(p, 1 - y, y) for p in {p for _, _, a, b in scorer.hits(fold(text)) for p in (a, b) if p}]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["phrase", "n0", "n1"])

    seen = rows.mapInArrow(phrases, "phrase string, n0 long, n1 long").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scorer.exceptions = frozenset(r["phrase"] for r in seen.where("n0 >= 5 AND n0 > 4 * n1").collect())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [scorer.measure(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64()), batch.column(1)], names=["total", "density", "y"])

    got = rows.mapInArrow(measured, "total double, density double, y int").collect()  # the bounded sample's rows
    x = np.array([(r["total"], r["density"]) for r in got]).reshape(-1, 2)
    scorer.weights = fit(x, np.array([r["y"] for r in got], float))
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(*scorer.measure(t)) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    scored = score(docs, train(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
