"""Language ID by hierarchical discrimination.

Texts become counts of letter 1-, 2- and 3-grams hashed into DIM places. The languages of the training rows are
clustered into families by the likeness of their mean vectors. Linear support vector machines, one against the rest,
predict the family first; within it, one-versus-one linear machines for each pair of its languages vote.

Training takes a bounded sample: about SAMPLE labelled rows in all, spread evenly over the languages, chosen by a
hash of the id, so any share of a language may come from anywhere; whole texts are read. Prediction reads every row.

Defined results: `und` with score 0 for a text that is null or has no letter, and for all rows if no language could be
learned; if just one could, every text with a letter is in it. Rows that repeat an id are given back each. An empty
table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM = 4096
#: Labelled rows that training takes in all, about.
SAMPLE = 3000
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Per code point: the code point if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of square roots of n-gram counts; None if the text has no letter."""
    if not text:
        return None
    letters = _table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = letters > 0
    if not inside.any():
        return None
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one gap after each word
    c = np.concatenate(([0], letters[keep], [0])).astype(np.uint64)
    h1 = c * np.uint64(0x9E3779B97F4A7C15)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h1[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + h1[2:]
    grams = np.concatenate((h1, h2 + np.uint64(1), h3 + np.uint64(2)))
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(52)
    v = np.sqrt(np.bincount(grams.astype(np.int64), minlength=DIM)).astype(np.float32)
    return v / np.linalg.norm(v)


def svm(x: np.ndarray, y: np.ndarray, steps: int = 300, c: float = 50.0) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; y is 1 or -1, classes weigh alike."""
    x = np.hstack((x, np.ones((len(x), 1)))).astype(np.float32)
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, seen, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    rate = 1 / (1 / c + 2 * max(float((side * (x**2).sum(1)).sum()), 1e-9))
    for _ in range(steps):  # Nesterov's gradient method
        slack = np.maximum(0, 1 - y * (x @ seen.astype(np.float32)))
        new = seen - rate * (seen / c - 2 * ((side * y * slack).astype(np.float32) @ x))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        seen, w = new + (before - 1) / t * (new - w), new
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        names = sorted(set(langs))
        which = np.array([names.index(n) for n in langs])
        self.families = self._families(np.array([x[which == k].mean(0) for k in range(len(names))]), names) if names else []
        place = {n: f for f, members in enumerate(self.families) for n in members}
        family = np.array([place[n] for n in langs])
        self.rest = np.array([svm(x, np.where(family == f, 1.0, -1.0)) for f in range(len(self.families))]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.families:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = np.isin(which, [names.index(a), names.index(b)])
                    self.pairs[a, b] = svm(x[rows], np.where(which[rows] == names.index(a), 1.0, -1.0))

    @staticmethod
    def _families(means: np.ndarray, names: list[str]) -> list[list[str]]:
        """Average-link clusters of likeness, as many as the rounded-up root of the number of languages."""
        unit = means - means.mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        like, groups = unit @ unit.T, [[k] for k in range(len(names))]
        while len(groups) > max(1, int(np.ceil(len(names) ** 0.5))):
            _, i, j = max((like[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            groups[i] += groups.pop(j)
        return [sorted(names[k] for k in g) for g in groups]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        sure = lambda m: float(1 / (1 + np.exp(-3 * m)))
        score, f = 1.0, 0
        if self.rest is not None:
            margins = self.rest[:, :-1] @ v + self.rest[:, -1]
            f = int(margins.argmax())
            score = sure(margins[f])
        members = self.families[f]
        votes, least = dict.fromkeys(members, 0), dict.fromkeys(members, np.inf)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                w = self.pairs[a, b]
                m = float(w[:-1] @ v + w[-1])
                votes[a if m >= 0 else b] += 1
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(members, key=lambda n: (votes[n], least[n]))
        return best, score * (sure(least[best]) if len(members) > 1 else 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, v.astype(np.float32).tobytes()) for lang, v in zip(batch.column(0).to_pylist(), map(features, batch.column(1).to_pylist())) if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=["lang", "v"])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """Learns from rows where learn holds and the language isn't null."""
    rows = docs.where(learn & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}  # a row for each language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1e6 * min(1.0, SAMPLE / len(counts) / n))))])
    taken = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col), F.col(text_col)).mapInArrow(_vectors, "lang string, v binary").limit(2 * SAMPLE).collect()
    return Hierarchy(np.array([np.frombuffer(r["v"], np.float32) for r in taken]), [r["lang"] for r in taken]) if taken else None


def predict(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [("und", 0.0) if v is None or model is None else model.predict(v) for v in map(features, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.read(spark, sf_dir, "documents")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    return predict(docs, train(docs, ~held)).withColumn("held_out", held)


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
