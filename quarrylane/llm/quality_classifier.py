"""Quality classifier: naive Bayes support vectors.

Tokens are runs of word bytes and runs of other visible bytes. Features are the presence of single tokens and of pairs of
neighbours, of the tokens' shapes (case, kind) in threes, and of buckets of how often tokens, pairs and shapes repeat,
all hashed. A present feature is scaled by its class log-count ratio, a text's vector is brought to length one, and a
linear model with hinge loss is fitted by dual coordinate descent. A logistic curve fitted on labelled rows set aside
turns margins into scores.

Training reads at most about ``most_rows`` labelled documents, drawn by a hash of the id; scoring covers everything.

Defined cases: null text is empty and scored like any other text; with fewer than two classes among the labels the
score is their share; rows that repeat a doc_id are scored each; several labels of a document count as the lowest; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import textkernels as tk
from quarrylane.llm.common import held_out

SPACE = 1 << 18
_KIND = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 else 2 for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    data = tk.text_bytes(text)
    kind = _KIND[data]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(1, np.uint32)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (np.diff(at) != 1) | (kind[at[1:]] != kind[at[:-1]])
    first = np.flatnonzero(new)
    tokens = tk.run_hashes(data, kind > 0, first)
    b = data[at]
    count = lambda mask: np.add.reduceat(mask[b].astype(np.int32), first)
    size = np.diff(np.append(first, len(at)))
    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    shape = kind[at[first]].astype(np.uint64) * np.uint64(16) + (upper > 1) * np.uint64(1) + (lower > 0) * np.uint64(2) + (digit > 0) * np.uint64(4) + ((kind[at[first]] == 2) & (size > 2)) * np.uint64(8)
    shapes = tk.kmers(shape, 3)
    pairs = tk.kmers(tokens, 2)
    # how often things repeat, in halvings of the share of distinct ones
    level = lambda x: np.uint64(min(12, int(-2 * np.log2(len(np.unique(x)) / len(x)))))
    marks = np.array([np.uint64(100 + 20 * k) + level(x) for k, x in enumerate((tokens, pairs, tk.kmers(tokens, 8)))], np.uint64)
    for value, base in ((upper.sum() / max(1, upper.sum() + lower.sum()), 200), ((kind == 2).sum() / len(at), 240)):
        marks = np.append(marks, np.uint64(base + int(value * 20)))
    with np.errstate(over="ignore"):
        every = np.concatenate([tk.mix(tokens + np.uint64(1)), tk.mix(pairs + np.uint64(2)), tk.mix(shapes + np.uint64(3)), tk.mix(marks * np.uint64(0x9E3779B97F4A7C15))])
    return np.unique((every % np.uint64(SPACE)).astype(np.uint32))


class NaiveBayesSvm:
    def __init__(self, smooth: float = 1.0, cost: float = 4.0, epochs: int = 12, seed: int = 3):
        self.smooth, self.cost, self.epochs, self.seed = smooth, cost, epochs, seed

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> NaiveBayesSvm:
        share = float(y.mean()) if len(y) else 0.5
        self.r = self.w = np.zeros(SPACE, np.float32)
        self.curve = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        if len(np.unique(y)) < 2:
            return self
        aside = np.arange(len(y)) % 5 == 4
        if len(np.unique(y[aside])) < 2:
            aside[:] = False
        fit = np.flatnonzero(~aside)
        counts = [np.full(SPACE, self.smooth) for _ in range(2)]
        for k in fit:
            counts[int(y[k])][rows[k]] += 1
        self.r = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())).astype(np.float32)
        self._descend([rows[k] for k in fit], np.where(y[fit] > 0, 1.0, -1.0))
        check = np.flatnonzero(aside) if aside.any() else fit
        self.curve = self._logistic(np.array([self.margin(rows[k]) for k in check]), y[check])
        return self

    def _descend(self, rows: list[np.ndarray], sign: np.ndarray) -> None:
        """Dual coordinate descent for hinge loss; the constant feature is the bias."""
        values = [self._scaled(f) for f in rows]
        w, bias, alpha = np.zeros(SPACE), 0.0, np.zeros(len(rows))
        norms = [float(v @ v) + 1.0 for v in values]
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            for k in rng.permutation(len(rows)):
                f, v = rows[k], values[k]
                slope = sign[k] * (w[f] @ v + bias) - 1
                old = alpha[k]
                alpha[k] = min(max(old - slope / norms[k], 0.0), self.cost)
                step = (alpha[k] - old) * sign[k]
                if step:
                    w[f] += step * v
                    bias += step
        self.w, self.bias = w.astype(np.float32), bias

    def _scaled(self, f: np.ndarray) -> np.ndarray:
        v = self.r[f]
        return v / max(float(np.sqrt(v @ v)), 1e-6)

    def margin(self, f: np.ndarray) -> float:
        return float(self.w[f] @ self._scaled(f)) + getattr(self, "bias", 0.0)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and offset by Newton steps, with targets drawn in so that separable data stay finite."""
        high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        t, a, b = np.where(y > 0, high, low), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g, h = p - t, p * (1 - p) + 1e-9
            m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
            da, db = np.linalg.solve(m, [(g * x).sum() + 1e-3 * a, g.sum()])
            a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        return max(a, 0.0), b

    def score(self, f: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(f) + b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, label: str = "quality") -> NaiveBayesSvm:
    usable = labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    share = min(1.0, most_rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) <= int(share * (1 << 40)))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["_y"], "f": [features(t).tobytes() for t in f["text"]]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    found = sorted(rows.mapInPandas(each, "doc_id long, y long, f binary").collect(), key=lambda r: (r["doc_id"], bytes(r["f"])))
    return NaiveBayesSvm().fit([np.frombuffer(r["f"], np.uint32) for r in found], np.array([float(r["y"] > 0) for r in found]))


def scorer(model: NaiveBayesSvm):
    """A pandas UDF from text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([model.score(features(t or "")) for t in texts], dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = docs.select("doc_id", held_out().alias("held_out"), scorer(train(docs, labels))(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) >= threshold).select(*docs.columns)
