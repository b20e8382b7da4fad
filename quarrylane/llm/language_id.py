"""Language ID by a byte convolutional network trained in numpy.

Bytes are embedded; filters of several widths slide over a fixed-length window, each keeps its maximum, and a softmax
gives the languages' probabilities. A text is cut into such windows, all of them are scored, and their probabilities are
averaged by the number of bytes they hold. Training reads windows of at most about ``per_lang`` labelled documents of
each language, drawn by a hash of the id; everything else covers all data.

Defined cases: null text and text without a letter are ``und`` with score 0; equal texts get equal predictions; with no
labelled rows at all every text is ``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import held_out

LETTER = re.compile(r"[^\W\d_]")
WINDOW, WIDTHS, EMBED, FILTERS = 160, (2, 3, 4), 6, 16


class ByteConvNet:
    """Embedding, multi-width filters, maximum over the window, softmax; trained with Adam."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["w"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def _unfold(self, x: np.ndarray, w: int) -> np.ndarray:
        n, size, e = x.shape
        return np.ascontiguousarray(sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2)).reshape(n, size - w + 1, w * e)

    def forward(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, x, pooled = self.p, self.p["e"][windows], []
        for w in WIDTHS:
            u = self._unfold(x, w)
            h = (u.reshape(-1, u.shape[2]) @ p[f"f{w}"]).reshape(len(x), -1, FILTERS)
            if keep is None:
                pooled.append(h.max(axis=1))
            else:
                at = h.argmax(axis=1)
                pooled.append(np.take_along_axis(h, at[:, None], 1)[:, 0])
                keep[w] = (u, at)
        z = np.concatenate([np.maximum(h + p[f"b{w}"], 0) for h, w in zip(pooled, WIDTHS, strict=True)], axis=1)
        logits = z @ p["w"] + p["c"]
        out = np.exp(logits - logits.max(axis=1, keepdims=True))
        if keep is not None:
            keep["z"] = z
        return out / out.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        d = self.forward(windows, keep)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        z, g = keep["z"], {}
        g["w"], g["c"] = z.T @ d, d.sum(axis=0)
        dz = (d @ self.p["w"].T) * (z > 0)
        ge = np.zeros_like(self.p["e"])
        for k, w in enumerate(WIDTHS):
            part = dz[:, k * FILTERS : (k + 1) * FILTERS]
            u, at = keep[w]
            chosen = np.take_along_axis(u[:, :, None, :], at[:, None, :, None], axis=1)[:, 0]
            g[f"f{w}"] = np.einsum("nfd,nf->df", chosen, part)
            g[f"b{w}"] = part.sum(axis=0)
            du = part[:, :, None] * self.p[f"f{w}"].T[None]
            for j in range(w):
                bytes_at = np.take_along_axis(windows, at + j, axis=1)
                np.add.at(ge, bytes_at.ravel(), du[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
        g["e"] = ge
        return g

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 9) -> ByteConvNet:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                step += 1
                rows = order[k : k + batch]
                for name, g in self.gradients(windows[rows], y[rows]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


#: Window positions; a filter at the last one still lies within WINDOW bytes.
STEP = WINDOW - max(WIDTHS) + 1


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def training_window(text: str) -> np.ndarray:
    """The first WINDOW lower-cased bytes of a short piece, padded with blanks."""
    return np.frombuffer(text_bytes(text)[:WINDOW].ljust(WINDOW), np.uint8)


class WindowScorer:
    """The trained network for whole texts: filter responses are sums of two tables over byte pairs, in 16-bit integers."""

    def __init__(self, net: ByteConvNet):
        p = net.p
        at = {(w, k): p["e"] @ p[f"f{w}"].reshape(w, EMBED, FILTERS)[k] for w in WIDTHS for k in range(w)}
        pair = lambda x, y: (x[:, None] + y[None]).reshape(1 << 16, FILTERS)
        first = np.concatenate([pair(at[w, 0], at[w, 1]) for w in WIDTHS], axis=1)
        second = np.concatenate([pair(at[3, 2], np.zeros_like(at[3, 2])), pair(at[4, 2], at[4, 3])], axis=1)
        self.scale = 32000 / (np.abs(first).max() + np.abs(second).max())
        self.first, self.second = (np.rint(x * self.scale).astype(np.int16) for x in (first, second))
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        self.w, self.c = p["w"], p["c"]

    def score(self, texts: list[str], piece: int = 24_000) -> np.ndarray:
        """One row of probabilities per text, averaged over all its windows by their length."""
        parts = [text_bytes(t) for t in texts]
        data = np.frombuffer(b"    ".join(parts) + b"    ", np.uint8)
        lengths = np.array([len(x) for x in parts])
        offsets = np.concatenate(([0], np.cumsum(lengths + 4)[:-1]))
        counts = np.maximum(1, -(-(lengths - max(WIDTHS) + 1) // STEP))
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[owner] + nth * STEP
        ends = np.append(starts[1:], len(data) - 3)
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        tops = np.empty((len(starts), len(WIDTHS) * FILTERS), np.int16)
        k = 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(starts, starts[k] + piece)))
            low, high = starts[k], ends[last - 1]
            h = self.first[pairs[low:high]]
            h[:, FILTERS:] += self.second[pairs[low + 2 : high + 2]]
            tops[k:last] = np.maximum.reduceat(h, starts[k:last] - low, axis=0)
            k = last
        z = np.maximum(tops / np.float32(self.scale) + self.bias, 0)
        logits = z @ self.w + self.c
        out = np.exp(logits - logits.max(axis=1, keepdims=True))
        out *= (np.minimum(lengths[owner] - nth * STEP, WINDOW).clip(1) / out.sum(axis=1))[:, None]
        total = np.add.reduceat(out, np.cumsum(counts) - counts, axis=0)
        return total / total.sum(axis=1, keepdims=True)


def train(docs: DataFrame, per_lang: int = 250, windows: int = 3, epochs: int = 5) -> tuple[ByteConvNet, list[str]] | None:
    """A network and its languages from labelled documents that are not held out; None when there are none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    bound = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, per_lang / counts[k]) * (1 << 40))))])
    spots = [F.substring("text", F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for j in range(windows)]
    drawn = usable.where(draw <= F.element_at(bound, F.col("lang"))).select("lang", "doc_id", F.array_distinct(F.array(*spots)).alias("parts"))
    x, y = [], []
    for row in sorted(drawn.collect(), key=lambda r: (r["doc_id"] or 0, r["lang"])):
        for part in row["parts"]:
            if LETTER.search(part):
                x.append(training_window(part))
                y.append(langs.index(row["lang"]))
    if not x:
        return None
    return ByteConvNet(len(langs)).fit(np.array(x), np.array(y), epochs), langs


def predictor(model: tuple[ByteConvNet, list[str]] | None, most_bytes: int = 1 << 20):
    """A pandas UDF from text to (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = WindowScorer(model[0]) if model else None
        for texts in parts:
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if scorer and t and LETTER.search(t)]
            sizes = np.cumsum([len(texts.iat[i]) for i in rows])
            cuts = np.flatnonzero(np.diff(sizes // most_bytes, prepend=0)) if rows else []
            for group in np.split(np.array(rows, int), cuts):
                if len(group):
                    shares = scorer.score([texts.iat[i] for i in group])
                    for i, share in zip(group, shares, strict=True):
                        best[i], score[i] = model[1][int(share.argmax())], float(share.max())
            yield pd.DataFrame({"lang_pred": best, "score": score})

    return predict


def predict(docs: DataFrame, model: tuple[ByteConvNet, list[str]] | None) -> DataFrame:
    """docs with lang_pred and score."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    rows = rows.select("_row", predictor(model)(F.col("_text")).alias("_p"))
    return rows.select("_row.*", "_p.lang_pred", "_p.score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language the network knows with at least that score."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))
    return predict(rows, train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_doc.*")
