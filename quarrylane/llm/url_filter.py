"""URL filters: longest-match host and path rules, then boosted trees on lexical features.

The trees are trained in numpy on a table of labelled URLs. The table is written from a rule (kinds of host words,
paths and parameters), so it is small, fixed and reproducible. A verdict is the matching rule's, else the trees'.

Defined cases: null or scheme-less urls have an empty host and path, match no rule and are judged by the trees like
any other text; equal rows get equal verdicts; columns not asked for are dropped; an empty table stays empty.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host suffix, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Host words of unwanted sites and of ordinary ones.
UNWANTED = "casino win bet poker slots pills cheap viagra loan payday xxx porn adult sex cams escort warez crack torrent free bonus jackpot replica dating hot deal click earn money spam farm seo link".split()
ORDINARY = "news blog shop school library museum garden travel cook sport health city river stone forest music paper science history weather house market craft media radio forum wiki docs data open".split()


def labelled_urls(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """(url, 1 for unwanted) pairs from a fixed rule: host words, depth, digits, parameters and suffixes differ by class."""
    rnd = random.Random(seed)
    open_syllables = [c + v for c in "bcdfghlmnprstvw" for v in "aeiou"]
    clusters = "th er on an re en st nd tion in ed es at ti ing or he nt sch ung ver eau ch".split()
    made = []
    for k in range(n):
        bad = int(k % 2)
        invented = "".join(rnd.choice(rnd.choice([open_syllables, clusters])) for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.4:
            invented = rnd.choice(clusters) * rnd.randint(1, 2) + rnd.choice(clusters)
        if bad:
            words = [w + rnd.choice(["", "", "s"]) for w in rnd.sample(UNWANTED, rnd.randint(1, 3))]
            host = rnd.choice(["-", "-", "", "."]).join(words) + rnd.choice(["", "", str(rnd.randint(1, 999))])
            host += "." + rnd.choice(["example.com", "example.net", "example.org", "biz", "info", "xyz", "top", "com", "net"])
        else:
            host = rnd.choice([invented, invented, rnd.choice(ORDINARY), invented + rnd.choice(["-", ""]) + rnd.choice(ORDINARY)])
            host += "." + rnd.choice(["example.com", "example.net", "example.org", "org", "com", "net", "edu", "de", "fr"])
        host = rnd.choice(["", "", "www.", "m.", "blog."]) + host
        path = rnd.choice(["/en/", "/de/", "/fr/", "/es/", "/", "/a/b/", "/2023/05/"]) + str(rnd.randint(1, 999))
        tail = rnd.choice(["", "", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"] + (["?aff=%d&click=%d&sid=%d" % (rnd.randint(1, 9999), rnd.randint(1, 9999), rnd.randint(1, 9999))] if bad else []))
        made.append((rnd.choice(["http://", "https://"]) + host + path + tail, bad))
    return made


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


class Features:
    """Lexical features of URLs; the suffix and host-word statistics are smoothed log odds from the labelled table."""

    SPLIT = re.compile(r"[^a-z]+")

    def __init__(self, labelled: list[tuple[str, int]]):
        count: dict[str, list[float]] = {}
        for url, y in labelled:
            for key in self.keys(url):
                count.setdefault(key, [1.0, 1.0])[y] += 1
        self.odds = {k: math.log(b / a) for k, (a, b) in count.items()}
        #: words that tell a class, to be found inside longer ones
        self.telling = [(k, v) for k, v in sorted(self.odds.items()) if len(k) > 3 and abs(v) > 1.5 and k[0] != "."]

    @classmethod
    def host_of(cls, url: str) -> str:
        return re.split(r"[/?#]", url.partition("://")[2], maxsplit=1)[0].lower()

    @classmethod
    def keys(cls, url: str) -> list[str]:
        host = cls.host_of(url)
        return [f".{host.rpartition('.')[2]}"] + [w.rstrip("s") for w in cls.SPLIT.split(host.rpartition(".")[0]) if w and w not in ("www", "m", "blog", "example")]

    def row(self, url: str) -> list[float]:
        host = self.host_of(url)
        rest = url.partition("://")[2][len(host) :]
        path, _, query = rest.partition("?")
        suffix, *words = self.keys(url)
        odds = [self.odds.get(w, 0.0) for w in words]
        return [
            len(url), len(host), host.count("."), host.count("-"), path.count("/"), query.count("=") , query.count("&"),
            sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), entropy(host), entropy(path),
            self.odds.get(suffix, 0.0), max(odds, default=0.0), sum(odds), sum(v for k, v in self.telling if k in host),
        ]

    def matrix(self, urls: list[str]) -> np.ndarray:
        return np.array([self.row(u) for u in urls], dtype=np.float64).reshape(len(urls), 15)


class BoostedTrees:
    """Logistic gradient boosting with depth-limited trees over quantile cuts."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, cuts: int = 24, least: int = 8):
        self.rounds, self.depth, self.rate, self.cuts, self.least = rounds, depth, rate, cuts, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), edges, self.depth)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, edges, depth):
        leaf = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                at = np.searchsorted(cuts, x[rows, j])
                cg, ch, cn = (np.cumsum(np.bincount(at, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(cn < self.least) | (len(rows) - cn < self.least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, cuts[k])
        if best[1] is None:
            return float(leaf)
        _, j, cut = best
        left = x[rows, j] <= cut
        return (j, float(cut), self._grow(x, g, h, rows[left], edges, depth - 1), self._grow(x, g, h, rows[~left], edges, depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._walk(low, x), self._walk(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, x) for t in self.trees))))


def train(labelled: list[tuple[str, int]]) -> tuple[Features, BoostedTrees]:
    """Features and trees. Each half's word statistics come from the other half while the trees are fitted, so that they
    learn how far to trust them; the features kept use all rows."""
    # classes alternate in the table, so rows go by twos
    a, b = ([r for i, r in enumerate(labelled) if i // 2 % 2 == k] for k in range(2))
    x = np.concatenate([Features(b).matrix([u for u, _ in a]), Features(a).matrix([u for u, _ in b])])
    return Features(labelled), BoostedTrees().fit(x, np.array([y for _, y in a + b], float))


def host_column(url: Column) -> Column:
    after = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.instr(url, F.lit("://")), F.lit(0)) > 0, lower).otherwise(F.lit(""))


def path_column(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, F.lit("://")), F.lit(0)) > 0, path).otherwise(F.lit(""))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or nulls. Host plus path give a rule's length."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, suffix, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        found = found.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def judge(pages: DataFrame, rules: list | None = None, threshold: float = 0.5, key: str = "page_id", model: tuple | None = None) -> DataFrame:
    """key, host, path, rule, verdict and the trees' score for every url."""
    rules = RULES if rules is None else rules
    if model is None:
        features, trees = train(labelled_urls())
    else:
        features, trees = model

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            urls = f["_url"].fillna("").tolist()
            f["score"] = trees.predict(features.matrix(urls)) if urls else np.zeros(0)
            yield f.drop(columns="_url")

    url = F.col("url")
    rows = pages.select(F.col(key), host_column(url).alias("host"), path_column(url).alias("path"), url.alias("_url"))
    rows = rows.withColumn("_r", by_rule(F.col("host"), F.col("path"), rules)).select(key, "host", "path", "_r.rule", F.col("_r.verdict").alias("_by_rule"), "_url")
    schema = T.StructType([f for f in rows.schema if f.name != "_url"] + [T.StructField("score", T.DoubleType())])
    out = rows.mapInPandas(scored, schema)
    verdict = F.coalesce("_by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")
