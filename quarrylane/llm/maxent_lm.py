"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside an add-0.1 unigram base.

Tokens are runs of bytes other than ASCII white space, with A-Z lower-cased, and one end a text. The 384 most frequent
tokens sit 32 by 32 in 12 classes by rank; all other words, known or not, belong to one of 12 classes by their last two
bytes. ``P(token) = P(class | context) * P(token | class, context)``. Both factors are softmaxes over sums of hashed
weights of the context's features: the previous word, the second word back on its own (a skip), both together, the
classes of the last three words, and a constant. Within a class of endings the second factor is the add-0.1 unigram of
the class, with one place for a word that training has not seen. The factors sum to one.

Counts cover every training token. Each training round reads one part of the documents by a hash of the text; its tasks run
AdaGrad over their rows from the current weights and send the change of each weight row they touched; changes are added up
by row on Spark, divided by the number of tasks that touched the row, and become the next round's weights. Every training
token is visited once. The tables on the driver and in closures are bounded by parameters: ``words`` coded tokens of at most
64 bytes, and 2 * ``rows`` * 32 weights. Tokens beyond the coded ones meet their counts in a join.

Defined cases: null text is empty (one end); a null doc_id is not held out; rows that repeat a doc_id are scored each;
without training rows every token of the base has the probability one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import copy
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import written

WIDE, DEEP = 24, 32  # classes; words in a class by rank
RANKED = WIDE // 2 * DEEP
#: Stands for the end among the tokens: no word holds a blank.
END = b" "
LONGEST = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def ending_class(token: bytes) -> int:
    return WIDE // 2 + (token[-1] * 7 + (token[-2] if len(token) > 1 else 0) * 3) % (WIDE - WIDE // 2)


class Vocabulary:
    """Codes of the most frequent tokens, in order of rank, and what the base and the classes need of the counts.

    Codes from ``len(tokens)`` on stand for words that have none, one for each class of endings.
    """

    def __init__(self, counted: list[tuple[bytes, int]], total: int, distinct: int, by_class: dict[int, tuple[int, int]]):
        counted = sorted(counted, key=lambda x: (-x[1], x[0]))
        self.code = {t: k for k, (t, _) in enumerate(counted)}
        self.size, self.total, self.distinct = len(counted), total, distinct
        self.n = np.array([n for _, n in counted], np.float64)
        self.known = self.n > 0
        self.cls = np.array([k // DEEP if k < RANKED else ending_class(t) for k, (t, _) in enumerate(counted)] + list(range(WIDE // 2, WIDE)), np.int64)
        self.base = np.append(np.log10((self.n + 0.1) / self.base_room), np.zeros(WIDE - WIDE // 2))
        room = np.array([by_class.get(k, (0, 0)) for k in range(WIDE)], np.float64)
        #: log10 of N + 0.1 * (V + 1) within each class of endings, ranked words left out
        self.room = np.log10(room[:, 0] + 0.1 * (room[:, 1] + 1))
        inner = np.append(np.log10(self.n + 0.1), np.zeros(WIDE - WIDE // 2)) - self.room[self.cls]
        inner[: min(self.size, RANKED)] = 0
        self.inner = inner
        mass = np.zeros(WIDE)
        np.add.at(mass, self.cls[: min(self.size, RANKED)], self.n[:RANKED])
        mass += room[:, 0]
        self.mass = mass

    def without_codes(self) -> Vocabulary:
        """What a model needs of it: tasks that read codes have no use for the words."""
        light = copy.copy(self)
        light.code = {}
        return light

    @property
    def base_room(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Codes of the tokens and the end; the words that have no code."""
        code, size = self.code, self.size
        ids = np.fromiter(map(code.get, itertools.chain(tokens, (END,)), itertools.repeat(-1)), np.int32, len(tokens) + 1)
        without = np.flatnonzero(ids < 0)
        rest = [tokens[k] if k < len(tokens) else END for k in without.tolist()]
        if rest:
            ids[without] = [size + ending_class(t) - WIDE // 2 for t in rest]
        return ids, rest


class Model:
    """Weight rows by hashed feature: ``wide`` scores classes, ``deep`` the ranked words of one class."""

    def __init__(self, vocabulary: Vocabulary, rows: int, wide: np.ndarray | None = None, deep: np.ndarray | None = None):
        self.v, self.rows = vocabulary, rows
        self.wide = np.zeros((rows, WIDE), np.float32) if wide is None else wide
        self.deep = np.zeros((rows, DEEP), np.float32) if deep is None else deep

    def start(self) -> Model:
        """Constant features at the logarithms of the unigram."""
        self.wide[self._row(np.zeros(1, np.uint64), 0, self.rows)] = np.log((self.v.mass + 0.1) / (self.v.mass + 0.1).sum())
        for c in range(min(WIDE // 2, -(-min(self.v.size, RANKED) // DEEP))):
            n = self.v.n[c * DEEP : min((c + 1) * DEEP, RANKED)]
            bias = np.full(DEEP, -30.0)
            bias[: len(n)] = np.log((n + 0.1) / (n + 0.1).sum())
            self.deep[self._row(np.full(1, c + 1, np.uint64), 0, self.rows)] = bias
        return self

    @staticmethod
    def _row(key: np.ndarray, template: int, rows: int) -> np.ndarray:
        """The row of a feature. Rows under WIDE belong to the constant features alone."""
        if not template:
            return key.astype(np.int64)
        with np.errstate(over="ignore"):
            x = (key + np.uint64(template) * _B) * _A
            x = (x ^ (x >> np.uint64(29))) * _B
        return (WIDE + ((x >> np.uint64(32)) % np.uint64(rows - WIDE))).astype(np.int64)

    def features(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Keys of the context features at every token; first: whether a text begins there."""
        none = self.v.size + WIDE
        back, where, begins = [], np.arange(len(ids)), np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        for k in (1, 2, 3):
            at = where - k
            back.append(np.where(at >= begins, ids[np.maximum(at, 0)], none).astype(np.uint64))
        cls = np.append(self.v.cls, [WIDE] * (none + 1 - len(self.v.cls))).astype(np.uint64)
        c1, c2, c3 = (cls[b.astype(np.int64)] for b in back)
        with np.errstate(over="ignore"):
            return [np.zeros(len(ids), np.uint64), back[0], back[1], back[0] * np.uint64(1 << 20) + back[1], (c1 * np.uint64(128) + c2) * np.uint64(128) + c3]

    def parts(self, ids: np.ndarray, first: np.ndarray):
        """Rows of the class factor for all tokens (None: row 0 for each); places, rows and words of the second factor for the ranked ones."""
        keys = self.features(ids, first)
        cls = self.v.cls[ids]
        ranked = np.flatnonzero(ids < min(self.v.size, RANKED))
        own = (cls[ranked] + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            deep = [self._row(own if not t else (k[ranked] * np.uint64(64) + own) ^ _A, t, self.rows) for t, k in enumerate(keys)]
        return cls, [None, *(self._row(k, t, self.rows) for t, k in enumerate(keys) if t)], ranked, ids[ranked] % DEEP, deep

    @staticmethod
    def _logits(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        out = table.take(rows[1], axis=0)
        for r in rows[2:]:
            out += table.take(r, axis=0)
        out += table[0] if rows[0] is None else table.take(rows[0], axis=0)
        out -= out.max(axis=1, keepdims=True)
        return out

    @classmethod
    def _log_p(cls, table: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        x = cls._logits(table, rows)
        own = x[np.arange(len(y)), y].astype(np.float64)
        return own - np.log(np.exp(x, out=x).sum(axis=1, dtype=np.float64))

    def log10(self, ids: np.ndarray, first: np.ndarray, step: int = 4096) -> np.ndarray:
        """log10 of every token's probability; words without a code lack the logarithm of their count plus 0.1."""
        out = self.v.inner[ids].copy()
        cls, wide, ranked, words, deep = self.parts(ids, first)
        for a in range(0, len(ids), step):
            out[a : a + step] += self._log_p(self.wide, [r if r is None else r[a : a + step] for r in wide], cls[a : a + step]) / np.log(10)
        for a in range(0, len(ranked), step):
            out[ranked[a : a + step]] += self._log_p(self.deep, [r[a : a + step] for r in deep], words[a : a + step]) / np.log(10)
        return out

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[np.ndarray, np.ndarray]:
        """AdaGrad, with one rate a weight row, over the batches in place; which rows of either table were touched."""
        sums = [np.full(self.rows, 0.02, np.float32) for _ in range(2)]
        touched = [np.zeros(self.rows, bool) for _ in range(2)]
        for ids, first in batches:
            cls, wide, _, words, deep = self.parts(ids, first)
            for k, (table, rows, y) in enumerate(((self.wide, wide, cls), (self.deep, deep, words))):
                if len(y):
                    self._step(table, sums[k], touched[k], rows, y, rate)
        return touched[0], touched[1]

    def _step(self, table: np.ndarray, sums: np.ndarray, touched: np.ndarray, rows: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        d = self._logits(table, rows)
        np.exp(d, out=d)
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        by_output = np.ascontiguousarray(d.T, np.float64)
        for r in rows:
            if r is None:
                g = d.sum(axis=0)
                sums[0] += g @ g / len(g)
                table[0] -= rate / np.sqrt(sums[0]) * g
                touched[0] = True
                continue
            order = np.argsort(r.astype(np.uint16 if self.rows <= 1 << 16 else np.int64), kind="stable")
            ordered = r[order]
            begins = np.diff(ordered, prepend=-1) != 0
            own = ordered[begins]
            which = np.empty(len(r), np.int64)
            which[order] = np.cumsum(begins) - 1
            g = np.stack([np.bincount(which, x, len(own)) for x in by_output], axis=1).astype(np.float32)
            s = sums[own] + np.einsum("ij,ij->i", g, g) / g.shape[1]
            sums[own] = s
            g *= (rate / np.sqrt(s))[:, None]
            table[own] -= g
            touched[own] = True


def _tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def count_tokens(texts: DataFrame, text: str = "text", most: int = 400_000) -> DataFrame:
    """token, n of all tokens of the texts, ends included; counted in tasks before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(_tokens(t.as_py()))
                seen[END] += 1
                if len(seen) > most:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(each, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, words: int) -> Vocabulary:
    """The most frequent tokens that are together at most ``words``, cut where a sixteenth of a doubling of counts ends."""
    short = F.octet_length("token") <= LONGEST
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("n") * 16)
    room, least = words, None
    for row in counts.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect():
        if row["v"] > room:
            break
        room, least = room - row["v"], row["level"]
    head = [] if least is None else [(bytes(r["token"]), r["n"]) for r in counts.where(short & (level >= least)).collect()]
    ranked = sorted(head, key=lambda x: (-x[1], x[0]))[:RANKED]
    last = lambda k: F.coalesce(F.conv(F.hex(F.substring("token", k, 1)), 16, 10).cast("int"), F.lit(0))
    ending = WIDE // 2 + (last(-1) * 7 + F.when(F.octet_length("token") > 1, last(-2)).otherwise(0) * 3) % (WIDE - WIDE // 2)
    by_class = {r["c"]: [r["n"], r["v"]] for r in counts.groupBy(ending.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for t, n in ranked:
        by_class[ending_class(t)][0] -= n
        by_class[ending_class(t)][1] -= 1
    return Vocabulary(head, total["n"], total["v"], {k: (n, v) for k, (n, v) in by_class.items()})


CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_coded_known long, coded_base double, shard int, ids binary, rest array<binary>"


def encode(docs: DataFrame, voc: Vocabulary, rounds: int) -> DataFrame:
    """Every document's codes, what the base has of them, and its words without a code."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, rest = zip(*(voc.encode(_tokens(t.as_py())) for t in part.column("text")), strict=True)
                has = [x < voc.size for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(h.sum()) for h in has], pa.int64()), pa.array([float(voc.base[x].sum()) for x in ids], pa.float64()),
                        part.column("shard"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(rest, pa.list_(pa.binary())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_coded_known", "coded_base", "shard", "ids", "rest"],
                )

    shard = F.when(held_out(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("text"), F.lit(rounds)).cast("int"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), shard.alias("shard"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, CODED)


def _batches(rows: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and beginnings of texts, about ``tokens`` at a time; long texts are cut into runs that begin anew."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.concatenate(held), np.zeros(size, bool)
        first[np.cumsum([0, *(len(x) for x in held[:-1])])] = True
        return ids, first

    for batch in rows:
        for x in batch.column("ids"):
            ids = np.frombuffer(x.as_py(), np.int32)
            for a in range(0, len(ids), tokens):
                held.append(ids[a : a + tokens])
                size += len(held[-1])
                if size >= tokens:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def train(coded: DataFrame, voc: Vocabulary, rounds: int, rows: int = 1 << 15, rate: float = 0.15, tokens: int = 16384) -> Model:
    """One pass over the training documents, in ``rounds`` parts, with the tasks' changes averaged after each part."""
    voc = voc.without_codes()
    model = Model(voc, rows).start()
    for k in range(rounds):
        now, slow = model, rate * 0.7**k

        def changes(batches: Iterator[pa.RecordBatch], now: Model = now, slow: float = slow) -> Iterator[pa.RecordBatch]:
            own = Model(now.v, now.rows, now.wide.copy(), now.deep.copy())
            touched = own.learn(_batches(batches, tokens), slow)
            for which, (new, old) in enumerate(((own.wide, now.wide), (own.deep, now.deep))):
                at = np.flatnonzero(touched[which])
                for a in range(0, len(at), 4096):
                    part = at[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part * 2 + which, pa.int32()), pa.array([1] * len(part), pa.int64()), pa.array([x.tobytes() for x in (new[part] - old[part]).astype(np.float16)], pa.binary())], ["weight_row", "tasks", "change"])

        sums = _summed(coded.where(F.col("shard") == k).select("ids").mapInArrow(changes, "weight_row int, tasks long, change binary"), rows)
        wide, deep = now.wide.copy(), now.deep.copy()
        for r in sums.collect():
            table = deep if r["weight_row"] % 2 else wide
            table[r["weight_row"] // 2] += np.frombuffer(r["change"], np.float32) / r["tasks"]
        model = Model(voc, rows, wide, deep)
    return model


def _summed(changes: DataFrame, rows: int) -> DataFrame:
    """The sum of all changes of a weight row, in one stream a task: memory is that of the rows, not of the tasks that sent them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        tasks: Counter = Counter()
        for batch in batches:
            for row, n, change in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(change, np.float16)
                tasks[row] += n
                if row in total:
                    total[row] += x
                else:
                    total[row] = x.astype(np.float64)
        at = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([tasks[k] for k in at], pa.int64()), pa.array([total[k].astype(np.float32).tobytes() for k in at], pa.binary())], ["weight_row", "tasks", "change"])

    return changes.repartition("weight_row").mapInArrow(each, "weight_row int, tasks long, change binary")


def _score(coded: DataFrame, model: Model) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                ids = [np.frombuffer(x.as_py(), np.int32) for x in part.column("ids")]
                begins = np.cumsum([0, *(len(x) for x in ids[:-1])])
                joined = np.concatenate(ids)
                first = np.zeros(len(joined), bool)
                first[begins] = True
                found = np.add.reduceat(model.log10(joined, first), begins)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(found, pa.float64())], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_coded_known", "coded_base", "coded_score"]
    return coded.select(*names[:-1], "ids").mapInArrow(each, "row long, doc_id long, held_out boolean, n_tokens long, n_coded_known long, coded_base double, coded_score double")


def score_documents(docs: DataFrame, words: int = 1 << 18, rounds: int = 3, rows: int = 1 << 15) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    counts = written(count_tokens(docs.where(~held_out())), "lm-counts")
    voc = vocabulary(counts, words)
    coded = written(encode(docs, voc, rounds), "lm-coded", "shard")
    model = train(coded, voc, rounds, rows)
    # words without a code meet their counts; those that training has not seen find none
    rest = coded.select("row", F.explode("rest").alias("token")).join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rest_log"), F.count("*").alias("rest_tokens"), F.count("n").alias("rest_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = _score(coded, model).join(rest, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_coded_known") + zero("rest_known")).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("coded_base") + zero("rest_log") - zero("rest_tokens") * float(np.log10(voc.base_room))).alias("base_score"), (F.col("coded_score") + zero("rest_log")).alias("score"))

