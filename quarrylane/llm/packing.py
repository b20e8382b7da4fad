"""Best-fit packing planned on the length histogram.

Documents are tokenized and cut into pieces of at most ``size`` tokens. Best fit runs over counts of lengths, longest
first: a step places as many pieces of one length as fit into all sequences with the smallest sufficient room. The plan
has a row per step, so its size depends on ``size`` and not on the number of documents. Pieces then take planned slots
by their rank within their length. Ranks come from two levels (length and a salt), so a length that holds a third of all
pieces is still dealt over many tasks.

Defined cases: null text is empty text and becomes one piece with the end id alone; repeated rows are packed as often
as they occur; an empty table gives an empty result; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.common import checkpointed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a worker's cache before the older half goes (about 200 bytes each).
CACHE = 600_000
#: A Latin word in composed letters, then marks: two parts for this tokenizer, whatever the case of the letters.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@\[-`{}]*)\Z")
MARK = "~"
#: Latin-1 in lower case, with blanks for line ends: what the tokenizer makes of it anyway.
PLAIN = bytes(range(256)).decode("latin-1").lower().replace("\n", " ").encode("latin-1")
#: A full stop or comma that continues a run of marks, which is one part for this tokenizer; elsewhere it is a part of its own.
RUN = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in range(256) if not chr(c).isalnum() and chr(c) not in " \t\r\n") + b"][.,]")


def parts_of(text: str) -> list[str]:
    """The blank-separated parts of a text; in Latin-1 they are lower-cased first, with stops and commas apart, so that fewer differ."""
    try:
        plain = text.encode("latin-1").translate(PLAIN)
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    if not RUN.search(plain):
        plain = plain.replace(b".", b" .").replace(b",", b" ,")
    return plain.decode("latin-1").split(" ")


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that its later tasks find what earlier ones cached."""
    home = sys.modules.setdefault("_packing_worker_state", types.ModuleType("_packing_worker_state"))
    return home.__dict__.setdefault(name, {})


class WordCache:
    """Token ids (as little-endian bytes) of blank-separated parts, for a tokenizer that never joins over white space.

    Unknown parts are reduced to lower-cased words and marks where that is exact, and encoded in one call, joined by a
    mark that is a token of its own.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.older = tokenizer, {}, {}
        self.mark = tokenizer.encode(MARK, add_special_tokens=False).ids

    def _encode(self, parts: list[str]) -> list[bytes]:
        plain = [p for p in parts if MARK not in p and p]
        found: dict[str, bytes] = {}
        if plain and len(self.mark) == 1:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(plain) - 1:
                run, starts, ends = ids.tobytes(), [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), 4 * len(ids)]
                found = {p: run[a:b] for p, a, b in zip(plain, starts, ends, strict=True)}
        return [found[p] if p in found else np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in parts]

    def _learn(self, parts: set[str]) -> None:
        simple = {p: m.groups() for p in parts if not (p.islower() and p.isalpha()) and (m := SIMPLE.match(p))}
        need = {x for word, marks in simple.values() for x in (word.lower(), marks)} | (parts - simple.keys())
        need = self._recall(need.difference(self.known))
        self.known.update(zip(need, self._encode(need), strict=True))
        for p, (word, marks) in simple.items():
            self.known[p] = self.known[word.lower()] + self.known[marks]

    def _recall(self, parts: set[str]) -> list[str]:
        """The parts that the older half of the cache does not know either; those it knows are young again."""
        kept = parts & self.older.keys()
        self.known.update({p: self.older[p] for p in kept})
        return list(parts - kept)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), 200):
            group = [t if "<|" in t else parts_of(t) for t in texts[k : k + 200]]
            every = set().union(*(g for g in group if isinstance(g, list)))
            new = every.difference(self.known)
            if new and len(self.known) + len(new) > CACHE // 2:
                self.known, self.older = {}, self.known
                new = every
            if new:
                self._learn(set(self._recall(new)))
            get = self.known.__getitem__
            for g in group:
                whole = isinstance(g, str)
                out.append(np.array(self.tokenizer.encode(g, add_special_tokens=False).ids, dtype="<u4") if whole else np.frombuffer(b"".join(map(get, g)), dtype="<u4"))
        return out


def word_ids(load: Callable) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their token ids. Texts with a special token's mark are encoded whole, as such tokens are matched before the text is split."""
    state = worker_state(f"{load.__module__}.{load.__qualname__}")
    if "cache" not in state:
        state["cache"] = WordCache(load())
    return state["cache"].ids


def pieces_of(docs: DataFrame, load: Callable, size: int = 4096, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """The pieces of every document, without their ids."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(load)
        for f in frames:
            rows = []
            for doc, ids in zip(f["key"], encode(f["text"].tolist()), strict=True):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def plan(counts: dict[int, int], size: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over a histogram: (length, first rank, count, first sequence, offset) per step.

    rooms maps the room left to runs of sequences (first, count) that have it; the smallest sufficient room is used
    first, and a new run of sequences is opened when none suffices.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    steps: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(room: int, first: int, n: int) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = size // length
                first, n = opened, -(-left // per)
                opened += n
                offset = 0
                done: list[int] = []
                while left:
                    m = min(n, left)
                    steps.append((length, rank, m, first, offset))
                    done.append(m)
                    rank, left, offset = rank + m, left - m, offset + length
                full = done[-1]
                give(size - offset, first, full)
                give(size - offset + length, first + full, n - full)
                continue
            room = order[at]
            first, n = rooms[room].pop()
            m = min(n, left)
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            if n > m:
                give(room, first + m, n - m)
            give(room - length, first, m)
            steps.append((length, rank, m, first, size - room))
            rank, left = rank + m, left - m
    return steps


def ranked(pieces: DataFrame, salts: int = 256) -> DataFrame:
    """pieces with rank: a number from 0 without gaps within each length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "salt")


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset. The histogram (at most ``size`` rows) goes to the driver, its plan to all tasks."""
    pieces = checkpointed(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[np.ndarray]] = {}
    for step in plan(counts, size):
        by_length.setdefault(step[0], []).append(np.array(step[1:], dtype=np.int64))
    slots = {k: np.array(v) for k, v in by_length.items()}

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            lengths, ranks = f["length"].to_numpy(), f["rank"].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                table = slots[int(length)]
                k = np.searchsorted(table[:, 0], ranks[at], side="right") - 1
                sequence[at], offset[at] = table[k, 2] + ranks[at] - table[k, 0], table[k, 3]
            yield f.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    rows = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(placed, PIECES + ", sequence_id long, offset long")


def word_bpe() -> object:
    """The public 49k word BPE; loaded where it is used."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, load: Callable = word_bpe, size: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(pieces_of(docs, load, size, end_id), size)
