"""SentencePiece encoding and decoding on a relational lattice.

A border between two characters that no piece has side by side is never crossed, so texts are cut there first. Distinct
words (what is between such borders, two characters or more) are exploded into their substrings of bounded length, joined
with the piece table, and the edges that are pieces are grouped by word. A Spark higher-order aggregate folds each word's
edges into its segmentation, kept as one long: bit i says that a piece begins or ends at character i. Documents then look
their words up.

Two folds: ``viterbi`` takes the path of the greatest sum of scores, as unigram models do. The public model is of the BPE
kind, for which a best path over its scores is not what the library gives; there ``merges`` joins the best-ranked
neighbouring pair, step by step, and the results equal the library's.

Every split of the input asks for its own distinct words. The answers and the documents, compressed, then meet in one
shuffle by the split's number, answers first: a task learns the words of a split and streams its documents through them.
Results are stored at once, so Python gets a few MB of texts at a time and not the texts of 10,000 rows.
Within a split words are told apart by 64-bit hashes.
Words of over 60 characters (a long holds no more borders), words without an edge and words that a re-planned split did
not ask for are segmented in place by the same rule.

Defined cases: null and empty text have no ids and decode to empty text; characters outside the vocabulary become byte
pieces; equal rows encode alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import let, written
from quarrylane.llm.textkernels import mix

BLANK = "▁"
LONGEST = 60
#: Characters (bytes where texts are still in Arrow) that are handled at a time.
AT_ONCE = 1 << 20


@dataclass
class Pieces:
    """A BPE model's table: rank and id of normal pieces, ids of byte pieces, text of every id."""

    rank: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[str]
    unknown: int

    @property
    def widest(self) -> int:
        return max(map(len, self.rank), default=1)


def load_pieces(path: str) -> Pieces:
    """The piece table of a model file; pieces that join words by an inner blank are not supported."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(re.search(f"[^{BLANK}]{BLANK}", texts[i]) for i in normal):
        raise ValueError("pieces reach over word borders")
    order = sorted({-model.get_score(i) for i in normal})
    level = {s: k for k, s in enumerate(order)}
    ids = {texts[i]: i for i in normal}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces({texts[i]: level[-model.get_score(i)] for i in normal}, ids, byte_ids, texts, model.unk_id())


def merged(word: str, rank: dict[str, int]) -> list[str]:
    """The pieces of one word: merge the best-ranked pair of neighbours, the leftmost on ties, until none is a piece."""
    import heapq

    n = len(word)
    after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), list(word)
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (r, i, part[i] + part[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, text = heapq.heappop(heap)
        if not part[i] or (j := after[i]) >= n or part[i] + part[j] != text:
            continue
        part[i], part[j] = text, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [p for p in part if p]


def outranked(rank: dict[str, int]) -> set[str]:
    """The pieces that are the beginning or the end of a piece of a better (or equal) rank, whose other part is a piece or a character."""
    known = lambda p: len(p) == 1 or p in rank
    return {x for p, r in rank.items() for k in range(1, len(p)) if known(p[:k]) and known(p[k:]) for x in (p[:k], p[k:]) if len(x) > 1 and rank[x] >= r}


def prepared(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def best_path(word: str, scores: dict[str, float], unknown: float) -> list[str]:
    """The pieces of the path of the greatest sum of scores; single characters that are no piece count ``unknown``."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        best.append(max((best[s][0] + scores.get(word[s:e], unknown if e - s == 1 else -1e30), -s) for s in range(e)))
    out, e = [], len(word)
    while e:
        s = -best[e][1]
        out.append(word[s:e])
        e = s
    return out[::-1]


class Cutter:
    """Cuts texts into words at the borders that no piece crosses, with a 64-bit hash for every word, in array operations."""

    def __init__(self, pieces: Pieces):
        pairs = {(a, b) for p in pieces.rank for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in pairs for c in pair})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        for a, b in pairs:
            self.joined[self.place[ord(a)] * self.width + self.place[ord(b)]] = True
        with np.errstate(over="ignore"):
            self.power = mix(np.arange(1, 1 << 16, dtype=np.uint64)) | np.uint64(1)

    def hashes(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of every run of characters that begins at a start."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        at = np.arange(len(codes), dtype=np.int32)
        at -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(codes))))
        at %= len(self.power)
        with np.errstate(over="ignore"):
            terms = codes.astype(np.uint64)
            terms += np.uint64(1)
            terms *= self.power[at]
            return mix(np.add.reduceat(terms, starts))

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The prepared texts end to end, their characters, the words' starts and for each text its first word (and the end)."""
        own = [prepared(t) for t in texts]
        whole = "".join(own)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in own]))).astype(np.int64)
        place = self.place[codes]
        opens = np.ones(len(codes) + 1, bool)
        if len(codes):
            opens[1:-1] = ~self.joined[place[:-1] * self.width + place[1:]]
        opens[edges] = True
        starts = np.flatnonzero(opens[:-1])
        return whole, codes, starts, np.searchsorted(starts, edges)


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters."""
    low = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about AT_ONCE bytes of text."""
    run = np.cumsum(pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [rows.num_rows])) if rows.num_rows else np.zeros(1, np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield rows.slice(low, high - low)


def asked_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(split, word): the distinct words of 2 to LONGEST characters of every input split."""

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = Cutter(pieces), np.zeros(0, np.uint64)
        for f in (part for frame in frames for part in slices(frame)):
            split = f.column("split")[0].as_py()
            whole, codes, starts, _ = cutter.cut(f.column("text").to_pylist())
            ends = np.append(starts[1:], len(codes))
            mine = (ends - starts >= 2) & (ends - starts <= LONGEST)
            h, at = np.unique(cutter.hashes(codes, starts)[mine], return_index=True)
            new = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h if len(known) else np.ones(len(h), bool)
            at = np.flatnonzero(mine)[at[new]]
            known = np.sort(np.concatenate((known, h[new])))
            words = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            yield pa.record_batch({"split": pa.array(np.full(len(words), split, np.int32)), "word": pa.array(words, pa.string())})

    rows = docs.select(F.spark_partition_id().alias("split"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "split int, word string")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def fold_merges(n: Column, edges: Column) -> Column:
    """Borders of a word of n characters as bits, from its edges (order, ends, inner, outranked).

    Every step removes the inner border of the best edge that spans exactly two neighbours. One pass over the edges in
    order does the same as long as no merge lets an edge fit that the pass has left behind. Only an outranked edge can do
    that; where one does, the word is folded step by step.
    """
    start = _bit(n + 1) - F.lit(1).cast("long")
    late = F.lit(1 << 62)
    fits = lambda cuts, e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)
    without = lambda cuts, e: cuts.bitwiseAND(F.bitwise_not(e["inner"]))

    def step(cuts: Column, _: Column) -> Column:
        best = F.array_min(F.filter(edges, lambda e: fits(cuts, e)))
        return let(best, lambda b: F.when(b.isNull(), cuts).otherwise(without(cuts, b)))

    def in_order(cuts: Column, e: Column) -> Column:
        behind = lambda less: F.exists(edges, lambda x: (x["order"] <= e["order"]) & fits(less, x))
        checked = let(without(cuts, e), lambda less: F.when(behind(less), less.bitwiseOR(late)).otherwise(less))
        return F.when(~fits(cuts, e), cuts).when(e["outranked"], checked).otherwise(without(cuts, e))

    steps = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)
    return let(F.aggregate(F.sort_array(edges), start, in_order), lambda cuts: F.when(cuts.bitwiseAND(late) == 0, cuts).otherwise(steps))


def fold_viterbi(n: Column, edges: Column, unknown: float) -> Column:
    """Borders of the path of the greatest sum of scores; of equal sums the one whose last piece is longest.

    The state holds the best sum and the start of its last piece for every character border so far; then the path is
    followed back from the end.
    """

    def way(state: Column, s: Column, score: Column) -> Column:
        total = F.coalesce(F.get(state, s)["sum"] + score, F.lit(float("-inf")))
        return F.named_struct(F.lit("sum"), total, F.lit("back"), F.coalesce(-s, F.lit(0)))

    def best(state: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: way(state, x["s"], x["score"]))
        alone = F.when(F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1)), F.lit(float("-inf"))).otherwise(F.lit(unknown))
        top = F.array_max(F.concat(ways, F.array(way(state, e - 1, alone))))
        return F.named_struct(F.lit("sum"), F.coalesce(top["sum"], F.lit(float("-inf"))), F.lit("back"), F.coalesce(top["back"], F.lit(0)))

    first = F.array(F.named_struct(F.lit("sum"), F.lit(0.0), F.lit("back"), F.lit(0)))
    states = F.aggregate(F.sequence(F.lit(1), n), first, lambda state, e: F.concat(state, F.array(best(state, e))))
    pair = lambda at, cuts: F.named_struct(F.lit("at"), F.coalesce(at, F.lit(0)), F.lit("cuts"), F.coalesce(cuts, F.lit(0).cast("long")))

    def back(states: Column) -> Column:
        step = lambda path, _: F.when(path["at"] == 0, path).otherwise(let(-F.get(states, path["at"])["back"], lambda s: pair(s, path["cuts"].bitwiseOR(_bit(s)))))
        return F.aggregate(F.sequence(F.lit(1), n), pair(n, _bit(n)), step)["cuts"]

    return let(states, back)


def segmented(asked: DataFrame, pieces: Pieces, fold: str = "merges", scores: dict[str, float] | None = None, unknown: float = -20.0) -> DataFrame:
    """(split, word, cuts): the lattice over distinct words of up to LONGEST characters.

    The piece table is as large as the vocabulary and no larger. Substrings meet it by hash; matches are compared.
    """
    spark = asked.sparkSession
    behind = outranked(pieces.rank) if fold == "merges" else set()
    rows = [(p, r, 0.0, p in behind) for p, r in pieces.rank.items() if len(p) > 1] if fold == "merges" else [(p, 0, float(x), False) for p, x in (scores or {}).items()]
    table = spark.createDataFrame(rows, "piece string, rank int, score double, outranked boolean").withColumn("h", F.xxhash64("piece"))
    least, widest = 2 if fold == "merges" else 1, max((len(r[0]) for r in rows), default=1)
    words = asked.repartition("word").groupBy("word", F.floor(F.col("split") / 4096).alias("_g")).agg(F.collect_list("split").alias("splits"))
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - least), lambda s: F.transform(F.sequence(s + least, F.least(n, s + widest)), lambda e: F.struct(s.alias("s"), e.alias("e"), F.xxhash64(F.substring("word", s + 1, e - s)).alias("h")))))
    edges = words.where(n >= 2).select("word", "_g", "splits", F.inline(spans)).join(F.broadcast(table), "h")
    edges = edges.where(F.col("piece") == F.expr("substring(word, s + 1, e - s)"))
    ends, inner = _bit(F.col("s")).bitwiseOR(_bit(F.col("e"))), _bit(F.col("e")) - _bit(F.col("s") + 1)
    edge = F.struct((F.col("rank") * 64 + F.col("s")).alias("order"), ends.alias("ends"), inner.alias("inner"), *(["s", "e", "score"] if fold != "merges" else ["outranked"]))
    edges = edges.groupBy("word", "_g").agg(F.any_value("splits").alias("splits"), F.collect_list(edge).alias("edges"))
    cuts = fold_merges(n, F.col("edges")) if fold == "merges" else fold_viterbi(n, F.col("edges"), unknown)
    # first the fold, once a word, then a row for each split that asked
    return edges.select("splits", "word", cuts.alias("cuts")).select(F.explode("splits").alias("split"), "word", "cuts")


def packed_documents(docs: DataFrame) -> DataFrame:
    """(split, batch): doc_id and text of every split as compressed batches."""

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in (part for frame in frames for part in slices(frame)):
            batch = zlib.compress(pickle.dumps((f.column("doc_id").to_pylist(), f.column("text").to_pylist())), 1)
            yield pa.record_batch({"split": pa.array([f.column("split")[0].as_py()], pa.int32()), "batch": pa.array([batch], pa.binary())})

    rows = docs.select(F.spark_partition_id().alias("split"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "split int, batch binary")


class Encoder:
    """Texts to ids in array operations, given the segmentations of a split's words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cutter = pieces, Cutter(pieces)
        names = list(pieces.ids)
        codes, starts = self._codes(names)
        h = self.cutter.hashes(codes, starts)
        order = np.argsort(h)
        self.piece_hash, self.piece_id = h[order], np.array([pieces.ids[p] for p in names], np.uint32)[order]
        self.learn(())

    def learn(self, parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Forget the words known so far and know these, in batches as ``answers`` gives them."""
        h = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        count, flat = np.concatenate([np.zeros(0, np.int32), *(p[1] for p in parts)]), np.concatenate([np.zeros(0, np.uint32), *(p[2] for p in parts)])
        order = np.argsort(h)
        self.known, self.count, self.first, self.flat = h[order], count[order], (np.cumsum(count, dtype=np.int64) - count)[order], flat

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths

    def _ids_of_parts(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.pieces.ids.get(p)
            out += [k] if k is not None else [self.pieces.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def answers(self, words: list[str], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and number of ids of every word, and the ids end to end."""
        whole, n = "".join(words), np.array([len(w) for w in words], np.int64)
        codes, starts = self._codes(words)
        at = np.arange(len(codes)) - np.repeat(starts, n)
        opens = (np.repeat(c, n) >> at) & 1 == 1
        heads = np.flatnonzero(opens)
        h, count = self.cutter.hashes(codes, heads), np.add.reduceat(opens.astype(np.int64), starts)
        k = np.minimum(np.searchsorted(self.piece_hash, h), len(self.piece_hash) - 1)
        found = self.piece_hash[k] == h
        ids = self.piece_id[k]
        if not found.all():  # characters that are no piece: bytes in their place
            tails = np.append(heads[1:], len(codes))
            per = [[int(i)] if ok else self._ids_of_parts([whole[a:b]]) for i, ok, a, b in zip(ids, found, heads.tolist(), tails.tolist(), strict=True)]
            sizes = np.array([len(x) for x in per], np.int64)
            count = np.add.reduceat(sizes, np.cumsum(count) - count)
            ids = np.array([i for x in per for i in x], np.uint32)
        return self.cutter.hashes(codes, starts), count.astype(np.int32), ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for low, high in batches(texts):
            whole, codes, starts, firsts = self.cutter.cut(texts[low:high])
            if not len(starts):
                out += [np.zeros(0, np.uint32)] * (high - low)
                continue
            h, index = np.unique(self.cutter.hashes(codes, starts), return_inverse=True)
            some = np.zeros(len(h), np.int64)
            some[index] = np.arange(len(index))
            k = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            found = self.known[k] == h if len(self.known) else np.zeros(len(h), bool)
            count, first, flat = np.where(found, self.count[k], 0) if len(self.known) else np.zeros(len(h), np.int64), self.first[k] if len(self.known) else np.zeros(len(h), np.int64), [self.flat]
            size = len(self.flat)
            for j in np.flatnonzero(~found).tolist():  # single characters, and words that were not asked for
                a = int(starts[some[j]])
                b = int(starts[some[j] + 1]) if some[j] + 1 < len(starts) else len(codes)
                word = whole[a:b]
                ids = np.array(self._ids_of_parts([word] if b - a == 1 else merged(word, self.pieces.rank)), np.uint32)
                count[j], first[j] = len(ids), size
                size += len(ids)
                flat.append(ids)
            flat_ids, c = np.concatenate(flat) if len(flat) > 1 else self.flat, count[index]
            ends = np.cumsum(c)
            ids = flat_ids[np.repeat(first[index] - (ends - c), c) + np.arange(ends[-1])]
            upto = np.concatenate(([0], ends))[firsts]
            out += [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return out


class Decoder:
    """Ids to texts: bytes joined, blanks restored, the leading one dropped; broken bytes become U+FFFD."""

    def __init__(self, pieces: Pieces):
        value = {k: bytes([b]) for b, k in enumerate(pieces.byte_ids)}
        each = [value[i] if i in value else t.encode() for i, t in enumerate(pieces.texts)]
        self.size = np.array([len(x) for x in each], np.int64)
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(each), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        c = self.size[ids]
        ends = np.cumsum(c)
        text = self.flat[np.repeat(self.first[ids] - (ends - c), c) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def over_documents(docs: DataFrame, pieces: Pieces, emit: Callable[[int, str, np.ndarray], tuple], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """emit(doc_id, text, ids) of every document, as columns of the given types, stored.

    One task holds the answers of one split and one batch of its documents at a time.
    """
    n = docs.select("doc_id").rdd.getNumPartitions()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    answers = segmented(asked_words(docs, pieces), pieces).withColumn("batch", F.lit(None).cast("binary"))
    both = answers.unionByName(packed_documents(docs), allowMissingColumns=True).repartitionById(n, F.pmod("split", F.lit(n)).cast("int"))

    def joined(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words, of = Encoder(pieces), [], None
        for f in frames:
            split, is_word = f.column("split").to_numpy(), f.column("batch").is_null().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(split) != 0) | np.diff(is_word)) + 1, [len(split)])) if len(split) else np.zeros(1, np.int64)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                run = f.slice(low, high - low)
                if split[low] != of:
                    of, words = split[low], []
                    encoder.learn(())
                if is_word[low]:
                    words.append(encoder.answers(run.column("word").to_pylist(), run.column("cuts").to_numpy()))
                    continue
                if words:
                    encoder.learn(words)
                    words = []
                for packed in run.column("batch"):
                    ids, texts = pickle.loads(zlib.decompress(packed.as_py()))
                    rows = [emit(*x) for x in zip(ids, texts, encoder.encode(texts), strict=True)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))

    return written(both.sortWithinPartitions("split", F.col("batch").isNotNull()).mapInArrow(joined, schema), "sentencepiece")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document."""
    return over_documents(docs, load_pieces(path), lambda doc, text, ids: (doc, ids), {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded documents."""
    pieces = load_pieces(path)

    def texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for f in frames:
            own = [decoder.text(np.array(ids or [], np.int64)) for ids in f.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": f.column("doc_id"), "text": pa.array(own, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    pieces = load_pieces(path)
    decoder = Decoder(pieces)

    def row(doc: int, text: str, ids: np.ndarray) -> tuple:
        return doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), decoder.text(ids) == text.replace(BLANK, " ")

    types = {"doc_id": pa.int64(), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()}
    return over_documents(docs, pieces, row, types, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
