"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are lower-cased runs of letters and digits. A sketch takes the three least k-mers (two words, labelled with their
occurrence) under its own hash and keeps them in text order; documents that share one of 48 sketches are candidates.
Three k-mers a sketch keep a passage that many documents share from bringing all of them together; 48 sketches keep
candidates likely up to the 20 % of edits that the alignment accepts: two documents are near when the word edits are at
most 20 % of the longer one. Classes are the connected components of the near pairs.

Equal word sequences are one document from the start. Buckets of at most ``small`` documents compare all their pairs.
Near documents have lengths of one length class or of neighbouring ones. In a larger bucket every document is compared
with the shortest one of its length class and of the class below. Where that leaves neighbouring length classes of a
bucket in more than one class, the documents of different classes are compared in blocks, so no bucket emits all pairs
as rows and none is cut off.

Defined cases: null text is empty; documents without a word are in one class only if their texts are equal; rows that
repeat a doc_id and a text are one document; of different texts with one doc_id, one (by hash) stands for the id; columns
besides doc_id and text are ignored; an empty table gives an empty result. Word sequences are compared by 64-bit and
32-bit word hashes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import textkernels as tk
from quarrylane.llm.common import checkpointed
from quarrylane.llm.components import components

K, TAKE, SKETCHES, LEAST, SMALL = 2, 3, 48, 0.8, 12
#: At most so many documents, and about so many words, in a block of a large bucket; two blocks meet in one task.
BLOCK, BLOCK_WORDS = 2048, 1 << 21


def sequence_hash(words: np.ndarray, text: str) -> np.ndarray:
    """Two longs that stand for a word sequence, or for the text where it has no word."""
    own = words.tobytes() if len(words) else b"\0" + text.encode("utf-8", "surrogatepass")
    return np.frombuffer(hashlib.md5(own, usedforsecurity=False).digest(), np.int64)


def sketches(docs: DataFrame, k: int = K, take: int = TAKE, n: int = SKETCHES) -> DataFrame:
    """doc_id, a hash of the word sequence (two longs), the sketch keys and the number of words."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                words = tk.word_hashes(text)
                h = sequence_hash(words, text)
                rows.append((doc, int(h[0]), int(h[1]), tk.order_minhash(words, k, take, n), len(words)))
            yield pd.DataFrame(rows, columns=["doc_id", "w1", "w2", "keys", "n"]).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(each, "doc_id long, w1 long, w2 long, keys array<long>, n int")


def words_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, words, bag): the word sequences, as 32-bit hashes, of the documents asked for (id), and counts folded to bytes."""

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hashed = [tk.word_hashes(t) for t in f["text"]]
            own = [sequence_hash(w, t) for w, t in zip(hashed, f["text"], strict=True)]
            words = [(w >> np.uint64(32)).astype("<u4") for w in hashed]
            bags = [np.minimum(np.bincount(w & 127, minlength=128), 255).astype(np.uint8).tobytes() for w in words]
            yield pd.DataFrame({"id": f["doc_id"], "w1": [int(h[0]) for h in own], "w2": [int(h[1]) for h in own], "words": [w.tobytes() for w in words], "bag": bags})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = texts.join(asked.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    coded_rows = own.mapInPandas(coded, "id long, w1 long, w2 long, words binary, bag binary")
    return coded_rows.groupBy("id").agg(F.min_by(F.struct("words", "bag"), F.struct("w1", "w2")).alias("_w")).select("id", "_w.words", "_w.bag")


def verified(pairs: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose word sequences are near."""

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [tk.alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(f["wa"], f["wb"], strict=True)]
            yield f.loc[ok, ["a", "b"]]

    left = words.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInPandas(near, "a long, b long")


def _open_pairs(x: np.ndarray, y: np.ndarray, b: np.ndarray, root: np.ndarray, own: np.ndarray, n: np.ndarray, bags: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place i of block x the places j of block y that may be near and are of another class, and bounds of the edits.

    Bags of words, folded to 128 counts of at most 255, bound the edits from below.
    """
    for i in np.flatnonzero(b == x):
        j = np.flatnonzero((b == y) & (root != root[i]) & (own | own[i]))
        if x[i] == y[i]:
            j = j[j > i]
        most = np.floor((1 - least) * np.maximum(n[i], n[j]) + 1e-9)
        more = np.abs(n[j] - n[i])
        j, most, more = j[more <= most], most[more <= most], more[more <= most]
        if len(j):
            bound = (np.abs(bags[j] - bags[i]).sum(axis=1) + more) / 2
            yield int(i), j[bound <= most], bound[bound <= most]


def _maybe_near(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """The rows of each group (gid; rows of a group are adjacent) that are in an open pair of it."""
    rest = None
    for f in itertools.chain(frames, [None]):
        last = f is None
        f = rest if last else f if rest is None else pd.concat([rest, f], ignore_index=True)
        if f is None or not len(f):
            continue
        gid = f["gid"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        ends = np.append(starts[1:], len(f))
        if not last:
            rest = f.iloc[starts[-1] :].reset_index(drop=True)
            starts, ends = starts[:-1], ends[:-1]
        columns = [f[c].to_numpy() for c in ("x", "y", "b", "root", "own", "n")]
        bags, keep = f["bag"].to_numpy(), np.zeros(len(f), bool)
        for low, high in zip(starts, ends, strict=True):
            if high - low < 2:
                continue
            own_bags = np.frombuffer(b"".join(bags[low:high]), np.uint8).reshape(-1, 128).astype(np.int32)
            for i, j, _ in _open_pairs(*[c[low:high] for c in columns], own_bags, least):
                if len(j):
                    keep[low + i] = keep[low + j] = True
        yield f.loc[keep].drop(columns=["gid", "bag"])


def _separate(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Near pairs between the blocks x and y of one bucket that join documents of different classes.

    A pair is compared in the first sketch it agrees in only, and not at all when an earlier pair of the group has joined
    its classes.
    """
    ids, roots, at = group["id"].to_numpy(), group["root"].tolist(), int(group["at"].iloc[0])
    words, keys = [np.frombuffer(w, "<u4") for w in group["words"]], np.stack(group["keys"].to_list())
    bags = np.frombuffer(b"".join(group["bag"]), np.uint8).reshape(-1, 128).astype(np.int32)
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    pairs = []
    for i, j, bound in _open_pairs(*[group[c].to_numpy() for c in ("x", "y", "b", "root", "own", "n")], bags, least):
        first = ~(keys[j, :at] == keys[i, :at]).any(axis=1)
        pairs += zip(bound[first].tolist(), [i] * int(first.sum()), j[first].tolist(), strict=True)
    out = []
    for _, i, j in sorted(pairs):
        u, v = find(roots[i]), find(roots[j])
        if u != v and tk.alike(words[i], words[j], least):
            parent[u] = v
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def length_class(n: Column, least: float) -> Column:
    """Near documents are in one class or in neighbouring ones: their lengths differ by a factor of 1 / least at most."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(-float(np.log(least))) + 1e-9).cast("int")


def _listed(rows: DataFrame) -> DataFrame:
    """One row for each id, with its other columns as a list: at most two for each sketch, times the blocks of a bucket."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "id"])).alias("_places"))


def between_classes(many: DataFrame, roots: DataFrame, reps: DataFrame, words: DataFrame, block: int = BLOCK, least: float = LEAST) -> DataFrame:
    """Near pairs of different classes (node, root) in large buckets (key, at, id, n).

    Each document meets its own length class and the one above. A part of a bucket in one class is settled; elsewhere the documents outside the part's most frequent class
    are compared with all of the part, block by block; a part that fits into one block is one.
    """
    step = -float(np.log(least))
    rows = many.join(roots, F.col("id") == F.col("node"), "left").select("key", "at", "id", "n", F.coalesce("root", "id").alias("root"), length_class(F.col("n"), least).alias("_c"))
    rows = checkpointed(rows)
    several = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    parts = rows.join(several, "key").select("key", "at", "id", "n", "root", "_c", F.explode(F.array("_c", F.col("_c") + 1)).alias("part"))
    parts = checkpointed(parts)
    by_root = parts.groupBy("key", "part", "root").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("_c") == F.col("part")).alias("_own"))
    by_part = by_root.groupBy("key", "part").agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"), F.max_by("root", F.struct("_n", "root")).alias("_major"), F.count(F.lit(1)).alias("_roots"), F.max("_own").alias("_own"))
    open_ = by_part.where("_roots > 1 and _own")
    fit = F.least(F.lit(float(block)), F.greatest(F.lit(32.0), F.floor(BLOCK_WORDS / F.exp((F.col("part") + 1) * step))))
    blocks = lambda c: F.greatest(F.ceil(c / fit), F.lit(1)).cast("int")
    rows = parts.join(open_.withColumn("_one", F.col("_all") <= fit), ["key", "part"])
    rows = rows.withColumn("_few", blocks(F.col("_all") - F.col("_most"))).withColumn("_rest", F.when(F.col("_one"), 0).otherwise(blocks(F.col("_most"))))
    minor, dealt = F.col("_one") | (F.col("root") != F.col("_major")), F.xxhash64("id", F.lit(1))
    rows = rows.withColumn("b", F.when(minor, F.pmod(dealt, F.col("_few"))).otherwise(F.col("_few") + F.pmod(dealt, F.col("_rest"))).cast("int"))
    rows = rows.select("id", "key", "part", "at", "n", "root", "b", (F.col("_c") == F.col("part")).alias("own"), F.when(minor, F.col("_few") + F.col("_rest") - 1).otherwise(F.col("_few") - 1).alias("_last"))
    # a document meets its bag once, however many groups it is dealt to, and its words only where it may be near another one
    dealt = _listed(rows).join(words.select("id", "bag"), "id")
    pair = lambda e, o: F.struct(*[e[c].alias(c) for c in ("key", "part", "at", "n", "root", "own", "b")], F.least(e["b"], o).alias("x"), F.greatest(e["b"], o).alias("y"))
    groups = F.flatten(F.transform("_places", lambda e: F.transform(F.sequence(F.lit(0), e["_last"]), lambda o: pair(e, o))))
    dealt = dealt.select("id", "bag", F.inline(groups)).withColumn("gid", F.xxhash64("key", "part", "x", "y"))
    kept = "key long, part int, at int, id long, n int, root long, own boolean, b int, x int, y int"
    dealt = dealt.select("gid", "key", "part", "at", "id", "n", "root", "own", "b", "x", "y", "bag").repartition("gid").sortWithinPartitions("gid")
    rows = checkpointed(dealt.mapInPandas(lambda frames: _maybe_near(frames, least), kept))
    rows = _listed(rows).join(words, "id").join(reps.select("id", "keys"), "id").select("id", "words", "bag", "keys", F.inline("_places"))
    return rows.groupBy("key", "part", "x", "y").applyInPandas(lambda g: _separate(g, least), "a long, b long")


def near_roots(reps: DataFrame, docs: DataFrame, small: int = SMALL, block: int = BLOCK, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Classes of distinct documents (id, keys, n) as two tables (node, root): of documents, then of the first one's roots."""
    rows = reps.select("id", "n", F.posexplode("keys").alias("at", "_k")).select("id", "n", "at", F.xxhash64("at", "_k").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = checkpointed(rows.join(checkpointed(buckets), "key"))
    few, many = rows.where(F.col("size") <= small).select("key", "id", "n"), rows.where(F.col("size") > small)
    all_pairs = few.toDF("key", "a", "na").join(few.toDF("key", "b", "nb"), "key").where("a < b").select("a", "b", "na", "nb")
    many = many.withColumn("_c", length_class(F.col("n"), least))
    heads = many.groupBy("key", "_c").agg(F.min(F.struct("n", "id")).alias("head"))
    none = F.lit(None).cast("struct<n:int,id:bigint>")
    both = heads.select("key", "_c", F.col("head").alias("own"), none.alias("below")).unionByName(heads.select("key", (F.col("_c") + 1).alias("_c"), none.alias("own"), F.col("head").alias("below")))
    heads = checkpointed(both.groupBy("key", "_c").agg(F.max("own").alias("own"), F.max("below").alias("below")))
    asked = checkpointed(many.select("key", "id", "n", "_c").join(heads, ["key", "_c"]).select("id", "n", "own", "below"))
    star = lambda h: asked.where(f"id <> {h}.id").select(F.least("id", f"{h}.id").alias("a"), F.greatest("id", f"{h}.id").alias("b"), F.col("n").alias("na"), F.col(f"{h}.n").alias("nb"))
    stars = star("own").unionByName(star("below"))
    # shorter by more than the edits allowed: never near
    fits = F.abs(F.col("na") - F.col("nb")) <= F.floor((1 - least) * F.greatest("na", "nb") + 1e-9)
    pairs = checkpointed(all_pairs.unionByName(stars).where(fits).select("a", "b").distinct())
    words = checkpointed(words_of(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(many.select("id"))))
    roots = components(verified(pairs, words, least).select(F.col("b").alias("u"), F.col("a").alias("v")))
    more = between_classes(many.select("key", "at", "id", "n"), roots, reps, words, block, least)
    for end in ("a", "b"):
        more = more.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    return roots, components(more.select(F.coalesce("_a", "a").alias("u"), F.coalesce("_b", "b").alias("v")))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every document."""
    own = checkpointed(sketches(docs))
    copies = checkpointed(own.groupBy("w1", "w2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    member = own.join(copies, ["w1", "w2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "w1", "w2", "keys", "n")
    reps = member.where("doc_id = rep").groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct("keys", "n"), F.struct("w1", "w2")).alias("_r")).select("id", "_r.keys", "_r.n")
    roots, again = near_roots(checkpointed(reps), docs, least=least)
    out = member.select("doc_id", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep", "doc_id").alias("_c"))
    out = out.join(again, F.col("_c") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("root", "_c").alias("class_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept: the document with the least doc_id of each class stays."""
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs without the documents whose class has an earlier one; documents without an id stay."""
    gone = near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
