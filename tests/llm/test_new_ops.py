"""Language-model scores, whitening and the Merkle manifest against brute-force versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import maxent_lm, merkle, whitening

# -- language-model scores


def split(text):
    return [w for w in (text or "").encode().lower().split()] + [None]


@pytest.fixture(scope="module")
def lm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "text").collect(), maxent_lm.score_documents(docs).collect()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_lm_base_is_the_smoothed_unigram(lm):
    docs, rows = lm
    c = Counter(w for d in docs if not held(d["doc_id"]) for w in split(d["text"]))
    total, room = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    texts = {d["doc_id"]: split(d["text"]) for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        words = texts[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in c for w in words))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / room) for w in words), rel=1e-9)


def test_lm_model_beats_the_base_on_held_out_texts(lm):
    _, rows = lm
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def test_lm_rare_words_meet_their_counts_whatever_is_coded(spark):
    """With few coded words, nearly all go through the join: the base stays the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r["doc_id"]: r for r in maxent_lm.score_documents(docs, words=700, rounds=1).collect()}
    b = {r["doc_id"]: r for r in maxent_lm.score_documents(docs, rounds=1).collect()}
    for k in a:
        assert a[k]["base_score"] == pytest.approx(b[k]["base_score"], rel=1e-9) and a[k]["n_known"] == b[k]["n_known"]


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    counted = [(f"w{k}{chr(97 + k % 9)}".encode(), int(900 / (k + 1)) + 1) for k in range(700)]
    rare = [(b"zz%d" % k, 1) for k in range(30)]
    by = defaultdict(lambda: [0, 0])
    ranked = {t for t, _ in sorted(counted, key=lambda x: (-x[1], x[0]))[: maxent_lm.RANKED]}
    for t, n in counted + rare:
        if t not in ranked:
            by[maxent_lm.ending_class(t)][0] += n
            by[maxent_lm.ending_class(t)][1] += 1
    voc = maxent_lm.Vocabulary(counted, sum(n for _, n in counted + rare), len(counted + rare), {k: tuple(v) for k, v in by.items()})
    model = maxent_lm.Model(voc, 1 << 10).start()
    model.wide += rng.standard_normal(model.wide.shape).astype(np.float32)
    model.deep[maxent_lm.WIDE :] += rng.standard_normal(model.deep[maxent_lm.WIDE :].shape).astype(np.float32)
    context, _ = voc.encode([b"w3d", b"w650c"])
    context = context[:-1]

    def log10(token):
        ids, rest = voc.encode([token])
        run = np.append(context, ids[0]).astype(np.int32)
        got = model.log10(run, np.arange(3) == 0)[-1]
        return got + sum(math.log10(dict(rare).get(w, 0) + 0.1) for w in rest[:1] if w == token)

    total = sum(10 ** log10(t) for t, _ in counted + rare)
    unseen, k = {}, 0
    while len(unseen) < maxent_lm.WIDE // 2 and k < 60_000:
        word = bytes([97 + k % 26, 97 + k // 26 % 26, 65 + k // 676 % 26])
        unseen.setdefault(maxent_lm.ending_class(word), word)
        k += 1
    assert len(unseen) == maxent_lm.WIDE // 2
    assert total + sum(10 ** log10(w) for w in unseen.values()) == pytest.approx(1, abs=1e-3)


def test_lm_odd_rows(spark, odd_docs, no_docs):
    rows = maxent_lm.score_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert [r["n_tokens"] for r in empty] == [1, 1]
    twice = [(r["base_score"], r["score"]) for r in rows if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    assert maxent_lm.score_documents(no_docs).collect() == []


# -- whitening


def brute_whitening(vectors, k):
    x = np.unique(np.floor(np.array(vectors, np.float64) * 64).astype(np.int64), axis=0)
    e, v = np.linalg.eigh(np.cov(x.T.astype(np.float64), bias=True))
    return x, e[::-1][:k], v[:, ::-1][:, :k]


@pytest.mark.parametrize("blocks", [2, 5])
def test_whitening_equals_dense_eigenvectors(spark, blocks, monkeypatch):
    """With 2 blocks it restarts often."""
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    given = {r["vec_id"]: list(r["embedding"]) for r in emb.collect()}
    plain = whitening.leading
    monkeypatch.setattr(whitening, "leading", lambda fit, trace, k: plain(fit, trace, k, spare=4, blocks=blocks + 1))
    rows = whitening.whiten(emb.withColumnRenamed("embedding", "vector")).collect()
    x, e, v = brute_whitening(list(given.values()), 16)
    n, sums = len(x), x.sum(axis=0)
    assert len(rows) == 16 * len(given)
    trace = np.cov(x.T.astype(np.float64), bias=True).trace()
    signs = {}
    for r in rows:
        own = np.floor(np.array(given[r["vec_id"]], np.float64) * 64).astype(np.int64)
        assert r["n"] == n and r["deviation"] == int(((n * own - sums) ** 2).sum())
        c = r["component"] - 1
        want = (own - sums / n) @ v[:, c] / math.sqrt(e[c])
        sign = signs.setdefault(c, 1 if want * r["whitened"] >= 0 else -1)
        assert r["whitened"] == pytest.approx(sign * want, abs=1e-7)
        assert r["explained"] == pytest.approx(e[c] / trace, rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.standard_normal(5)], "x") for k in range(40)]
    odd = [(100, None, "x"), (101, [1.0, None, 0.0, 0.0, 0.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("inf")] + [0.0] * 4, "x"), (104, [1.0, 2.0], "x"), (105, [], "x"), (106, [1e300] * 5, "x"), (None, good[0][1], "x"), (0, good[0][1], "x")]
    df = spark.createDataFrame(good + odd, "vec_id long, vector array<double>, n string")
    rows = whitening.whiten(df).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4, 5} and {r["n"] for r in rows} == {40}
    assert Counter(r["vec_id"] for r in rows) == Counter({**{k: 5 for k in range(1, 40)}, 0: 10, None: 5})
    assert sum(r["explained"] for r in rows if r["vec_id"] == 1) == pytest.approx(1)
    assert whitening.whiten(df.where("vec_id = 1")).collect() == []
    assert whitening.whiten(df.where("vec_id > 500")).collect() == []


def test_whitening_of_flat_spectrum_and_large_entries(spark):
    """Directions without variance have no component; huge integers keep exact deviations."""
    rng = np.random.default_rng(4)
    vectors = [[float(a), float(b), 7.0, float(a)] for a, b in rng.integers(-40, 40, (60, 2)) * 3000]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, vector array<double>")
    rows = whitening.whiten(df).collect()
    assert {r["component"] for r in rows} == {1, 2}
    x = np.unique(np.floor(np.array(vectors) * 64).astype(np.int64), axis=0)
    n, sums = len(x), [int(c) for c in x.sum(axis=0)]
    for r in rows:
        own = [int(64 * c) for c in vectors[r["vec_id"]]]
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))


# -- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root and for every leaf its siblings as (before, after) by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    paths = [[("", nodes[x ^ 1])[:: 1 if x % 2 == 0 else -1] if (x := k >> level) ^ 1 < len(nodes) else ("", "") for level, nodes in enumerate(levels[:-1])] for k in range(len(leaves))]
    return levels[-1][0], paths


def brute_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, more=0: sha(field(d["doc_id"]) + field(d["source"]) + field(d["lang"]) + field(None if d["n_chars"] is None else d["n_chars"] + more) + field(d["text"]))
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        trees[g] = brute_tree([leaf(d) for d in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for d, path in zip(groups[g], trees[g][1], strict=True):
            bad = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            folded = leaf(d, int(bad))
            for before, after in path + top:
                folded = sha(before + folded + after)
            out.append((d["doc_id"], leaf(d), trees[g][0], root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=str)


def manifest(df, rows):
    return sorted((tuple(r) for r in merkle.prove_documents(df, rows).collect()), key=str)


@pytest.mark.parametrize("rows", [3, 40, 50_000])
def test_manifest_equals_brute_force(spark, docs, rows):
    got = manifest(docs, rows)
    assert got == brute_manifest([r.asDict() for r in docs.collect()])
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (7, 8, 9), (64, 65, 1, 17), (200,)])
def test_manifest_of_all_shapes(spark, sizes):
    made = [(k, f"text {k}", f"l{g}", "s", k) for g, n in enumerate(sizes) for k in range(g * 1000, g * 1000 + n)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert manifest(df, 4) == brute_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    assert manifest(odd_docs, 2) == brute_manifest([r.asDict() for r in odd_docs.collect()])
    assert manifest(no_docs, 2) == []


def test_manifest_splits_equal_rows_over_ranges(spark):
    df = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    leaves = df.select("doc_id", F.lit("=en").alias("grp"), F.lit("x").alias("leaf"))
    sizes = [r["count"] for r in merkle._range_sorted(leaves, ["doc_id"], 50).groupBy("range").count().collect()]
    assert max(sizes) < 120
    assert manifest(df, 50) == brute_manifest([r.asDict() for r in df.collect()])


def test_runs_cover_each_tree_once():
    for n in range(1, 40):
        for a in range(n):
            for m in range(1, n - a + 1):
                run = merkle.Shape(a, m, n)
                covered = sorted(x for level, at in run.ragged() for x in range(at << level, min((at + 1) << level, n)))
                assert covered == list(range(a, a + m))
                needed = {(level, (k >> level) ^ 1) for k in range(a, a + m) for level in range(merkle.depth_of(n)) if (k >> level) ^ 1 < run.width(level)}
                assert {c for c in needed if not run.has(*c)} == set(run.outside())
