"""Packing, tokenizing, classifiers, extraction, near-dedup and the pipeline."""

import collections
import itertools
import random
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylane.llm import common, components, html_extract, language_id, order_minhash, packing, quality_classifier, queries, sentencepiece, url_filter
from quarrylane.llm import textkernels as tk

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- packing ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(counts):
    steps = packing.plan(counts, 64)
    used = collections.defaultdict(list)
    for n, c in counts.items():
        ranks = sorted(r for length, low, m, _, _ in steps if length == n for r in range(low, low + m))
        assert ranks == list(range(c))
    for length, _, m, first, offset in steps:
        for k in range(m):
            used[first + k].append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    # as few as plain best-fit-decreasing needs
    rooms = []
    for n in sorted(itertools.chain.from_iterable([k] * c for k, c in counts.items()), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 64) - n)
    assert len(used) <= len(rooms) + 1


def test_pack_documents(spark, docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k] = (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))
    rows = packing.pack_documents(docs).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    for part in (rows, packing.pack_documents(odd_docs).collect()):
        by = collections.defaultdict(list)
        for r in part:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in by.values():
            x.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 4096
    assert packing.pack_documents(no_docs).count() == 0


def test_word_cache_equals_library():
    t = packing.word_bpe()
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aBéßÀ .,!'~<|>_-[]()0129\n\t²ǅσΣ") for _ in range(rnd.randint(0, 30))) for _ in range(800)] + ["<|endoftext|> a", "it's John's ~", ""]
    cache = packing.WordCache(t)
    assert [x.tolist() for x in cache.ids(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_cache_keeps_frequent_words(monkeypatch):
    """When the cache is full, the words that come up again and again are not encoded anew."""
    monkeypatch.setattr(packing, "CACHE", 400)
    rnd = random.Random(3)
    fresh = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(n)]
    cache, common, encoded = packing.WordCache(packing.word_bpe()), fresh(50), collections.Counter()
    encode = cache._encode
    monkeypatch.setattr(cache, "_encode", lambda parts: encoded.update(parts) or encode(parts))
    texts = [" ".join([w if k % 2 else f"{w.title()}," for k, w in enumerate(common)] + fresh(60)) for _ in range(40)]
    for t in texts:
        assert cache.ids([t])[0].tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids
    assert {encoded[w] for w in common} == {1} and len(cache.known) + len(cache.older) <= 600


def test_stops_are_parts_of_their_own():
    assert packing.parts_of("Ab, É. x\nY.5") == ["ab", ",", "é", ".", "x", "y", ".5"]
    assert packing.parts_of("Ab... c.") == ["ab...", "c."] and packing.parts_of("Σσ. B") == ["Σσ.", "B"]


# -- SentencePiece ----------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library(spark, docs, odd_docs, no_docs):
    import sentencepiece as library

    m = library.SentencePieceProcessor(model_file=MODEL)
    for part in (docs, odd_docs):
        want = sorted((str(r["doc_id"]), m.encode(r["text"] or "")) for r in part.collect())
        encoded = sentencepiece.encode_documents(part, MODEL)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == want
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode_documents(sentencepiece.encode_documents(docs, MODEL), MODEL).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sentencepiece.encode_documents(no_docs, MODEL).count() == 0


def test_lattice_equals_merging(spark, docs):
    pieces = sentencepiece.load_pieces(MODEL)
    rows = sentencepiece.segmented(sentencepiece.asked_words(docs.limit(40), pieces), pieces).collect()
    assert len(rows) > 500
    for r in rows:
        at = [i for i in range(len(r["word"]) + 1) if r["cuts"] >> i & 1]
        assert [r["word"][a:b] for a, b in zip(at, at[1:])] == sentencepiece.merged(r["word"], pieces.rank)


def test_merging_in_one_pass_and_step_by_step(spark):
    """Pieces of random ranks over three letters: many merges let an edge of better rank fit that came up before."""
    rnd = random.Random(4)
    made = ["".join(x) for n in (2, 3, 4) for x in itertools.product("abc", repeat=n)]
    names = [*"abc", *rnd.sample(made, 60)]
    order = rnd.sample(range(len(names)), len(names))
    pieces = sentencepiece.Pieces(dict(zip(names, order, strict=True)), {p: k for k, p in enumerate(names)}, [0] * 256, names, 0)
    worse = sentencepiece.outranked(pieces.rank)
    assert 0 < len(worse) < 60 and sentencepiece.outranked({"ab": 0, "abc": 1, "bc": 2, "cd": 2, "bcd": 3}) == {"bc"}
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 14))) for _ in range(500)} | {"abc" * 20}
    got = sentencepiece.segmented(spark.createDataFrame([(0, w) for w in words], "split int, word string"), pieces).collect()
    for r in got:
        cuts = [i for i in range(len(r["word"]) + 1) if r["cuts"] >> i & 1]
        assert [r["word"][a:b] for a, b in itertools.pairwise(cuts)] == sentencepiece.merged(r["word"], pieces.rank)
    assert len(got) > 400


def test_viterbi_fold_finds_the_best_path(spark):
    """The fold of a unigram table against all segmentations of every word."""
    rnd = random.Random(6)
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): -rnd.random() * 9 for _ in range(40)}
    scores.pop("b", None)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 9))) for _ in range(150)})
    asked = spark.createDataFrame([(k % 3, w) for k, w in enumerate(words)], "split int, word string")
    pieces = sentencepiece.Pieces({}, {}, [], [], 0)
    got = {r["word"]: r["cuts"] for r in sentencepiece.segmented(asked, pieces, "viterbi", scores, -12.0).collect()}
    value = lambda parts: sum(scores.get(p, -12.0 if len(p) == 1 else -1e30) for p in parts)

    def every(word):
        return [[word]] + [[word[:k], *rest] for k in range(1, len(word)) for rest in every(word[k:])] if word else [[]]

    assert got.keys() == {w for w in words if any(p in w for p in scores)}
    for w, cuts in got.items():
        at = [i for i in range(len(w) + 1) if cuts >> i & 1]
        parts = [w[a:b] for a, b in zip(at, at[1:])]
        assert at[0] == 0 and at[-1] == len(w) and abs(value(parts) - max(map(value, every(w)))) < 1e-9
        assert abs(value(sentencepiece.best_path(w, scores, -12.0)) - value(parts)) < 1e-9


def test_encoder_without_answers_equals_library():
    import sentencepiece as library

    m = library.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aBé ß .,!?'~-09\n\t²漢😀▁ the ing") for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["", " ", "a" * 300, "x  y   z "]
    pieces = sentencepiece.load_pieces(MODEL)
    got = sentencepiece.Encoder(pieces).encode(texts)
    assert [g.tolist() for g in got] == m.encode(texts)
    decoder = sentencepiece.Decoder(pieces)
    assert [decoder.text(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_takes_texts_in_small_batches(spark, monkeypatch):
    """Both passes over the texts get a few MB at a time, however long the texts of 10,000 rows are."""
    plain = sentencepiece.slices

    def watched(rows):
        if rows.nbytes > 2 * 4 * 2**20:
            raise ValueError(f"{rows.nbytes} bytes at once")
        yield from plain(rows)

    monkeypatch.setattr(sentencepiece, "slices", watched)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 2000).alias("text"))
    got = sentencepiece.digest(docs, MODEL).agg(F.count("*"), F.count_if("round_trip"), F.min("n_ids"), F.max("n_ids")).first()
    assert got[0] == got[1] == 2000 and got[2] == got[3] > 4000


# -- classifiers ------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    p = language_id.predict(docs, model).toPandas()
    held = p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (p[held].lang == p[held].lang_pred).mean() > 0.95
    odd = language_id.predict(odd_docs.drop("score"), model).toPandas()
    assert set(odd[odd.doc_id.isin([2, 3, 6])].lang_pred) == {"und"} and set(odd[odd.doc_id == 5].score.round(9)).__len__() == 1
    assert language_id.identify(no_docs).count() == 0
    assert set(language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).limit(5).where("false")).columns) == {"doc_id", "held_out", "lang_pred", "score"}
    assert language_id.keep_identified(docs.limit(100)).columns == docs.columns


def test_scorer_equals_network():
    net = language_id.ByteConvNet(3)
    text = "the quick brown fox " * 7
    want = net.forward(language_id.training_window(text)[None])[0]
    assert np.abs(language_id.WindowScorer(net).score([text[:160], "x", ""])[0] - want).max() < 0.01


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteConvNet(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, language_id.WINDOW)), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.forward(x)[np.arange(4), y]).mean()
    g = net.gradients(x, y)
    for name in ("w", "f3", "e"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][i] += 1e-5
        up = loss()
        net.p[name][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[name][i]) < 1e-4
        net.p[name][i] += 1e-5


def test_quality_classifier(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = quality_classifier.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (p[p.held_out].predicted == p[p.held_out].quality).mean() > 0.95
    rows = quality_classifier.classify(odd_docs, labels).toPandas()
    assert len(rows) == 9 and rows.score.between(0, 1).all()
    assert quality_classifier.classify(no_docs, labels).count() == 0
    assert quality_classifier.classify(odd_docs, labels.where("false")).toPandas().score.nunique() == 1
    assert quality_classifier.keep_good(docs.limit(50), labels).columns == docs.columns


# -- pages ------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice"><p>We use cookies to make this work.</p></div>
<main><article><h1>A title</h1><p>First para with &lt;b&gt; and <a href="x">link text</a>.<p>Sec<b>ond</b>.<aside>Pull quote</aside><div class="ad-slot">Buy now</div><p>Third &amp;\n last<script>x="</p>"</script></article>
<section class="comments"><p>Nice one, I liked the whole thing.</p></section></main><form><label>Mail</label><button>Go</button></form><footer>c 2020</footer></body></html>"""


@pytest.mark.parametrize("page,text", [(PAGE, "A title First para with <b> and link text. Second. Third & last"), ("", ""), ("plain text only", "plain text only"), ("<p>unclosed", "unclosed"), ("<!-- never", ""), ("a < b", "a < b")])
def test_main_text(page, text):
    assert html_extract.main_text(page, html_extract.train()) == text


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a \"'> ", "<div>", "</div>", "<div></x>", "<![CDATA[", "<!", "<script ", "</script ", "<p class=ad>", "</b>", 'class=" ', "<", "&#", "<b id='nav' "])
def test_hostile_pages_take_linear_time(part):
    """A megabyte of a part that never closes, alone and around other text."""
    for page in (part * (1_000_000 // len(part)), "<p class=ad>" + part * (500_000 // len(part)) + "</x>" * 100_000 + ">"):
        start = time.perf_counter()
        html_extract.blocks_of(page)
        assert time.perf_counter() - start < 10


def test_sections_quotes_and_references():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert texts("a <![CDATA[x < y]]> b") == ["a x < y b"] and texts("<![CDATA[<p>x") == ["x"]
    assert texts("<p title='a > b'>x</p>") == ["x"] and texts("<p title='a>x</p>") == ["x"] and texts("2 < 3 and <") == ["2 < 3 and <"]
    assert texts("&#" + "0" * 6000 + "65; &#" + "9" * 6000 + "; &#x41;") == ["A \ufffd A"]
    assert texts("<script>a</script x</p><p>b") == ["b"] and texts("x<!-- y") == ["x"] and texts("<head>t<body>b") == ["b"]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 63), (2, 0), (2, 0)]
    assert html_extract.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("https://WWW.A.example.com/en/812?x", "www.a.example.com", "/en/812", "com/en/", "block"), ("http://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("http://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"), ("http://b.example.net/de/81#a", "b.example.net", "/de/81", "example.net/de/8", "block"), ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://a.b/c://d/e", "a.b", "/c://d/e", None, None),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, rule string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_trees():
    rows = url_filter.labelled_urls()
    f, m = url_filter.train(rows[:2400])
    assert ((m.predict(f.matrix([u for u, _ in rows[2400:]])) > 0.5) == np.array([y for _, y in rows[2400:]])).mean() > 0.85


# -- near-dedup -------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=16), st.integers(0, 10))
def test_banded_distance(a, b, most):
    assert tk.banded_distance(a, b, most) == min(edits(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.data())
def test_alike(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 5))):
        i = data.draw(st.integers(0, len(b)))
        b = data.draw(st.sampled_from([b[:i] + b[i + 1 :], b[:i] + [9] + b[i:], b[:i] + [8] + b[i + 1 :]]))
    if b:
        assert tk.alike(np.array(a), np.array(b), 0.8) == (edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def copies(rnd, words, share):
    return [w if rnd.random() > share else f"x{rnd.randrange(10**6)}" for w in words]


def test_near_dedup_finds_planted_copies(spark):
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    rows, group = [], {}
    passage = fresh(40)
    for g in range(25):
        base = fresh(rnd.randint(60, 300))
        for _ in range(rnd.randint(1, 4)):
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copies(rnd, base, 0.04))))
    big = fresh(120)
    for _ in range(60):
        group[len(rows)] = 99
        rows.append((len(rows), ", ".join(copies(rnd, big, 0.03)).upper()))
    for k in range(80):
        group[len(rows)] = 1000 + k
        rows.append((len(rows), " ".join(fresh(50) + passage + fresh(50))))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    firsts = {}
    for i, g in group.items():
        firsts.setdefault(g, i)
    assert got == {i: firsts[g] for i, g in group.items()}


def near_classes(texts):
    """The least index of each text's class, by comparing all pairs."""
    words = [tk.word_hashes(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for b in range(len(texts)):
        for a in range(b):
            u, v = sorted((find(a), find(b)))
            if u != v and tk.alike(words[a], words[b], 0.8):
                root[v] = u
    return {i: find(i) for i in range(len(texts))}


def test_near_dedup_hub_of_two_kinds(spark):
    """Versions with text in front and versions with text at the end are near the original only."""
    rnd = random.Random(11)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    base = fresh(100)
    texts = [" ".join(fresh(20) + base) for _ in range(150)] + [" ".join(base)] + [" ".join(base + fresh(20)) for _ in range(150)]
    want = near_classes(texts)
    assert set(want.values()) == {0}
    got = order_minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_near_dedup_joins_bags_once_a_document(spark, monkeypatch):
    """However many buckets and blocks a document is dealt to, it meets its bag and its words once."""
    rnd = random.Random(14)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    template = fresh(200)
    docs = spark.createDataFrame([(i, " ".join(template + fresh(60))) for i in range(60)], "doc_id long, text string")
    joined, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, on=None, how=None: ("bag" in other.columns and on == "id" and joined.append(self)) or join(self, other, on, how))
    assert order_minhash.near_dedup(docs).count() == 60
    assert len(joined) == 2
    for rows in joined:
        assert rows.count() == rows.select("id").distinct().count()
    assert joined[0].select("_places").first()["_places"]


def test_near_dedup_pairs_on_one_template(spark):
    """Near pairs that agree only in the k-mers of a template all texts are written on."""
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    template, texts = fresh(200), []
    for _ in range(40):
        own = fresh(60)
        texts += [" ".join(template + own), " ".join(template + [w if k % 3 else f"y{rnd.randrange(10**6)}" for k, w in enumerate(own)])]
    want = near_classes(texts)
    assert want == {i: i - i % 2 for i in range(80)}
    got = order_minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_near_dedup_recall_behind_a_shared_passage(spark):
    """All 60 texts share 60 of their 100 words; the versions change every fourth of the other 40."""
    rnd = random.Random(13)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for _ in range(30):
        own = fresh(40)
        texts += [" ".join(passage + own), " ".join(passage + [w if k % 4 else f"y{rnd.randrange(10**6)}" for k, w in enumerate(own)])]
    want = near_classes(texts)
    assert want == {i: i - i % 2 for i in range(60)}
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] in (i, want[i]) for i in got) and sum(got[i] == got[i + 1] for i in range(0, 60, 2)) >= 27


@pytest.mark.parametrize("spread", [False, True])
def test_sketches_reach_the_edits_accepted(spread):
    rnd = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        a = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = a.copy()
        at = np.arange(2, 200, 5) if spread else rnd.choice(200, 40, replace=False)
        b[at] = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
        assert tk.alike(a, b, order_minhash.LEAST)
        x, y = (tk.order_minhash(w, order_minhash.K, order_minhash.TAKE, order_minhash.SKETCHES) for w in (a, b))
        hits += bool((x == y).any())
    assert hits / 300 > (0.9 if spread else 0.99)


def test_near_dedup_odd_rows(odd_docs, no_docs):
    rows = order_minhash.near_dedup(odd_docs.select("doc_id", "text", "source")).collect()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == 9 and by[5] == 1 and by[3] == 2 and by[7] == 7 and by[6] == 6
    assert order_minhash.near_dedup(no_docs).count() == 0
    assert order_minhash.dedup_documents(odd_docs).columns == odd_docs.columns


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(find(n) == r for n, r in got.items()) and all(find(n) in (got.get(n, n),) for n in range(500))


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_stored_frames_take_texts_in_small_batches(spark):
    """Python gets a few MB of texts at a time where a frame is stored, however many rows that is."""
    docs = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = common.checkpointed(docs.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long"))
    most = sizes.agg(F.max("n"), F.sum("n")).first()
    assert most[1] == 2000 and most[0] * 10_000 <= 2 * 4 * 2**20


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == columns and 0 < after.count() <= before.count(), name
        before = after
    texts = pd.Series([r["text"] for r in before.collect()])
    assert texts.is_unique
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
