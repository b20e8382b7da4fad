"""Line dedup, fingerprints and quality rules against brute force and DuckDB."""

import glob
import hashlib
import os
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import common, line_dedup, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(n) for n in names]
    assert names == sorted(df.columns)
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(18, 40))).strip() or "q" for _ in range(12)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(4):
            x = rnd.choice(base)
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(x))
                x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + rnd.choice("abcd") + x[i:], x[:i] + rnd.choice("abcd") + x[i + 1 :]])
            lines.append(rnd.choice(["", "  "]) + x)
        texts.append("\n".join(lines + [""]))
    seen, want = [], {}
    for k, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            x = line.strip(" \t\x0b\x0c\r")
            if x == "":
                kept.append(line)
                continue
            near = any(x == y or (len(x) >= 20 and len(y) >= 20 and abs(len(x) - len(y)) <= 1 and edit(x, y) == 1) for y in seen)
            if not near:
                kept.append(line)
            seen.append(x)
        want[k] = "\n".join(kept)
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_stored_frames_leave_no_shuffle_files(spark, tmp_path):
    """What is stored at once has no use for the shuffle files it came from; the settings are as they were."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for f in manager.getAllFiles().mkString("\n").split("\n") if (name := f.rpartition("/")[2]).startswith("shuffle_")}
    old, before = files(), {k: spark.conf.get(k, None) for k in common.STORING}
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = common.checkpointed(frame)
    again = common.written(frame, "cleanup")
    assert {k: spark.conf.get(k, None) for k in common.STORING} == before
    for _ in range(50):
        if not files() - old:
            break
        time.sleep(0.2)
    assert not files() - old
    assert sorted(stored.collect()) == sorted(again.collect()) == sorted(frame.collect())


def test_line_dedup_odd_rows(odd_docs, no_docs):
    rows = line_dedup.dedup(odd_docs).collect()
    assert len(rows) == 9 and {r["text"] for r in rows if r["doc_id"] == 2} == {None}
    assert [r["n_kept"] for r in rows if r["doc_id"] == 5] == [0, 0] and [r["text"] for r in rows if r["doc_id"] == 1] == ["a short text here"]
    kept = line_dedup.dedup_documents(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, None}
    assert line_dedup.dedup(no_docs).count() == 0


def test_fingerprints_edited_and_next(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, after = r["text"], rows[(k + 1) % len(rows)]["text"]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and (edited != text or g["near_edited"] == 1.0)
    same = {}
    for r in rows:
        same.setdefault(r["text"], set()).add(got[r["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert sum(g["near_edited"] for g in got.values()) / len(got) > 0.6 > 0.3 > sum(g["near_next"] for g in got.values()) / len(got)


def test_ranges_hold_with_an_outlier_and_a_hot_id(spark):
    """One far id does not gather all others in a range, and an id of a third of all rows is spread; next rows stay right."""
    ids = [*range(2000), 10**15, *[None] * 1000]
    df = spark.createDataFrame([(d, f"text {k} of many") for k, d in enumerate(ids)], "doc_id long, text string")
    keyed = df.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_at"), F.xxhash64("text").alias("_tie"))
    order = [r["text"] for r in sorted(keyed.collect(), key=lambda r: (r["_at"], r["_tie"]))]
    rows = simhash.with_next(df).where("not _ghost").collect()
    assert {r["text"]: r["_next"] for r in rows} == dict(zip(order, order[1:] + order[:1], strict=True)) and len(rows) == len(ids)
    sizes = Counter(r["_range"] for r in rows)
    assert len(sizes) > 20 and max(sizes.values()) < 400
    assert len({r["_range"] for r in rows if r["doc_id"] is None}) > 5


def test_votes(spark):
    """Every bit is the majority over the terms, with the terms of the whole text."""
    text = " ".join(f"w{i % 13}" for i in range(40))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    terms = df.select(F.explode(simhash.term_hashes(F.col("text"))).alias("h")).select("h", F.xxhash64("h", F.lit(1)).alias("g")).collect()
    f = simhash.fingerprints(df, ["k"]).first()
    for word, column in (("f1", "h"), ("f2", "g")):
        bits = sum(1 << j for j in range(64) if 2 * sum((t[column] >> j) & 1 for t in terms) > len(terms))
        assert f[word] % (1 << 64) == bits


def test_block_tables_find_all(spark):
    rnd = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre, rows = rnd.getrandbits(128), []
    for _ in range(60):
        x = centre
        for b in rnd.sample(range(128), rnd.randint(0, 7)):
            x ^= 1 << b
        rows.append((signed(x >> 64), signed(x & ((1 << 64) - 1))))
    df = spark.createDataFrame(rows, "f1 long, f2 long")
    got = {tuple(r)[:4] for r in simhash.within_radius(df, df, 4).collect()}
    bits = lambda a, b: sum(bin((x ^ y) % (1 << 64)).count("1") for x, y in zip(a, b, strict=True))
    assert got == {(*a, *b) for a in set(rows) for b in set(rows) if 1 <= bits(a, b) <= 4}


def test_fingerprints_odd_rows(odd_docs, no_docs, spark):
    rows = simhash.fingerprint_documents(odd_docs).collect()
    assert len(rows) == 9 and len({r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert simhash.fingerprint_documents(no_docs).count() == 0
    one = simhash.fingerprint_documents(spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_quality_rules_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in quality_rules.judge(odd_docs).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[4]["n_words"] == 60_000 and rows[4]["n_repeat_words"] == 60_000 and rows[4]["base_failed"]
    assert quality_rules.judge(no_docs).count() == 0
    assert quality_rules.filter_documents(odd_docs).columns == odd_docs.columns


def test_cascade_order_changes_nothing(docs):
    names = list(quality_rules.RULES)
    a = quality_rules.judge(docs, order=names).drop("reject_rule")
    b = quality_rules.judge(docs, order=names[::-1]).drop("reject_rule")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(quality_rules.cascade_order(docs)) == sorted(names)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_document_fingerprints", "op4_quality_rules"])
def test_no_python_in_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
