"""Table versions and numbering."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrylane.operators import ranks
from quarrylane.operators.versions import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def put(store, name, df):
    with store.write() as tx:
        return tx.replace(name, df)


def test_readers_keep_their_version(spark, store):
    assert store.snapshot().version == 0 and "t" not in store.snapshot()
    assert put(store, "t", spark.range(5)) == 5
    held = store.snapshot()
    lazy = held.table("t")
    assert put(store, "t", spark.range(7)) == 7
    assert lazy.count() == 5 and held.table("t").count() == 5 and store.table("t").count() == 7
    assert store.snapshot(1).table("t").count() == 5 and store.snapshot().rows("t") == 7


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark, store):
    put(store, "t", spark.range(5))
    put(store, "t", store.table("t").withColumn("id", F.col("id") * 2))
    assert sorted(r[0] for r in store.table("t").collect()) == [0, 2, 4, 6, 8]


def test_a_failing_write_is_not_seen_and_leaves_nothing(spark, store):
    """The second of two tables breaks half way through its rows: neither of the new ones is ever seen."""
    with store.write() as tx:
        tx.replace("a", spark.range(10))
        tx.replace("b", spark.range(10))
    folders = store.files.names("data")
    breaks = spark.range(0, 100_000, 1, 8).withColumn("id", F.when(F.col("id") == 99_000, F.raise_error(F.lit("half way")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException), store.write() as tx:
        tx.replace("a", spark.range(99))
        tx.replace("b", breaks)
    assert store.snapshot().version == 1 and store.table("a").count() == 10 and store.table("b").count() == 10
    assert store.files.names("data") == folders and store.files.names("drafts") == []


def test_a_killed_write_is_not_seen_and_goes_by_age(spark, store):
    put(store, "t", spark.range(3))
    spark.range(9).write.parquet(f"{store.root}/data/t-left")
    store.files.create("drafts/half.json", '{"version": 2, "tab')
    assert store.table("t").count() == 3
    assert store.expire(older_than=3600) == [] and any(n == "t-left" for n, _ in store.files.names("data"))
    assert store.expire(older_than=-60) == []
    assert [n for n, _ in store.files.names("data") if "left" in n] == [] == store.files.names("drafts") and store.table("t").count() == 3


def test_the_second_of_two_writers_fails(spark, store):
    put(store, "t", spark.range(1))
    with pytest.raises(Conflict), store.write() as tx:
        tx.replace("t", spark.range(2))
        put(store, "t", spark.range(3))
    assert store.table("t").count() == 3 and store.snapshot().version == 2 and len(store.files.names("data")) == 2


def test_old_versions_go_by_age(spark, store):
    for n in (1, 2, 3):
        put(store, "t", spark.range(n))
    assert store.expire(older_than=-60, keep=2) == [1]
    assert store.snapshot(2).table("t").count() == 2 and store.table("t").count() == 3 and len(store.files.names("data")) == 2
    assert store.expire(older_than=3600) == []


def test_partitions(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), "m string, v int")
    with store.write() as tx:
        assert tx.replace_parts("f", rows(("2026-01", 1), ("2026-02", 2), (None, 3), ("a/b=c", 4)), "m") == 4
    before = store.snapshot()
    assert before.parts("f") == ["2026-01", "2026-02", "a/b=c", "null"]
    with store.write() as tx:
        tx.replace_parts("f", rows(("2026-02", 20), ("2026-03", 30)), "m", clear=["2026-01", "null"])
    after = store.snapshot()
    assert sorted((r["m"], r["v"]) for r in after.table("f").collect()) == [("2026-02", 20), ("2026-03", 30), ("a/b=c", 4)] and after.rows("f") == 3
    assert after.tables["f"]["folders"]["a/b=c"] == before.tables["f"]["folders"]["a/b=c"]
    assert [r["v"] for r in after.table("f", ["2026-03"]).collect()] == [30]
    with store.write() as tx:
        tx.replace_parts("f", rows(("x", 1)), "m", whole=True)
    assert store.snapshot().parts("f") == ["x"] and before.table("f").count() == 4
    with store.write() as tx:
        tx.replace_parts("f", rows(), "m", clear=["x"])
    assert store.table("f").count() == 0 and store.table("f").columns == ["m", "v"]


def test_numbers_in_order_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", 7)
    df = spark.range(100).select(F.sha1(F.col("id").cast("string")).alias("k")).repartition(5)
    out = ranks.numbered(df, "k", "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert [(r["n"]) for r in sorted(out.collect(), key=lambda r: r["k"])] == list(range(1, 101))
    assert sorted(r["n"] for r in ranks.numbered(spark.createDataFrame([(None,), ("a",), ("a",), ("a",)], "k string"), "k", "n", 10).collect()) == [11, 12, 13, 14]
    assert ranks.numbered(df.limit(0), "k", "n").collect() == []


def test_known_keys_keep_their_numbers(spark):
    known = spark.createDataFrame([("b", 1), ("x", 5)], "k string, n long")
    got = {r["k"]: r["n"] for r in ranks.kept(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", "n", known).collect()}
    assert got == {"b": 1, "a": 6, "c": 7}
