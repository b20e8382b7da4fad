"""The stored catalogue as a source, and the refresh from the command line."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylane import refresh
from quarrylane.operators.versions import Store
from quarrylane.sources import staging, stored
from test_refresh import put, rent, sale


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('db')}/catalogue.db"
    con = sqlite3.connect(path)
    con.executescript(
        """
        CREATE TABLE areas (id INTEGER PRIMARY KEY, name TEXT, dld_community_name_en TEXT, also_known_as TEXT, rating REAL);
        CREATE TABLE sub_communities (id INTEGER PRIMARY KEY, parent_area_id INTEGER, name TEXT);
        CREATE TABLE developers (id INTEGER PRIMARY KEY, name TEXT);
        CREATE TABLE developments (id INTEGER PRIMARY KEY, name TEXT, area_id INTEGER, developer_id INTEGER);
        CREATE TABLE buildings (id INTEGER PRIMARY KEY, development_id INTEGER, name TEXT);
        CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID;
        CREATE TABLE bare (id INTEGER PRIMARY KEY, ok BOOLEAN);
        INSERT INTO sub_communities VALUES (1, 1, 'JVC District 11');
        INSERT INTO developers VALUES (7, 'Azizi');
        INSERT INTO developments VALUES (10, 'Venice 1', 1, 7);
        INSERT INTO keyed VALUES ('a', 1), ('b', 2);
        """
    )
    con.executemany("INSERT INTO areas VALUES (?, ?, ?, ?, ?)", [(1, "JVC", None, None, 4.5), *((k, f"Area {k}", None, None, k / 2) for k in range(2, 1001))])
    con.execute("INSERT INTO areas VALUES (5000, 77, NULL, NULL, 'no number')")
    con.commit()
    con.close()
    return path


def test_tables_are_read_in_parallel(spark, database):
    areas = stored.read(spark, database, "areas", ranges=6)
    assert dict(areas.dtypes) == {"id": "bigint", "name": "string", "dld_community_name_en": "string", "also_known_as": "string", "rating": "double"}
    assert areas.rdd.getNumPartitions() == 6 and areas.count() == 1001
    assert areas.select(F.sum("id")).first()[0] == sum(range(1, 1001)) + 5000
    odd = areas.where("id = 5000").first()
    assert (odd["name"], odd["rating"]) == ("77", None)
    assert sorted(tuple(r) for r in stored.read(spark, database, "keyed").collect()) == [("a", 1), ("b", 2)]
    assert stored.read(spark, database, "bare").collect() == []
    with pytest.raises(Exception, match="no table"):
        stored.read(spark, database, "missing")


@pytest.mark.parametrize("where", ["id > 990", "id in (3, 4, 5000)", "name = '77'", "name like 'Area 99%'", "rating >= 499.5 and id < 2000", "rating is null", "name is not null and id = 7", "dld_community_name_en is null and id <= 2", "id = 3 or name = 'JVC'", "name > 'Area 998'"])
def test_filters_give_the_same_rows(spark, database, where):
    pushed = stored.read(spark, database, "areas").where(where)
    plain = spark.createDataFrame(stored.read(spark, database, "areas").collect(), "id long, name string, dld_community_name_en string, also_known_as string, rating double").where(where)
    assert sorted(r["id"] for r in pushed.collect()) == sorted(r["id"] for r in plain.collect()) != []


def test_filters_reach_the_database(spark, database):
    pushed = stored.read(spark, database, "areas").where("id > 990 and rating < 498")
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan stored_catalogue" in plan and "990" not in plan and "498" not in plan, plan  # only IS NOT NULL is left to Spark
    reader = stored.StoredReader("catalogue.db", "areas", stored.read(spark, database, "areas").schema, 4)
    assert list(reader.pushFilters([stored.GreaterThan(("id",), 998), stored.IsNull(("rating",))])) == [stored.IsNull(("rating",))]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [999, 1000, 5000]


def test_refresh_from_the_command_line(spark, database, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "s.csv", staging.SALES, [sale("2026-01-05 10:00:00"), sale("2026-01-06 10:00:00", "JVC District 11")])
    put(folder / "r.csv", staging.RENTALS, [rent("2026-03-01")])
    (folder / "odd.csv").write_text("x\n1\n")
    refresh.main(["--data-dir", str(folder), "--out", f"{tmp_path}/wh", "--catalogue", database])
    said = capsys.readouterr().out
    assert "s.csv (dld_sales): 2 rows" in said and "[unrecognised]" in said and "fact_sales: months 2026-01" in said and "version 1" in said
    snap = Store(spark, f"{tmp_path}/wh").snapshot()
    got = {r["canonical_key"]: r["community_key"] for r in snap.table("dim_area").where("dld_area_name is not null").collect()}
    assert got["jvc"] == got["jvc district 11"] == "s1"
