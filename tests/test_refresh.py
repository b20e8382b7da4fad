"""The incremental warehouse against whole builds."""

import csv
import os

import pytest

from quarrylane.operators import warehouse
from quarrylane.operators.versions import Store
from quarrylane.sources import staging

NAMES = {"fact_sales": "sale_id", "fact_rentals": "rental_id"}


def put(path, dataset, rows):
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(dataset.columns))
        w.writeheader()
        w.writerows([dict.fromkeys(dataset.columns, "") | r for r in rows])


def sale(day, area="JVC", project="Venice 1", value="1000000", **more):
    return {"INSTANCE_DATE": day, "GROUP_EN": "Sales", "AREA_EN": area, "PROJECT_EN": project, "TRANS_VALUE": value, "ACTUAL_AREA": "100", "PROP_SB_TYPE_EN": "Flat", "ROOMS_EN": "1 B/R", **more}


def rent(day, area="Marina", project="Marina Gate", **more):
    return {"REGISTRATION_DATE": day, "AREA_EN": area, "PROJECT_EN": project, "ANNUAL_AMOUNT": "60000", "ROOMS": "2", "VERSION_EN": "New", **more}


@pytest.fixture
def catalogue(spark):
    make = spark.createDataFrame
    return {
        "areas": make([(1, "JVC", None, "Jumeirah Village Circle"), (2, "Palm", None, None)], "id long, name string, dld_community_name_en string, also_known_as string"),
        "developments": make([(10, "Venice 1", 1, 7), (11, "Marina Gate", 2, 8)], "id long, name string, area_id long, developer_id long"),
        "buildings": make([(100, 11, "Marina Gate Tower A")], "id long, development_id long, name string"), "developers": make([(7, "Azizi"), (8, "Select")], "id long, name string"),
    }


@pytest.fixture
def extracts(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "jan.csv", staging.SALES, [sale("2026-01-05 10:00:00"), sale("2026-01-20 10:00:00", "Business Bay", "Bay Tower 2"), sale("2026-02-01 09:00:00")])
    put(folder / "feb.csv", staging.SALES, [sale("2026-02-11 10:00:00", "Marina"), sale("not a day", "Palm Jumeirah", None)])
    put(folder / "rents.csv", staging.RENTALS, [rent("2026-03-01"), rent("2026-04-01", "jvc ", "Marina Gates")])
    (folder / "odd.csv").write_text("x,y\n1,2\n")
    return folder


def content(snap):
    """All tables with ids replaced by the names they stand for."""
    areas = {r["area_id"]: (r["canonical_key"], r["scraped_area_id"]) for r in snap.table("dim_area").collect()}
    masters = {r["master_project_id"]: r["canonical_key"] for r in snap.table("dim_master_project").collect()}
    projects = {r["project_id"]: r["canonical_key"] for r in snap.table("dim_project").collect()}
    swap = {"area_id": areas, "project_id": projects, "master_project_id": masters}
    assert all(len(set(x.values())) == len(x) for x in swap.values())
    out = {}
    for name in (*NAMES, "dim_area", "dim_project", "dim_master_project"):
        rows = []
        for r in snap.table(name).collect():
            d = {k: (swap[k].get(v) if k in swap else v) for k, v in r.asDict().items() if k not in ("imported_at", "slug", "building_slug")}
            if (d.get("community_key") or "").startswith("a"):
                d["community_key"] = "a"
            rows.append(str(sorted(d.items())))
        out[name] = sorted(rows)
    return out


def whole(spark, extracts, tmp_path, catalogue, overrides=None):
    out = f"{tmp_path}/whole-{len(os.listdir(tmp_path))}"
    warehouse.refresh(spark, str(extracts), out, catalogue, overrides)
    return content(Store(spark, out).snapshot())


def ids(snap):
    return {name: {r["canonical_key"]: r[key] for r in snap.table(name).where("canonical_key is not null").collect()} for name, key in (("dim_project", "project_id"), ("dim_master_project", "master_project_id"))} | {
        "dim_area": {(r["canonical_key"], r["match_confidence"] == "scraped_only"): r["area_id"] for r in snap.table("dim_area").collect()}}


def test_refresh_writes_what_is_touched_and_equals_a_whole_build(spark, extracts, catalogue, tmp_path):
    out = f"{tmp_path}/store"
    first = warehouse.refresh(spark, str(extracts), out, catalogue)
    assert first["version"] == 1 and first["rows"]["fact_sales"] == 5 and first["rows"]["fact_rentals"] == 2
    assert first["months"] == {"fact_sales": ["2026-01", "2026-02", "null"], "fact_rentals": ["2026-03", "2026-04"]} and len(first["unrecognised"]) == 1
    store = Store(spark, out)
    one = store.snapshot()
    assert warehouse.refresh(spark, str(extracts), out, catalogue)["version"] == 1

    # a changed file: a row moves from february to may, a new project before all others in the alphabet; a new file; a month without rows
    put(extracts / "feb.csv", staging.SALES, [sale("2026-05-11 10:00:00", "Marina", "Aaa Residence"), sale("not a day", "Palm Jumeirah", None)])
    put(extracts / "jun.csv", staging.SALES, [sale("2026-05-30 10:00:00", "Al Barsha", "Zzz House", "77")])
    put(extracts / "rents.csv", staging.RENTALS, [rent("2026-04-01", "jvc ", "Marina Gates")])
    # a refresh that fails half way leaves the first version as it was, and nothing of its own
    before, folders = content(one), store.files.names("data")
    with pytest.raises(KeyError):
        warehouse.refresh(spark, str(extracts), out, {k: v for k, v in catalogue.items() if k != "developers"})
    assert store.snapshot().version == 1 and content(store.snapshot()) == before and store.files.names("data") == folders

    second = warehouse.refresh(spark, str(extracts), out, catalogue)
    two = store.snapshot()
    assert second["version"] == 2 and sorted(x["rows"] for x in second["staged"].values()) == [1, 1, 2]
    assert second["months"] == {"fact_sales": ["2026-02", "2026-05", "null"], "fact_rentals": ["2026-03", "2026-04"]}
    same = lambda name, m: one.tables[name]["folders"].get(m) == two.tables[name]["folders"].get(m)
    assert same("fact_sales", "2026-01") and not same("fact_sales", "2026-02") and two.parts("fact_rentals") == ["2026-04"]
    assert content(two) == whole(spark, extracts, tmp_path, catalogue)
    was, now = ids(one), ids(two)
    for name in was:
        kept = {k: v for k, v in was[name].items() if k in now[name]}
        assert kept == {k: now[name][k] for k in kept} and len(kept) >= 2
    assert now["dim_project"]["aaa residence"] > max(was["dim_project"].values())
    # readers of the first version still read it
    assert content(one) == before and one.table("fact_sales").count() == 5


def test_refresh_after_a_change_of_the_catalogue(spark, extracts, catalogue, tmp_path):
    """All names are matched again; ids stay and no fact is written."""
    out = f"{tmp_path}/store"
    warehouse.refresh(spark, str(extracts), out, catalogue)
    store = Store(spark, out)
    one = store.snapshot()
    more = catalogue | {"areas": catalogue["areas"].unionByName(spark.createDataFrame([(3, "Business Bay", None, None), (4, "Creek", None, None)], catalogue["areas"].schema))}
    over = {"project": spark.createDataFrame([("bay tower 2", 11)], "key string, id long")}
    got = warehouse.refresh(spark, str(extracts), out, more, over)
    two = store.snapshot()
    assert got["version"] == 2 and got["staged"] == {} and got["months"] == {"fact_sales": [], "fact_rentals": []}
    assert one.tables["fact_sales"] == two.tables["fact_sales"] and content(two) == whole(spark, extracts, tmp_path, more, over)
    assert {r["canonical_key"]: r["community_key"] for r in two.table("dim_area").collect()}["business bay"] == "s3"
    assert ids(one)["dim_project"] == ids(two)["dim_project"]
