"""Resolution, warehouse, staging, incremental tables, trees, pages and streams on small inputs."""

import csv

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import normalize as nz
from quarrylane.operators import incremental as inc
from quarrylane.operators import pages as pg
from quarrylane.operators import medians, resolve, similarity, trees, warehouse
from quarrylane.operators.versions import Store
from quarrylane.sources import export, staging
from quarrylane.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_token_sort():
    assert round(similarity.token_sort_ratio("jumeirah villages circle", "jumeirah village circle"), 2) == 97.87
    assert similarity.token_sort_ratio("business", "business bay") == 80.0
    assert similarity.token_sort_ratio("b a", "a b") == 100.0


def test_match_cascade(spark):
    keys = frame(spark, [("jumeirah villages circle",), ("business",), ("exact one",), ("zzz",), ("forced",), ("denied",), ("",)], "key string")
    cands = frame(spark, [("jumeirah village circle", 1), ("business bay", 2), ("exact one", 3), ("denied", 4)], "key string, id long")
    over = frame(spark, [("forced", 9), ("denied", None)], "key string, id long")
    got = {r["key"]: (r["matched_id"], r["confidence"]) for r in resolve.match(keys, cands, over).collect()}
    assert got["jumeirah villages circle"] == (1, "fuzzy_high") and got["business"] == (None, "fuzzy_low") and got["exact one"] == (3, "exact")
    assert got["zzz"] == (None, "unmatched") and got["forced"] == (9, "exact") and got["denied"] == (None, "unmatched") and got[""] == (None, "unmatched")


def test_candidates_and_two_grains(spark):
    areas = frame(spark, [(1, "Jumeirah Village Circle", "Al Barsha South Fourth", "JVC, J V C")], "id long, name string, dld_community_name_en string, also_known_as string")
    subs = frame(spark, [(5, 1, "JVC District 11")], "id long, parent_area_id long, name string")
    got = {r["key"]: r["id"] for r in resolve.area_candidates(areas, subs).collect()}
    assert got == {k: 1 for k in ("jumeirah village circle", "al barsha south fourth", "jvc", "j v c", "jvc district 11")}
    devs, built = resolve.project_candidates(frame(spark, [(100, "Azizi Venice")], "id long, name string"), frame(spark, [(500, 100, "Venice Tower A")], "id long, development_id long, name string"))
    got = {r["key"]: (r["development_id"], r["building_id"]) for r in resolve.resolve_projects(frame(spark, [("venice tower a",), ("azizi venice",), ("nothing",)], "key string"), devs, built).collect()}
    assert got == {"venice tower a": (100, 500), "azizi venice": (100, None), "nothing": (None, None)}


def test_search(spark):
    c = frame(spark, [("azizi venice 12", "Azizi Venice 12", "building"), ("azizi venice", "Azizi Venice", "master"), ("venice 12 b", "Venice 12 B", "building"), ("palm", "Palm", "master")], "key string, name string, kind string")
    rows = resolve.rank_search("Venice 12", c).collect()
    assert [(r["name"], r["tier"]) for r in rows][:2] == [("Venice 12 B", 3), ("Azizi Venice 12", 4)]
    over = frame(spark, [("venice 12", "palm")], "key string, target string")
    assert resolve.rank_search("Venice 12", c, over).first()["name"] == "Palm"
    assert resolve.rank_search("v", c).count() == 0


def test_link_areas(spark):
    d = frame(spark, [(1, None, "JVC"), (2, None, "Barsha"), (3, 9, "JVC"), (4, None, "?")], "id long, area_id long, area_raw string")
    a = frame(spark, [(7, "JVC", None), (8, "X", "Barsha")], "id long, name string, dld_community_name_en string")
    assert {r["id"]: r["area_id"] for r in resolve.link_areas(d, a).collect()} == {1: 7, 2: 8, 3: 9, 4: None}


def sale(**kw):
    row = dict.fromkeys(staging.SALES.columns, "")
    return row | {"INSTANCE_DATE": "2026-07-01 16:00:21", "GROUP_EN": "Sales", "AREA_EN": "JVC", "TRANS_VALUE": "1000000", "ACTUAL_AREA": "100", "ROOMS_EN": "1 B/R", "PROJECT_EN": "Venice 1", "PROP_SB_TYPE_EN": "Flat"} | kw


def write_csv(path, columns, rows, bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        w = csv.DictWriter(f, columns, quoting=csv.QUOTE_ALL)
        w.writeheader()
        w.writerows(rows)


@pytest.fixture
def extracts(tmp_path):
    columns = list(staging.SALES.columns)
    write_csv(tmp_path / "a.csv", columns, [sale(), sale(), sale(TRANS_VALUE="abc", PARKING="NA", NEAREST_MALL_EN='two\nlines "q"'), sale(IS_OFFPLAN_EN="Off-Plan", ACTUAL_AREA="0", AREA_EN="jvc ")], bom=True)
    write_csv(tmp_path / "b.csv", columns[::-1], [sale(PROJECT_EN="Venice 2")])
    rent = dict.fromkeys(staging.RENTALS.columns, "") | {"REGISTRATION_DATE": "2026-07-02", "AREA_EN": "Marina", "ANNUAL_AMOUNT": "60000", "ROOMS": "3", "VERSION_EN": "Renewed", "PROJECT_EN": "Venice 1"}
    write_csv(tmp_path / "r.csv", list(staging.RENTALS.columns), [rent])
    write_csv(tmp_path / "odd.csv", ["x"], [{"x": "1"}])
    return tmp_path


def test_staging(spark, extracts, tmp_path_factory):
    known, unknown = staging.scan(spark, str(extracts))
    assert [d.name for _, d in known] == ["dld_sales", "dld_sales", "dld_rentals"] and len(unknown) == 1
    rows = staging.stage(spark, [p for p, d in known if d is staging.SALES], staging.SALES).collect()
    a = sorted((r for r in rows if r["source_file"].endswith("a.csv")), key=lambda r: r["row_num"])
    assert len(rows) == 5 and [r["row_num"] for r in a] == [0, 1, 2, 3] and a[2]["PARKING"] == "NA" and a[2]["NEAREST_MALL_EN"] == 'two\nlines "q"' and a[0]["PARKING"] is None
    out = str(tmp_path_factory.mktemp("tables"))
    assert staging.refresh(spark, str(extracts), out) == {"dld_sales": 5, "dld_rentals": 1}
    assert staging.refresh(spark, str(extracts), out) == {}
    write_csv(extracts / "b.csv", list(staging.SALES.columns), [sale(), sale()])
    assert staging.refresh(spark, str(extracts), out) == {"dld_sales": 2}
    assert Store(spark, out).table("stg_dld_sales").count() == 6
    with pytest.raises(ValueError):
        staging.import_file(spark, str(extracts / "odd.csv"), out)


def test_warehouse(spark, extracts, tmp_path_factory):
    sales = staging.stage(spark, [str(extracts / "a.csv"), str(extracts / "b.csv")], staging.SALES)
    rentals = staging.stage(spark, [str(extracts / "r.csv")], staging.RENTALS)
    catalogue = {
        "areas": frame(spark, [(1, "JVC", None, None), (2, "Palm", None, None)], "id long, name string, dld_community_name_en string, also_known_as string"),
        "developments": frame(spark, [(10, "Venice 1", 1, 7)], "id long, name string, area_id long, developer_id long"), "buildings": frame(spark, [], "id long, development_id long, name string"), "developers": frame(spark, [(7, "Azizi")], "id long, name string"),
    }
    tables = warehouse.build(sales, rentals, catalogue)
    area = {r["canonical_key"]: r for r in tables["dim_area"].collect()}
    assert area["jvc"]["community_key"] == "s1" and area["marina"]["community_key"].startswith("a") and area["palm"]["match_confidence"] == "scraped_only"
    s = tables["fact_sales"].collect()
    assert len(s) == 5 and len({r["sale_id"] for r in s}) == 5 and {r["area_id"] for r in s} == {area["jvc"]["area_id"]}
    assert sum(r["trans_value_aed"] is None for r in s) == 1 and sum(r["price_per_sqft_aed"] is None for r in s) == 2 and sum(r["is_offplan"] for r in s) == 1
    r = tables["fact_rentals"].first()
    assert r["is_renewal"] and r["canonical_bedroom"] == "3BR" and r["total_properties"] == 0
    m = tables["dim_master_project"].collect()
    assert len(m) == 1 and m[0]["building_count"] == 2 and m[0]["developer_name"] == "Azizi" and m[0]["area_name"] == "JVC" and not m[0]["needs_review"]
    counts = warehouse.write_all(tables, str(tmp_path_factory.mktemp("wh")))
    assert counts["fact_sales"] == 5 and counts["dim_project"] == 2


DEV = "url string, name string, raw_status string, total_units int"


def test_merge_and_log(spark):
    old = frame(spark, [("u1", "A", "Under development", 100), ("u2", "B", "Complete", 491)], DEV)
    new = frame(spark, [("u1", "A", " Complete ", 250), ("u2", "B", "Complete", None), ("u3", "C", None, None)], DEV)
    got = {r["url"]: (r["raw_status"], r["total_units"]) for r in inc.merge(old, new, ["url"]).collect()}
    assert got["u2"] == ("Complete", 491) and got["u1"][1] == 250 and "u3" in got
    log = {(r["entity_key"], r["field_name"], r["old_value"], r["new_value"], r["change_kind"]) for r in inc.change_log(old, new, "url", ("raw_status", "total_units"), "development").collect()}
    assert log == {("u1", "raw_status", "Under development", "Complete", "field_changed"), ("u1", "total_units", "100", "250", "field_changed"), ("u3", None, None, None, "new_record")}
    assert inc.change_log(old, old, "url", ("raw_status",), "d").count() == 0


def test_null_keys_do_not_repeat(spark):
    rows = frame(spark, [(1, None, "x")], "development_id long, area_id long, label string")
    assert inc.merge(rows, rows, ["development_id", "area_id"]).count() == 1
    assert inc.insert_absent(rows, rows.unionByName(rows), ["development_id", "area_id", "label"]).count() == 1


def test_disappearance_and_stubs(spark):
    stored = frame(spark, [("u1", "A", "Planned", "planned", False, True), ("u2", "B", None, None, True, False)], "url string, name string, raw_status string, normalized_status string, is_stub boolean, is_active boolean")
    out, log = inc.disappeared(stored, frame(spark, [("u2",)], "url string"), "url", "development")
    assert {r["url"]: r["is_active"] for r in out.collect()} == {"u1": False, "u2": False} and log.count() == 1
    got = {r["url"]: r for r in inc.add_stubs(stored, frame(spark, [("u1", "A", None), ("u2", "B", "Complete"), ("u3", "C", "Announced")], "url string, name string, raw_status string"), nz.status("raw_status")).collect()}
    assert not got["u1"]["is_stub"] and got["u2"]["is_active"] and got["u2"]["normalized_status"] == "completed" and got["u3"]["is_stub"] and got["u3"]["normalized_status"] == "announced"


def test_queue(spark):
    queue = frame(spark, [(1, "a", "done", 0, None, 1)], "job_id int, url string, status string, depth int, discovered_from string, attempts int")
    q = inc.enqueue(queue, frame(spark, [(1, "a", 1, None), (1, "b", 2, "a"), (1, "b", 1, "c")], "job_id int, url string, depth int, discovered_from string"))
    assert q.count() == 2 and inc.next_pending(q, 1).first()["url"] == "b"
    q = inc.mark(q, frame(spark, [(1, "b", "in_progress")], "job_id int, url string, new_status string"))
    assert {r["status"]: r["n"] for r in inc.queue_counts(q, 1).collect()} == {"done": 1, "in_progress": 1}


def test_tree(spark):
    nodes = frame(spark, [("a", "JVC", None), ("b", "District 11", "JVC"), ("c", "X", "Y"), ("d", "Y", "X")], "id string, name string, parent_name string")
    items = frame(spark, [("b",), ("b",), ("c",)], "area_id string")
    assert {r["id"]: r["n"] for r in trees.subtree_counts(nodes, items, "area_id").collect()} == {"a": 2, "b": 2, "c": 1, "d": 1}
    assert {tuple(r) for r in trees.closure(nodes).collect()} == {tuple(r) for r in trees.closure_recursive(spark, nodes).collect()}


AREA = """<a href="/dubai/area-guides">Area Guides</a><h1>JVC</h1><img alt=" jvc " src="/i.png"><div class="font-bold">Area</div><div>Dubai</div>
<div class="relative"><div class="zena-expander"><span class="price-val" data-orig="1,100,000"></span></div><div class="text-gray-500">Date</div><div>31st Jul 2026</div><div class="text-gray-500">No. of Buyers</div><div>2</div></div>
<a class="group" href="/dubai/jvc-11"><div class="font-bold">District 11</div><span class="material-icons">x</span> Complete</a>
<div class="ps-3-col-block"><h2 class="ps-crosshead">Transport &amp; Access</h2></div><div class="ps-3-col-block"><div class="ps-prose"><div class="ps-h3">By car</div><p>22 minutes to <a href="/dubai/mall">Dubai Mall</a>.</p></div></div>
<p>There are currently 886 building developments, 456 are complete and two are either on-hold</p>"""
DEVELOPMENT = """<a href="/dubai/buildings">Building Guides</a><h1>Tower</h1><div class="font-bold leading-snug">Status</div><div>Under development</div><div class="font-bold">Units</div><div>a total of 491 units.</div>
<div class="font-bold">The developer</div><div><a href="/d/azizi">Azizi</a></div><div class="border rounded-xl"><div class="font-medium mb-4">Tower Milestones</div><div class="grid-cols-2"><div>Started</div><div>June 2015</div></div></div>
<div class="font-bold">Project value</div><div>AED 203,168,000 (USD 55.3m)</div>"""


def test_pages(spark):
    area = frame(spark, [("https://s.example/dubai/jvc", AREA)], "url string, html string")
    r = pg.areas(area).first()
    assert (r["kind"], r["name"], r["dev_total"], r["dev_completed"], r["dev_on_hold"], r["hero_image_url"]) == ("area", "JVC", 886, 456, 2, "https://s.example/i.png")
    t = pg.typed_transactions(area).first()
    assert t["price_aed"] == 1100000.0 and str(t["transaction_date"]) == "2026-07-31" and t["buyers"] == 2
    page = pg.extract(area, "area").first()["page"]
    assert [(x["name"], x["raw_status"]) for x in page["sub_communities"]] == [("District 11", "Complete")]
    assert [(x["name"], x["section"]) for x in page["mentioned_places"]] == [("Dubai Mall", "By car")]
    dev = frame(spark, [("https://s.example/dubai/tower", DEVELOPMENT), ("u", None)], "url string, html string")
    d = {r["url"]: r for r in pg.developments(dev).collect()}["https://s.example/dubai/tower"]
    assert (d["kind"], d["normalized_status"], d["total_units"], d["project_value_usd"]) == ("development", "under_construction", 491, 55300000.0)
    assert pg.dated(dev).first()["date"] == "2015-06"
    assert pg.listing(area, "schools").count() == 0 and pg.links(area).count() == 3


def test_exports(spark, tmp_path):
    areas = frame(spark, [(1, "A"), (2, "B")], "id long, name string")
    devs = frame(spark, [(10, 1, "T")], "id long, area_id long, name string")
    built = frame(spark, [(5, 10, "T1"), (6, 10, "T0")], "id long, development_id long, name string")
    rows = {r["id"]: r["json"] for r in export.combined(areas, devs, {"buildings": built}, {}).collect()}
    assert '"buildings":[{"id":5' in rows[1] and '"developments":[]' in rows[2]
    assert export.export_csv({"areas": areas, "other": devs}, str(tmp_path)) == ["areas"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/areas_csv").count() == 2


def test_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read(spark, str(tmp_path / "in")), late="1000 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_fuzzy_match_query_against_brute_force(spark):
    """The registered query over the whole table: every key's score is that of its best candidate, or NULL below 75."""
    from quarrylane.plans import registry

    d = "/root/testdata/sf0.001"
    names = {r[0] for r in spark.read.parquet(f"{d}/part.parquet").select(nz.canonical_key("p_name")).distinct().collect()}
    rows = registry.QUERIES["fuzzy_match"](spark, d).collect()
    assert len(rows) == len({r["key"] for r in rows}) > 10
    for r in rows:
        best = 100.0 if r["key"] in names else max(similarity.token_sort_ratio(r["key"], x) for x in names)
        assert r["score"] is None if best < 75 else abs(r["score"] - best) < 1e-9
        assert r["confidence"] == ("exact" if r["key"] in names else "fuzzy_high" if best >= 90 else "fuzzy_low" if best >= 75 else "unmatched")


def test_exact_medians_of_null_keys_and_missing_values(spark):
    rows = spark.createDataFrame(
        [(None, 1.0, None), (None, 4.0, None), ("a", 3.0, 7.0), ("a", 3.0, None), ("a", 9.0, 8.0), ("b", None, None)], "k string, v double, w double"
    )
    values = {"mv": F.col("v"), "mw": F.col("w")}
    got = {r["k"]: (r["mv"], r["mw"]) for r in medians.exact_medians(rows, ["k"], values).collect()}
    assert got == {None: (2.5, None), "a": (3.0, 7.5)}
    whole = medians.with_medians(rows.agg(F.count("*").alias("n")), rows, [], values).first()
    assert (whole["n"], whole["mv"], whole["mw"]) == (6, 3.0, 7.5)
    groups = medians.with_medians(rows.groupBy("k").agg(F.count("*").alias("n")), rows, ["k"], values)
    assert {r["k"]: (r["n"], r["mv"]) for r in groups.collect()} == {None: (2, 2.5), "a": (3, 3.0), "b": (1, None)}
    assert medians.with_medians(rows.limit(0).agg(F.count("*").alias("n")), rows.limit(0), [], values).first()["mv"] is None
    many = spark.range(200001).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(100000)).cast("double").alias("v"))
    assert medians.exact_median(many, ["k"], "v").first()["median"] == many.agg(F.median("v")).first()[0]
