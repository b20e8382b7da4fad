"""Queries of the page extractors over pages of each kind, written from the rows of ``part``, with SQL for the expected records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import vocabulary as v
from quarrylane.operators import pages as pg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SITE = "https://site.example"
HOME = SITE + v.PATH_PREFIX


#: So many pages are written and read by a task.
PAGES = 2000


def dealt(part: DataFrame) -> DataFrame:
    """The rows over as many tasks as their pages need: a page is fifty times as large as its row, so splits of the table hold too many."""
    return part.repartition(-(-part.count() // PAGES) or 1)


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: run(dealt(spark.read.parquet(f"{d}/part.parquet")))
    ORACLES[name] = sql


def filled(template: str) -> Column:
    """The template with <<column>> replaced by the row's values."""
    parts = template.split("<<")
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        column, rest = part.split(">>", 1)
        out += [F.col(column).cast("string"), F.lit(rest)]
    return F.concat(*out)


def pages(part: DataFrame, template: str, last: str = "") -> DataFrame:
    rows = part.withColumn("month", F.element_at(F.array(*map(F.lit, v.MONTH_NAMES)), F.pmod("p_partkey", F.lit(12)).cast("int") + 1))
    rows = rows.withColumn("status", F.element_at(F.array(F.lit("Complete"), F.lit("Under development"), F.lit("Planned")), F.pmod("p_partkey", F.lit(3)).cast("int") + 1))
    return rows.select(F.concat(F.lit(HOME + "p"), F.col("p_partkey").cast("string"), F.lit(last)).alias("url"), filled(template).alias("html"))


URL = f"'{HOME}p' || p_partkey"
MONTH = "[" + ", ".join(f"'{m}'" for m in v.MONTH_NAMES) + "][p_partkey % 12 + 1]"
TWO = "lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0')"
STATUS = "['Complete', 'Under development', 'Planned'][p_partkey % 3 + 1]"
NORMAL = "['completed', 'under_construction', 'planned'][p_partkey % 3 + 1]"

# -- kinds of pages ---------------------------------------------------------------------------------------------------
CRUMBS = {
    0: f'<a href="{v.PATH_PREFIX}{v.AREA_INDEX}">Area Guides</a><h1>x</h1>', 1: f'<a href="{SITE}{v.PATH_PREFIX}buildings">Dubai Building Guides</a>', 2: "<p>Complete list of <b>Dubai's</b>\n geographical areas</p>",
    3: f'<a href="{v.PATH_PREFIX}{v.AREA_INDEX}">Guides</a>', 4: None,
}


def _kinds(part: DataFrame) -> DataFrame:
    n = F.pmod("p_partkey", F.lit(6))
    html = F.lit(None).cast("string")
    for k, text in CRUMBS.items():
        html = F.when(n == k, F.lit(text)).otherwise(html)
    url = F.when(n == 5, F.concat(F.lit(HOME + "p"), "p_partkey", F.lit("/"), F.element_at(F.array(*map(F.lit, v.AREA_PAGES)), F.pmod(F.floor(F.col("p_partkey") / 6), F.lit(4)).cast("int") + 1))).otherwise(F.concat(F.lit(HOME + "p"), "p_partkey"))
    return pg.kinds(part.select(url.alias("url"), html.alias("html"))).select("url", "kind")


_supporting = "[" + ", ".join(f"'{x}'" for x in v.AREA_PAGES) + "][p_partkey // 6 % 4 + 1]"
add("site_page_kinds", _kinds, f"SELECT {URL} || CASE WHEN p_partkey % 6 = 5 THEN '/' || {_supporting} ELSE '' END AS url, CASE WHEN p_partkey % 6 = 5 THEN {_supporting} ELSE ['area', 'development', 'area_index', 'unknown', 'unknown'][p_partkey % 6 + 1] END AS kind FROM part")

# -- a development's page ---------------------------------------------------------------------------------------------
DEVELOPMENT = f"""<html><body><a href="{v.PATH_PREFIX}buildings">Building Guides</a>
<main><h1> <<p_name>>  <b><<p_partkey>></b></h1><img alt="other" src="/o.png"><img alt="<<p_name>> <<p_partkey>>" src="/img/<<p_partkey>>.jpg">
<div class="x"><div class="font-bold leading-snug">Status</div><span>-</span><div><<status>></div></div>
<div><div class="font-bold leading-snug">Building type</div><div>Multi-building &amp; mall</div></div>
<div><div class="leading-snug font-bold other">Storeys</div><div>G + <<p_size>></div></div>
<div><div class="font-bold">Area</div><div> Zone <<p_size>> </div></div>
<div><div class="font-bold">The developer</div><div><a href="/dubai/dev/<<p_size>>"><<p_brand>></a></div></div>
<div><div class="font-bold">The architect</div><div><a href="{SITE}/dubai/arch/1">Arch &amp; Co</a>, <a href="arch-2">Second</a></div></div>
<div><div class="font-bold">Units</div><div>A total of 1,<<p_partkey>> units</div></div>
<div><div class="font-bold">Overview</div><div><<p_type>>
 text</div></div>
<div><div class="font-bold">Sub-buildings</div><div><a href="/dubai/p<<p_partkey>>-a">Tower A</a><a href="/dubai/p<<p_partkey>>-b"> Tower  B </a></div></div>
<div><div>Website</div><div><a href="http://www.p<<p_partkey>>.example/">site</a></div></div><div><div>Plot</div><div>On plot JV-<<p_partkey>> east</div></div>
<div class="border rounded-xl p"><div class="font-medium mb-4"><<p_name>> Milestones</div><div class="grid-cols-2 g"><div>Launch</div><div><<month>> 2019</div></div><div class="grid-cols-2"><div>Handover</div><div>Q2 2024</div></div><div class="grid-cols-2"><div>none</div><div></div></div></div>
<div class="flex-col lg:flex-row"><div class="select-none"><span><<month>></span><span>2021</span></div><div class="grow">Works at <<p_size>> %</div></div><div class="flex-col lg:flex-row"><div class="grow">no date</div></div>
<div class="ps-3-col-block"><h2>Construction photos</h2></div><div>t</div><div><a class="zena-photoswipe-item" href="/ph/<<p_partkey>>-1.jpg">1</a><a class="zena-photoswipe-item" href="/ph/2.jpg">2</a> Show all <<p_size>> photos</div>
<div class="ps-3-col-block"><h3>Masterplan</h3></div>
<div class="relative"><div class="zena-expander"><span class="price-val" data-orig="1,<<p_partkey>>.5">..</span><span class="ps-area-size-switcher" data-sqft="<<p_size>>"></span></div>
<div class="text-gray-500">Transaction ID</div><div>1-<<p_partkey>></div><div class="text-gray-500">Date</div><div>Fri <b>1 <<month>> 2024</b></div><div class="text-gray-500">No. of Buyers</div><div>2</div><div class="text-gray-500">Room Type</div><div><<p_type>></div><a href="/other">o</a><a href="/dubai/guide-<<p_partkey>>">g</a></div>
<div class="zena-expander"></div>
<div class="ps-3-col-block"><h2 class="ps-crosshead">Transport &amp; Access</h2></div><div>gap</div><div class="ps-3-col-block"><div class="ps-prose"><p>First <a href="/dubai/m"><<p_brand>></a> here.</p><div class="ps-h3">By car</div><p>To <a href="http://x.example/<<p_partkey>>">Mall <<p_size>></a> and <a href="/dubai/m"><<p_brand>></a>.</p><div class="ps-h3">By bus</div><p>None</p></div></div>
<div class="ps-loc-fact-body"><p>Fact <<p_partkey>></p></div></main><a href="/outside">o</a></body></html>"""
DEV = lambda part: pages(part, DEVELOPMENT)
NAME = "p_name || ' ' || p_partkey"

add("site_developments", lambda p: pg.developments(DEV(p)).select("url", "kind", "name", "building_type_raw", "raw_status", "storeys_raw", "area_raw", "overview", "developer_raw", "is_multi_building", "developer_url", "official_website", "plot_reference", "hero_image_url", "normalized_status", "total_units"), f"""
SELECT {URL} AS url, 'development' AS kind, {NAME} AS name, 'Multi-building & mall' AS building_type_raw, {STATUS} AS raw_status, 'G + ' || p_size AS storeys_raw, 'Zone ' || p_size AS area_raw, p_type || ' text' AS overview, p_brand AS developer_raw, true AS is_multi_building,
       '{HOME}dev/' || p_size AS developer_url, 'http://www.p' || p_partkey || '.example/' AS official_website, 'JV-' || p_partkey AS plot_reference, '{SITE}/img/' || p_partkey || '.jpg' AS hero_image_url, {NORMAL} AS normalized_status, ('1' || p_partkey)::BIGINT AS total_units FROM part""")
add("site_companies", lambda p: pg.extract(DEV(p), "development", ["companies"]).select(F.col("url").alias("page"), F.inline("page.companies")), f"""
SELECT {URL} AS page, 'Developer' AS role, p_brand AS name, '{HOME}dev/' || p_size AS url FROM part UNION ALL SELECT {URL}, 'Architect', 'Arch & Co', '{HOME}arch/1' FROM part UNION ALL SELECT {URL}, 'Architect', 'Second', '{HOME}arch-2' FROM part""")
add("site_sub_buildings", lambda p: pg.extract(DEV(p), "development", ["sub_buildings"]).select(F.col("url").alias("page"), F.inline("page.sub_buildings")), f"SELECT {URL} AS page, 'Tower ' || t AS text, {URL} || '-' || lower(t) AS url FROM part, (SELECT unnest(['A', 'B']) AS t)")
add("site_milestones", lambda p: pg.dated(DEV(p)).select("url", "label", "date_raw", "date"), f"SELECT {URL} AS url, 'Launch' AS label, {MONTH} || ' 2019' AS date_raw, '2019-' || {TWO} AS date FROM part UNION ALL SELECT {URL}, 'Handover', 'Q2 2024', '2024-Q2' FROM part")
add("site_timeline", lambda p: pg.dated(DEV(p), "timeline").select("url", "date_raw", "description", "date"), f"SELECT {URL} AS url, {MONTH} || ' 2021' AS date_raw, 'Works at ' || p_size || ' %' AS description, '2021-' || {TWO} AS date FROM part")
add("site_documents", lambda p: pg.extract(DEV(p), "development", ["documents"]).select("url", F.inline("page.documents")).select("url", "doc_type", "label", "photo_count", F.array_join("photo_urls", " ").alias("photos")), f"""
SELECT {URL} AS url, 'construction_photos' AS doc_type, 'Construction photos' AS label, p_size::INT AS photo_count, '{SITE}/ph/' || p_partkey || '-1.jpg {SITE}/ph/2.jpg' AS photos FROM part""" + f" UNION ALL SELECT {URL}, 'masterplan', 'Masterplan', NULL, '' FROM part")
add("site_transactions", lambda p: pg.typed_transactions(DEV(p), "development").select("url", "transaction_id", F.date_format("transaction_date", "yyyy-MM-dd").alias("day"), "price_aed", "size_sqft", "buyers", "sellers", "room_type", "guide_url"), f"""
SELECT {URL} AS url, '1-' || p_partkey AS transaction_id, '2024-' || {TWO} || '-01' AS day, ('1' || p_partkey || '.5')::DOUBLE AS price_aed, p_size::DOUBLE AS size_sqft, 2::BIGINT AS buyers, NULL::BIGINT AS sellers, p_type AS room_type, '{HOME}guide-' || p_partkey AS guide_url FROM part""")
add("site_places", lambda p: pg.extract(DEV(p), "development", ["mentioned_places"]).select("url", F.inline("page.mentioned_places")), f"""
SELECT {URL} AS url, p_brand AS name, '{HOME}m' AS linked_url, 'First ' || p_brand || ' here.' AS context_sentence, NULL AS section FROM part
UNION ALL SELECT {URL}, 'Mall ' || p_size, 'http://x.example/' || p_partkey, 'To Mall ' || p_size || ' and ' || p_brand || '.', 'By car' FROM part
UNION ALL SELECT {URL}, p_brand, '{HOME}m', 'To Mall ' || p_size || ' and ' || p_brand || '.', 'By car' FROM part""")
add("site_facts", lambda p: pg.extract(DEV(p), "development", ["additional_info"]).select("url", F.explode("page.additional_info").alias("fact")), f"SELECT {URL} AS url, 'Fact ' || p_partkey AS fact FROM part")
add("site_links", lambda p: pg.links(DEV(p)), f"""
SELECT DISTINCT {URL} AS source, unnest(['{HOME}dev/' || p_size, '{HOME}arch/1', '{HOME}arch-2', {URL} || '-a', {URL} || '-b', 'http://www.p' || p_partkey || '.example/', '{SITE}/ph/' || p_partkey || '-1.jpg', '{SITE}/ph/2.jpg', '{SITE}/other', '{HOME}guide-' || p_partkey, '{HOME}m', 'http://x.example/' || p_partkey]) AS url FROM part""")

# -- an area's page ---------------------------------------------------------------------------------------------------
AREA = f"""<a href="{v.PATH_PREFIX}{v.AREA_INDEX}">Area Guides</a><h1><<p_brand>> Mall</h1><img alt="<<p_brand>> mall" src="i/<<p_partkey>>.png"><p> Updated <<month>> 2026 </p>
<div><div class="font-bold">Area</div><div>Zone <<p_size>></div></div><div><div class="font-bold">Also known as</div><div><<p_name>>, JVC</div></div>
<div class="wrap"><div class="select-none"><span>COMMUNITY</span><div class="font-transport-medium"><<p_size>></div><div class="font-transport-medium"><<p_name>></div><div class="font-din">a</div><div class="font-din">b</div></div></div>
<div><div class="text-gray-700">Buildings</div><div>1,<<p_partkey>></div><div class="text-gray-700">Villas</div><div><<p_size>></div></div>
<p>There are currently 8<<p_partkey>> building developments, of which 4<<p_size>> are complete, 12 are at various stages of construction and two are either on-hold.</p>
<a class="group" href="/dubai/sub-<<p_partkey>>"><div class="font-bold">Sub <<p_partkey>></div><img src="/s.png"><div><span class="material-icons">x</span> <<status>> </div></a>
<a class="group" href="/dubai/sub-<<p_partkey>>"><div class="font-bold">Again</div></a><a class="group" href="/else/1"><div class="font-bold">Else</div></a>
<div><a href="/dubai/b<<p_partkey>>" title=" <<p_name>> "><div class="line-clamp-2 font-bold">short</div></a><div><span>i</span> <<status>></div></div><div><a href="/dubai/c<<p_partkey>>"><div class="font-bold line-clamp-2">C <<p_size>></div></a></div>"""
add("site_areas", lambda p: pg.areas(pages(p, AREA)).select("url", "kind", "name", "area_type", "parent_area_name", "also_known_as", "dld_community_code", "dld_community_name_en", "dld_community_name_ar", "dld_buildings", "dld_villas", "dev_total", "dev_completed", "dev_under_construction", "dev_on_hold", "hero_image_url", "updated_label"), f"""
SELECT {URL} AS url, 'area' AS kind, p_brand || ' Mall' AS name, 'mall' AS area_type, 'Zone ' || p_size AS parent_area_name, p_name || ', JVC' AS also_known_as, p_size::VARCHAR AS dld_community_code, p_name AS dld_community_name_en, 'b' AS dld_community_name_ar,
       ('1' || p_partkey)::BIGINT AS dld_buildings, p_size::BIGINT AS dld_villas, ('8' || p_partkey)::BIGINT AS dev_total, ('4' || p_size)::BIGINT AS dev_completed, 12::BIGINT AS dev_under_construction, 2::BIGINT AS dev_on_hold, '{HOME}i/' || p_partkey || '.png' AS hero_image_url, 'Updated ' || {MONTH} || ' 2026' AS updated_label FROM part""")
add("site_sub_communities", lambda p: pg.extract(pages(p, AREA), "area", ["sub_communities"]).select(F.col("url").alias("page"), F.inline("page.sub_communities")), f"SELECT {URL} AS page, 'Sub ' || p_partkey AS name, '{HOME}sub-' || p_partkey AS url, {STATUS} AS raw_status, '{SITE}/s.png' AS image_url FROM part")
add("site_building_cards", lambda p: pg.extract(pages(p, AREA), "area", ["building_cards"]).select(F.col("url").alias("page"), F.inline("page.building_cards")), f"SELECT {URL} AS page, p_name AS name, '{HOME}b' || p_partkey AS url, {STATUS} AS raw_status FROM part UNION ALL SELECT {URL}, 'C ' || p_size, '{HOME}c' || p_partkey, NULL FROM part")

# -- directories ------------------------------------------------------------------------------------------------------
AMENITIES = """<h2 class="ps-crosshead">Overview</h2><h2 class="ps-crosshead">Dining</h2><div><div class="font-bold">Cafe <<p_size>></div><div><a class="ps-link" href="/b"><<p_brand>></a>, Level <<p_partkey>></div></div>
<h3 class="ps-crosshead">Gyms</h3><div><div>Gym <<p_partkey>>, <a class="ps-link" href="/b"><<p_name>></a></div></div><div><div>Gym <<p_partkey>>, <a class="ps-link" href="/c"><<p_name>></a></div></div>"""
add("site_amenities", lambda p: pg.listing(pages(p, AMENITIES, "/amenities"), "amenities"), f"""
SELECT {URL} || '/amenities' AS url, 'Cafe ' || p_size AS name, 'Dining' AS category, p_brand AS building_context, 'Level ' || p_partkey AS distance_text FROM part UNION ALL SELECT {URL} || '/amenities', 'Gym ' || p_partkey, 'Gyms', p_name, NULL FROM part""")
SCHOOLS = """<h2 class="ps-crosshead">British</h2><div><div class="font-bold mb-4"><<p_brand>> School</div><div><span>Government rating:</span> Good <<p_size>></div><div><span>Distance:</span> <<p_size>> km</div><div><span>note</span> x</div><div><span>Location:</span> Zone <<p_size>></div></div>
<div><div class="font-bold mb-4">Plain <<p_partkey>></div></div>"""
add("site_schools", lambda p: pg.listing(pages(p, SCHOOLS, "/schools"), "schools"), f"""
SELECT {URL} || '/schools' AS url, p_brand || ' School' AS name, 'British' AS curriculum, 'Good ' || p_size AS rating, p_size || ' km' AS distance_text, NULL AS fees_text, 'Zone ' || p_size AS location_text FROM part UNION ALL SELECT {URL} || '/schools', 'Plain ' || p_partkey, 'British', NULL, NULL, NULL, NULL FROM part""")
