"""All queries by name over the stand-in tables, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylane.plans import market, queries
from quarrylane.plans.market import PRELUDE, window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = queries


def add(name: str, run: Callable, sql: str | None = None) -> None:
    """run takes a market; sql follows the prelude."""
    QUERIES[name] = lambda spark, sf_dir: run(market.stand_in(spark, sf_dir))
    if sql:
        ORACLES[name] = PRELUDE + sql


def pct(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} <> 0 THEN round_even((({cur})::DOUBLE - {prev}) / {prev} * 100.0 * 100.0, 0) / 100.0 END"


def yld(rent: str, price: str) -> str:
    return f"CASE WHEN {rent} <> 0 AND {price} <> 0 THEN round_even({rent} / {price} * 100.0 * 100.0, 0) / 100.0 END"


def share(part: str, total: str) -> str:
    return f"CASE WHEN {total} <> 0 THEN round_even(({part})::DOUBLE / {total} * 100.0 * 100.0, 0) / 100.0 END"


def r(x: str, places: int) -> str:
    return f"round_even(({x})::DOUBLE * {10.0**places}, 0) / {10.0**places}"


def money(x: str, where: str = "") -> str:
    return f"sum({x}::DECIMAL(18,2)) {where and f'FILTER ({where})'}::DOUBLE" if not where else f"CAST(sum({x}::DECIMAL(18,2)) FILTER ({where}) AS DOUBLE)"


CUR, PREV = "day BETWEEN w.s AND w.e", "day BETWEEN w.ps AND w.pe"
MOMENTUM = "CASE WHEN change_pct IS NULL THEN 'insufficient_data' WHEN change_pct > 3 THEN 'accelerating' WHEN change_pct < -3 THEN 'slowing' ELSE 'stable' END"
UPCOMING = "('under_construction', 'planned', 'announced')"


def kpis(fact: str, days: int) -> str:
    return window(days) + f", a AS (SELECT count(*) FILTER ({CUR}) AS n, count(*) FILTER ({PREV}) AS pn, {money('val', CUR)} AS v, {money('val', PREV)} AS pv, median(val) FILTER ({CUR}) AS mp, median(psf) FILTER ({CUR}) AS mpsf FROM {fact}, w)"


add("overview_sales_kpis", lambda k: Q.sales_kpis(k, k.period("90d")), kpis("sales", 90) + f" SELECT n AS sales_count, v AS value, v / n AS avg_price, mp AS median_price, {r('mpsf', 4)} AS median_psf, {pct('n', 'pn')} AS change_pct, {pct('v', 'pv')} AS value_change_pct, CASE WHEN n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS confidence FROM a")
add("overview_rental_kpis", lambda k: Q.rental_kpis(k, k.period("90d")), kpis("rentals", 90) + f" SELECT n AS rental_count, v / n AS avg_rent, mp AS median_rent, {pct('n', 'pn')} AS change_pct, CASE WHEN n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS confidence FROM a")
add("overview_community_kpis", lambda k: Q.sales_kpis(k, k.period("1y"), "s3"), kpis("(SELECT * FROM sales WHERE area_id IN (SELECT area_id FROM area WHERE ck = 's3'))", 365) + f" SELECT n AS sales_count, v AS value, v / n AS avg_price, mp AS median_price, {r('mpsf', 4)} AS median_psf, {pct('n', 'pn')} AS change_pct, {pct('v', 'pv')} AS value_change_pct, CASE WHEN n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS confidence FROM a")
add("overview", lambda k: Q.overview(k, k.period("90d")))
add("best_selling_type", lambda k: Q.best_selling_type(k, k.period("90d")), window(90) + f" SELECT bed AS canonical_bedroom, count(*) AS n FROM sales, w WHERE {CUR} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
add("top_rental_area", lambda k: Q.top_rental_area(k, k.period("90d")), window(90) + f" SELECT cn AS community_name, count(*)::BIGINT AS n FROM rentals JOIN area USING (area_id), w WHERE {CUR} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")


def counts(fact: str, days: int) -> str:
    return window(days) + f", g AS (SELECT ck, cn, count(*) FILTER ({CUR}) AS c, count(*) FILTER ({PREV}) AS p, median(val) FILTER ({CUR}) AS mv FROM {fact} JOIN area USING (area_id), w GROUP BY 1, 2)"


add("growth_area", lambda k: Q.growth_area(k, k.period("90d")), counts("sales", 90) + f" SELECT cn AS community_name, c::BIGINT AS current_count, p::BIGINT AS previous_count, {pct('c', 'p')} AS change_pct FROM g WHERE c >= 5 ORDER BY c - p DESC, ck LIMIT 1")
add("largest_supply", lambda k: Q.largest_supply(k), "SELECT n_name AS area, units::BIGINT AS units FROM (SELECT s.units, d.scraped, s.dev_id FROM supply s JOIN dev d ON d.id = s.dev_id) JOIN nation ON n_nationkey = scraped ORDER BY units DESC, dev_id LIMIT 1")
add("supply_totals", lambda k: Q.supply_totals(k), "SELECT (SELECT count(*) FROM dev WHERE active) AS active_projects, (SELECT count(*) FROM dev WHERE active AND status = 'under_construction') AS under_construction, (SELECT sum(units)::BIGINT FROM supply) AS known_units")

GROWN = f", x AS (SELECT ck AS community_key, cn AS community_name, c AS current_count, p AS previous_count, mv AS median_value, {pct('c', 'p')} AS change_pct FROM g WHERE c >= 10), grown AS (SELECT *, {MOMENTUM} AS momentum FROM x WHERE change_pct IS NOT NULL)"
add("area_growth", lambda k: Q.area_growth(k, k.period("1y")), counts("sales", 365) + GROWN + " SELECT * FROM grown")
add("area_growth_rentals", lambda k: Q.area_growth(k, k.period("90d"), rentals=True), counts("rentals", 90) + GROWN + " SELECT * FROM grown")
add("pulse_fastest_growing", lambda k: Q.fastest_growing(k, k.period("90d")), counts("sales", 90) + GROWN + " SELECT * FROM grown ORDER BY change_pct DESC, community_key LIMIT 5")
add("pulse_cooling", lambda k: Q.cooling(k, k.period("90d")), counts("sales", 90) + GROWN + " SELECT * FROM grown WHERE change_pct < 0 ORDER BY change_pct, community_key LIMIT 5")
add("pulse_rental_hotspots", lambda k: Q.rental_hotspots(k, k.period("90d")), counts("rentals", 90) + GROWN + " SELECT * FROM grown ORDER BY change_pct DESC, community_key LIMIT 5")


def hot(days: int, places: int) -> str:
    return window(days) + f""", g AS (SELECT project_id, count(*) FILTER ({CUR}) AS c, count(*) FILTER (day BETWEEN w.s - INTERVAL 6 MONTH AND w.s - 1) / 6.0 AS a FROM sales, w GROUP BY 1),
    k AS (SELECT *, c / a AS q FROM g WHERE c >= 3 AND a > 0 ORDER BY c / a DESC, project_id LIMIT 15), x AS (SELECT k.*, {r('q', places)} AS ratio FROM k WHERE a >= 0.1)
    SELECT x.project_id, pname AS project_name, c AS current_count, {r('a', 1)} AS trailing_monthly_avg, ratio FROM x JOIN project USING (project_id) WHERE ratio >= 2.0 ORDER BY ratio DESC, x.project_id LIMIT 5"""


add("hot_projects", lambda k: Q.hot_projects(k, k.period("1y"), least=3, avg_from=0.1), hot(365, 2))
add("signal_momentum", lambda k: Q.hot_projects(k, k.period("1y"), least=3, avg_from=0.1, places=1), hot(365, 1))
add("developer_momentum", lambda k: Q.developer_momentum(k, k.period("90d")), window(90) + f", g AS (SELECT d.developer_id, count(*) FILTER ({CUR}) AS c, count(*) FILTER ({PREV}) AS p FROM sales JOIN dev d ON d.id = project_id, w GROUP BY 1) SELECT name AS developer_name, c::BIGINT AS current_count, p::BIGINT AS previous_count, {pct('c', 'p')} AS change_pct FROM g JOIN developer ON developer.id = developer_id WHERE c >= 5 AND p <> 0 ORDER BY 4 DESC, developer_id LIMIT 5")
add("signal_dominant", lambda k: Q.signal_dominant(k, k.period("90d"), share_from=20.0), window(90) + f", g AS (SELECT ck, cn, bed, count(*) AS c FROM rentals JOIN area USING (area_id), w WHERE {CUR} GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY ck, cn) AS total FROM g) SELECT cn AS community_name, bed AS canonical_bedroom, c::BIGINT AS c, total::BIGINT AS total, {r('100.0 * c / total', 1)} AS share_pct FROM t WHERE total >= 15 AND {r('100.0 * c / total', 1)} >= 20 ORDER BY c / total DESC, ck, bed LIMIT 5")
add("signal_growth", lambda k: Q.signal_growth(k, k.period("90d"), growth_from=5.0), counts("rentals", 90) + f" SELECT * FROM (SELECT cn AS community_name, c::BIGINT AS current_count, p::BIGINT AS previous_count, {pct('c', 'p')} AS change_pct FROM g WHERE c >= 15) WHERE change_pct >= 5 ORDER BY change_pct DESC, community_name DESC LIMIT 5")
add("signal_rent_vs_psf", lambda k: Q.signal_rent_vs_psf(k, k.period("1y"), rent_from=1.0, band=20.0), window(365) + f""", rent AS (SELECT ck, cn, bed, median(val) FILTER ({CUR}) AS a, median(val) FILTER ({PREV}) AS b, count(*) FILTER ({CUR}) AS n, count(*) FILTER ({PREV}) AS pn FROM rentals JOIN area USING (area_id), w GROUP BY ALL),
    sold AS (SELECT ck, median(psf) FILTER ({CUR}) AS a, median(psf) FILTER ({PREV}) AS b FROM sales JOIN area USING (area_id), w GROUP BY 1)
    SELECT * FROM (SELECT cn AS community_name, bed AS canonical_bedroom, n, {pct('rent.a', 'rent.b')} AS rent_pct, {pct('sold.a', 'sold.b')} AS psf_pct FROM rent JOIN sold USING (ck) WHERE n >= 10 AND pn >= 10) WHERE rent_pct >= 1 AND abs(psf_pct) <= 20""")
INCOMING = f"SELECT ck, cn, sum(u)::BIGINT AS incoming_units FROM (SELECT d.scraped, sum(s.units) AS u FROM supply s JOIN dev d ON d.id = s.dev_id WHERE d.status IN {UPCOMING} GROUP BY 1) JOIN (SELECT DISTINCT scraped, ck, cn FROM area) USING (scraped) GROUP BY 1, 2"


def risk(units: str, demand: str) -> str:
    q = r(f"({units})::DOUBLE / {demand}", 2)
    return f"CASE WHEN {units} IS NULL OR {demand} IS NULL THEN 'insufficient_data' WHEN {demand} <= 0 THEN CASE WHEN {units} = 0 THEN 'insufficient_data' ELSE 'very_high' END WHEN {q} < 0.5 THEN 'low' WHEN {q} < 1.5 THEN 'moderate' WHEN {q} < 3 THEN 'high' ELSE 'very_high' END"


def yearly(n: str, days: int) -> str:
    return f"round_even(365.0::DOUBLE * ({n}) / {days}.0::DOUBLE, 0)"


add("signal_supply", lambda k: Q.signal_supply(k, k.period("90d")), window(90) + f""", inc AS ({INCOMING}), n AS (SELECT ck, count(*) AS c FROM rentals JOIN area USING (area_id), w WHERE {CUR} GROUP BY 1),
    x AS (SELECT ck, cn, incoming_units, {yearly('coalesce(c, 0)', 90)} AS d FROM inc LEFT JOIN n USING (ck)), y AS (SELECT *, {risk('incoming_units', 'd')} AS risk FROM x)
    SELECT cn AS community_name, incoming_units, d AS annual_demand, CASE WHEN d > 0 THEN {r('incoming_units / d', 2)} END AS ratio, risk FROM y WHERE risk IN ('high', 'very_high') ORDER BY incoming_units DESC, ck LIMIT 5""")


def stats(days: int) -> str:
    return window(days) + f""", s AS (SELECT ck, count(*) AS sc, median(val) AS mp, median(psf) AS mpsf, {money('val', 'true')} AS sv FROM sales JOIN area USING (area_id), w WHERE {CUR} GROUP BY 1),
    r AS (SELECT ck, count(*) AS rc, median(val) AS mr, count(*) FILTER (is_renewal) AS ren, count(*) FILTER (NOT is_renewal) AS fresh FROM rentals JOIN area USING (area_id), w WHERE {CUR} GROUP BY 1),
    st AS (SELECT ck, cn, coalesce(sc, 0) AS sc, coalesce(rc, 0) AS rc, mp, mpsf, mr, sv, coalesce(ren, 0) AS ren, coalesce(fresh, 0) AS fresh FROM (SELECT ck, min(cn) AS cn FROM area GROUP BY 1) LEFT JOIN s USING (ck) LEFT JOIN r USING (ck))"""


add("community_list", lambda k: Q.community_list(k, k.period("90d"), sort="yield_pct", page=1, page_size=10), stats(90) + f" SELECT ck AS community_key, cn AS community_name, sc AS sales_count, mp AS median_price, {r('mpsf', 4)} AS median_psf, rc AS rental_count, mr AS median_rent, {yld('mr', 'mp')} AS yield_pct FROM st ORDER BY yield_pct DESC NULLS LAST, ck LIMIT 10")
add("community_search", lambda k: Q.community_list(k, k.period("90d"), search="an", page=2, page_size=3), stats(90) + f" SELECT ck AS community_key, cn AS community_name, sc AS sales_count, mp AS median_price, {r('mpsf', 4)} AS median_psf, rc AS rental_count, mr AS median_rent, {yld('mr', 'mp')} AS yield_pct FROM st WHERE cn ILIKE '%an%' ORDER BY sc DESC NULLS LAST, ck LIMIT 3 OFFSET 3")


def summary(days: int, where: str = "true") -> str:
    return stats(days) + f", inc AS ({INCOMING}), x AS (SELECT st.*, incoming_units, {yearly('sc + rc', days)} AS d FROM st LEFT JOIN inc USING (ck) WHERE {where}) SELECT ck AS community_key, cn AS community_name, sc AS sales_count, sv AS sales_value, mp AS median_price, rc AS rental_count, mr AS median_rent, ren AS renewals, fresh AS new_leases, {yld('mr', 'mp')} AS yield_pct, incoming_units, d AS annual_demand, {risk('incoming_units', 'd')} AS risk FROM x"


add("community_detail", lambda k: Q.community_summary(k, k.period("90d")), summary(90))
add("compare_communities", lambda k: Q.compare_communities(k, k.period("180d"), ["s1", "s2", "s7"]), summary(180, "st.ck IN ('s1', 's2', 's7')"))
for _fact, _flag in (("sales", False), ("rentals", True)):
    add(f"community_bedrooms_{_fact}", lambda k, f=_flag: Q.bedroom_split(k, k.period("1y"), "s3", f), window(365) + f", g AS (SELECT bed AS canonical_bedroom, count(*) AS n FROM {_fact}, w WHERE {CUR} AND area_id IN (SELECT area_id FROM area WHERE ck = 's3') GROUP BY 1) SELECT *, {share('n', 'sum(n) OVER ()')} AS share_pct FROM g")
add("community_top_projects", lambda k: Q.community_top_projects(k, k.period("1y"), "s3"), window(365) + f" SELECT project_id, count(*) AS n, median(val) AS median_price, min(pname) AS project_name FROM sales JOIN project USING (project_id), w WHERE {CUR} AND area_id IN (SELECT area_id FROM area WHERE ck = 's3') GROUP BY 1 ORDER BY n DESC, project_id LIMIT 10")
add("community_developers", lambda k: Q.community_developers(k, "s3"), f" SELECT developer.name AS developer_name, count(*) AS developments, (sum(units) FILTER (status IN {UPCOMING}))::BIGINT AS upcoming_units FROM dev JOIN developer ON developer.id = developer_id WHERE scraped IN (SELECT scraped FROM area WHERE ck = 's3') GROUP BY developer_id, developer.name ORDER BY developments DESC, developer_id LIMIT 10")

LABELS = {
    "community": ("JOIN area USING (area_id)", "cn"), "developer": ("JOIN dev d ON d.id = project_id LEFT JOIN developer ON developer.id = d.developer_id", "developer.name"), "property_type": ("", "kind"),
    "bedroom": ("", "bed"), "offplan": ("", "CASE WHEN is_offplan THEN 'Off-plan' ELSE 'Ready' END"), "contract_type": ("", "CASE WHEN is_renewal THEN 'Renewal' ELSE 'New' END"), "project": ("LEFT JOIN project USING (project_id)", "pname"),
}
for _fact, _flag, _dims in (("sales", False, ("community", "developer", "property_type", "bedroom", "offplan", "project")), ("rentals", True, ("community", "property_type", "bedroom", "contract_type", "project"))):
    for _by in _dims:
        _join, _label = LABELS[_by]
        add(f"{_fact}_breakdown_{_by}", lambda k, b=_by, f=_flag: Q.breakdown(k, k.period("90d"), b, f), window(90) + f", g AS (SELECT {_label} AS label, count(*) AS n, {money('val', 'true')} AS total_value, median(val) AS median_value FROM {_fact} {_join}, w WHERE {CUR} AND {_label} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 20) SELECT *, {share('n', 'sum(n) OVER ()')} AS share_pct FROM g")
for _grain in ("day", "week", "month"):
    add(f"sales_trend_{_grain}", lambda k, g=_grain: Q.trend(k, k.period("6m"), g), window(182) + f" SELECT date_trunc('{_grain}', day)::DATE AS bucket, count(*) AS n, median(val) AS median_value, {money('val', 'true')} AS total_value FROM sales, w WHERE {CUR} GROUP BY 1")
    add(f"rentals_trend_{_grain}", lambda k, g=_grain: Q.trend(k, k.period("6m"), g, rentals=True), window(182) + f" SELECT date_trunc('{_grain}', day)::DATE AS bucket, count(*) AS n, median(val) AS median_value, count(*) FILTER (is_renewal) AS renewals, count(*) FILTER (NOT is_renewal) AS new_leases FROM rentals, w WHERE {CUR} GROUP BY 1")

BEDS = {"Studio": "b_studio", "1BR": "b_1br", "2BR": "b_2br", "3BR": "b_3br", "4BR": "b_4br", "5BR+": "b_5br_up", "Unknown": "b_unknown", "Other": "b_other"}
MATRIX = window(90) + f", c AS (SELECT ck, cn, bed FROM rentals JOIN area USING (area_id), w WHERE {CUR}), best AS (SELECT ck, count(*) AS total FROM c GROUP BY 1 ORDER BY total DESC, ck LIMIT 10) SELECT c.ck AS community_key, cn AS community_name, best.total::BIGINT AS total, "
add("demand_matrix_absolute", lambda k: Q.demand_matrix(k, k.period("90d")), MATRIX + ", ".join(f"count(*) FILTER (bed = '{b}')::BIGINT AS {n}" for b, n in BEDS.items()) + " FROM c JOIN best USING (ck) GROUP BY c.ck, cn, best.total")
add("demand_matrix_share", lambda k: Q.demand_matrix(k, k.period("90d"), share=True), MATRIX + ", ".join(f"{share(f'''count(*) FILTER (bed = '{b}')''', 'best.total')} AS {n}" for b, n in BEDS.items()) + " FROM c JOIN best USING (ck) GROUP BY c.ck, cn, best.total")


def types(days: int, sales: str = "sales", rentals: str = "rentals") -> str:
    return window(days) + f""", s AS (SELECT bed, count(*) FILTER ({CUR}) AS sc, count(*) FILTER ({PREV}) AS pc, median(val) FILTER ({CUR}) AS mp FROM {sales}, w WHERE {CUR} OR {PREV} GROUP BY 1), r AS (SELECT bed, count(*) AS rc, median(val) AS mr FROM {rentals}, w WHERE {CUR} GROUP BY 1),
    g AS (SELECT bed, coalesce(sc, 0) AS sc, coalesce(pc, 0) AS pc, coalesce(rc, 0) AS rc, mp, mr FROM s FULL JOIN r USING (bed) WHERE coalesce(sc, 0) + coalesce(rc, 0) > 0)
    SELECT bed AS canonical_bedroom, sc AS sales_count, rc AS rental_count, mp AS median_price, mr AS median_rent, {share('sc', 'sum(sc) OVER ()')} AS sales_share_pct, {pct('sc', 'pc')} AS sales_change_pct, {yld('mr', 'mp')} AS yield_pct, CASE WHEN least(sc, rc) >= 5 THEN 'ok' ELSE 'insufficient_data' END AS confidence FROM g"""


add("unit_types", lambda k: Q.unit_types(k, k.period("90d")), types(90))
_SCOPE = "project_id IN (SELECT project_id FROM project JOIN master USING (master_id) WHERE slug = 'brand-11')"
add("master_unit_types", lambda k: Q.master_unit_types(k, k.period("180d"), "brand-11"), types(180, f"(SELECT * FROM sales WHERE {_SCOPE})", f"(SELECT * FROM rentals WHERE {_SCOPE})"))
add("master_kpis", lambda k: Q.master_kpis(k, k.period("180d"), "brand-11", unit_type="2BR", kind="ready"))
add("master_trend", lambda k: Q.master_trend(k, k.period("180d"), "brand-11"), window(180) + f" SELECT date_trunc('week', day)::DATE AS bucket, count(*) AS n, median(val) AS median_value, {money('val', 'true')} AS total_value FROM sales, w WHERE {CUR} AND {_SCOPE} GROUP BY 1")

EXPLORE = "SELECT sale_id, line_no, day, cn AS community_name, pname AS project_name, bed AS canonical_bedroom, val AS value FROM sales JOIN area USING (area_id) LEFT JOIN project USING (project_id) LEFT JOIN master USING (master_id) WHERE bed = '2BR' AND day >= '2000-01-01' AND val BETWEEN 10000 AND 60000 AND NOT is_offplan"
_F = {"canonical_bedroom": "2BR", "date_from": "2000-01-01", "min_price": "10000", "max_price": "60000", "is_offplan": "false"}
add("explorer_page", lambda k: Q.explorer(k, page=2, page_size=40, **_F), EXPLORE + " ORDER BY day DESC, sale_id, line_no LIMIT 40 OFFSET 40")
add("explorer_count", lambda k: Q.explorer_count(k, **_F), f"SELECT count(*) AS n FROM ({EXPLORE})")
add("explorer_master", lambda k: Q.explorer(k, master_slug="brand-11", page_size=30), EXPLORE.split(" WHERE ")[0] + " WHERE slug = 'brand-11' ORDER BY day DESC, sale_id, line_no LIMIT 30")
add("explorer_rentals", lambda k: Q.explorer(k, rentals=True, page_size=30, is_renewal="1", community_key="s3"), "SELECT rental_id, line_no, day, cn AS community_name, pname AS project_name, bed AS canonical_bedroom, val AS value FROM rentals JOIN area USING (area_id) LEFT JOIN project USING (project_id) WHERE is_renewal AND ck = 's3' ORDER BY day DESC, rental_id, line_no LIMIT 30")
add("map_developments", lambda k: Q.map_developments(k), "SELECT id, name, lat AS latitude, lng AS longitude, status AS normalized_status, coalesce(c, 0)::BIGINT AS sales_count FROM dev LEFT JOIN (SELECT project_id, count(*) AS c FROM sales GROUP BY 1) ON project_id = id WHERE lat IS NOT NULL AND lng IS NOT NULL")
add("project_list", lambda k: Q.project_list(k, k.period("90d")), window(90) + f", s AS (SELECT project_id, count(*) AS sc, median(val) AS mp FROM sales, w WHERE {CUR} GROUP BY 1), r AS (SELECT project_id, count(*) AS rc FROM rentals, w WHERE {CUR} GROUP BY 1) SELECT project.project_id, pname AS project_name, coalesce(sc, 0) AS sales_count, coalesce(rc, 0) AS rental_count, mp AS median_price, status AS normalized_status, developer.name AS developer_name FROM project LEFT JOIN s USING (project_id) LEFT JOIN r USING (project_id) LEFT JOIN dev ON dev.id = project.project_id LEFT JOIN developer ON developer.id = developer_id ORDER BY coalesce(sc, 0) + coalesce(rc, 0) DESC, project.project_id LIMIT 50")


def liquid(n: str, months: str, steady: str) -> str:
    return r(f"(least({n} / {months} / 50.0::DOUBLE, 1.0) * 0.7::DOUBLE + {steady} * 0.3::DOUBLE) * 100.0::DOUBLE", 1)


def months(days: int) -> str:
    return f"({max(1.0, days / 30.44)!r})::DOUBLE"


add("project_detail", lambda k: Q.project_detail(k, k.period("180d")), window(180) + f" SELECT project_id, count(*) AS sales_count, median(val) AS median_price, count(DISTINCT date_trunc('month', day)) AS active_months, max(day) AS last_sale, {liquid('count(*)', months(180), 'least(1.0::DOUBLE, count(DISTINCT date_trunc(' + repr('month') + ', day)) / ' + months(180) + ')')} AS liquidity FROM sales, w WHERE {CUR} GROUP BY 1")
add("master_trailing_counts", lambda k: Q.master_trailing(k, k.period("180d")), window(180) + f" SELECT slug, count(*) FILTER (day > e - 30)::BIGINT AS sales_30d, count(*) FILTER (day > e - 90)::BIGINT AS sales_90d, count(*) FILTER (day > e - 182)::BIGINT AS sales_182d, {r('count(*) FILTER (day > e - 180) / 180.0::DOUBLE', 3)} AS velocity_per_day FROM sales JOIN project USING (project_id) JOIN master USING (master_id), w WHERE day > e - 182 GROUP BY 1")
add("building_performance", lambda k: Q.building_performance(k, k.period("180d")), window(180) + f""", s AS (SELECT project_id, count(*) AS sc, {money('val', 'true')} / count(*) AS ap, max(day) AS ls FROM sales, w WHERE {CUR} GROUP BY 1), r AS (SELECT project_id, count(*) AS rc, {money('val', 'true')} / count(*) AS ar, max(day) AS lr FROM rentals, w WHERE {CUR} GROUP BY 1)
    SELECT project_id, slug, blabel AS building_label, coalesce(sc, 0) AS sales_count, coalesce(rc, 0) AS rental_count, ap AS avg_price, ar AS avg_rent, {yld('ar', 'ap')} AS yield_pct, greatest(ls, lr) AS last_transaction FROM project JOIN master USING (master_id) LEFT JOIN s USING (project_id) LEFT JOIN r USING (project_id)""")
add("sales_vs_rentals", lambda k: Q.sales_vs_rentals(k, k.period("180d")), window(180) + f""", g AS (SELECT master_id, bed, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q FROM (SELECT project_id, bed, 1 AS s, 0 AS q FROM sales, w WHERE {CUR} UNION ALL SELECT project_id, bed, 0, 1 FROM rentals, w WHERE {CUR}) JOIN project USING (project_id) GROUP BY 1, 2),
    t AS (SELECT master_id, sum(s)::BIGINT AS sc, sum(q)::BIGINT AS rc, first(bed ORDER BY s + q DESC, bed) AS top FROM g GROUP BY 1)
    SELECT slug, sc AS sales_count, rc AS rental_count, top AS top_bedroom, CASE WHEN sc <> 0 THEN {r('rc::DOUBLE / sc', 2)} END AS rental_to_sales, {share('sc', '(sc + rc)')} AS sales_share_pct FROM t JOIN master USING (master_id)""")
add("developer_share", lambda k: Q.developer_share(k, k.period("180d")), window(180) + f""", s AS (SELECT developer_id, count(*) AS sc, {money('val', 'true')} AS sv FROM sales JOIN dev ON dev.id = project_id, w WHERE {CUR} GROUP BY 1), d AS (SELECT developer_id, count(DISTINCT id) AS n FROM dev GROUP BY 1),
    g AS (SELECT developer.id, developer.name AS developer_name, coalesce(n, 0) AS developments, sc::BIGINT AS sales_count, sv AS sales_value FROM developer LEFT JOIN d ON d.developer_id = developer.id LEFT JOIN s ON s.developer_id = developer.id ORDER BY sc DESC NULLS LAST, developer.id LIMIT 50)
    SELECT developer_name, developments, sales_count, sales_value, {share('sales_count', 'sum(sales_count) OVER ()')} AS share_pct FROM g""")
add("supply_status", lambda k: Q.supply_status(k), "SELECT coalesce(status, 'other') AS status, count(*) AS n, sum(units)::BIGINT AS units FROM dev GROUP BY 1")
add("supply_mix", lambda k: Q.supply_mix(k), "SELECT sum(units)::BIGINT AS total_units, sum(studios)::BIGINT AS studios, sum(beds_1)::BIGINT AS beds_1, sum(beds_2)::BIGINT AS beds_2, sum(beds_3)::BIGINT AS beds_3, sum(villas)::BIGINT AS villas FROM supply")
add("supply_upcoming_area", lambda k: Q.supply_upcoming(k), f"SELECT n_name AS name, count(*) AS developments, sum(units)::BIGINT AS units FROM dev JOIN nation ON n_nationkey = scraped WHERE status IN {UPCOMING} GROUP BY n_nationkey, 1 ORDER BY units DESC NULLS LAST, n_nationkey LIMIT 20")
add("supply_upcoming_developer", lambda k: Q.supply_upcoming(k, "developer"), f"SELECT developer.name AS name, count(*) AS developments, sum(units)::BIGINT AS units FROM dev JOIN developer ON developer.id = developer_id WHERE status IN {UPCOMING} GROUP BY developer.id, 1 ORDER BY units DESC NULLS LAST, developer.id LIMIT 20")
BOTH = lambda d: window(d) + f""", s AS (SELECT ck, cn, count(*) FILTER ({CUR}) AS sales, count(*) FILTER ({PREV}) AS prev_sales, median(val) FILTER ({CUR}) AS price, median(val) FILTER ({PREV}) AS prev_price FROM sales JOIN area USING (area_id), w WHERE {CUR} OR {PREV} GROUP BY 1, 2),
    q AS (SELECT ck, count(*) FILTER ({CUR}) AS rentals, count(*) FILTER ({PREV}) AS prev_rentals, median(val) FILTER ({CUR}) AS rent, median(val) FILTER ({PREV}) AS prev_rent FROM rentals JOIN area USING (area_id), w WHERE {CUR} OR {PREV} GROUP BY 1),
    b AS (SELECT s.*, coalesce(rentals, 0) AS rentals, coalesce(prev_rentals, 0) AS prev_rentals, rent, prev_rent FROM s LEFT JOIN q USING (ck))"""  # noqa: E731
add("opportunities_yield", lambda k: Q.opportunities_yield(k, k.period("90d")), BOTH(90) + f" SELECT cn AS community_name, sales, rentals, {yld('rent', 'price')} AS yield_pct FROM b WHERE sales >= 15 AND rentals >= 15 ORDER BY yield_pct DESC, ck LIMIT 15")
add("opportunities_rising", lambda k: Q.opportunities_rising(k, k.period("90d"), growth_from=5.0), BOTH(90) + f" SELECT community_name, sales, prev_sales, change_pct FROM (SELECT ck, cn AS community_name, sales, prev_sales, {pct('sales', 'prev_sales')} AS change_pct FROM b WHERE sales >= 15) WHERE change_pct >= 5 ORDER BY change_pct DESC, ck LIMIT 15")
add("opportunities_rent_vs_price", lambda k: Q.opportunities_rent_vs_price(k, k.period("90d"), gap_from=1.0), BOTH(90) + f" SELECT community_name, rent_pct, price_pct, {r('rent_pct - price_pct', 2)} AS gap FROM (SELECT ck, cn AS community_name, {pct('rent', 'prev_rent')} AS rent_pct, {pct('price', 'prev_price')} AS price_pct FROM b WHERE rentals >= 15 AND prev_rentals >= 15) WHERE rent_pct > price_pct + 1 ORDER BY 4 DESC, ck LIMIT 15")
_PARTS = "CASE WHEN y IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, y / 15.0::DOUBLE * 100.0::DOUBLE)) END AS ys, CASE WHEN gr IS NULL THEN NULL ELSE (greatest(-20.0::DOUBLE, least(20.0::DOUBLE, gr)) + 20.0::DOUBLE) / 40.0::DOUBLE * 100.0::DOUBLE END AS gs"
add("decision_engine_scores", lambda k: Q.decision_engine(k, k.period("180d"), limit=None).drop("risks", "missing_data", "why"), window(180) + f""", s AS (SELECT ck, cn, count(*) FILTER ({CUR}) AS sc, median(val) FILTER ({CUR}) AS price, median(psf) FILTER ({CUR}) AS psf, median(psf) FILTER ({PREV}) AS ppsf, count(DISTINCT date_trunc('month', day)) FILTER ({CUR}) AS am FROM sales JOIN area USING (area_id), w GROUP BY 1, 2),
    q AS (SELECT ck, count(*) AS rc, median(val) AS rent FROM rentals JOIN area USING (area_id), w WHERE {CUR} GROUP BY 1), inc AS ({INCOMING}),
    g AS (SELECT s.*, coalesce(rc, 0) AS rc, rent, incoming_units FROM s LEFT JOIN q USING (ck) LEFT JOIN inc USING (ck) WHERE sc > 0 AND (sc >= 10 OR coalesce(rc, 0) >= 10)),
    h AS (SELECT *, {yld('rent', 'price')} AS y, {pct('psf', 'ppsf')} AS gr, {liquid('sc', months(180), 'least(1.0::DOUBLE, am / ' + months(180) + ')')} AS lq, {yearly('sc + rc', 180)} AS d FROM g),
    k AS (SELECT *, {_PARTS}, {risk('incoming_units', 'd')} AS risk FROM h),
    z AS (SELECT *, (coalesce(ys * 0.34::DOUBLE, 0) + coalesce(gs * 0.33::DOUBLE, 0) + coalesce(lq * 0.33::DOUBLE, 0)) / (CASE WHEN ys IS NULL THEN 0::DOUBLE ELSE 0.34::DOUBLE END + CASE WHEN gs IS NULL THEN 0::DOUBLE ELSE 0.33::DOUBLE END + 0.33::DOUBLE) AS base, CASE risk WHEN 'very_high' THEN 40.0 WHEN 'high' THEN 20.0 WHEN 'moderate' THEN 5.0 ELSE 0.0 END AS penalty FROM k)
    SELECT ck AS community_key, cn AS community_name, sc AS sales_count, rc AS rental_count, y AS yield_pct, gr AS growth_pct, lq AS liquidity, incoming_units, risk, {r('greatest(0.0::DOUBLE, least(100.0::DOUBLE, base - penalty))', 1)} AS score FROM z""")
add("decision_engine", lambda k: Q.decision_engine(k, k.period("1y"), "rental_income", "low", budget_max=50000.0, property_type="Villa", ready_offplan="ready"))
_INVALID = lambda f, v: f"(SELECT count(*) AS rows, count(*) FILTER (area_id IS NULL) AS without_area, count(*) FILTER (project_id IS NULL) AS without_project, count(*) FILTER ({v} IS NULL OR {v} <= 0) AS invalid_value, count(*) FILTER (sqm IS NULL OR sqm <= 0) AS invalid_area FROM {f})"
add("dq_summary", lambda k: Q.data_quality(k), "SELECT 'area_match' AS measure, conf AS name, count(*) AS n FROM area GROUP BY conf UNION ALL SELECT 'project_match', conf, count(*) FROM project GROUP BY conf UNION ALL SELECT 'grouping', method, count(*) FROM project GROUP BY method "
    + " ".join(f"UNION ALL SELECT '{f}', name, n FROM (UNPIVOT {_INVALID(f, 'val')} ON rows, without_area, without_project, invalid_value, invalid_area INTO NAME name VALUE n)" for f in ("sales", "rentals")))
add("hierarchy_review", lambda k: Q.hierarchy_review(k), "SELECT slug, buildings AS building_count, string_agg(pname, '|' ORDER BY pname, method) AS buildings, string_agg(method, '|' ORDER BY pname, method) AS methods FROM master JOIN project USING (master_id) WHERE review GROUP BY slug, master.buildings ORDER BY building_count DESC, slug LIMIT 50")

from quarrylane.plans import crawl_registry as _crawl  # noqa: E402
from quarrylane.plans import operators_registry as _single  # noqa: E402
from quarrylane.plans import site_registry as _site  # noqa: E402

QUERIES |= _single.QUERIES | _site.QUERIES | _crawl.QUERIES
ORACLES |= _single.ORACLES | _site.ORACLES | _crawl.ORACLES


# -- oracles made of others -------------------------------------------------------------------------------------------


def named(alias: str, columns: str) -> str:
    return ", ".join(f"{alias}.{c} AS {alias}_{c}" for c in columns.split())


_SALES_KPIS = "sales_count value avg_price median_price median_psf change_pct value_change_pct confidence"
_RENTAL_KPIS = "rental_count avg_rent median_rent change_pct confidence"
_PARTS = {
    "s": ("overview_sales_kpis", _SALES_KPIS), "r": ("overview_rental_kpis", _RENTAL_KPIS), "type": ("best_selling_type", "canonical_bedroom n"), "area": ("top_rental_area", "community_name n"),
    "growth": ("growth_area", "community_name current_count previous_count change_pct"), "supply": ("largest_supply", "area units"),
}
_AED = "CASE WHEN s.value IS NULL THEN 'N/A' WHEN s.value >= 1e9 THEN printf('AED %.2fB', s.value / 1e9) WHEN s.value >= 1e6 THEN printf('AED %.2fM', s.value / 1e6) WHEN s.value >= 1e3 THEN printf('AED %.0fK', s.value / 1e3) ELSE printf('AED %.0f', s.value) END"
ORACLES["overview"] = (
    "SELECT " + ", ".join(named(a, c) for a, (_, c) in _PARTS.items())
    + f", t.*, {yld('r.median_rent', 's.median_price')} AS estimated_gross_yield_pct, {_AED} AS value_formatted FROM "
    + " LEFT JOIN ".join(f"({ORACLES[name]}) {a}" + (" ON true" if a != "s" else "") for a, (name, _) in _PARTS.items())
    + f" LEFT JOIN ({PRELUDE} SELECT (SELECT count(*) FROM dev WHERE active) AS active_projects, (SELECT count(*) FROM dev WHERE active AND status = 'under_construction') AS under_construction, (SELECT sum(units)::BIGINT FROM supply) AS known_units) t ON true"
)


def _summary(fact: str, days: int, columns: str, where: str) -> str:
    """The KPI query of a fact over some of its rows only."""
    return f"({PRELUDE}{kpis(f'(SELECT * FROM {fact} WHERE {where})', days)} SELECT {columns} FROM a)"


_OK = "CASE WHEN n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS confidence"
_S = f"n AS sales_count, v AS value, v / n AS avg_price, mp AS median_price, {r('mpsf', 4)} AS median_psf, {pct('n', 'pn')} AS change_pct, {pct('v', 'pv')} AS value_change_pct, {_OK}"
_R = f"n AS rental_count, v / n AS avg_rent, mp AS median_rent, {pct('n', 'pn')} AS change_pct, {_OK}"
ORACLES["master_kpis"] = f"SELECT {named('s', _SALES_KPIS)}, {named('r', _RENTAL_KPIS)} FROM {_summary('sales', 180, _S, _SCOPE + ' AND bed = $$2BR$$ AND NOT is_offplan')} s, {_summary('rentals', 180, _R, _SCOPE + ' AND bed = $$2BR$$')} r"
