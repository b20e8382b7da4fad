"""Queries that apply single operators and functions to the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import metrics, normalize as nz, urls, vocabulary as v
from quarrylane.operators import incremental as inc
from quarrylane.operators import pages as pg
from quarrylane.operators import medians, resolve, search, similarity, trees, warehouse
from quarrylane.plans import catalogue as cat
from quarrylane.plans import market
from quarrylane.plans.market import PRELUDE, STATUSES
from quarrylane.sources import export, staging
from quarrylane.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T = Callable[[str], DataFrame]


def add(name: str, run: Callable[[T], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: run(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
    if sql:
        ORACLES[name] = sql


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + f"][{index} % {len(values)} + 1]"


KEY = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
part = lambda t, *c: t("part").select("p_partkey", *c)
K = lambda: F.col("p_partkey")  # noqa: E731  columns need a session, so they are made when a query runs

# -- functions --------------------------------------------------------------------------------------------------------
_name = lambda: F.concat("p_name", F.lit("  ("), "p_brand", F.lit(") - "), "p_type")
add("canonical_key_ascii", lambda t: part(t, nz.canonical_key(_name()).alias("key")), f"SELECT p_partkey, {KEY.format(x='''p_name || '  (' || p_brand || ') - ' || p_type''')} AS key FROM part")
ROOMS = ["Studio", "1 B/R", "2 B/R", " 4 b/r", "5 B/R", "9BR", "Hotel", "PENTHOUSE", "", "Loft", "0 B/R"]
add("bedroom_labels", lambda t: part(t, nz.bedroom_from_label(pick(ROOMS, K())).alias("bedroom")), f"SELECT p_partkey, CASE WHEN x = '' THEN NULL WHEN x = 'studio' THEN 'Studio' WHEN x IN ('hotel', 'office', 'shop', 'penthouse') THEN 'Other' WHEN regexp_matches(x, '^\\d+\\s*b/?r$') THEN CASE WHEN regexp_extract(x, '^\\d+')::INT <= 4 THEN regexp_extract(x, '^\\d+')::INT || 'BR' ELSE '5BR+' END ELSE 'Other' END AS bedroom FROM (SELECT p_partkey, lower(trim({sql_pick(ROOMS, 'p_partkey')})) AS x FROM part)")
add("bedroom_buckets", lambda t: part(t, nz.bedroom_from_rooms(F.when(K() % 7 != 0, K() % 9 - 1), pick(["Flat", "Studio", "Villa"], K())).alias("bedroom")), f"SELECT p_partkey, CASE WHEN {sql_pick(['Flat', 'Studio', 'Villa'], 'p_partkey')} = 'Studio' THEN 'Studio' WHEN p_partkey % 7 = 0 THEN 'Unknown' WHEN p_partkey % 9 - 1 <= 0 THEN 'Studio' WHEN p_partkey % 9 - 1 <= 4 THEN (p_partkey % 9 - 1) || 'BR' ELSE '5BR+' END AS bedroom FROM part")
RAW = [w.title() for words in v.PROPERTY_TYPES.values() for w in words] + ["Castle", " Villa "]
_map = "CASE " + " ".join("WHEN x IN (" + ", ".join(f"'{w}'" for w in words) + f") THEN '{k}'" for k, words in v.PROPERTY_TYPES.items()) + " END"
add("property_type_map", lambda t: part(t, nz.property_type(pick(RAW, K()), pick(["Villa", "Nothing", "Land"], K())).alias("kind")), f"SELECT p_partkey, coalesce({_map.replace('x IN', f'lower(trim({sql_pick(RAW, chr(112) + chr(95) + chr(112) + chr(97) + chr(114) + chr(116) + chr(107) + chr(101) + chr(121))})) IN')}, {_map.replace('x IN', 'lower(' + sql_pick(['Villa', 'Nothing', 'Land'], 'p_partkey') + ') IN')}, 'Other') AS kind FROM part")
_suffix = lambda: nz.building_suffix(F.col("raw"), nz.canonical_key("raw"))
_raw = lambda: F.when(K() % 3 == 0, F.concat("p_brand", F.lit(" Tower "), (K() % 50).cast("string"))).when(K() % 3 == 1, F.concat("p_name", F.lit(" - "), "p_type")).otherwise(F.concat("p_name", F.lit(" (a - b)")))
add("suffix_hierarchy", lambda t: t("part").select("p_partkey", _raw().alias("raw")).select("p_partkey", _suffix()["master_key"].alias("master_key"), _suffix()["label"].alias("label"), _suffix()["method"].alias("method")), f"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {KEY.format(x='p_brand')} WHEN 1 THEN {KEY.format(x='p_name')} ELSE {KEY.format(x="p_name || ' (a - b)'")} END AS master_key,
  CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 50)::VARCHAR WHEN 1 THEN trim(p_type) END AS label, CASE p_partkey % 3 WHEN 0 THEN 'trailing_number' WHEN 1 THEN 'hyphen_split' ELSE 'none' END AS method FROM part""")
add("slugify", lambda t: part(t, nz.slugify(F.concat(F.lit(" "), "p_brand", F.lit(" / "), "p_type", F.lit("!!"))).alias("slug")), "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(' ' || p_brand || ' / ' || p_type || '!!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'project') AS slug FROM part")
add("display_names", lambda t: part(t, nz.display_name(F.lower("p_name")).alias("name")), "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name FROM part")
STATUS_TEXT = ["Complete", "Under development (Cancelled)", "On hold", "on-hold", "Delayed works", "Under construction", "Design stage", "Planning", "Announced", "Unknown", ""]
add("status_vocabulary", lambda t: part(t, nz.status(pick(STATUS_TEXT, K())).alias("status")), f"SELECT p_partkey, CASE {' '.join(f'''WHEN regexp_matches(x, '{p}', 'i') THEN '{n}' ''' for n, p in v.STATUS_PATTERNS)} ELSE 'other' END AS status FROM (SELECT p_partkey, {sql_pick(STATUS_TEXT, 'p_partkey')} AS x FROM part)")
_MON = [m[:3] for m in v.MONTH_NAMES]
add("fuzzy_dates", lambda t: t("orders").select("o_orderkey", nz.fuzzy_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Due "), F.date_format("o_orderdate", "MMMM yyyy"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"))).otherwise(F.concat(F.lit("in "), F.year("o_orderdate"), F.lit(".")))).alias("d")), "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) ELSE year(o_orderdate)::VARCHAR END AS d FROM orders")
add("transaction_dates", lambda t: t("orders").select("o_orderkey", nz.transaction_date(F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit("th "), F.date_format("o_orderdate", "MMM yyyy"))).alias("d")), "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
_cents = lambda: F.format_number(F.floor("o_totalprice"), 0)
add("money_parse", lambda t: t("orders").select("o_orderkey", nz.money(F.concat(F.lit("Price aed "), _cents())).alias("aed"), nz.size_sqft(F.concat(_cents(), F.lit(".5 Sq. Ft"))).alias("sqft"), nz.first_int(F.concat(F.lit("n: "), _cents(), F.lit(" x 2"))).alias("n"), nz.total_units(F.concat(F.lit("A total of "), _cents(), F.lit(" units.")))["units"].alias("units")), "SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS aed, floor(o_totalprice) + 0.5 AS sqft, floor(o_totalprice)::BIGINT AS n, floor(o_totalprice)::BIGINT AS units FROM orders")
NUMBERS = ["12", " 3.50 ", "1e3", "12d", "abc", "", "-.5", "1_000", "NaN"]
add("safe_numbers", lambda t: part(t, nz.safe_double(pick(NUMBERS, K())).alias("x")), f"SELECT p_partkey, CASE WHEN regexp_matches(x, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(x AS DOUBLE) END AS x FROM (SELECT p_partkey, trim({sql_pick(NUMBERS, 'p_partkey')}) AS x FROM part)")
DATES = ["2026-07-01 16:00:21", " 2024-02-29", "2026-13-45", "1/2/2020", ""]
add("iso_dates", lambda t: part(t, nz.iso_date(pick(DATES, K())).alias("d")), f"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(trim({sql_pick(DATES, 'p_partkey')}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE) AS d FROM part")
add("stable_id", lambda t: t("orders").select("o_orderkey", nz.stable_id(nz.row_uid("sales", F.lit("a.csv"), "o_orderkey")).alias("id")), "SELECT o_orderkey, ('0x' || substr(sha1('sales:a.csv:' || o_orderkey), 1, 15))::BIGINT AS id FROM orders")
ALIASES = ["JVC/JVT; Jumeirah Village", "a and b,c", "Sandy and  Andover", " ", "x|y"]
add("alias_lists", lambda t: part(t, F.concat_ws("+", nz.split_aliases(pick(ALIASES, K()))).alias("catalogue_side"), F.concat_ws("+", nz.split_names(pick(ALIASES, K()))).alias("candidate_side"), nz.normalize_alias(pick(ALIASES, K())).alias("alias")), f"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(x), '(?i)\\s*(?:,|/|;|\\band\\b)\\s*'), lambda y: trim(y)), lambda y: y <> ''), '+') AS catalogue_side, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[,/;|]| and '), lambda y: trim(y)), lambda y: y <> ''), '+') AS candidate_side, regexp_replace(lower(trim(x)), '\\s+', ' ', 'g') AS alias FROM (SELECT p_partkey, {sql_pick(ALIASES, 'p_partkey')} AS x FROM part)")
AREAS = ["Mall of the Emirates", "Ski Dubai", "The Springs", "Emallville", ""]
add("area_types", lambda t: part(t, nz.area_type(pick(AREAS, K())).alias("kind")), f"SELECT p_partkey, CASE WHEN regexp_matches(lower(x), '\\bmall\\b') THEN 'mall' WHEN lower(x) = 'ski dubai' THEN 'landmark' ELSE 'community' END AS kind FROM (SELECT p_partkey, {sql_pick(AREAS, 'p_partkey')} AS x FROM part)")
add("url_parts", lambda t: t("pages").select("page_id", urls.host("url").alias("host"), urls.path("url").alias("path")), "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM pages")
add("url_canonical", lambda t: t("pages").select("page_id", urls.canonical("url").alias("url")), "SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN '?page=' || regexp_extract(url, '[?&]page=([0-9]+)', 1) ELSE '' END AS url FROM pages")
add("content_hashes", lambda t: t("pages").select("page_id", nz.content_hash("html").alias("hash"), nz.looks_blocked("html").alias("blocked")), "SELECT page_id, sha256(html) AS hash, false AS blocked FROM pages")
add("json_props", lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
add("format_aed", lambda t: t("orders").select("o_orderkey", metrics.format_aed(F.floor("o_totalprice") * 1000 + 3).alias("text")), "SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('AED %.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('AED %.2fM', x / 1e6) WHEN x >= 1e3 THEN printf('AED %.0fK', x / 1e3) ELSE printf('AED %.0f', x) END AS text FROM (SELECT o_orderkey, floor(o_totalprice) * 1000.0 + 3 AS x FROM orders)")
_ud = lambda: (F.when(K() % 11 != 0, F.col("p_size") * 10), F.when(K() % 7 != 0, K() % 40 * 5.0))
add("oversupply_metric", lambda t: part(t, metrics.oversupply_risk(*_ud()).alias("risk"), metrics.momentum(F.when(K() % 5 != 0, K() % 21 - 10)).alias("momentum")), "SELECT p_partkey, CASE WHEN u IS NULL OR d IS NULL THEN 'insufficient_data' WHEN d <= 0 THEN CASE WHEN u = 0 THEN 'insufficient_data' ELSE 'very_high' END WHEN round_even(u / d * 100.0, 0) / 100 < 0.5 THEN 'low' WHEN round_even(u / d * 100.0, 0) / 100 < 1.5 THEN 'moderate' WHEN round_even(u / d * 100.0, 0) / 100 < 3 THEN 'high' ELSE 'very_high' END AS risk, CASE WHEN m IS NULL THEN 'insufficient_data' WHEN m > 3 THEN 'accelerating' WHEN m < -3 THEN 'slowing' ELSE 'stable' END AS momentum FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 10 END AS u, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 40 * 5.0::DOUBLE END AS d, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 21 - 10 END AS m FROM part)")

# -- resolution and search --------------------------------------------------------------------------------------------
_pert = lambda: F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 200))


def sql_sorted(text: str) -> str:
    return f"list_aggregate(list_sort(list_filter(string_split({text}, ' '), lambda w: w <> '')), 'string_agg', ' ')"


def sql_ratio(a: str, b: str) -> str:
    """200 * LCS / (length a + length b) of two columns, by the table of longest common subsequences, a row a character of a."""
    cell = f"CASE WHEN c[1] = unicode(substr({b}, j[1]::INT, 1)) THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], q[j[1]]) END"
    row = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda x: [x::BIGINT])), lambda q, j: list_append(q, {cell}))"
    letters = f"list_transform(range(1, length({a}) + 1), lambda x: [unicode(substr({a}, x::INT, 1))::BIGINT])"
    last = f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda x: 0::BIGINT), {letters}), lambda p, c: {row})"
    return f"200.0::DOUBLE * ({last})[-1] / (length({a}) + length({b}))"


add("fuzzy_match", lambda t: resolve.match(t("part").select(nz.canonical_key(_pert()).alias("key")), t("part").groupBy(nz.canonical_key("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))), f"""
WITH keys AS (SELECT DISTINCT {KEY.format(x="substr(p_name, 1, 3) || substr(p_name, 5, 200)")} AS key FROM part),
cands AS (SELECT {KEY.format(x='p_name')} AS cand, min(p_partkey) AS id FROM part GROUP BY 1),
pairs AS (SELECT key, cand, id, {sql_sorted('key')} AS a, {sql_sorted('cand')} AS b FROM keys, cands),
scored AS (SELECT key, cand, id, {sql_ratio('a', 'b')} AS score FROM pairs),
best AS (SELECT key, arg_min(id, (-score, cand)) AS id, max(score) AS score FROM scored WHERE score >= 75 GROUP BY key)
SELECT k.key, CASE WHEN c.id IS NOT NULL THEN c.id WHEN b.score >= 90 THEN b.id END AS matched_id,
       CASE WHEN c.id IS NOT NULL THEN 'exact' WHEN b.score >= 90 THEN 'fuzzy_high' WHEN b.score >= 75 THEN 'fuzzy_low' ELSE 'unmatched' END AS confidence,
       CASE WHEN c.id IS NOT NULL THEN 100.0::DOUBLE ELSE b.score END AS score
FROM keys k LEFT JOIN cands c ON c.cand = k.key LEFT JOIN best b USING (key)""")
add("exact_match", lambda t: resolve.match(t("supplier").select(nz.canonical_key("s_name").alias("key")), t("supplier").groupBy(nz.canonical_key("s_name").alias("key")).agg(F.min("s_suppkey").alias("id"))).where("confidence = 'exact'"), f"SELECT key, min(s_suppkey) AS matched_id, 'exact' AS confidence, 100.0::DOUBLE AS score FROM (SELECT {KEY.format(x='s_name')} AS key, s_suppkey FROM supplier) GROUP BY key")
add("token_sort_scores", lambda t: t("part").select("p_partkey", similarity.token_sort(F.lower("p_name"), F.lower("p_type")).alias("score")), f"""
SELECT p_partkey, {sql_ratio('a', 'b')} AS score FROM (SELECT p_partkey, {sql_sorted('lower(p_name)')} AS a, {sql_sorted('lower(p_type)')} AS b FROM part)""")
_cands = lambda t: t("part").select(nz.canonical_key("p_name").alias("key"), F.col("p_name").alias("name"), F.lit("building").alias("kind")).unionByName(t("part").select(nz.canonical_key("p_brand").alias("key"), F.col("p_brand").alias("name"), F.lit("master").alias("kind")).distinct())


def _sql_tiers(queries: str, entries: str, limit: int) -> str:
    """Ranked results of every query (q) among entries (key, kind, name, id) by comparing all pairs."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    return f"""
WITH queries AS ({queries}), entries AS ({entries}),
pairs AS (SELECT *, {sql_sorted('q')} AS a, {sql_sorted('key')} AS b FROM queries, entries),
scored AS (SELECT *, {sql_ratio('a', 'b')} AS ratio FROM pairs),
tiers AS (
  SELECT *, CASE WHEN key = q AND kind = 'master' THEN 0 WHEN key = q THEN 1 WHEN starts_with(key, q) THEN 3 WHEN list_has_all({words('key')}, {words('q')}) THEN 4 WHEN ratio >= 70 THEN 5 END::INT AS tier FROM scored),
ranked AS (
  SELECT *, CASE WHEN tier <= 1 THEN 100.0 WHEN tier = 3 THEN 90.0 WHEN tier = 4 THEN 80.0 ELSE ratio END::DOUBLE AS score FROM tiers WHERE tier IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, CASE kind WHEN 'master' THEN 0 ELSE 1 END, score DESC, name, id)::INT AS position FROM ranked)
SELECT * FROM placed WHERE position <= {limit}"""


_entries_sql = f"SELECT {KEY.format(x='p_name')} AS key, 'building' AS kind, p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name UNION ALL SELECT {KEY.format(x='p_brand')}, 'master', p_brand, min(p_partkey) FROM part GROUP BY p_brand"
add("search_rank", lambda t: resolve.rank_search("brand 11", _cands(t).distinct()), f"SELECT name, kind, key, tier, score FROM ({_sql_tiers("SELECT 'brand 11' AS q", _entries_sql, 10)})")


def _search_entries(t: T) -> DataFrame:
    of = lambda c, kind: t("part").groupBy(c).agg(F.min("p_partkey").cast("long").alias("id")).select(nz.canonical_key(c).alias("key"), "id", F.lit(kind).alias("kind"), F.col(c).alias("name"), F.lit(kind).alias("subtitle"), nz.slugify(F.col(c)).alias("slug"), F.lit(None).cast("string").alias("master_slug"))
    return of("p_name", "building").unionByName(of("p_brand", "master"))


def search_index(t: T) -> DataFrame:
    """Every brand, misspelt name and word of a type as a query over names and brands."""
    asked = t("part").select(F.explode(F.array(F.col("p_brand"), F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 200)), F.substring("p_name", 1, 3), F.substring_index("p_name", " ", -1))).alias("query"))
    return search.search(asked, search.index(_search_entries(t))).select("query", "position", "key", "id", "kind", "tier", "score")


_asked_sql = f"SELECT DISTINCT query, {KEY.format(x='query')} AS q FROM (SELECT unnest([p_brand, substr(p_name, 1, 3) || substr(p_name, 5, 200), substr(p_name, 1, 3), string_split(p_name, ' ')[-1]]) AS query FROM part) WHERE length(trim(query)) >= 2"
add("search_index", search_index, f"SELECT query, position, key, id, kind, tier, score FROM ({_sql_tiers(_asked_sql, _entries_sql, 12)})")
add("mode_enrichment", lambda t: resolve.mode_by(t("part").select("p_brand", "p_type"), "p_brand", "p_type"), "SELECT p_brand, first(p_type ORDER BY c DESC, p_type) AS p_type FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL) GROUP BY p_brand")
add("unique_slugs", lambda t: resolve.unique_slugs(t("part").select(K(), nz.slugify("p_brand").alias("slug")), "slug", "p_partkey"), "SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS s FROM part))")

# -- sets, merges, change log -----------------------------------------------------------------------------------------
add("semi_anti_sets", lambda t: t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey").withColumn("kind", F.lit("anti")).unionByName(t("customer").join(t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey").withColumn("kind", F.lit("semi"))), "SELECT c_custkey, 'anti' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'semi' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
add("union_distinct_bounds", lambda t: t("orders").select(F.col("o_orderdate").cast("date").alias("d")).unionAll(t("lineitem").select(F.col("l_shipdate").cast("date").alias("d"))).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.countDistinct("d").alias("days")), "SELECT min(d) AS low, max(d) AS high, count(DISTINCT d) AS days FROM (SELECT o_orderdate::DATE AS d FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem)")
_old = lambda t: t("orders").where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
_new = lambda t: t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("N"), "o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
OLD = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS st, o_totalprice AS tp FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'N' || o_orderstatus END AS st, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice + 1 END AS tp FROM orders WHERE o_orderkey % 2 = 0"
add("merge_keep_existing", lambda t: inc.merge(_old(t), _new(t), ["o_orderkey"]), f"SELECT o_orderkey, coalesce(n.st, o.st) AS o_orderstatus, coalesce(n.tp, o.tp) AS o_totalprice FROM ({OLD}) o FULL JOIN ({NEW}) n USING (o_orderkey)")
add("latest_wins_upsert", lambda t: inc.newest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], F.desc("ts"), F.desc("event_id")), "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
add("change_log_diff", lambda t: inc.change_log(_old(t).drop("o_totalprice"), _new(t).drop("o_totalprice"), "o_orderkey", ("o_orderstatus",), "order"), f"SELECT 'order' AS entity_type, n.o_orderkey AS entity_key, CASE WHEN o.o_orderkey IS NOT NULL THEN 'o_orderstatus' END AS field_name, CASE WHEN o.o_orderkey IS NOT NULL THEN o.st END AS old_value, CASE WHEN o.o_orderkey IS NOT NULL THEN n.st END AS new_value, CASE WHEN o.o_orderkey IS NULL THEN 'new_record' ELSE 'field_changed' END AS change_kind FROM ({NEW}) n LEFT JOIN ({OLD}) o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR (n.st IS NOT NULL AND n.st IS DISTINCT FROM o.st)")
add("disappearance", lambda t: inc.disappeared(t("customer").select("c_custkey", (F.col("c_custkey") % 4 != 0).alias("is_active")), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "customer")[0], "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS is_active FROM customer")
add("insert_absent", lambda t: inc.insert_absent(t("nation").where("n_nationkey < 10").select("n_nationkey", "n_name"), t("nation").where("n_nationkey > 5").select("n_nationkey", "n_name"), ["n_nationkey"]), "SELECT n_nationkey, n_name FROM nation")
add("replace_rows", lambda t: inc.replace_rows(t("nation").select("n_nationkey", "n_name"), t("nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.lower("n_name").alias("n_name")), ["n_nationkey"]), "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
_links = lambda t: t("pages").select((F.col("page_id") % 2).cast("int").alias("job_id"), F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.col("page_id") % 3).cast("int").alias("depth"), F.lit(None).cast("string").alias("discovered_from"))
add("crawl_enqueue", lambda t: inc.enqueue(_links(t).limit(0).withColumn("status", F.lit("")).withColumn("attempts", F.lit(0)), _links(t)).select("job_id", "url", "depth", "status"), "SELECT (page_id % 2)::INT AS job_id, regexp_replace(url, '[?#].*$', '') AS url, min(page_id % 3)::INT AS depth, 'pending' AS status FROM pages GROUP BY 1, 2")
add("daily_counter", lambda t: inc.requests_by_day(t("events").select(F.col("ts").alias("at"))), "SELECT ts::DATE AS day, count(*) AS requests FROM events GROUP BY 1")
add("entity_counts", lambda t: inc.entity_counts({k: t(k) for k in ("region", "nation", "supplier", "part")}), " UNION ALL ".join(f"SELECT '{k}' AS entity, count(*) AS n FROM {k}" for k in ("region", "nation", "supplier", "part")))
add("update_candidates", lambda t: inc.update_candidates(t("part").select(F.col("p_name").alias("url"), pick(STATUSES, F.col("p_size")).alias("normalized_status"), (K() % 5 != 0).alias("is_active"), (K() % 3 == 0).alias("is_stub"), F.col("p_size").alias("last_seen_at")), 50).select("normalized_status", "last_seen_at"), f"SELECT normalized_status, last_seen_at FROM (SELECT p_name AS url, {sql_pick(STATUSES, 'p_size')} AS normalized_status, p_size AS last_seen_at FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0) ORDER BY CASE normalized_status WHEN 'under_construction' THEN 0 WHEN 'planned' THEN 1 WHEN 'announced' THEN 2 WHEN 'on_hold' THEN 3 ELSE 4 END, last_seen_at, url LIMIT 50")

# -- catalogue dashboard ----------------------------------------------------------------------------------------------
_nodes = lambda t: t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_name")).unionByName(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_name")))
_items = lambda t: t("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("area_id"), F.lit(True).alias("is_active"))
ROLLUP = "SELECT 'n' || n_nationkey AS id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) FROM region"
add("tree_rollup", lambda t: trees.subtree_counts(_nodes(t), _items(t), "area_id"), ROLLUP)
add("tree_closure_recursive", lambda t: trees.closure_recursive(t("region").sparkSession, _nodes(t)), "SELECT 'n' || n_nationkey AS root, 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
add("tree_interval_labels", lambda t: trees.subtrees(trees.labels(_nodes(t)), _nodes(t)), "SELECT 'n' || n_nationkey AS root, 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
add("catalogue_areas", lambda t: cat.list_areas(_nodes(t), _items(t), "a"), f"SELECT * FROM ({ROLLUP}) WHERE name ILIKE '%a%'")
dev = lambda t: market.stand_in(t("region").sparkSession, t("region").inputFiles()[0].rsplit("/", 1)[0]).developments


def on_market(name: str, run: Callable[[market.Market], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: run(market.stand_in(spark, d))
    if sql:
        ORACLES[name] = PRELUDE + sql


on_market("catalogue_overview", lambda k: cat.overview(k.developments, developers=k.developers), "SELECT count(*) AS developments, count(*) FILTER (active) AS active, count(*) FILTER (dtype ILIKE '%villa%') AS villas, count(*) FILTER (dtype ILIKE '%townhouse%') AS townhouses, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + ", sum(units)::BIGINT AS known_units, (SELECT count(*) FROM developer) AS developers FROM dev")
on_market("zero_filled_status", lambda k: cat.status_breakdown(k.developments.where("normalized_status <> 'delayed'")), "SELECT s AS status, (SELECT count(*) FROM dev WHERE status = s AND s <> 'delayed') AS n FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in STATUSES) + "]) AS s)")
on_market("conditional_coverage", lambda k: cat.coverage(k.developments, ["latitude", "total_units"]), "SELECT 'latitude' AS field, count(lat) AS present, count(*) - count(lat) AS missing FROM dev UNION ALL SELECT 'total_units', count(units), count(*) - count(units) FROM dev")
_full = lambda k: k.developments.withColumns({"area_id": F.concat(F.lit("n"), "area_id"), "last_seen": F.col("id") * 7919 % 1000, "actual_completion_date": F.when(F.col("id") % 4 == 0, F.concat((F.col("id") % 9 + 2020).cast("string"), F.lit("-01"))), "master_development_id": F.when(F.col("id") % 3 != 0, F.floor(F.col("id") / 3) * 3)})
_tree = lambda k: _nodes(lambda n: k.sales.sparkSession.read.parquet(f"{_folder(k)}/{n}.parquet"))
_folder = lambda k: k.areas.inputFiles()[0].rsplit("/", 1)[0]
FULL = ", full_dev AS (SELECT dev.*, id * 7919 % 1000 AS seen, CASE WHEN id % 4 = 0 THEN (id % 9 + 2020) || '-01' END AS done2, CASE WHEN id % 3 <> 0 THEN id // 3 * 3 END AS master_of, n_regionkey, n_name FROM dev LEFT JOIN nation ON scraped = n_nationkey) "
on_market("catalogue_developments", lambda k: cat.list_developments(_full(k), _tree(k), k.developers, page=2, page_size=3, area_id="r1", dev_type="o", completion_year="2021").select("id", "name", "area_name", "developer_name"), FULL + "SELECT d.id, d.name, n_name AS area_name, developer.name AS developer_name FROM full_dev d JOIN developer ON developer_id = developer.id WHERE active AND n_regionkey = 1 AND dtype ILIKE '%o%' AND (done LIKE '2021%' OR done2 LIKE '2021%') ORDER BY seen DESC, d.id LIMIT 3 OFFSET 3")
on_market("catalogue_development_count", lambda k: cat.count_developments(_full(k), _tree(k), search="a", developer_id=11, status="planned"), "SELECT count(*) AS n FROM dev WHERE active AND name ILIKE '%a%' AND developer_id = 11 AND status = 'planned'")
on_market("catalogue_development", lambda k: cat.development(_full(k), _tree(k), k.developers, dev_id=77).select("id", "name", "area_name", "developer_name"), FULL + "SELECT d.id, d.name, n_name AS area_name, developer.name AS developer_name FROM full_dev d JOIN developer ON developer_id = developer.id WHERE d.id = 77")
on_market("catalogue_master_of", lambda k: cat.master_of(_full(k), 77).select("id", "name"), "SELECT id, name FROM dev WHERE id = 75")
on_market("catalogue_subs_of", lambda k: cat.subs_of(_full(k), 75).select("id", "name"), FULL + "SELECT id, name FROM full_dev WHERE master_of = 75")
on_market("catalogue_unit_supply", lambda k: cat.children(k.unit_supply, 89, "development_id").select("development_id", "total_units"), "SELECT p_partkey AS development_id, p_size * 10 AS total_units FROM part WHERE p_partkey = 89 AND p_size % 2 = 0")
on_market("catalogue_transactions", lambda k: cat.children(k.sales.withColumnRenamed("project_id", "development_id"), 77, F.desc("instance_date"), "sale_id", "line_no", limit=50).select("sale_id", "line_no", "instance_date"), "SELECT sale_id, line_no, day AS instance_date FROM sales WHERE project_id = 77 ORDER BY day DESC, sale_id, line_no LIMIT 50")
on_market("catalogue_unit_coverage", lambda k: cat.unit_coverage(_full(k).withColumn("total_units", F.when(F.col("id") % 6 != 0, F.col("total_units"))).replace({"MEDIUM": "Villa", "LARGE": "Semi townhouse"}, subset="development_type"), _tree(k), "r2"), FULL + "SELECT count(*) AS total, count(u) AS known_units, coalesce(sum(u), 0)::BIGINT AS residential_units, count(*) FILTER (dtype = 'MEDIUM') AS villas, count(*) FILTER (dtype = 'LARGE') AS townhouses FROM (SELECT *, CASE WHEN id % 6 <> 0 THEN units END AS u FROM full_dev WHERE active AND n_regionkey = 2)")
add("catalogue_area", lambda t: cat.area(_nodes(t), "n7").select("id", "name"), "SELECT 'n7' AS id, n_name AS name FROM nation WHERE n_nationkey = 7")
add("catalogue_sub_communities", lambda t: cat.sub_communities(t("nation").select("n_name", F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_area_id")), 3).select("name"), "SELECT n_name AS name FROM nation WHERE n_regionkey = 3")
_log = lambda t: t("orders").select(F.col("o_orderkey").alias("id"), pick(["new_record", "field_changed", "disappeared", "other"], F.col("o_orderkey")).alias("change_kind"), F.lit("development").alias("entity_type"), (F.col("o_custkey") % 100).alias("entity_key"), F.col("o_orderdate").alias("detected_at"))
add("catalogue_recent_changes", lambda t: cat.recent_changes(_log(t)).select("id", "change_kind"), "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'field_changed' ELSE 'disappeared' END AS change_kind FROM orders WHERE o_orderkey % 4 IN (1, 2) ORDER BY 1 DESC LIMIT 25")
add("catalogue_recent_discoveries", lambda t: cat.recent_discoveries(_log(t)).select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 ORDER BY 1 DESC LIMIT 25")
add("catalogue_change_history", lambda t: cat.changes_of(_log(t), "development", 7).select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 100 = 7")
_jobs = lambda t: t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.timestamp_add("SECOND", F.col("o_orderkey") % 9000, "o_orderdate").alias("finished_at"))
add("catalogue_jobs", lambda t: cat.jobs(_jobs(t)).select("id", "elapsed"), "SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS elapsed FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)")
add("catalogue_latest_job", lambda t: cat.jobs(_jobs(t), latest=True).select("id"), "SELECT max(o_orderkey) AS id FROM orders")
_crawl = lambda t: t("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("job_id"), F.col("event_type").alias("status"))
add("catalogue_queue_counts", lambda t: inc.queue_counts(_crawl(t), 1), "SELECT event_type AS status, count(*) AS n FROM events WHERE user_id % 3 = 1 GROUP BY 1")
add("catalogue_recent_errors", lambda t: cat.recent_errors(_crawl(t), 1), "SELECT event_id AS id, user_id % 3 AS job_id, event_type AS status FROM events WHERE user_id % 3 = 1 ORDER BY 1 DESC LIMIT 20")
add("catalogue_crawl_health", lambda t: cat.crawl_health(inc.requests_by_day(t("events").select(F.col("ts").alias("at"))), _crawl(t), part(t, nz.area_type(pick(AREAS, K())).alias("area_type")), t("supplier"), t("customer"), "2024-01-03"), "SELECT (SELECT count(*) FROM events WHERE ts::DATE = '2024-01-03') AS requests_today, (SELECT max(event_id) FROM events) AS last_error, (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS mall_count, (SELECT count(*) FROM part WHERE p_partkey % 5 = 1) AS landmark_count, (SELECT count(*) FROM supplier) AS mentioned_places, (SELECT count(*) FROM customer) AS entity_aliases")
on_market("catalogue_options", lambda k: cat.options(k.developments, "development_type"), "SELECT DISTINCT dtype AS development_type FROM dev")
on_market("nested_export", lambda k: export.nested(k.developers, {"developments": (k.developments.select("id", "name", "developer_id"), "developer_id")}).select("id", F.size("developments").alias("n"), F.get("developments", F.lit(0))["id"].alias("first_id")), "SELECT developer.id, count(dev.id)::INT AS n, min(dev.id) AS first_id FROM developer LEFT JOIN dev ON dev.developer_id = developer.id GROUP BY 1")

# -- pages and events -------------------------------------------------------------------------------------------------
add("page_kinds", lambda t: pg.kinds(t("pages")).select("page_id", "kind"), "SELECT page_id, 'unknown' AS kind FROM pages")
add("page_links", lambda t: pg.links(t("pages")).groupBy("source").agg(F.count(F.lit(1)).alias("links")))
add("page_areas", lambda t: pg.areas(t("pages")).select("url", "name", "area_type"))
add("page_log_dedupe", lambda t: t("pages").select(F.sha2(F.col("html").cast("binary"), 256).alias("content_hash")).dropDuplicates(["content_hash"]), "SELECT DISTINCT sha256(html) AS content_hash FROM pages")
add("event_windows", lambda t: ev.windowed(t("events"), "1 hour"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
add("event_sliding_windows", lambda t: ev.windowed(t("events"), "2 hours", "1 hour").drop("total"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
add("event_sessions", lambda t: ev.sessions(t("events")).select("user_id", "start", "n"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s")
add("bracketed_medians", lambda t: medians.exact_median(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median FROM lineitem GROUP BY 1, 2")


# -- warehouse --------------------------------------------------------------------------------------------------------


def warehouse_rebuild(t: T) -> DataFrame:
    """Staging rows made from the fact table, built into all warehouse tables; (name, n, total) of the facts and of dim_project."""
    text = lambda c: F.col(c).cast("string")
    rows = t("lineitem").join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lineage = [F.lit("made.csv").alias("source_file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_num"), F.lit("").alias("file_hash"), F.current_timestamp().alias("imported_at")]
    common = {"AREA_EN": F.col("s_name"), "PROJECT_EN": F.col("p_name"), "MASTER_PROJECT_EN": F.col("p_brand"), "ACTUAL_AREA": text("l_quantity")}
    sales = common | {"INSTANCE_DATE": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "GROUP_EN": F.lit("Sales"), "TRANS_VALUE": text("l_extendedprice"), "ROOMS_EN": F.concat(text("l_linenumber"), F.lit(" B/R")), "PROP_SB_TYPE_EN": F.lit("Flat")}
    rents = common | {"REGISTRATION_DATE": F.date_format("l_shipdate", "yyyy-MM-dd"), "ANNUAL_AMOUNT": text("l_extendedprice"), "ROOMS": text("l_linenumber"), "VERSION_EN": F.when(F.col("l_returnflag") == "R", "Renewed")}
    staged = lambda flag, columns, d: rows.where(F.col("l_linestatus") == flag).select(*[d.get(c, F.lit(None).cast("string")).alias(c) for c in columns], *lineage)
    brands = t("part").select("p_brand").distinct().select(F.substring("p_brand", 7, 4).cast("long").alias("id"), F.col("p_brand").alias("name"))
    nothing = F.lit(None).cast("string")
    catalogue = {
        "areas": t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), nothing.alias("dld_community_name_en"), nothing.alias("also_known_as")), "developers": brands,
        "developments": brands.select("id", "name", F.lit(1).cast("long").alias("area_id"), F.col("id").alias("developer_id")), "buildings": brands.where("false").select("id", F.col("id").alias("development_id"), "name"),
    }
    tables = warehouse.build(staged("F", staging.SALES.columns, sales), staged("O", staging.RENTALS.columns, rents), catalogue)
    total = lambda name, c: tables[name].agg(F.count("*").alias("n"), (metrics.money_sum(c) if c else F.lit(None).cast("double")).alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return total("fact_sales", "trans_value_aed").unionByName(total("fact_rentals", "annual_amount_aed")).unionByName(total("dim_project", None))


add("warehouse_rebuild", warehouse_rebuild, f"SELECT 'fact_sales' AS name, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'fact_rentals', count(*), sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'dim_project', count(DISTINCT {KEY.format(x='p_name')}), NULL FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
