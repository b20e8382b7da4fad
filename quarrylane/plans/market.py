"""The tables that market queries read, and the stand-in that maps the star-schema test tables onto them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import periods

SQFT = 10.7639
BEDROOMS = ["Studio", "1BR", "2BR", "3BR", "4BR", "5BR+", "Unknown", "Other"]
STATUSES = ["planned", "announced", "under_construction", "completed", "on_hold", "delayed", "cancelled", "other"]
UPCOMING = ["under_construction", "planned", "announced"]


@dataclass
class Market:
    """Facts, dimensions and catalogue tables as data frames; the bounds of the dates are looked up once."""

    sales: DataFrame
    rentals: DataFrame
    area: DataFrame
    project: DataFrame
    master: DataFrame
    developments: DataFrame
    developers: DataFrame
    areas: DataFrame
    unit_supply: DataFrame
    _bounds: list[tuple[date, date]] = field(default_factory=list)

    def period(self, name: str = "30d", start: str | None = None, end: str | None = None) -> periods.Period:
        if not self._bounds:
            self._bounds.append(periods.bounds(self.sales, self.rentals))
        return periods.resolve(*self._bounds[0], name, start, end)

    @property
    def sold(self) -> DataFrame:
        return self.sales.where(F.col("group_en") == "Sales")


def stand_in(spark: SparkSession, sf_dir: str) -> Market:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    item, part, supplier, nation = read("lineitem"), read("part"), read("supplier"), read("nation")
    bedroom = F.when(F.col("l_linenumber") <= 4, F.concat(F.col("l_linenumber").cast("string"), F.lit("BR"))).otherwise("5BR+")
    kind = F.element_at(F.array(*map(F.lit, ("Apartment", "Villa", "Townhouse"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    facts = dict(
        area_id=F.col("l_suppkey"), project_id=F.col("l_partkey"), canonical_bedroom=bedroom, canonical_property_type=kind, area_sqm=F.col("l_quantity"),
    )
    day, value = F.col("l_shipdate").cast("date"), F.col("l_extendedprice")
    psf = value / (F.col("l_quantity") * F.lit(SQFT))
    named = lambda d: [c.alias(k) for k, c in d.items()]
    sales = item.where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("sale_id"), F.col("l_linenumber").alias("line_no"), day.alias("instance_date"), F.lit("Sales").alias("group_en"),
        (F.col("l_returnflag") == "A").alias("is_offplan"), *named(facts), value.alias("trans_value_aed"), psf.alias("price_per_sqft_aed"),
    )
    rentals = item.where("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("rental_id"), F.col("l_linenumber").alias("line_no"), day.alias("registration_date"), (F.col("l_returnflag") == "R").alias("is_renewal"),
        *named(facts), value.alias("annual_amount_aed"), psf.alias("rent_per_sqft_aed"),
    )
    nation = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    area = supplier.join(nation, F.col("s_nationkey") == F.col("id")).select(
        F.col("s_suppkey").alias("area_id"), F.col("s_name").alias("dld_area_name"), F.concat(F.lit("s"), "s_nationkey").alias("community_key"),
        F.col("name").alias("community_name"), F.col("s_nationkey").alias("scraped_area_id"),
        F.when(F.col("s_suppkey") % 4 == 0, "exact").when(F.col("s_suppkey") % 4 == 1, "fuzzy_low").otherwise("unmatched").alias("match_confidence"),
        (F.col("s_suppkey") % 40 + 60).cast("double").alias("match_score"),
    )
    brand = F.substring("p_brand", 7, 4).cast("int")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("p_size") % 8 + 1).cast("int"))
    project = part.select(
        F.col("p_partkey").alias("project_id"), F.col("p_name").alias("dld_project_name"), F.col("p_partkey").alias("matched_development_id"), brand.alias("master_project_id"),
        F.col("p_partkey").cast("string").alias("building_label"), F.concat(F.lit("b-"), "p_partkey").alias("building_slug"),
        F.when(F.col("p_partkey") % 3 == 0, "trailing_number").when(F.col("p_partkey") % 3 == 1, "hyphen_split").otherwise("none").alias("grouping_method"),
        F.when(F.col("p_partkey") % 5 == 0, "exact").when(F.col("p_partkey") % 5 == 1, "fuzzy_high").otherwise("unmatched").alias("match_confidence"),
    )
    master = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("building_count"), F.max(F.col("p_partkey") % 3 == 1).alias("needs_review")).select(
        brand.alias("master_project_id"), F.lower(F.translate("p_brand", "#", " ")).alias("canonical_key"), F.col("p_brand").alias("display_name"),
        F.lower(F.translate("p_brand", "#", "-")).alias("slug"), "building_count", "needs_review",
    )
    developments = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 25).cast("int").alias("area_id"), brand.alias("developer_id"),
        status.alias("normalized_status"), (F.col("p_size") * 10).alias("total_units"), (F.col("p_size") % 5 != 0).alias("is_active"), F.col("p_type").alias("development_type"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("latitude"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("longitude"),
        F.concat((F.col("p_size") % 9 + 2020).cast("string"), F.lit("-06")).alias("estimated_completion_date"),
    )
    developers = part.select(brand.alias("id"), F.col("p_brand").alias("name")).distinct()
    supply = part.where("p_size % 2 = 0").select(
        F.col("p_partkey").alias("development_id"), (F.col("p_size") * 10).alias("total_units"), F.col("p_size").alias("studios"),
        *[(F.col("p_size") * k).alias(f"beds_{k}") for k in (1, 2, 3)], (F.col("p_size") % 7).alias("villas"),
    )
    return Market(sales, rentals, area, project, master, developments, developers, nation, supply)


#: The same mapping in SQL: a prelude of common table expressions for the oracle queries.
PRELUDE = """
WITH items AS (SELECT *, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber <= 4 THEN l_linenumber || 'BR' ELSE '5BR+' END AS bed,
    ['Apartment', 'Villa', 'Townhouse'][l_partkey % 3 + 1] AS kind, l_extendedprice / (l_quantity * 10.7639) AS psf FROM lineitem),
sales AS (SELECT l_orderkey AS sale_id, l_linenumber AS line_no, day, l_returnflag = 'A' AS is_offplan, l_suppkey AS area_id, l_partkey AS project_id, bed, kind,
    l_quantity AS sqm, l_extendedprice AS val, psf FROM items WHERE l_linestatus = 'F'),
rentals AS (SELECT l_orderkey AS rental_id, l_linenumber AS line_no, day, l_returnflag = 'R' AS is_renewal, l_suppkey AS area_id, l_partkey AS project_id, bed, kind,
    l_quantity AS sqm, l_extendedprice AS val, psf FROM items WHERE l_linestatus = 'O'),
area AS (SELECT s_suppkey AS area_id, 's' || s_nationkey AS ck, n_name AS cn, s_nationkey AS scraped,
    CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy_low' ELSE 'unmatched' END AS conf, (s_suppkey % 40 + 60)::DOUBLE AS score, s_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
project AS (SELECT p_partkey AS project_id, p_name AS pname, CAST(substr(p_brand, 7, 4) AS INT) AS master_id, 'b-' || p_partkey AS bslug, p_partkey::VARCHAR AS blabel,
    CASE p_partkey % 3 WHEN 0 THEN 'trailing_number' WHEN 1 THEN 'hyphen_split' ELSE 'none' END AS method,
    CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy_high' ELSE 'unmatched' END AS conf FROM part),
master AS (SELECT CAST(substr(p_brand, 7, 4) AS INT) AS master_id, p_brand AS mname, lower(replace(p_brand, '#', '-')) AS slug, count(*) AS buildings, max(p_partkey % 3 = 1) AS review
    FROM part GROUP BY p_brand),
dev AS (SELECT p_partkey AS id, p_name AS name, (p_partkey % 25)::INT AS scraped, CAST(substr(p_brand, 7, 4) AS INT) AS developer_id,
    ['planned', 'announced', 'under_construction', 'completed', 'on_hold', 'delayed', 'cancelled', 'other'][p_size % 8 + 1] AS status, p_size * 10 AS units, p_size % 5 <> 0 AS active,
    p_type AS dtype, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS lat, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS lng, (p_size % 9 + 2020) || '-06' AS done FROM part),
developer AS (SELECT DISTINCT CAST(substr(p_brand, 7, 4) AS INT) AS id, p_brand AS name FROM part),
supply AS (SELECT p_partkey AS dev_id, p_size * 10 AS units, p_size AS studios, p_size * 1 AS beds_1, p_size * 2 AS beds_2, p_size * 3 AS beds_3, p_size % 7 AS villas FROM part WHERE p_size % 2 = 0),
top AS (SELECT max(day) AS hi, min(day) AS lo FROM items)
"""


def window(days: int) -> str:
    """A CTE w with the bounds of a period of so many days and of the one before it."""
    return f", w AS (SELECT hi - {days - 1} AS s, hi AS e, hi - {2 * days - 1} AS ps, hi - {days} AS pe FROM top)"
