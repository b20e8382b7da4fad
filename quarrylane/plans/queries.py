"""Market queries: (market, parameters) to one data frame each.

Two periods are compared in one pass with conditional aggregates. Facts are reduced before they meet a dimension; joins
carry no hints, so adaptive execution picks broadcast or sort-merge from real sizes. Every top-k breaks ties by a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import metrics as m
from quarrylane.functions.periods import Period
from quarrylane.operators.medians import with_medians
from quarrylane.plans.market import BEDROOMS, UPCOMING, Market


def count_when(c: Column) -> Column:
    return F.count(F.when(c, 1))


def communities(facts: DataFrame, mk: Market) -> DataFrame:
    """Facts with their community; area ids unknown to the dimension drop out."""
    return facts.join(mk.area.select("area_id", "community_key", "community_name"), "area_id")


def in_community(facts: DataFrame, mk: Market, key: str | None) -> DataFrame:
    return facts if key is None else facts.join(mk.area.where(F.col("community_key") == key).select("area_id"), "area_id", "left_semi")


def _two_windows(facts: DataFrame, p: Period, day: str) -> DataFrame:
    return facts.where(p.either(day)).withColumn("_cur", p.cur(day)).withColumn("_prev", p.prev(day))


# -- overview ---------------------------------------------------------------------------------------------------------


def sales_kpis(mk: Market, p: Period, community: str | None = None) -> DataFrame:
    """One row: count, value, average and medians of the period, and changes against the one before."""
    f = _two_windows(in_community(mk.sold, mk, community), p, "instance_date")
    cur = lambda c: F.when(F.col("_cur"), F.col(c))
    a = f.agg(
        count_when(F.col("_cur")).alias("sales_count"), count_when(F.col("_prev")).alias("prev_count"), m.money_sum(cur("trans_value_aed")).alias("value"),
        m.money_sum(F.when(F.col("_prev"), F.col("trans_value_aed"))).alias("prev_value"),
    )
    a = with_medians(a, f, [], {"median_price": cur("trans_value_aed"), "median_psf": cur("price_per_sqft_aed")})
    return a.select(
        "sales_count", "value", m.ratio("value", "sales_count").alias("avg_price"), "median_price", m.rounded("median_psf", 4).alias("median_psf"),
        m.pct_change("sales_count", "prev_count").alias("change_pct"), m.pct_change("value", "prev_value").alias("value_change_pct"),
        m.confidence("sales_count").alias("confidence"),
    )


def rental_kpis(mk: Market, p: Period, community: str | None = None) -> DataFrame:
    f = _two_windows(in_community(mk.rentals, mk, community), p, "registration_date")
    cur = F.when(F.col("_cur"), F.col("annual_amount_aed"))
    a = f.agg(count_when(F.col("_cur")).alias("rental_count"), count_when(F.col("_prev")).alias("prev_count"), m.money_avg(cur).alias("avg_rent"))
    a = with_medians(a, f, [], {"median_rent": cur})
    return a.select("rental_count", "avg_rent", "median_rent", m.pct_change("rental_count", "prev_count").alias("change_pct"), m.confidence("rental_count").alias("confidence"))


def overview(mk: Market, p: Period, community: str | None = None) -> DataFrame:
    """The overview page as one row: both fact summaries, yield, leaders and supply."""
    named = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    parts = [named(sales_kpis(mk, p, community), "s"), named(rental_kpis(mk, p, community), "r"), named(best_selling_type(mk, p), "type"), named(top_rental_area(mk, p), "area"), named(growth_area(mk, p), "growth"), named(largest_supply(mk), "supply"), supply_totals(mk)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True), "left")
    return out.withColumn("estimated_gross_yield_pct", m.gross_yield("r_median_rent", "s_median_price")).withColumn("value_formatted", m.format_aed("s_value"))


def best_selling_type(mk: Market, p: Period) -> DataFrame:
    g = mk.sold.where(p.cur("instance_date")).groupBy("canonical_bedroom").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.asc_nulls_last("canonical_bedroom")).limit(1)


def top_rental_area(mk: Market, p: Period) -> DataFrame:
    by_area = mk.rentals.where(p.cur("registration_date")).groupBy("area_id").agg(F.count("*").alias("n"))
    g = communities(by_area, mk).groupBy("community_name").agg(F.sum("n").alias("n"))
    return g.orderBy(F.desc("n"), F.asc_nulls_last("community_name")).limit(1)


def growth_area(mk: Market, p: Period, least: int = 5) -> DataFrame:
    g = _area_counts(mk.sold, mk, p, "instance_date").where(F.col("current_count") >= least)
    g = g.orderBy(F.desc(F.col("current_count") - F.col("previous_count")), F.asc_nulls_last("community_key")).limit(1)
    return g.select("community_name", "current_count", "previous_count", m.pct_change("current_count", "previous_count").alias("change_pct"))


def largest_supply(mk: Market) -> DataFrame:
    d = mk.developments.select(F.col("id").alias("development_id"), F.col("area_id").alias("_area"))
    a = mk.areas.select(F.col("id").alias("_area"), F.col("name").alias("area"))
    g = mk.unit_supply.where("total_units is not null").join(d, "development_id").join(a, "_area")
    return g.orderBy(F.desc("total_units"), F.asc("development_id")).limit(1).select("area", F.col("total_units").cast("long").alias("units"))


def supply_totals(mk: Market) -> DataFrame:
    d = mk.developments.where("is_active").agg(F.count("*").alias("active_projects"), count_when(F.col("normalized_status") == "under_construction").alias("under_construction"))
    return d.join(mk.unit_supply.agg(F.sum(F.col("total_units").cast("long")).alias("known_units")), F.lit(True), "left")


# -- growth, pulse and signals ----------------------------------------------------------------------------------------


def _area_counts(facts: DataFrame, mk: Market, p: Period, day: str) -> DataFrame:
    by_area = _two_windows(facts, p, day).groupBy("area_id").agg(count_when(F.col("_cur")).alias("c"), count_when(F.col("_prev")).alias("q"))
    return communities(by_area, mk).groupBy("community_key", "community_name").agg(F.sum("c").alias("current_count"), F.sum("q").alias("previous_count"))


def area_growth(mk: Market, p: Period, rentals: bool = False, least: int = 10) -> DataFrame:
    """Per community: counts of both periods, their change, the current median and the momentum."""
    facts, day, value = (mk.rentals, "registration_date", "annual_amount_aed") if rentals else (mk.sold, "instance_date", "trans_value_aed")
    g = communities(_two_windows(facts, p, day), mk).groupBy("community_key", "community_name")
    a = g.agg(count_when(F.col("_cur")).alias("current_count"), count_when(F.col("_prev")).alias("previous_count"), F.median(F.when(F.col("_cur"), F.col(value))).alias("median_value"))
    a = a.where(F.col("current_count") >= least).withColumn("change_pct", m.pct_change("current_count", "previous_count")).where("change_pct is not null")
    return a.withColumn("momentum", m.momentum("change_pct"))


def fastest_growing(mk: Market, p: Period, limit: int = 5) -> DataFrame:
    return area_growth(mk, p).orderBy(F.desc("change_pct"), "community_key").limit(limit)


def cooling(mk: Market, p: Period, limit: int = 5) -> DataFrame:
    return area_growth(mk, p).where("change_pct < 0").orderBy("change_pct", "community_key").limit(limit)


def rental_hotspots(mk: Market, p: Period, limit: int = 5) -> DataFrame:
    return area_growth(mk, p, rentals=True).orderBy(F.desc("change_pct"), "community_key").limit(limit)


def hot_projects(mk: Market, p: Period, limit: int = 5, least: int = 5, ratio_from: float = 2.0, avg_from: float = 1.0, places: int = 2) -> DataFrame:
    """Projects whose period count is a multiple of their monthly average over the six months before.

    The first 3 * limit by ratio are taken before the thin-baseline filter, as the ratio's definition wants.
    """
    day = F.col("instance_date")
    before = day.between(F.add_months(F.lit(p.start), -6), F.date_sub(F.lit(p.start), 1))
    g = mk.sold.where("project_id is not null").where(p.cur("instance_date") | before).groupBy("project_id")
    a = g.agg(count_when(p.cur("instance_date")).alias("current_count"), (count_when(before) / F.lit(6.0)).alias("avg"))
    a = a.where((F.col("current_count") >= least) & (F.col("avg") > 0)).withColumn("_r", F.col("current_count") / F.col("avg"))
    a = a.orderBy(F.desc("_r"), "project_id").limit(3 * limit).where(F.col("avg") >= avg_from).withColumn("ratio", m.rounded("_r", places)).where(F.col("ratio") >= ratio_from)
    a = a.join(mk.project.select("project_id", F.col("dld_project_name").alias("project_name")), "project_id")
    return a.orderBy(F.desc("ratio"), "project_id").limit(limit).select("project_id", "project_name", "current_count", m.rounded("avg", 1).alias("trailing_monthly_avg"), "ratio")


def by_developer(facts: DataFrame, mk: Market) -> DataFrame:
    d = mk.project.select("project_id", F.col("matched_development_id").alias("_dev")).join(mk.developments.select(F.col("id").alias("_dev"), "developer_id"), "_dev")
    return facts.join(d.select("project_id", "developer_id"), "project_id")


def developer_momentum(mk: Market, p: Period, limit: int = 5, least: int = 5) -> DataFrame:
    by_project = _two_windows(mk.sold, p, "instance_date").groupBy("project_id").agg(count_when(F.col("_cur")).alias("c"), count_when(F.col("_prev")).alias("q"))
    g = by_developer(by_project, mk).groupBy("developer_id").agg(F.sum("c").alias("current_count"), F.sum("q").alias("previous_count"))
    g = g.where(F.col("current_count") >= least).join(mk.developers.select(F.col("id").alias("developer_id"), F.col("name").alias("developer_name")), "developer_id")
    g = g.withColumn("change_pct", m.pct_change("current_count", "previous_count")).where("change_pct is not null")
    return g.orderBy(F.desc("change_pct"), "developer_id").limit(limit).drop("developer_id")


def signal_dominant(mk: Market, p: Period, limit: int = 5, least: int = 15, share_from: float = 35.0) -> DataFrame:
    """Bedroom types that hold a large share of a community's rentals; unknown types count in the total only."""
    by_area = mk.rentals.where(p.cur("registration_date")).groupBy("area_id", "canonical_bedroom").agg(F.count("*").alias("c"))
    g = communities(by_area, mk).groupBy("community_key", "community_name", "canonical_bedroom").agg(F.sum("c").alias("c"))
    g = g.withColumn("total", F.sum("c").over(Window.partitionBy("community_key", "community_name"))).where((F.col("total") >= least) & ~F.col("canonical_bedroom").isin("Unknown", "Other"))
    share = m.rounded(F.lit(100.0) * F.col("c") / F.col("total"), 1)
    g = g.withColumn("share_pct", share).where(F.col("share_pct") >= share_from)
    return g.orderBy(F.desc(F.col("c") / F.col("total")), "community_key", "canonical_bedroom").limit(limit).select("community_name", "canonical_bedroom", "c", "total", "share_pct")


def signal_growth(mk: Market, p: Period, limit: int = 5, least: int = 15, growth_from: float = 20.0) -> DataFrame:
    g = _area_counts(mk.rentals, mk, p, "registration_date").where(F.col("current_count") >= least)
    g = g.withColumn("change_pct", m.pct_change("current_count", "previous_count")).where(F.col("change_pct") >= growth_from)
    return g.orderBy(F.desc("change_pct"), F.desc("community_name"), "community_key").limit(limit).select("community_name", "current_count", "previous_count", "change_pct")


def signal_rent_vs_psf(mk: Market, p: Period, least: int = 10, rent_from: float = 8.0, band: float = 3.0, limit: int | None = None) -> DataFrame:
    """Community and bedroom pairs whose median rent rose while the community's price per area stayed flat."""
    rent = communities(_two_windows(mk.rentals.where(~F.col("canonical_bedroom").isin("Unknown", "Other")), p, "registration_date"), mk)
    value = F.col("annual_amount_aed")
    rent = rent.groupBy("community_key", "community_name", "canonical_bedroom").agg(
        F.median(F.when(F.col("_cur"), value)).alias("cur_rent"), F.median(F.when(F.col("_prev"), value)).alias("prev_rent"),
        count_when(F.col("_cur")).alias("n"), count_when(F.col("_prev")).alias("prev_n"),
    )
    sold = communities(_two_windows(mk.sold, p, "instance_date"), mk)
    psf = sold.groupBy("community_key").agg(F.median(F.when(F.col("_cur"), F.col("price_per_sqft_aed"))).alias("cur_psf"), F.median(F.when(F.col("_prev"), F.col("price_per_sqft_aed"))).alias("prev_psf"))
    g = rent.where((F.col("n") >= least) & (F.col("prev_n") >= least)).join(psf, "community_key")
    g = g.withColumn("rent_pct", m.pct_change("cur_rent", "prev_rent")).withColumn("psf_pct", m.pct_change("cur_psf", "prev_psf"))
    g = g.where((F.col("rent_pct") >= rent_from) & (F.abs("psf_pct") <= band))
    out = g.select("community_name", "canonical_bedroom", "n", "rent_pct", "psf_pct").orderBy(F.desc("rent_pct"), "community_name", "canonical_bedroom")
    return out if limit is None else out.limit(limit)


def _upcoming_by_community(mk: Market) -> DataFrame:
    """Upcoming units per community; a catalogue area counts once per community, however many area ids it has."""
    u = mk.unit_supply.join(mk.developments.where(F.col("normalized_status").isin(*UPCOMING)).select(F.col("id").alias("development_id"), F.col("area_id").alias("scraped_area_id")), "development_id")
    per_area = u.groupBy("scraped_area_id").agg(F.sum(F.col("total_units").cast("long")).alias("u"))
    once = mk.area.where("scraped_area_id is not null").select("scraped_area_id", "community_key", "community_name").distinct()
    return per_area.join(once, "scraped_area_id").groupBy("community_key", "community_name").agg(F.sum("u").alias("incoming_units"))


def signal_supply(mk: Market, p: Period, limit: int = 5) -> DataFrame:
    """Communities whose upcoming units are high against a year's rental demand."""
    by_area = mk.rentals.where(p.cur("registration_date")).groupBy("area_id").agg(F.count("*").alias("n"))
    rented = communities(by_area, mk).groupBy("community_key").agg(F.sum("n").alias("rentals"))
    g = _upcoming_by_community(mk).join(rented, "community_key", "left")
    g = g.withColumn("annual_demand", m.annualised(F.coalesce("rentals", F.lit(0)), p.days)).withColumn("risk", m.oversupply_risk("incoming_units", "annual_demand"))
    g = g.where(F.col("risk").isin("high", "very_high")).withColumn("ratio", m.oversupply_ratio("incoming_units", "annual_demand"))
    return g.orderBy(F.desc("incoming_units"), "community_key").limit(limit).select("community_name", "incoming_units", "annual_demand", "ratio", "risk")


# -- communities ------------------------------------------------------------------------------------------------------


def _community_stats(mk: Market, p: Period) -> DataFrame:
    s = communities(mk.sold.where(p.cur("instance_date")), mk).groupBy("community_key").agg(F.count("*").alias("sales_count"), F.median("trans_value_aed").alias("median_price"), F.median("price_per_sqft_aed").alias("median_psf"))
    r = communities(mk.rentals.where(p.cur("registration_date")), mk).groupBy("community_key").agg(F.count("*").alias("rental_count"), F.median("annual_amount_aed").alias("median_rent"))
    names = mk.area.groupBy("community_key").agg(F.min("community_name").alias("community_name"))
    g = names.join(s, "community_key", "left").join(r, "community_key", "left")
    return g.withColumn("sales_count", F.coalesce("sales_count", F.lit(0))).withColumn("rental_count", F.coalesce("rental_count", F.lit(0)))


def community_list(mk: Market, p: Period, sort: str = "sales_count", page: int = 1, page_size: int = 50, search: str | None = None) -> DataFrame:
    """A page of communities; sort is one of the columns, unknown names mean sales_count."""
    g = _community_stats(mk, p)
    if search:
        g = g.where(F.col("community_name").ilike(f"%{search}%"))
    sort = sort if sort in ("sales_count", "rental_count", "median_price", "median_psf", "median_rent", "yield_pct") else "sales_count"
    g = g.withColumn("yield_pct", m.gross_yield("median_rent", "median_price")).orderBy(F.desc_nulls_last(sort), "community_key")
    return g.offset((page - 1) * page_size).limit(page_size).withColumn("median_psf", m.rounded("median_psf", 4))


def community_summary(mk: Market, p: Period, keys: list[str] | None = None) -> DataFrame:
    """Detail figures for all or the given communities in one grouped pass: facts, yield, demand and supply risk."""
    area = mk.area if keys is None else mk.area.where(F.col("community_key").isin(keys))
    from dataclasses import replace

    mk = replace(mk, area=area)
    value = communities(mk.sold.where(p.cur("instance_date")), mk).groupBy("community_key").agg(m.money_sum("trans_value_aed").alias("sales_value"))
    leases = communities(mk.rentals.where(p.cur("registration_date")), mk).groupBy("community_key").agg(count_when(F.col("is_renewal")).alias("renewals"), count_when(~F.col("is_renewal")).alias("new_leases"))
    g = _community_stats(mk, p).join(value, "community_key", "left").join(leases, "community_key", "left").join(_upcoming_by_community(mk).drop("community_name"), "community_key", "left")
    demand = m.annualised(F.col("sales_count") + F.col("rental_count"), p.days)
    g = g.withColumn("annual_demand", demand)
    return g.select(
        "community_key", "community_name", "sales_count", "sales_value", "median_price", "rental_count", "median_rent", F.coalesce("renewals", F.lit(0)).alias("renewals"),
        F.coalesce("new_leases", F.lit(0)).alias("new_leases"), m.gross_yield("median_rent", "median_price").alias("yield_pct"), "incoming_units", "annual_demand",
        m.oversupply_risk("incoming_units", "annual_demand").alias("risk"),
    )


def compare_communities(mk: Market, p: Period, keys: list[str]) -> DataFrame:
    if not 2 <= len(keys) <= 5:
        raise ValueError("compare two to five communities")
    return community_summary(mk, p, keys)


def bedroom_split(mk: Market, p: Period, community: str | None = None, rentals: bool = False) -> DataFrame:
    facts, day = (mk.rentals, "registration_date") if rentals else (mk.sold, "instance_date")
    g = in_community(facts.where(p.cur(day)), mk, community).groupBy("canonical_bedroom").agg(F.count("*").alias("n"))
    return g.withColumn("share_pct", m.market_share("n", F.sum("n").over(Window.partitionBy())))


def community_top_projects(mk: Market, p: Period, community: str, limit: int = 10) -> DataFrame:
    g = in_community(mk.sold.where(p.cur("instance_date")), mk, community).groupBy("project_id").agg(F.count("*").alias("n"), F.median("trans_value_aed").alias("median_price"))
    g = g.join(mk.project.select("project_id", F.col("dld_project_name").alias("project_name")), "project_id")
    return g.orderBy(F.desc("n"), "project_id").limit(limit)


def community_developers(mk: Market, community: str, limit: int = 10) -> DataFrame:
    """Developers with active developments in the community, and their upcoming units."""
    areas = mk.area.where(F.col("community_key") == community).select(F.col("scraped_area_id").alias("area_id")).distinct()
    d = mk.developments.join(areas, "area_id", "left_semi")
    upcoming = F.when(F.col("normalized_status").isin(*UPCOMING), F.col("total_units"))
    g = d.groupBy("developer_id").agg(F.count("*").alias("developments"), F.sum(upcoming.cast("long")).alias("upcoming_units"))
    g = g.join(mk.developers.select(F.col("id").alias("developer_id"), F.col("name").alias("developer_name")), "developer_id")
    return g.orderBy(F.desc("developments"), "developer_id").limit(limit).drop("developer_id")


# -- breakdowns and trends --------------------------------------------------------------------------------------------


def _labelled(facts: DataFrame, mk: Market, by: str, rentals: bool) -> DataFrame:
    """Facts with label; unknown dimensions mean community."""
    plain = {"property_type": F.col("canonical_property_type"), "bedroom": F.col("canonical_bedroom")}
    if rentals:
        plain["contract_type"] = F.when(F.col("is_renewal"), "Renewal").otherwise("New")
    else:
        plain["offplan"] = F.when(F.col("is_offplan"), "Off-plan").otherwise("Ready")
    if by in plain:
        return facts.withColumn("label", plain[by])
    if by == "project":
        return facts.join(mk.project.select("project_id", F.col("dld_project_name").alias("label")), "project_id", "left")
    if by == "developer" and not rentals:
        return by_developer(facts, mk).join(mk.developers.select(F.col("id").alias("developer_id"), F.col("name").alias("label")), "developer_id", "left")
    return communities(facts, mk).withColumnRenamed("community_name", "label")


def breakdown(mk: Market, p: Period, by: str = "community", rentals: bool = False, limit: int = 20) -> DataFrame:
    """Counts, value and median by a dimension. Shares are of the returned rows."""
    facts, day, value = (mk.rentals, "registration_date", "annual_amount_aed") if rentals else (mk.sold, "instance_date", "trans_value_aed")
    rows = _labelled(facts.where(p.cur(day)), mk, by, rentals).where("label is not null").select("label", value)
    g = rows.groupBy("label").agg(F.count("*").alias("n"), m.money_sum(value).alias("total_value")).orderBy(F.desc("n"), "label").limit(limit)
    g = with_medians(g, rows.join(g.select("label"), "label", "left_semi"), ["label"], {"median_value": F.col(value)})
    return g.withColumn("share_pct", m.market_share("n", F.sum("n").over(Window.partitionBy())))


def trend(mk: Market, p: Period, grain: str = "week", rentals: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Tumbling buckets of a day, an ISO week or a month; buckets without rows are absent."""
    day, value = ("registration_date", "annual_amount_aed") if rentals else ("instance_date", "trans_value_aed")
    facts = facts if facts is not None else (mk.rentals if rentals else mk.sold)
    bucket = F.col(day) if grain == "day" else F.trunc(day, "week" if grain == "week" else "month")
    extra = [count_when(F.col("is_renewal")).alias("renewals"), count_when(~F.col("is_renewal")).alias("new_leases")] if rentals else [m.money_sum(value).alias("total_value")]
    rows = facts.where(p.cur(day)).withColumn("bucket", bucket)
    g = rows.groupBy("bucket").agg(F.count("*").alias("n"), *extra)
    return with_medians(g, rows, ["bucket"], {"median_value": F.col(value)})


def demand_matrix(mk: Market, p: Period, top: int = 10, share: bool = False) -> DataFrame:
    """Rentals of the busiest communities by bedroom type, as counts or as shares of the row."""
    by_area = mk.rentals.where(p.cur("registration_date")).groupBy("area_id", "canonical_bedroom").agg(F.count("*").alias("c"))
    cells = communities(by_area, mk).groupBy("community_key", "community_name", "canonical_bedroom").agg(F.sum("c").alias("c"))
    best = cells.groupBy("community_key").agg(F.sum("c").alias("total")).orderBy(F.desc("total"), "community_key").limit(top)
    grid = cells.join(best, "community_key").groupBy("community_key", "community_name", "total").pivot("canonical_bedroom", BEDROOMS).agg(F.sum("c")).na.fill(0, BEDROOMS)
    if share:
        for b in BEDROOMS:
            grid = grid.withColumn(b, m.market_share(F.col(f"`{b}`"), F.col("total")))
    return grid.select("community_key", "community_name", "total", *[F.col(f"`{b}`").alias("b_" + b.lower().replace("+", "_up")) for b in BEDROOMS])


def unit_types(mk: Market, p: Period, community: str | None = None) -> DataFrame:
    s = _two_windows(in_community(mk.sold, mk, community), p, "instance_date").groupBy("canonical_bedroom").agg(
        count_when(F.col("_cur")).alias("sales_count"), count_when(F.col("_prev")).alias("prev_sales"), F.median(F.when(F.col("_cur"), F.col("trans_value_aed"))).alias("median_price"))
    r = in_community(mk.rentals.where(p.cur("registration_date")), mk, community).groupBy("canonical_bedroom").agg(F.count("*").alias("rental_count"), F.median("annual_amount_aed").alias("median_rent"))
    g = s.join(r, "canonical_bedroom", "full_outer").na.fill(0, ["sales_count", "prev_sales", "rental_count"]).where("sales_count + rental_count > 0")
    return g.select(
        "canonical_bedroom", "sales_count", "rental_count", "median_price", "median_rent", m.market_share("sales_count", F.sum("sales_count").over(Window.partitionBy())).alias("sales_share_pct"),
        m.pct_change("sales_count", "prev_sales").alias("sales_change_pct"), m.gross_yield("median_rent", "median_price").alias("yield_pct"), m.confidence(F.least("sales_count", "rental_count")).alias("confidence"),
    )


# -- explorer ---------------------------------------------------------------------------------------------------------

TRUE = ("true", "True", "1")
#: Query parameter to predicate; both facts share most of them.
FILTERS: dict[str, Callable[[str, str, str], Column]] = {
    "community_key": lambda v, d, x: F.col("community_key") == v,
    "canonical_bedroom": lambda v, d, x: F.col("canonical_bedroom") == v,
    "canonical_property_type": lambda v, d, x: F.col("canonical_property_type") == v,
    "is_offplan": lambda v, d, x: F.col("is_offplan") == F.lit(v in TRUE),
    "is_renewal": lambda v, d, x: F.col("is_renewal") == F.lit(v in TRUE),
    "date_from": lambda v, d, x: F.col(d) >= F.lit(v).cast("date"),
    "date_to": lambda v, d, x: F.col(d) <= F.lit(v).cast("date"),
    "min_price": lambda v, d, x: F.col(x) >= float(v),
    "max_price": lambda v, d, x: F.col(x) <= float(v),
    "min_rent": lambda v, d, x: F.col(x) >= float(v),
    "max_rent": lambda v, d, x: F.col(x) <= float(v),
    "master_slug": lambda v, d, x: F.col("slug") == v,
    "building_slug": lambda v, d, x: F.col("building_slug") == v,
}


def explorer(mk: Market, rentals: bool = False, page: int | None = 1, page_size: int = 50, **params: str) -> DataFrame:
    """A page of facts under whitelisted filters, newest first; page None gives all rows."""
    if page_size > 500:
        raise ValueError("page_size is at most 500")
    facts, day, value, key = (mk.rentals, "registration_date", "annual_amount_aed", "rental_id") if rentals else (mk.sold, "instance_date", "trans_value_aed", "sale_id")
    rows = communities(facts, mk)
    if {"master_slug", "building_slug"} & params.keys():
        rows = rows.join(mk.project.select("project_id", "master_project_id", "building_slug"), "project_id", "left").join(mk.master.select("master_project_id", "slug"), "master_project_id", "left")
    for name, v in params.items():
        if name in FILTERS and v not in (None, ""):
            rows = rows.where(FILTERS[name](v, day, value))
    if page is not None:
        rows = rows.orderBy(F.desc(day), key, "line_no").offset((page - 1) * page_size).limit(page_size)
    names = mk.project.select("project_id", F.col("dld_project_name").alias("project_name"))
    return rows.join(names, "project_id", "left").select(key, "line_no", F.col(day).alias("day"), "community_name", "project_name", "canonical_bedroom", F.col(value).alias("value"))


def explorer_count(mk: Market, rentals: bool = False, **params: str) -> DataFrame:
    return explorer(mk, rentals, page=None, **params).agg(F.count("*").alias("n"))


# -- projects and developers ------------------------------------------------------------------------------------------


def map_developments(mk: Market) -> DataFrame:
    """Developments with coordinates and the sales recorded for them."""
    sold = mk.sold.groupBy("project_id").agg(F.count("*").alias("c")).join(mk.project.select("project_id", F.col("matched_development_id").alias("id")), "project_id").groupBy("id").agg(F.sum("c").alias("sales_count"))
    d = mk.developments.where("latitude is not null and longitude is not null")
    return d.join(sold, "id", "left").select("id", "name", "latitude", "longitude", "normalized_status", F.coalesce("sales_count", F.lit(0)).alias("sales_count"))


def project_list(mk: Market, p: Period, search: str | None = None, limit: int = 50) -> DataFrame:
    s = mk.sold.where(p.cur("instance_date")).groupBy("project_id").agg(F.count("*").alias("sales_count"), F.median("trans_value_aed").alias("median_price"))
    r = mk.rentals.where(p.cur("registration_date")).groupBy("project_id").agg(F.count("*").alias("rental_count"))
    d = mk.developments.select(F.col("id").alias("matched_development_id"), "normalized_status", "developer_id")
    names = mk.project if not search else mk.project.where(F.col("dld_project_name").ilike(f"%{search}%"))
    g = names.join(s, "project_id", "left").join(r, "project_id", "left").na.fill(0, ["sales_count", "rental_count"])
    g = g.orderBy(F.desc(F.col("sales_count") + F.col("rental_count")), "project_id").limit(limit)
    g = g.join(d, "matched_development_id", "left").join(mk.developers.select(F.col("id").alias("developer_id"), F.col("name").alias("developer_name")), "developer_id", "left")
    return g.select("project_id", F.col("dld_project_name").alias("project_name"), "sales_count", "rental_count", "median_price", "normalized_status", "developer_name")


def project_detail(mk: Market, p: Period, project_id: int | None = None) -> DataFrame:
    """Counts, medians, active months and liquidity, for one project or all."""
    sold = mk.sold.where(p.cur("instance_date"))
    sold = sold if project_id is None else sold.where(F.col("project_id") == project_id)
    g = sold.groupBy("project_id").agg(F.count("*").alias("sales_count"), F.median("trans_value_aed").alias("median_price"), F.countDistinct(F.trunc("instance_date", "month")).alias("active_months"), F.max("instance_date").alias("last_sale"))
    months = m.months_span(p.days)
    return g.withColumn("liquidity", m.liquidity("sales_count", months, m.consistency("active_months", months)))


def scope(facts: DataFrame, mk: Market, slug: str | None, building: str | None = None, unit_type: str | None = None, kind: str | None = None) -> DataFrame:
    """Facts of a master project, or of one building of it; off-plan and ready apply where the fact has them."""
    ids = mk.project.select("project_id", "master_project_id", "building_slug").join(mk.master.select("master_project_id", "slug"), "master_project_id")
    if slug is not None:
        ids = ids.where(F.col("slug") == slug)
    if building:
        ids = ids.where(F.col("building_slug") == building)
    facts = facts.join(ids.select("project_id"), "project_id", "left_semi")
    if unit_type:
        facts = facts.where(F.col("canonical_bedroom") == unit_type)
    if kind in ("offplan", "ready") and "is_offplan" in facts.columns:
        facts = facts.where(F.col("is_offplan") == F.lit(kind == "offplan"))
    return facts


def master_trailing(mk: Market, p: Period) -> DataFrame:
    """Per master project: sales in the last 30, 90 and 182 days of the period and the daily velocity, in one pass."""
    day, end = F.col("instance_date"), F.lit(p.end)
    last = lambda n: count_when(day > F.date_sub(end, n))
    reach = max(182, p.days)
    per = mk.sold.where(day.between(F.date_sub(end, reach - 1), end)).groupBy("project_id").agg(last(30).alias("a"), last(90).alias("b"), last(182).alias("c"), last(p.days).alias("n"))
    g = per.join(mk.project.select("project_id", "master_project_id"), "project_id").groupBy("master_project_id").agg(*[F.sum(x).alias(y) for x, y in zip("abcn", ("sales_30d", "sales_90d", "sales_182d", "n"), strict=True)])
    return g.join(mk.master.select("master_project_id", "slug"), "master_project_id").select("slug", "sales_30d", "sales_90d", "sales_182d", m.rounded(F.col("n") / F.lit(float(p.days)), 3).alias("velocity_per_day"))


def master_unit_types(mk: Market, p: Period, slug: str) -> DataFrame:
    from dataclasses import replace

    return unit_types(replace(mk, sales=scope(mk.sales, mk, slug), rentals=scope(mk.rentals, mk, slug)), p)


def master_kpis(mk: Market, p: Period, slug: str, building: str | None = None, unit_type: str | None = None, kind: str | None = None) -> DataFrame:
    from dataclasses import replace

    part = replace(mk, sales=scope(mk.sales, mk, slug, building, unit_type, kind), rentals=scope(mk.rentals, mk, slug, building, unit_type, kind))
    named = lambda df, x: df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns])
    return named(sales_kpis(part, p), "s").join(named(rental_kpis(part, p), "r"), F.lit(True), "left")


def master_trend(mk: Market, p: Period, slug: str, rentals: bool = False) -> DataFrame:
    return trend(mk, p, "week", rentals, scope(mk.rentals if rentals else mk.sold, mk, slug))


def building_performance(mk: Market, p: Period, slug: str | None = None) -> DataFrame:
    """Per building: counts, averages, their yield and the last transaction."""
    s = scope(mk.sold.where(p.cur("instance_date")), mk, slug).groupBy("project_id").agg(F.count("*").alias("sales_count"), m.money_avg("trans_value_aed").alias("avg_price"), F.max("instance_date").alias("_s"))
    r = scope(mk.rentals.where(p.cur("registration_date")), mk, slug).groupBy("project_id").agg(F.count("*").alias("rental_count"), m.money_avg("annual_amount_aed").alias("avg_rent"), F.max("registration_date").alias("_r"))
    names = mk.project.join(mk.master.select("master_project_id", "slug"), "master_project_id")
    names = names if slug is None else names.where(F.col("slug") == slug)
    g = names.select("project_id", "slug", "building_label").join(s, "project_id", "left").join(r, "project_id", "left").na.fill(0, ["sales_count", "rental_count"])
    return g.select("project_id", "slug", "building_label", "sales_count", "rental_count", "avg_price", "avg_rent", m.gross_yield("avg_rent", "avg_price").alias("yield_pct"), F.greatest("_s", "_r").alias("last_transaction"))


def sales_vs_rentals(mk: Market, p: Period) -> DataFrame:
    """Per master project: both counts, their ratio, shares, and the busiest bedroom type."""
    tag = lambda df, k: df.groupBy("project_id", "canonical_bedroom").agg(F.count("*").alias("c")).withColumn("k", F.lit(k))
    both = tag(mk.sold.where(p.cur("instance_date")), "s").unionByName(tag(mk.rentals.where(p.cur("registration_date")), "r"))
    g = both.join(mk.project.select("project_id", "master_project_id"), "project_id").groupBy("master_project_id", "canonical_bedroom").agg(F.sum(F.when(F.col("k") == "s", F.col("c")).otherwise(0)).alias("s"), F.sum(F.when(F.col("k") == "r", F.col("c")).otherwise(0)).alias("r"))
    g = g.groupBy("master_project_id").agg(F.sum("s").alias("sales_count"), F.sum("r").alias("rental_count"), F.min_by("canonical_bedroom", F.struct(-(F.col("s") + F.col("r")), "canonical_bedroom")).alias("top_bedroom"))
    total = F.col("sales_count") + F.col("rental_count")
    return g.join(mk.master.select("master_project_id", "slug"), "master_project_id").select("slug", "sales_count", "rental_count", "top_bedroom", m.rounded(m.ratio("rental_count", "sales_count"), 2).alias("rental_to_sales"), m.market_share("sales_count", total).alias("sales_share_pct"))


def developer_share(mk: Market, p: Period, limit: int = 50) -> DataFrame:
    """Developers by sales; shares are of the returned rows, developers without sales come last."""
    sold = mk.sold.where(p.cur("instance_date")).groupBy("project_id").agg(F.count("*").alias("c"), m.money_sum("trans_value_aed").alias("v"))
    s = by_developer(sold, mk).groupBy("developer_id").agg(F.sum("c").alias("sales_count"), m.money_sum("v").alias("sales_value"))
    d = mk.developments.groupBy("developer_id").agg(F.countDistinct("id").alias("developments"))
    g = mk.developers.select(F.col("id").alias("developer_id"), F.col("name").alias("developer_name")).join(d, "developer_id", "left").join(s, "developer_id", "left")
    g = g.orderBy(F.desc_nulls_last("sales_count"), "developer_id").limit(limit)
    return g.select("developer_name", F.coalesce("developments", F.lit(0)).alias("developments"), "sales_count", "sales_value", m.market_share("sales_count", F.sum("sales_count").over(Window.partitionBy())).alias("share_pct"))


# -- supply, opportunities, decision ----------------------------------------------------------------------------------


def supply_status(mk: Market) -> DataFrame:
    return mk.developments.groupBy(F.coalesce("normalized_status", F.lit("other")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("total_units").cast("long")).alias("units"))


def supply_mix(mk: Market) -> DataFrame:
    """Sums of all unit columns; NULL when the table is empty."""
    return mk.unit_supply.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in mk.unit_supply.columns if c != "development_id"])


def supply_upcoming(mk: Market, by: str = "area", limit: int = 20) -> DataFrame:
    d = mk.developments.where(F.col("normalized_status").isin(*UPCOMING))
    key, names = ("area_id", mk.areas) if by == "area" else ("developer_id", mk.developers)
    g = d.groupBy(key).agg(F.count("*").alias("developments"), F.sum(F.col("total_units").cast("long")).alias("units")).join(names.select(F.col("id").alias(key), "name"), key)
    return g.orderBy(F.desc_nulls_last("units"), key).limit(limit).select("name", "developments", "units")


def _both_periods(mk: Market, p: Period) -> DataFrame:
    s = communities(_two_windows(mk.sold, p, "instance_date"), mk).groupBy("community_key", "community_name").agg(count_when(F.col("_cur")).alias("sales"), count_when(F.col("_prev")).alias("prev_sales"), F.median(F.when(F.col("_cur"), F.col("trans_value_aed"))).alias("price"), F.median(F.when(F.col("_prev"), F.col("trans_value_aed"))).alias("prev_price"))
    r = communities(_two_windows(mk.rentals, p, "registration_date"), mk).groupBy("community_key").agg(count_when(F.col("_cur")).alias("rentals"), count_when(F.col("_prev")).alias("prev_rentals"), F.median(F.when(F.col("_cur"), F.col("annual_amount_aed"))).alias("rent"), F.median(F.when(F.col("_prev"), F.col("annual_amount_aed"))).alias("prev_rent"))
    return s.join(r, "community_key", "left").na.fill(0, ["rentals", "prev_rentals"])


def opportunities_yield(mk: Market, p: Period, least: int = 15, limit: int = 15) -> DataFrame:
    g = _both_periods(mk, p).where((F.col("sales") >= least) & (F.col("rentals") >= least)).withColumn("yield_pct", m.gross_yield("rent", "price")).where("yield_pct is not null")
    return g.orderBy(F.desc("yield_pct"), "community_key").limit(limit).select("community_name", "sales", "rentals", "yield_pct")


def opportunities_rising(mk: Market, p: Period, least: int = 15, limit: int = 15, growth_from: float = 30.0) -> DataFrame:
    g = _both_periods(mk, p).where(F.col("sales") >= least).withColumn("change_pct", m.pct_change("sales", "prev_sales")).where(F.col("change_pct") >= growth_from)
    return g.orderBy(F.desc("change_pct"), "community_key").limit(limit).select("community_name", "sales", "prev_sales", "change_pct")


def opportunities_rent_vs_price(mk: Market, p: Period, least: int = 15, limit: int = 15, gap_from: float = 5.0) -> DataFrame:
    g = _both_periods(mk, p).where((F.col("rentals") >= least) & (F.col("prev_rentals") >= least))
    g = g.withColumn("rent_pct", m.pct_change("rent", "prev_rent")).withColumn("price_pct", m.pct_change("price", "prev_price")).where(F.col("rent_pct") > F.col("price_pct") + gap_from)
    return g.orderBy(F.desc(m.rounded(F.col("rent_pct") - F.col("price_pct"), 2)), "community_key").limit(limit).select("community_name", "rent_pct", "price_pct", m.rounded(F.col("rent_pct") - F.col("price_pct"), 2).alias("gap"))


def decision_engine(mk: Market, p: Period, priority: str = "balanced", risk_tolerance: str = "medium", budget_max: float | None = None, areas: list[str] | None = None, property_type: str | None = None, bedroom: str | None = None, ready_offplan: str = "either", limit: int | None = 10, least: int = 10) -> DataFrame:
    """Communities scored by yield, price growth and liquidity under a priority, less an oversupply penalty."""
    weights = m.PRIORITY_WEIGHTS.get(priority, m.PRIORITY_WEIGHTS["balanced"])
    times = m.RISK_MULTIPLIER.get(risk_tolerance, 1.0)
    sold, rented = mk.sold, mk.rentals
    for c, v in (("canonical_property_type", property_type), ("canonical_bedroom", bedroom)):
        if v:
            sold, rented = sold.where(F.col(c) == v), rented.where(F.col(c) == v)
    if ready_offplan in ("ready", "offplan"):
        sold = sold.where(F.col("is_offplan") == F.lit(ready_offplan == "offplan"))
    if budget_max is not None:
        sold = sold.where(F.col("trans_value_aed") <= budget_max)
    sold, rented = communities(_two_windows(sold, p, "instance_date"), mk), communities(rented.where(p.cur("registration_date")), mk)
    if areas:
        sold, rented = sold.where(F.col("community_key").isin(areas)), rented.where(F.col("community_key").isin(areas))
    cur = lambda c: F.when(F.col("_cur"), c)
    s = sold.groupBy("community_key", "community_name").agg(
        count_when(F.col("_cur")).alias("sales_count"), F.median(cur(F.col("trans_value_aed"))).alias("price"), F.median(cur(F.col("price_per_sqft_aed"))).alias("psf"),
        F.median(F.when(F.col("_prev"), F.col("price_per_sqft_aed"))).alias("prev_psf"), F.countDistinct(cur(F.trunc("instance_date", "month"))).alias("active_months"),
    ).where("sales_count > 0")
    r = rented.groupBy("community_key").agg(F.count("*").alias("rental_count"), F.median("annual_amount_aed").alias("rent"))
    g = s.join(r, "community_key", "left").na.fill(0, ["rental_count"]).where((F.col("sales_count") >= least) | (F.col("rental_count") >= least))
    g = g.join(_upcoming_by_community(mk).drop("community_name"), "community_key", "left")
    months = m.months_span(p.days)
    g = g.withColumn("yield_pct", m.gross_yield("rent", "price")).withColumn("growth_pct", m.pct_change("psf", "prev_psf"))
    g = g.withColumn("liquidity", m.liquidity("sales_count", months, m.consistency("active_months", months)))
    g = g.withColumn("risk", m.oversupply_risk("incoming_units", m.annualised(F.col("sales_count") + F.col("rental_count"), p.days)))
    parts = {"yield": m.yield_score("yield_pct"), "appreciation": m.appreciation_score("growth_pct"), "liquidity": F.col("liquidity")}
    penalty = F.element_at(F.create_map(*[x for k, v in m.OVERSUPPLY_PENALTY.items() for x in (F.lit(k), F.lit(v * times))]), F.col("risk"))
    base = m.weighted_score(parts, weights)
    g = g.withColumn("score", m.rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - penalty)), 1)).where(base.isNotNull())
    risks = F.filter(F.array(
        F.when(F.col("risk").isin("high", "very_high"), F.concat(F.lit("Oversupply risk: "), "risk")),
        F.when((F.col("sales_count") < 30) | (F.col("rental_count") < 30), F.format_string("Small sample (sales=%d, rentals=%d)", "sales_count", "rental_count")),
    ), lambda x: x.isNotNull())
    missing = F.filter(F.array(F.when(F.col("incoming_units").isNull(), "supply"), F.when(F.col("yield_pct").isNull(), "yield"), F.when(F.col("growth_pct").isNull(), "price momentum")), lambda x: x.isNotNull())
    why = F.concat_ws(", ", F.when(F.col("yield_pct").isNotNull(), F.format_string("estimated yield %.1f%%", "yield_pct")), F.when(F.col("growth_pct").isNotNull(), F.format_string("price per area %+.1f%%", "growth_pct")), F.format_string("liquidity %.0f/100", "liquidity"))
    out = g.select("community_key", "community_name", "sales_count", "rental_count", "yield_pct", "growth_pct", "liquidity", "incoming_units", "risk", "score", risks.alias("risks"), missing.alias("missing_data"), why.alias("why")).orderBy(F.desc("score"), "community_key")
    return out if limit is None else out.limit(limit)


# -- data quality -----------------------------------------------------------------------------------------------------


def data_quality(mk: Market) -> DataFrame:
    """(measure, name, n): match confidences, unlinked and invalid rows, hierarchy methods."""
    groups = lambda df, c, measure: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "name", "n")
    invalid = lambda v: F.col(v).isNull() | (F.col(v) <= 0)
    rows = lambda df, measure, v: df.agg(F.count("*").alias("rows"), count_when(F.col("area_id").isNull()).alias("without_area"), count_when(F.col("project_id").isNull()).alias("without_project"), count_when(invalid(v)).alias("invalid_value"), count_when(invalid("area_sqm")).alias("invalid_area")).select(F.lit(measure).alias("measure"), F.expr("stack(5, 'rows', rows, 'without_area', without_area, 'without_project', without_project, 'invalid_value', invalid_value, 'invalid_area', invalid_area) as (name, n)"))
    parts = [groups(mk.area, "match_confidence", "area_match"), groups(mk.project, "match_confidence", "project_match"), groups(mk.project, "grouping_method", "grouping"), rows(mk.sales, "sales", "trans_value_aed"), rows(mk.rentals, "rentals", "annual_amount_aed")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hierarchy_review(mk: Market, limit: int = 50) -> DataFrame:
    """Master projects that need review, with their buildings and methods in name order; missing values stay in the lists."""
    b = mk.project.groupBy("master_project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dld_project_name").alias("n"), F.col("grouping_method").alias("g")))).alias("_b"))
    g = mk.master.where("needs_review").join(b, "master_project_id").orderBy(F.desc("building_count"), "slug").limit(limit)
    return g.select("slug", "building_count", F.concat_ws("|", F.transform("_b", lambda x: x["n"])).alias("buildings"), F.concat_ws("|", F.transform("_b", lambda x: x["g"])).alias("methods"))
