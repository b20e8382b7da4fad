"""Staging to facts and dimensions, whole or from changed files. Dimensions are settled before facts use them.

The tables of one build appear together, as one version of a store. A refresh stages new and changed files, finds the months
that their old and new rows touch, and writes those months of the facts only; the other months are the folders of the version
before. Dimension keys keep their ids from version to version, so facts that are not rewritten stay right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import normalize as nz
from quarrylane.operators import resolve
from quarrylane.operators.lineage import settled
from quarrylane.operators.versions import Store, Transaction
from quarrylane.sources import staging


def _keys(staged: DataFrame, area: DataFrame, project: DataFrame) -> DataFrame:
    """staged with area_id and project_id. Names are reduced to keys once per distinct name, not per row."""
    def ids(column: str, dim: DataFrame, key: str) -> DataFrame:
        names = staged.select(F.col(column).alias("_n")).where("_n is not null").distinct().withColumn("canonical_key", nz.canonical_key("_n"))
        return names.join(dim.select("canonical_key", key).where("canonical_key <> ''"), "canonical_key").select(F.col("_n").alias(column), key)

    areas = ids("AREA_EN", area.where("dld_area_name is not null"), "area_id")
    return staged.join(areas, "AREA_EN", "left").join(ids("PROJECT_EN", project, "project_id"), "PROJECT_EN", "left")


def fact_sales(staged: DataFrame, area: DataFrame, project: DataFrame) -> DataFrame:
    rows = _keys(staged, area, project)
    uid = nz.row_uid("sales", "source_file", "row_num")
    value, sqm = nz.safe_double("TRANS_VALUE"), nz.safe_double("ACTUAL_AREA")
    flag = lambda c, x: F.coalesce(F.col(c) == x, F.lit(False))
    return rows.select(
        nz.stable_id(uid).alias("sale_id"), uid.alias("source_row_uid"), nz.iso_date("INSTANCE_DATE").alias("instance_date"), F.col("GROUP_EN").alias("group_en"),
        F.col("PROCEDURE_EN").alias("procedure_en"), flag("IS_OFFPLAN_EN", "Off-Plan").alias("is_offplan"), flag("IS_FREE_HOLD_EN", "Free Hold").alias("is_freehold"),
        F.col("USAGE_EN").alias("usage_en"), "area_id", "project_id", F.col("PROP_TYPE_EN").alias("prop_type_en"), F.col("PROP_SB_TYPE_EN").alias("prop_sub_type_en"),
        nz.property_type("PROP_SB_TYPE_EN", "PROP_TYPE_EN").alias("canonical_property_type"), F.col("ROOMS_EN").alias("rooms_en"),
        F.coalesce(nz.bedroom_from_label("ROOMS_EN"), F.lit("Unknown")).alias("canonical_bedroom"), value.alias("trans_value_aed"), sqm.alias("area_sqm"),
        nz.per_sqft(value, sqm).alias("price_per_sqft_aed"), F.col("PARKING").alias("parking"), F.col("NEAREST_METRO_EN").alias("nearest_metro"),
        F.col("NEAREST_MALL_EN").alias("nearest_mall"), F.col("NEAREST_LANDMARK_EN").alias("nearest_landmark"), "source_file", "imported_at",
    )


def fact_rentals(staged: DataFrame, area: DataFrame, project: DataFrame) -> DataFrame:
    rows = _keys(staged, area, project)
    uid = nz.row_uid("rentals", "source_file", "row_num")
    amount, sqm, rooms = nz.safe_double("ANNUAL_AMOUNT"), nz.safe_double("ACTUAL_AREA"), nz.safe_double("ROOMS")
    flag = lambda c, x: F.coalesce(F.col(c) == x, F.lit(False))
    return rows.select(
        nz.stable_id(uid).alias("rental_id"), uid.alias("source_row_uid"), nz.iso_date("REGISTRATION_DATE").alias("registration_date"), nz.iso_date("START_DATE").alias("start_date"),
        nz.iso_date("END_DATE").alias("end_date"), F.col("VERSION_EN").alias("version_en"), flag("VERSION_EN", "Renewed").alias("is_renewal"), "area_id", "project_id",
        F.col("PROP_TYPE_EN").alias("prop_type_en"), F.col("PROP_SUB_TYPE_EN").alias("prop_sub_type_en"), nz.property_type("PROP_SUB_TYPE_EN", "PROP_TYPE_EN").alias("canonical_property_type"),
        rooms.alias("rooms"), nz.bedroom_from_rooms(rooms, "PROP_SUB_TYPE_EN").alias("canonical_bedroom"), nz.safe_double("CONTRACT_AMOUNT").alias("contract_amount_aed"),
        amount.alias("annual_amount_aed"), sqm.alias("area_sqm"), nz.per_sqft(amount, sqm).alias("rent_per_sqft_aed"), flag("IS_FREE_HOLD_EN", "Free Hold").alias("is_freehold"),
        F.col("USAGE_EN").alias("usage_en"), F.col("PARKING").alias("parking"), F.coalesce(nz.safe_double("TOTAL_PROPERTIES"), F.lit(0.0)).cast("int").alias("total_properties"),
        F.col("NEAREST_METRO_EN").alias("nearest_metro"), F.col("NEAREST_MALL_EN").alias("nearest_mall"), F.col("NEAREST_LANDMARK_EN").alias("nearest_landmark"), "source_file", "imported_at",
    )


def dimensions(sales: DataFrame, rentals: DataFrame, catalogue: dict[str, DataFrame], overrides: dict[str, DataFrame] | None = None, known: dict[str, DataFrame] | None = None, same_catalogue: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """dim_area, dim_project and the master projects without their enrichment; ids and, for the same catalogue, matches of
    ``known`` dimensions are kept."""
    own, old = overrides or {}, known or {}
    names = sales.select(F.col("AREA_EN").alias("name")).union(rentals.select("AREA_EN")).distinct()
    pairs = sales.select(F.col("PROJECT_EN").alias("name"), F.col("MASTER_PROJECT_EN").alias("master")).union(rentals.select("PROJECT_EN", "MASTER_PROJECT_EN")).distinct()
    area = settled(resolve.dim_area(settled(names), catalogue["areas"], catalogue.get("sub_communities"), own.get("area"), old.get("dim_area"), same_catalogue))
    project = settled(resolve.dim_project(settled(pairs), catalogue["developments"], catalogue["buildings"], own.get("project"), old.get("dim_project"), same_catalogue))
    project, master = map(settled, resolve.hierarchy(project, own.get("master"), old.get("dim_master_project")))
    return area, project, master


def build(sales: DataFrame, rentals: DataFrame, catalogue: dict[str, DataFrame], overrides: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All warehouse tables from staged sales and rentals and the catalogue (areas, sub_communities, developments, buildings, developers)."""
    area, project, master = dimensions(sales, rentals, catalogue, overrides)
    s, r = fact_sales(sales, area, project), fact_rentals(rentals, area, project)
    master = resolve.enrich_masters(master, s, r, project, area, catalogue["developments"], catalogue["developers"])
    return {"dim_area": area, "dim_project": project, "dim_master_project": master, "fact_sales": s, "fact_rentals": r}


#: The day of a fact, by which it is partitioned.
DAYS = {"fact_sales": "instance_date", "fact_rentals": "registration_date"}


def _by_month(name: str, facts: DataFrame) -> DataFrame:
    return facts.withColumn("month", F.date_format(DAYS[name], "yyyy-MM"))


def _put(tx: Transaction, tables: dict[str, DataFrame], months: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Write tables, of the facts only the given months where there are any given; the tables' row counts in the new version."""
    for name, df in tables.items():
        if name in DAYS:
            tx.replace_parts(name, _by_month(name, df), "month", clear=(months or {}).get(name), whole=months is None)
        else:
            tx.replace(name, df)
    return {name: tx.snapshot().rows(name) for name in tables}


def write_all(tables: dict[str, DataFrame], out: str) -> dict[str, int]:
    """Every table as the next version of the store at ``out``, facts partitioned by month; returns the row counts."""
    with Store(next(iter(tables.values())).sparkSession, out).write() as tx:
        return _put(tx, tables)


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """The same for the same rows in any order, and for another order of the tables."""
    parts = []
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first() if df.columns else (0, 0)
        parts.append(f"{name}:{row[0]}:{row[1]}")
    return " ".join(parts)


STATE = "catalogue string, built_at timestamp"


def refresh(spark: SparkSession, directory: str, out: str, catalogue: dict[str, DataFrame], overrides: dict[str, DataFrame] | None = None) -> dict:
    """Stage the new and changed files of a directory and bring the warehouse up to date, as one new version of the store at ``out``.

    Returns the version, the files staged with their rows, the files of no known header, the months of the facts that were
    written and the rows of every table. Without changes in files, catalogue or overrides there is no new version. A changed
    catalogue matches all names anew; ids stay. Files that are gone from the directory stay in the warehouse.
    """
    store = Store(spark, out)
    base = store.snapshot()
    mark = fingerprint(catalogue | {f"override {k}": v for k, v in (overrides or {}).items()})
    same = "build_state" in base and base.table("build_state").first()["catalogue"] == mark
    with store.write() as tx:
        staged, unknown = staging.stage_changed(spark, directory, tx)
        if not staged and same:
            return {"version": base.version, "staged": {}, "unrecognised": unknown, "months": {}, "rows": {}}
        now = tx.snapshot()
        tables = {d.name: now.table(f"stg_{d.name}") if f"stg_{d.name}" in now else spark.createDataFrame([], staging.staged_schema(d)) for d in staging.DATASETS}
        sales, rentals = tables["dld_sales"], tables["dld_rentals"]
        known = {name: base.table(name) for name in ("dim_area", "dim_project", "dim_master_project") if name in base}
        area, project, master = dimensions(sales, rentals, catalogue, overrides, known, same)
        months: dict[str, list[str]] = {}
        for name, dataset, rows, day, make in (("fact_sales", "dld_sales", sales, "INSTANCE_DATE", fact_sales), ("fact_rentals", "dld_rentals", rentals, "REGISTRATION_DATE", fact_rentals)):
            month = F.coalesce(F.date_format(nz.iso_date(day), "yyyy-MM"), F.lit("null"))
            if name in base:
                files = [f for f in staged if staged[f]["dataset"] == dataset]
                touched = lambda df, files=files, month=month: {r["m"] for r in df.where(F.col("file_id").isin([staging.file_id(f) for f in files])).select(month.alias("m")).distinct().collect()}
                months[name] = sorted(touched(rows) | (touched(base.table(f"stg_{dataset}")) if f"stg_{dataset}" in base else set())) if files else []
                if months[name]:
                    _put(tx, {name: make(rows.where(month.isin(months[name])), area, project)}, months)
            else:
                _put(tx, {name: make(rows, area, project)})
                months[name] = tx.snapshot().parts(name)
        now = tx.snapshot()
        master = resolve.enrich_masters(master, now.table("fact_sales"), now.table("fact_rentals"), project, area, catalogue["developments"], catalogue["developers"])
        _put(tx, {"dim_area": area, "dim_project": project, "dim_master_project": master, "build_state": spark.createDataFrame([(mark,)], "catalogue string").withColumn("built_at", F.current_timestamp())})
        now = tx.snapshot()
    return {"version": now.version, "staged": staged, "unrecognised": unknown, "months": months, "rows": {n: now.rows(n) for n in (*known, *DAYS, "dim_area", "dim_project", "dim_master_project")}}
