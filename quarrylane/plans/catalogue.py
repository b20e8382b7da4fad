"""Dashboard queries over the catalogue and the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.functions.normalize import elapsed
from quarrylane.operators import trees
from quarrylane.operators.trees import subtree_counts
from quarrylane.plans.market import STATUSES


def jobs(rows: DataFrame, latest: bool = False) -> DataFrame:
    out = rows.orderBy(F.desc("id")).withColumn("elapsed", elapsed("started_at", F.coalesce("finished_at", F.current_timestamp())))
    return out.limit(1) if latest else out


def recent_errors(rows: DataFrame, job_id: int | None = None, limit: int = 20) -> DataFrame:
    rows = rows if job_id is None else rows.where(F.col("job_id") == job_id)
    return rows.orderBy(F.desc("id")).limit(limit)


def overview(developments: DataFrame, **others: DataFrame) -> DataFrame:
    """One row of figures over developments and the row counts of other tables."""
    like = lambda s: F.count_if(F.col("development_type").ilike(f"%{s}%"))
    state = lambda s: F.count_if(F.col("normalized_status") == s).alias(s)
    out = developments.agg(F.count("*").alias("developments"), F.count_if("is_active").alias("active"), like("villa").alias("villas"), like("townhouse").alias("townhouses"), *map(state, STATUSES), F.sum(F.col("total_units").cast("long")).alias("known_units"))
    for name, df in others.items():
        out = out.join(df.agg(F.count("*").alias(name)), F.lit(True), "left")
    return out


def status_breakdown(developments: DataFrame, areas: DataFrame | None = None, area_id: int | None = None) -> DataFrame:
    """Counts of all eight statuses, zeros included; a missing status is other. With an area, over its subtree."""
    if area_id is not None:
        developments = in_area(developments, areas, area_id)
    domain = developments.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = developments.groupBy(F.coalesce("normalized_status", F.lit("other")).alias("status")).agg(F.count("*").alias("n"))
    return domain.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing) in one pass."""
    counts = rows.agg(*[x for f in fields for x in (F.count(f).alias(f"{f}_p"), F.count_if(F.col(f).isNull()).alias(f"{f}_m"))])
    return counts.select(F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', {f}_p, {f}_m" for f in fields) + ") as (field, present, missing)"))


def recent_changes(log: DataFrame, kinds: tuple[str, ...] = ("field_changed", "disappeared"), limit: int = 25) -> DataFrame:
    return log.where(F.col("change_kind").isin(*kinds)).orderBy(F.desc("id")).limit(limit)


def recent_discoveries(log: DataFrame, limit: int = 25) -> DataFrame:
    return recent_changes(log, ("new_record",), limit)


def crawl_health(budget: DataFrame, errors: DataFrame, areas: DataFrame, places: DataFrame, aliases: DataFrame, day: str | None = None) -> DataFrame:
    """One row: requests of a day (today), id of the last error, malls, landmarks, mentioned places and aliases."""
    on = F.current_date() if day is None else F.lit(day).cast("date")
    kind = lambda k: F.count_if(F.col("area_type") == k).alias(f"{k}_count")
    out = budget.where(F.col("day") == on).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests_today"))
    for part in (errors.agg(F.max("id").alias("last_error")), areas.agg(kind("mall"), kind("landmark")), places.agg(F.count("*").alias("mentioned_places")), aliases.agg(F.count("*").alias("entity_aliases"))):
        out = out.join(part, F.lit(True), "left")
    return out


def list_areas(areas: DataFrame, developments: DataFrame, search: str | None = None) -> DataFrame:
    """Areas with the active developments of their subtrees, most first."""
    out = subtree_counts(areas, developments.where("is_active"), "area_id")
    return out.where(F.col("name").ilike(f"%{search}%")) if search else out


def area(areas: DataFrame, area_id) -> DataFrame:
    return areas.where(F.col("id") == area_id)


def sub_communities(rows: DataFrame, area_id) -> DataFrame:
    return rows.where(F.col("parent_area_id") == area_id).orderBy("name")


def in_area(rows: DataFrame, areas: DataFrame, area_id, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of an area and of all areas below it: by the tree's interval labels where there are any, else from the area down."""
    root = areas.where(F.col("id") == area_id).select("id")
    ids = trees.subtrees(labelled, root).select(F.col("node").alias("area_id")) if labelled is not None else trees.below(areas, root).select(F.col("id").alias("area_id"))
    return rows.join(ids.distinct(), "area_id", "left_semi")


def unit_coverage(developments: DataFrame, areas: DataFrame, area_id) -> DataFrame:
    """Figures over the active developments of an area's subtree."""
    like = lambda s: F.count_if(F.col("development_type").ilike(f"%{s}%"))
    return in_area(developments.where("is_active"), areas, area_id).agg(
        F.count("*").alias("total"), F.count("total_units").alias("known_units"), F.coalesce(F.sum(F.col("total_units").cast("long")), F.lit(0)).alias("residential_units"),
        like("villa").alias("villas"), like("townhouse").alias("townhouses"),
    )


def with_names(developments: DataFrame, areas: DataFrame | None, developers: DataFrame | None) -> DataFrame:
    """developments with area_name and developer_name; those without an area or a developer stay."""
    for key, rows in (("area", areas), ("developer", developers)):
        if rows is not None:
            developments = developments.join(rows.select(F.col("id").alias(f"{key}_id"), F.col("name").alias(f"{key}_name")), f"{key}_id", "left")
    return developments


def matching(developments: DataFrame, areas: DataFrame | None = None, search: str | None = None, area_id=None, developer_id: int | None = None, status: str | None = None, dev_type: str | None = None, completion_year: str | None = None) -> DataFrame:
    """Active developments under optional filters: an area stands for its subtree, a year for either completion date."""
    rows = developments.where("is_active")
    if search:
        rows = rows.where(F.col("name").ilike(f"%{search}%"))
    if dev_type:
        rows = rows.where(F.col("development_type").ilike(f"%{dev_type}%"))
    for c, x in (("developer_id", developer_id), ("normalized_status", status)):
        if x:
            rows = rows.where(F.col(c) == x)
    if completion_year:
        rows = rows.where(F.startswith("estimated_completion_date", F.lit(completion_year)) | F.startswith("actual_completion_date", F.lit(completion_year)))
    return in_area(rows, areas, area_id) if area_id else rows


def list_developments(developments: DataFrame, areas: DataFrame | None = None, developers: DataFrame | None = None, page: int = 1, page_size: int = 100, **filters) -> DataFrame:
    """A page of the matching developments, the last seen first, with the names of area and developer."""
    rows = matching(developments, areas, **filters).orderBy(F.desc_nulls_last("last_seen"), "id")
    return with_names(rows.offset((page - 1) * page_size).limit(page_size), areas, developers)


def count_developments(developments: DataFrame, areas: DataFrame | None = None, **filters) -> DataFrame:
    return matching(developments, areas, **filters).agg(F.count("*").alias("n"))


def development(developments: DataFrame, areas: DataFrame | None = None, developers: DataFrame | None = None, dev_id: int | None = None, url: str | None = None) -> DataFrame:
    return with_names(developments.where(F.col("id") == dev_id if url is None else F.col("url") == url), areas, developers)


def children(rows: DataFrame, dev_id: int, *order: str, limit: int | None = None) -> DataFrame:
    """Buildings, unit supply, transactions, companies or milestones of a development."""
    out = rows.where(F.col("development_id") == dev_id).orderBy(*order)
    return out if limit is None else out.limit(limit)


def master_of(developments: DataFrame, dev_id: int) -> DataFrame:
    own = developments.where(F.col("id") == dev_id).select(F.col("master_development_id").alias("id"))
    return developments.join(own, "id", "left_semi")


def subs_of(developments: DataFrame, dev_id: int) -> DataFrame:
    return developments.where(F.col("master_development_id") == dev_id).orderBy("name")


def changes_of(log: DataFrame, entity_type: str, entity_key) -> DataFrame:
    return log.where((F.col("entity_type") == entity_type) & (F.col("entity_key") == entity_key)).orderBy(F.desc("detected_at"))


def options(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def pages_of(n: int, size: int = 100) -> int:
    return -(-n // size)
