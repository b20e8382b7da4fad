"""Incremental catalogue tables: merges that keep what is missing, a change log, disappearances, work lists, the crawl queue.

A table is a data frame; every operator takes the stored rows and the new ones and returns the next version. Versions
are written whole, so a reader sees the old or the new one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# -- fixed values: fields whose changes are logged --------------------------------------------------------------------
TRACKED_AREA = (
    "description", "also_known_as", "developer_raw", "dld_buildings", "dld_villas", "dld_residential_units", "dld_commercial_units",
    "dev_total", "dev_completed", "dev_under_construction", "dev_planned", "dev_on_hold", "dev_cancelled",
)
TRACKED_DEVELOPMENT = ("raw_status", "normalized_status", "total_units", "estimated_completion_date", "actual_completion_date", "developer_raw", "storeys_raw", "is_active")
#: Update order of statuses; others come last.
STATUS_RANK = {"under_construction": 0, "planned": 1, "announced": 2, "on_hold": 3}


def same_key(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def newest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: a new value wins unless it is NULL (or zero, for counts that partial pages report); keep columns never change.

    Keys are compared NULL-safe, so rows whose key has a NULL part are updated, not repeated.
    """
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")

    def value(c: str) -> Column:
        before = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        after = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in zero_is_missing:
            after = F.when(after != 0, after)
        return (F.coalesce(before, after) if c in keep else F.coalesce(after, before)).alias(c)

    return o.join(n, same_key("o", "n", keys), "full_outer").select(*[value(c) for c in columns])


def change_log(old: DataFrame, new: DataFrame, key: str, tracked: tuple[str, ...], entity: str) -> DataFrame:
    """One row per new record, and one per tracked field whose trimmed text changed; missing new values change nothing."""
    fields = [c for c in tracked if c in old.columns and c in new.columns]
    text = lambda a, c: F.trim(F.col(f"{a}.{c}").cast("string"))
    both = new.alias("n").join(old.alias("o").withColumn("_known", F.lit(True)), F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}")), "left")
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), text("o", c).alias("old_value"), text("n", c).alias("new_value")) for c in fields]) if fields else F.array().cast("array<struct<field_name:string,old_value:string,new_value:string>>")
    changed = F.filter(cells, lambda x: x["new_value"].isNotNull() & ~x["new_value"].eqNullSafe(x["old_value"]))
    fresh = F.array(F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    rows = both.select(F.col(f"n.{key}").alias("entity_key"), F.col("_known").isNotNull().alias("_k"), F.explode(F.when(F.col("_known").isNotNull(), changed).otherwise(fresh)).alias("c"))
    return rows.select(F.lit(entity).alias("entity_type"), "entity_key", "c.*", F.when(F.col("_k"), "field_changed").otherwise("new_record").alias("change_kind"))


def disappeared(stored: DataFrame, seen: DataFrame, key: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(stored with is_active off for active rows that the listing lacks, one log row for each)."""
    gone = stored.where("is_active").join(seen.select(key).distinct(), key, "left_anti").select(key).withColumn("_gone", F.lit(True))
    out = stored.join(gone, key, "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*stored.columns)
    log = gone.select(F.lit(entity).alias("entity_type"), F.col(key).alias("entity_key"), F.lit("is_active").alias("field_name"), F.lit("1").alias("old_value"), F.lit("0").alias("new_value"), F.lit("disappeared").alias("change_kind"))
    return out, log


def add_stubs(stored: DataFrame, cards: DataFrame, status: Column) -> DataFrame:
    """Listing cards (url, name, raw_status) as stub rows. A row that was enriched stays enriched; one seen again is active,
    and a raw status that fills a gap sets the normalised one too."""
    cards = newest(cards, ["url"], "name").select("url", F.col("name").alias("_name"), F.col("raw_status").alias("_raw"), F.lit(True).alias("_seen"))
    out = stored.join(cards, "url", "full_outer")
    new = F.col("is_stub").isNull()
    raw = F.coalesce("raw_status", "_raw")
    values = {"name": F.coalesce("name", "_name"), "raw_status": raw, "is_stub": F.coalesce("is_stub", F.lit(True)), "is_active": F.when(F.col("_seen").isNotNull(), True).otherwise(F.col("is_active"))}
    out = out.withColumn("_new", new).select("_new", "_seen", *[values[c].alias(c) if c in values else F.col(c) for c in stored.columns])
    if "normalized_status" in stored.columns:
        out = out.withColumn("normalized_status", F.when(F.col("normalized_status").isNull() | F.col("_new") | F.col("is_stub"), status).otherwise(F.col("normalized_status")))
    return out.select(*stored.columns)


def stubs(developments: DataFrame, limit: int | None = None) -> DataFrame:
    rows = developments.where("is_stub").orderBy("url").select("url")
    return rows if limit is None else rows.limit(limit)


def update_candidates(developments: DataFrame, limit: int | None = None) -> DataFrame:
    """Enriched active rows, by status rank and then the longest unvisited."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), F.col("normalized_status")), F.lit(4))
    rows = developments.where("is_active and not is_stub").orderBy(rank, F.asc_nulls_first("last_seen_at"), "url").select("url", "normalized_status", "last_seen_at")
    return rows if limit is None else rows.limit(limit)


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the new rows whose natural key it lacks, each once; NULL parts of a key are equal."""
    fresh = newest(new.select(*stored.columns), keys, *[F.asc_nulls_last(c) for c in stored.columns if c not in keys])
    absent = fresh.alias("n").join(stored.alias("o"), same_key("n", "o", keys), "left_anti")
    return stored.unionByName(absent)


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of whole rows: the new row of a key takes the place of the stored one."""
    fresh = newest(new.select(*stored.columns), keys, *[F.desc_nulls_last(c) for c in stored.columns if c not in keys])
    rest = stored.alias("o").join(fresh.alias("n"), same_key("o", "n", keys), "left_anti")
    return rest.unionByName(fresh)


def merge_developers(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Developers by url; a missing name keeps the known one."""
    return merge(stored, newest(new, ["url"], F.asc_nulls_last("name")), ["url"])


def milestones_wide(milestones: DataFrame) -> DataFrame:
    """One row per development with its four milestone dates."""
    kinds = ["announced", "construction_start", "estimated_completion", "completed"]
    return milestones.groupBy("development_id").pivot("kind", kinds).agg(F.max("date")).select("development_id", *[F.col(k).alias(f"{k}_date") for k in kinds])


def backfill(rows: DataFrame, column: str, value: Column, marker: str | None = None) -> DataFrame:
    """column filled where it is NULL; with a marker column, rows done before are left alone and all are marked."""
    open_ = F.col(column).isNull() if marker is None else F.col(column).isNull() & ~F.coalesce(F.col(marker), F.lit(False))
    out = rows.withColumn(column, F.when(open_, value).otherwise(F.col(column)))
    return out if marker is None else out.withColumn(marker, F.lit(True))


# -- queue, jobs, counters --------------------------------------------------------------------------------------------


def enqueue(queue: DataFrame, links: DataFrame) -> DataFrame:
    """queue (job_id, url, status, depth, discovered_from, attempts) with links it does not know yet as pending."""
    new = newest(links, ["job_id", "url"], "depth", F.asc_nulls_last("discovered_from")).join(queue.select("job_id", "url"), ["job_id", "url"], "left_anti")
    new = new.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return queue.unionByName(new.select(*queue.columns))


def next_pending(queue: DataFrame, job_id: int, limit: int = 1) -> DataFrame:
    return queue.where((F.col("job_id") == job_id) & (F.col("status") == "pending")).orderBy("depth", "url").limit(limit)


def mark(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Statuses (job_id, url, new_status) applied; work begun counts as an attempt."""
    out = queue.join(done.select("job_id", "url", "new_status"), ["job_id", "url"], "left")
    begun = F.coalesce(F.col("new_status") == "in_progress", F.lit(False))
    return out.withColumn("attempts", F.col("attempts") + begun.cast("int")).withColumn("status", F.coalesce("new_status", "status")).select(*queue.columns)


def queue_counts(queue: DataFrame, job_id: int) -> DataFrame:
    return queue.where(F.col("job_id") == job_id).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def retryable(queue: DataFrame, job_id: int, attempts: int = 3) -> DataFrame:
    return queue.where((F.col("job_id") == job_id) & (F.col("status") == "failed") & (F.col("attempts") < attempts))


def requests_by_day(requests: DataFrame) -> DataFrame:
    """The daily counter, derived from the request log."""
    return requests.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("requests"))


def job_stats(events: DataFrame) -> DataFrame:
    """Counters of each job from its event rows (job_id, kind, at): processed, error, blocked, and its state."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    state = F.when(F.max(F.col("kind") == "finished"), "finished").otherwise("running").alias("state")
    return events.groupBy("job_id").agg(n("processed"), n("error"), n("blocked"), state, F.min("at").alias("started_at"), F.max("at").alias("last_event_at"))


def migrate(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the columns that are new in the schema, NULL so far."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n) of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("entity"), "n") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
