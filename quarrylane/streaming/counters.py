"""Counters fed by streams, each batch counted once whatever is run again.

A batch's counts and the note that the batch is done become visible in one version of a store. A stream that is stopped after
its write and before its own checkpoint runs the batch again; the note then leaves it out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quarrylane.operators.versions import Conflict, Snapshot, Store, Transaction

LEDGER = "stream_ledger"
DAYS, JOBS = "daily_requests", "job_counters"


def once(store: Store, stream: str, batch: int, change: Callable[[Transaction], None], tries: int = 5) -> bool:
    """Apply a batch's change unless the ledger has the batch; whether it was applied. Other writers in between are awaited."""
    for attempt in range(tries):
        try:
            with store.write() as tx:
                now = tx.snapshot()
                seen = {r["stream"]: r["batch"] for r in now.table(LEDGER).collect()} if LEDGER in now else {}
                if batch <= seen.get(stream, -1):
                    return False
                change(tx)
                tx.replace(LEDGER, store.spark.createDataFrame(sorted((seen | {stream: batch}).items()), "stream string, batch long"))
            return True
        except Conflict:
            if attempt == tries - 1:
                raise
    return False


def add_to(tx: Transaction, table: str, new: DataFrame, keys: list[str], least: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> None:
    """A table of counters by key with the new counts added; least and most name columns that keep their extremes instead."""
    now = tx.snapshot()
    rows = now.table(table).unionByName(new) if table in now else new
    how = {c: F.min if c in least else F.max if c in most else F.sum for c in new.columns if c not in keys}
    tx.replace(table, rows.groupBy(*keys).agg(*[f(c).cast(new.schema[c].dataType).alias(c) for c, f in how.items()]))


def count_requests(requests: DataFrame, store: Store, checkpoint: str, name: str = "requests") -> DataStreamWriter:
    """A writer of the requests (at) of a stream to the counts by day."""

    def batch(rows: DataFrame, number: int) -> None:
        days = rows.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("requests"))
        once(store, name, number, lambda tx: add_to(tx, DAYS, days, ["day"]))

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def count_jobs(events: DataFrame, store: Store, checkpoint: str, name: str = "jobs") -> DataStreamWriter:
    """A writer of job events (job_id, kind, at) to the counters of every job."""

    def batch(rows: DataFrame, number: int) -> None:
        n = lambda k: F.count_if(F.col("kind") == k).alias(k)
        jobs = rows.groupBy("job_id").agg(n("processed"), n("error"), n("blocked"), n("finished"), F.min("at").alias("started_at"), F.max("at").alias("last_event_at"))
        once(store, name, number, lambda tx: add_to(tx, JOBS, jobs, ["job_id"], least=("started_at",), most=("last_event_at",)))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def status(snap: Snapshot, day: str, tables: tuple[str, ...] = ()) -> DataFrame:
    """(section, name, n): rows of tables, requests of a day, jobs by state, and the queue by status where there is one."""
    spark = snap.spark
    rows = [("entities", t, snap.rows(t)) for t in tables if t in snap]
    out = spark.createDataFrame(rows, "section string, name string, n long")
    if DAYS in snap:
        own = snap.table(DAYS).where(F.col("day") == F.lit(day).cast("date")).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("n"))
        out = out.unionByName(own.select(F.lit("requests").alias("section"), F.lit(day).alias("name"), "n"))
    if JOBS in snap:
        state = F.when(F.col("finished") > 0, "finished").otherwise("running").alias("name")
        out = out.unionByName(snap.table(JOBS).groupBy(state).agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("section"), "name", "n"))
    if "crawl_queue" in snap:
        out = out.unionByName(snap.table("crawl_queue").groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("queue").alias("section"), "name", "n"))
    return out
