"""Schema versions of a store: additive steps and idempotent backfills, each applied once and noted in the store.

A step adds columns, which writes no data, and may fill them from what is stored. A writer that opens a store applies the steps
that its log lacks, one version of the store a step. A reader opens it with ``migrate=False``: nothing is written, and the
columns of missing steps read as their defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators.versions import Snapshot, Store, Transaction, with_column

LOG = "schema_log"


@dataclass(frozen=True)
class Added:
    """A new column of a table; stored rows have the default."""

    table: str
    column: str
    kind: str
    default: object = None


@dataclass(frozen=True)
class Step:
    """A schema version: its columns, and by table what makes the filled rows of the stored ones."""

    version: int
    name: str
    columns: tuple[Added, ...] = ()
    fill: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()


def applied(snap: Snapshot) -> set[int]:
    """Versions of the steps that a store's log has."""
    return {r["version"] for r in snap.table(LOG).collect()} if LOG in snap else set()


def _apply(tx: Transaction, step: Step) -> None:
    for c in step.columns:
        if c.table in tx.tables:
            tx.add_column(c.table, c.column, c.kind, c.default)
    for table, fill in step.fill:
        if table in tx.tables:
            if "" not in tx.tables[table]["folders"]:
                raise ValueError(f"{table} is written by partition: fill it where it is written")
            tx.replace(table, fill(tx.snapshot().table(table)))
    spark = tx.store.spark
    new = spark.createDataFrame([(step.version, step.name)], "version int, name string").withColumn("applied_at", F.current_timestamp())
    now = tx.snapshot()
    tx.replace(LOG, now.table(LOG).unionByName(new) if LOG in now else new)


def start(spark: SparkSession, root: str, steps: Iterable[Step], migrate: bool = True) -> tuple[Store, Snapshot]:
    """The store at root and its newest snapshot after the steps it lacks, in order of version.

    A step that fails leaves the store at the step before. Tables that do not exist are passed over, and so are the columns
    that a table has already.
    """
    store = Store(spark, root)
    ordered = sorted(steps, key=lambda s: s.version)
    if len({s.version for s in ordered}) < len(ordered):
        raise ValueError("two steps have one version")
    done = applied(store.snapshot())
    missing = [s for s in ordered if s.version not in done]
    if migrate:
        for step in missing:
            with store.write() as tx:
                _apply(tx, step)
        return store, store.snapshot()
    snap = store.snapshot()
    tables = dict(snap.tables)
    for step in missing:
        for c in step.columns:
            if c.table in tables:
                tables[c.table] = with_column(tables[c.table], c.column, c.kind, c.default)
    return store, Snapshot(spark, store.root, snap.version, tables)
