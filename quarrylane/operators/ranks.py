"""Consecutive numbers in the order of a key, without a sort of the whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.lineage import settled

#: Rows of a range; ranges are at least as many as shuffle partitions.
ROWS = 200_000


def numbered(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """rows with start + 1, start + 2, ... by ``order``; equal values are numbered in some order.

    Ranges of the key are sorted each by itself; a row's number is its place in its range behind the rows of all earlier
    ranges. Only the ranges' counts are added up on the driver, one number a range.
    """
    spark = rows.sparkSession
    rows = settled(rows)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    key = F.col(order).asc_nulls_first()
    placed = settled(rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).agg(F.count("*")).collect())
    offsets, before = [], start
    for k, n in counts:
        offsets.append((k, before))
        before += n
    offset = spark.createDataFrame(offsets, "_part long, _offset long")
    out = placed.withColumn("_part", part).join(F.broadcast(offset), "_part")
    return out.withColumn(name, F.col("_offset") + place + 1).drop("_part", "_offset", "_id")


def kept(rows: DataFrame, key: str, name: str, known: DataFrame | None, start: int | None = None) -> DataFrame:
    """rows with the numbers that known (key, name) has for their keys; new keys are numbered behind the greatest of them, or
    behind ``start``. Without known numbers all are new."""
    if known is None:
        return numbered(rows, key, name, start or 0)
    if start is None:
        start = known.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    known = known.select(key, name).where(F.col(key).isNotNull()).dropDuplicates([key])
    old = rows.join(known, key)
    new = numbered(rows.join(known.select(key), key, "left_anti"), key, name, start)
    return old.select(*rows.columns, name).unionByName(new.select(*rows.columns, name))
