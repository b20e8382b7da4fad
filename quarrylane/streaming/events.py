"""Extensions on event streams: tumbling, sliding and session windows with watermarks; the same code serves batch frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files of a folder; the schema is fixed."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(stream: DataFrame, load: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], keys: list[str], checkpoint: str):
    """A query that folds micro-batches into a latest-wins table."""
    from quarrylane.operators.incremental import merge, newest

    def fold(batch: DataFrame, _: int) -> None:
        new = newest(batch, keys, *[F.desc_nulls_last(c) for c in batch.columns if c not in keys])
        old = load()
        save(new if old is None else merge(old, new, keys))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True)
