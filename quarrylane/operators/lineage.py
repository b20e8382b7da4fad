"""Cutting lineage where a table is used several times, so that plans stay small and work is done once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder, in spark.checkpoint.dir; a temporary folder stands in only where that is unset and all
    tasks run in this process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint."""
    _folder(df)
    return df.checkpoint(eager=True)


def on_disk(df: DataFrame) -> DataFrame:
    """df from Parquet beside the checkpoints, for a large table that is read many times."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
