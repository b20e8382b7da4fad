"""Column helpers and storage helpers the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space besides the blank itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE)), " "), "")


def word_count_of_space(text: Column) -> Column:
    """Code points that are not ASCII white space."""
    return F.length(F.translate(text, " " + OTHER_SPACE, ""))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and all tasks run in this process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or "/tmp/checkpoints"


#: For what is stored at once: its shuffle files go as soon as it is stored, and Python gets whole texts in small batches.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with these values, as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files before it are removed."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with settings(df.sparkSession, STORING):
        return df.select("*").checkpoint(eager=True)  # a frame takes over the settings when it is made


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet in the shared folder, in a folder for each value of ``by``, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, STORING):
        df.select("*").write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
