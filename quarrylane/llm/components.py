"""Connected components of a link table by alternating large-star and small-star steps, with no table on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import checkpointed

#: A checkpointed link table is read in partitions of at least about so many rows.
ROWS_A_PARTITION = 20_000


def _settled(df: DataFrame) -> DataFrame:
    """df checkpointed, in no more partitions than its measured size calls for."""
    df = checkpointed(df)
    return df.coalesce(max(1, df.count() // ROWS_A_PARTITION))


def _least(links: DataFrame) -> DataFrame:
    """The least neighbour of every u; cut off, so that the join with it can split a hub's rows over tasks."""
    return _settled(links.groupBy("u").agg(F.min("v").alias("m")))


def _is_forest(links: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: the links are stars around the components' least nodes."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node with a link (u, v) that is not its component's root; root is the component's least node."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = _settled(links)
    for _ in range(most_rounds):
        if _is_forest(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _settled(large)
        near = _least(large)
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        links = _settled(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    raise RuntimeError("components did not settle")
