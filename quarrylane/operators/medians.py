"""Exact medians for groups of any size.

The built-in median keeps a group's distinct values in one buffer. Here a group is first bracketed by approximate
quantiles; the rows below the bracket are only counted, and the distinct values inside it, a small share, are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined with right on keys where NULL equals NULL; the keys of left are kept."""
    own = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [left[k].eqNullSafe(own[f"_right_{i}"]) for i, k in enumerate(keys)], F.lit(True))
    return left.join(own, same, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def exact_medians(rows: DataFrame, keys: list[str], values: dict[str, Column], accuracy: int = 10000, slack: float = 0.001) -> DataFrame:
    """keys and a median by name for every value: the middle value, or the mean of the two middle ones.

    NULL values are ignored (a group without any has no row), NULL keys are a group, values are free of NaN. The bracket
    is the approximate 50 % quantile with ``slack`` to both sides, wider than the sketch's error of 1 / accuracy, so it
    always holds the middle ranks. Two passes over the rows serve all values.
    """
    each = F.array(*[F.struct(F.lit(name).alias("_which"), value.cast("double").alias("_v")) for name, value in values.items()])
    rows = rows.select(*keys, F.inline(each)).where("_v is not null")
    by = [*keys, "_which"]
    bracket = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], accuracy).alias("_q"))
    both = null_safe(rows, bracket, by, "inner")
    low, high = F.col("_q")[0], F.col("_q")[1]
    near = both.where(F.col("_v") <= high).groupBy(*by, F.when(F.col("_v") >= low, F.col("_v")).alias("_at")).agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_at")))
    ranked = near.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    at = lambda name, k: F.max(F.when((F.col("_which") == name) & (F.col("_from") <= k) & (k < F.col("_to")), F.col("_at")))
    return ranked.groupBy(*keys).agg(*[((at(name, lower) + at(name, upper)) / 2).alias(name) for name in values])


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median."""
    return exact_medians(rows, keys, {"median": F.col(value)})


def with_medians(groups: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Aggregated groups with the exact medians of the rows they come from."""
    return null_safe(groups, exact_medians(rows, keys, values), keys, "left")
