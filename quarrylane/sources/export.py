"""Exports: tables as CSV or JSON, and the nested catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables that can be exported one by one.
TABLES = ("areas", "sub_communities", "developments", "buildings", "unit_supply", "transactions", "amenities", "schools", "construction_history", "construction_milestones", "developers", "documents")


def export_csv(tables: dict[str, DataFrame], out: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """One CSV folder per known table; an empty table still leaves its header."""
    known = [n for n in names if n in tables]
    for n in known:
        tables[n].write.mode("overwrite").option("header", True).csv(f"{out}/{n}_csv")
    return known


def export_json(tables: dict[str, DataFrame], out: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """One folder of JSON lines per known table."""
    known = [n for n in names if n in tables]
    for n in known:
        tables[n].write.mode("overwrite").json(f"{out}/{n}_json")
    return known


def csv_page(rows: DataFrame, page: int, page_size: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def _children(child: DataFrame, key: str, name: str) -> DataFrame:
    """One row per parent with the sorted array of its children's records."""
    record = F.struct(*[c for c in sorted(child.columns) if c != key])
    return child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.sort_array(F.collect_list(record)).alias(name))


def nested(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """parents with an array per child table (child, foreign key); parents without children get empty arrays."""
    out = parents
    for name, (child, fk) in children.items():
        own = _children(child, fk, name)
        empty = F.array().cast(own.schema[name].dataType)
        out = out.join(own, F.col(key) == F.col("_id"), "left").drop("_id").withColumn(name, F.coalesce(name, empty))
    return out


def combined(areas: DataFrame, developments: DataFrame, of_development: dict[str, DataFrame], of_area: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per area: its developments with their own children, and its other children."""
    devs = nested(developments, {k: (df, "development_id") for k, df in of_development.items()})
    full = nested(areas, {"developments": (devs, "area_id")} | {k: (df, "area_id") for k, df in of_area.items()})
    return full.select("id", F.to_json(F.struct(*full.columns)).alias("json"))
