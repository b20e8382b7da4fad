"""A stored catalogue, one SQLite file, as Spark tables.

The file goes to every executor once, and each task reads one range of row ids, so a table is read in parallel. Filters that
SQLite answers the same way as Spark are pushed into its queries; Spark applies the others.

Defined cases: a table without row ids is one range; a value that does not fit its column's declared type is NULL; an unknown
table is an error; the file is opened for reading only and never changed.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith



def _open(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str) -> T.DataType:
    declared = declared.upper()
    if "BOOL" in declared:
        return T.BooleanType()
    if "INT" in declared:
        return T.LongType()
    if any(x in declared for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    return T.StringType()


def _value(v: object, kind: T.DataType) -> object:
    if v is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        if isinstance(v, (str, bytes)):
            return None
        if isinstance(kind, T.BooleanType):
            return bool(v)
        return int(v) if isinstance(kind, T.LongType) and float(v).is_integer() else float(v) if isinstance(kind, T.DoubleType) else None
    except (OverflowError, ValueError):
        return None


@dataclass
class Rows(InputPartition):
    """A range of row ids, or all rows."""

    low: int | None
    high: int | None


class StoredReader(DataSourceReader):
    def __init__(self, database: str, table: str, schema: T.StructType, ranges: int):
        self.database, self.table, self.schema, self.ranges = database, table, schema, ranges
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what SQLite answers; yields the rest back."""
        for f in filters:
            if not self._keep(f):
                yield f

    def _keep(self, f: Filter) -> bool:
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return False
        name, kind = _quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType
        # a value of another kind than declared reads as NULL here, so such values must not be compared in SQLite
        sure = f"typeof({name}) = 'text'" if isinstance(kind, T.StringType) else f"typeof({name}) IN ('integer', 'real')"
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        if isinstance(kind, T.BooleanType):
            return False
        if type(f) in signs and isinstance(f.value, (int, float, str)):
            self._add(f"({sure} AND {name} {signs[type(f)]} ?)", f.value)
        elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
            self._add(f"({sure} AND {name} IN ({', '.join('?' * len(f.value))}))", *f.value)
        elif isinstance(f, StringStartsWith):
            self._add(f"({sure} AND substr({name}, 1, {len(f.value)}) = ?)", f.value)
        elif isinstance(f, IsNotNull) and isinstance(kind, T.StringType):
            self._add(f"{name} IS NOT NULL")
        elif isinstance(f, IsNull) and isinstance(kind, T.StringType):
            self._add(f"{name} IS NULL")
        else:
            return False
        # text columns may hold numbers or bytes, which read as text: those rows stay for Spark to test
        if isinstance(kind, T.StringType) and not isinstance(f, (IsNotNull, IsNull)):
            self.where[-1] = f"({self.where[-1]} OR typeof({name}) NOT IN ('text', 'null'))"
            return False
        return True

    def _add(self, where: str, *values: object) -> None:
        self.where.append(where)
        self.values += values

    def partitions(self) -> list[InputPartition]:
        with _open(self.database) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Rows(None, None)]
        if low is None:
            return [Rows(0, 0)]
        n = max(1, min(self.ranges, high - low + 1))
        edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [Rows(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.insert(0, "rowid >= ? AND rowid < ?")
            values = [partition.low, partition.high, *values]
        columns = ", ".join(_quoted(c) for c in self.schema.names)
        kinds = [f.dataType for f in self.schema]
        con = _open(self.database)
        try:
            for row in con.execute(f"SELECT {columns} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values):
                yield tuple(_value(v, k) for v, k in zip(row, kinds, strict=True))
        finally:
            con.close()


class StoredSource(DataSource):
    """``spark.read.format("stored_catalogue").option("database", name).option("table", name)``; the file has been added before."""

    @classmethod
    def name(cls) -> str:
        return "stored_catalogue"

    def schema(self) -> T.StructType:
        with _open(self.options["database"]) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(c[1], _type(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return StoredReader(self.options["database"], self.options["table"], schema, int(self.options.get("ranges", 8)))


def read(spark: SparkSession, path: str, table: str, ranges: int = 8) -> DataFrame:
    """A table of the catalogue at path, in as many ranges of row ids."""
    name = os.path.basename(path)
    if name not in [os.path.basename(f) for f in spark.sparkContext.listFiles]:
        spark.sparkContext.addFile(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredSource)
    return spark.read.format("stored_catalogue").options(database=name, table=table, ranges=str(ranges)).load()


def catalogue(spark: SparkSession, path: str, ranges: int = 8) -> dict[str, DataFrame]:
    """The tables that the warehouse builds from, by name."""
    return {name: read(spark, path, name, ranges) for name in ("areas", "sub_communities", "developers", "developments", "buildings")}
