"""Raw extracts to staging tables: recognised by their header, all text, gated by content hash."""

from __future__ import annotations

import csv
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylane.operators.versions import Store, Transaction


@dataclass(frozen=True)
class Dataset:
    """A kind of extract: its name and its columns, in any order."""

    name: str
    columns: tuple[str, ...]


# -- fixed values: the columns of the two extracts --------------------------------------------------------------------
SALES = Dataset("dld_sales", (
    "TRANSACTION_NUMBER", "INSTANCE_DATE", "GROUP_EN", "PROCEDURE_EN", "IS_OFFPLAN_EN", "IS_FREE_HOLD_EN", "USAGE_EN", "AREA_EN", "PROP_TYPE_EN", "PROP_SB_TYPE_EN",
    "TRANS_VALUE", "PROCEDURE_AREA", "ACTUAL_AREA", "ROOMS_EN", "PARKING", "NEAREST_METRO_EN", "NEAREST_MALL_EN", "NEAREST_LANDMARK_EN", "TOTAL_BUYER", "TOTAL_SELLER",
    "MASTER_PROJECT_EN", "PROJECT_EN",
))
RENTALS = Dataset("dld_rentals", (
    "REGISTRATION_DATE", "START_DATE", "END_DATE", "VERSION_EN", "AREA_EN", "CONTRACT_AMOUNT", "ANNUAL_AMOUNT", "IS_FREE_HOLD_EN", "ACTUAL_AREA", "PROP_TYPE_EN",
    "PROP_SUB_TYPE_EN", "ROOMS", "USAGE_EN", "NEAREST_METRO_EN", "NEAREST_MALL_EN", "NEAREST_LANDMARK_EN", "PARKING", "TOTAL_PROPERTIES", "MASTER_PROJECT_EN", "PROJECT_EN",
))
DATASETS = (SALES, RENTALS)


#: Bytes of a file within which its header ends.
HEADER_BYTES = 1 << 16


def _columns(line: str | None) -> list[str]:
    """Column names of a header line, without a byte order mark or surrounding blanks."""
    row = next(csv.reader([(line or "").lstrip("\ufeff").rstrip("\r")]), [])
    return [x.strip() for x in row]


def headers(spark: SparkSession, paths: list[str] | str) -> dict[str, list[str]]:
    """Column names by path of some CSV files, or of those of a directory, read in one job."""
    return {r["path"]: _columns(r["header"]) for r in files(spark, paths).select("path", "header").collect()}


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file."""
    return next(iter(headers(spark, [path]).values()), [])


def detect(columns: list[str], datasets: tuple[Dataset, ...] = DATASETS) -> Dataset | None:
    """The dataset with exactly these columns."""
    found = frozenset(c.strip() for c in columns)
    return next((d for d in datasets if frozenset(d.columns) == found), None)


def files(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, hash, modified and header line of the CSV files of a directory, not of those below it, or of given files; all is
    computed where the files are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    raw = (reader.option("pathGlobFilter", "*.csv") if isinstance(where, str) else reader).load(where)
    line = F.substring_index(F.decode(F.substring("content", 1, HEADER_BYTES), "UTF-8"), "\n", 1)
    return raw.select("path", F.sha1("content").alias("hash"), F.col("modificationTime").alias("modified"), line.alias("header"))


def scan(spark: SparkSession, directory: str) -> tuple[list[tuple[str, Dataset]], list[str]]:
    """Recognised (path, dataset) pairs and unrecognised paths, both sorted."""
    kinds = [(p, detect(columns)) for p, columns in sorted(headers(spark, directory).items())]
    return [(p, d) for p, d in kinds if d], [p for p, d in kinds if not d]


def unrecognised(spark: SparkSession, directory: str) -> list[str]:
    return scan(spark, directory)[1]


def stage(spark: SparkSession, paths: list[str], dataset: Dataset) -> DataFrame:
    """All columns as text with row_num (from 0 within its file), source_file, file_hash and imported_at.

    Quoted newlines keep a file in one task, so the row number of a file is its order of reading; many files are read in
    parallel. Empty and quoted-empty cells are NULL; the text NA is data; duplicate rows stay.
    """
    parts = []
    known = headers(spark, paths)
    for order in sorted({tuple(columns) for columns in known.values()}):
        own = [p for p in known if tuple(known[p]) == order]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in order])
        reader = spark.read.schema(schema).options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)
        parts.append(reader.csv(own).select(*dataset.columns, F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("_i")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("_i")) - 1
    hashes = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("_p"), F.sha1("content").alias("file_hash"))
    rows = rows.withColumn("row_num", number.cast("long")).drop("_i").withColumn("_p", F.regexp_replace("source_file", "^file:/+", "/"))
    return rows.join(hashes, "_p", "left").drop("_p").withColumn("imported_at", F.current_timestamp())


REGISTRY = "path string, hash string, modified timestamp, dataset string, row_count long, status string, imported_at timestamp"


def needs_import(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that are new, changed, or whose last import did not succeed."""
    done = latest(registry, ["path"], "imported_at").where("status = 'success'").select("path", "hash")
    return found.join(done, ["path", "hash"], "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of every key; ties by the whole row."""
    rest = [F.desc_nulls_last(c) for c in rows.columns if c not in (*keys, order)]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *rest))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def record(registry: DataFrame, done: DataFrame) -> DataFrame:
    """The registry with the newest entry per path."""
    return latest(registry.unionByName(done), ["path"], "imported_at")


def plain_path(path: str) -> str:
    """A path without the scheme of local files, as both the file list and the readers' metadata name it."""
    return "/" + path.split(":", 1)[-1].lstrip("/") if path.startswith("file:") else path


def file_id(path: str) -> str:
    return hashlib.sha1(plain_path(path).encode()).hexdigest()


def staged_schema(dataset: Dataset) -> T.StructType:
    """The columns of a staging table."""
    text = [T.StructField(c, T.StringType()) for c in (*dataset.columns, "source_file")]
    return T.StructType([*text, T.StructField("row_num", T.LongType()), T.StructField("file_hash", T.StringType()), T.StructField("imported_at", T.TimestampType()), T.StructField("file_id", T.StringType())])


def replace_files(tx: Transaction, staged: DataFrame, dataset: Dataset, paths: list[str]) -> dict[str, int]:
    """Staged rows of some files in place of those files' rows, all other files' rows kept; the rows by path."""
    name = f"stg_{dataset.name}"
    own = F.sha1(F.regexp_replace("source_file", "^file:/+", "/").cast("binary"))
    rows = staged.withColumn("file_id", own).select(staged_schema(dataset).names)
    tx.replace_parts(name, rows, "file_id", clear=[file_id(p) for p in paths])
    counts = tx.tables[name]["rows"]
    return {p: counts.get(file_id(p), 0) for p in paths}


def import_file(spark: SparkSession, path: str, table_dir: str) -> dict:
    """Stage one file into the store at table_dir; a file with an unknown header is an error."""
    dataset = detect(header(spark, path))
    if dataset is None:
        raise ValueError(f"unknown header: {path}")
    with Store(spark, table_dir).write() as tx:
        rows = replace_files(tx, stage(spark, [path], dataset), dataset, [path])
    return {"dataset": dataset.name, "rows": rows[path]}


def stage_changed(spark: SparkSession, directory: str, tx: Transaction) -> tuple[dict[str, dict], list[str]]:
    """Stage every new or changed recognised file and note it in the store's registry.

    Returns dataset, rows, hash and modified by path, and the paths of unknown headers.
    """
    base = tx.snapshot()
    registry = base.table("import_registry") if "import_registry" in base else spark.createDataFrame([], REGISTRY)
    found = files(spark, directory)
    kinds = {r["path"]: detect(_columns(r["header"])) for r in found.select("path", "header").collect()}
    todo = {r["path"]: r for r in needs_import(found.drop("header"), registry).collect() if kinds.get(r["path"])}
    staged: dict[str, dict] = {}
    for dataset in DATASETS:
        own = sorted(p for p in todo if kinds[p] is dataset)
        if own:
            rows = replace_files(tx, stage(spark, own, dataset), dataset, own)
            staged |= {p: {"dataset": dataset.name, "rows": rows[p], "hash": todo[p]["hash"], "modified": todo[p]["modified"]} for p in own}
    if staged:
        done = [(p, s["hash"], s["modified"], s["dataset"], s["rows"], "success") for p, s in staged.items()]
        new = spark.createDataFrame(done, REGISTRY.rsplit(",", 1)[0]).withColumn("imported_at", F.current_timestamp())
        tx.replace("import_registry", record(registry, new))
    return staged, sorted(p for p, d in kinds.items() if d is None)


def refresh(spark: SparkSession, directory: str, table_dir: str) -> dict[str, int]:
    """Stage every new or changed recognised file into the store at table_dir; the rows staged per dataset."""
    with Store(spark, table_dir).write() as tx:
        staged, _ = stage_changed(spark, directory, tx)
    counts: dict[str, int] = {}
    for s in staged.values():
        counts[s["dataset"]] = counts.get(s["dataset"], 0) + s["rows"]
    return counts


def log_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log of url and content hash, one page per content) of fetched pages."""
    hashed = pages.withColumn("content_hash", F.sha2(F.col("html").cast("binary"), 256))
    return hashed.drop("html"), hashed.select("content_hash", "html").dropDuplicates(["content_hash"])
