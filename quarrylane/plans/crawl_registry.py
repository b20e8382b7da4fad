"""Walks of a site whose pages are parts and whose links are pairs of lines of one order, with SQL for what is reached."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import urls
from quarrylane.functions import vocabulary as v
from quarrylane.operators import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOST = "site.example"
HOME = f"https://{HOST}{v.PATH_PREFIX}"


def stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, pages and links: returned lines declare sub-areas, accepted ones are plain links, all others leave the site."""
    part, lines = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    n = F.pmod("p_partkey", F.lit(5))
    kind = F.when(n < 3, "area").when(n == 3, "development")
    pages = part.select(F.concat(F.lit(HOME + "p"), "p_partkey").alias("url"), kind.alias("kind"))
    first = part.where(n < 3).groupBy((F.pmod("p_partkey", F.lit(7))).alias("job_id")).agg(F.min("p_partkey").alias("k"))
    seeds = first.select("job_id", F.concat(F.lit(HOME + "p"), "k").alias("url"), F.lit("full").alias("mode"))
    one = lines.where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit(HOME + "p"), "l_partkey").alias("source"))
    home = F.when(F.col("l_returnflag") == "N", "https://other.example/").otherwise(HOME)
    two = lines.where("l_linenumber <> 1").select("l_orderkey", F.concat(home, F.lit("p"), "l_partkey").alias("url"), (F.col("l_returnflag") == "R").alias("child"))
    return seeds, pages, one.join(two, "l_orderkey").select("source", "url", "child").where(urls.allowed("url", HOST))


def reached(spark: SparkSession, d: str, **limits: int) -> DataFrame:
    seeds, pages, links = stored(spark, d)
    return crawl.walk(crawl.opened(seeds), pages, links, **limits)


QUERIES["crawl_walk"] = lambda spark, d: reached(spark, d).select("job_id", "url", "kind", "trusted", "status")
ORACLES["crawl_walk"] = f"""
WITH RECURSIVE page AS (SELECT p_partkey AS k, ['area', 'area', 'area', 'development', 'unknown'][p_partkey % 5 + 1] AS kind FROM part),
link AS (SELECT DISTINCT a.l_partkey AS k, b.l_partkey AS t, b.l_returnflag = 'R' AS child FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber <> 1 AND b.l_returnflag <> 'N'),
walk (job_id, k, trusted) AS (
  SELECT k % 7, min(k), true FROM page WHERE kind = 'area' GROUP BY 1
  UNION
  SELECT w.job_id, l.t, l.child AND p.kind = 'area' AS trusted FROM walk w JOIN page p ON p.k = w.k JOIN link l ON l.k = w.k WHERE p.kind = 'development' OR p.kind = 'area' AND w.trusted)
SELECT w.job_id, '{HOME}p' || w.k AS url, any_value(p.kind) AS kind, coalesce(bool_or(w.trusted AND p.kind = 'area'), false) AS trusted, CASE WHEN any_value(p.kind) IS NULL THEN 'failed' ELSE 'done' END AS status
FROM walk w LEFT JOIN page p ON p.k = w.k GROUP BY w.job_id, w.k"""
