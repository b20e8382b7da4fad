"""Search of master projects and buildings by many queries at once, over an index that is written once.

Tiers, lower ones first: 0 the key of a master, 1 of a building, 2 the target of an override (looked at before the key
itself), 3 the key begins with the query, 4 all words of the query are in the key, 5 similarity of 70 or more. Within a tier,
masters come first, then greater similarity (tier 5 only differs), then names.

The index has, for every beginning of a key, its ``most`` first candidates in that order, and the words of the keys with their
counts. Queries meet the beginnings by equality; a query's rarest word leads to the candidates whose other words are tested;
the similarity join serves the rest. A query that has its ``limit`` of results from a tier does not enter the tiers behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import normalize as nz
from quarrylane.operators import simjoin
from quarrylane.operators.lineage import settled

SHOWN = ("id", "kind", "name", "subtitle", "slug", "master_slug")
SIMILAR = 70.0
#: Results that a query can have at most: as many as the index keeps of each beginning.
MOST = 50


def _order(*more: Column) -> list[Column]:
    return [*more, F.when(F.col("kind") == "master", 0).otherwise(1), F.desc("score"), F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first()]


def candidates(masters: DataFrame, projects: DataFrame) -> DataFrame:
    """key and what is shown of master projects and of buildings with a name and a slug."""
    described = F.when(F.col("building_count") > 1, F.concat(F.lit("Master Project · "), "building_count", F.lit(" buildings")))
    of = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("Project · "), c))
    m = masters.select(
        F.col("canonical_key").alias("key"), F.col("master_project_id").cast("long").alias("id"), F.lit("master").alias("kind"), F.col("display_name").alias("name"),
        F.coalesce(described, of("developer_name"), of("area_name"), F.lit("Project")).alias("subtitle"), "slug", F.lit(None).cast("string").alias("master_slug"))
    above = masters.select("master_project_id", F.col("display_name").alias("_m"), F.col("slug").alias("_s"))
    b = projects.where("dld_project_name is not null and building_slug is not null").join(above, "master_project_id").select(
        F.col("canonical_key").alias("key"), F.col("project_id").cast("long").alias("id"), F.lit("building").alias("kind"), F.trim("dld_project_name").alias("name"),
        F.concat(F.lit("Building · "), "_m").alias("subtitle"), F.col("building_slug").alias("slug"), F.col("_s").alias("master_slug"))
    return m.unionByName(b)


def index(rows: DataFrame, most: int = MOST) -> dict[str, DataFrame]:
    """entries, beginnings and words of candidates (key and what is shown), to be written as tables."""
    entries = rows.select("key", *SHOWN).where("key is not null and key <> ''")
    starts = entries.select("*", F.lit(90.0).alias("score"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("start"))
    ranked = starts.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy(*_order()))).where(F.col("_n") <= most)
    words = entries.select("key", F.explode(F.array_distinct(F.filter(F.split("key", " "), lambda w: w != ""))).alias("word")).distinct()
    times = words.groupBy("word").agg(F.count("*").alias("times"))
    return {"entries": entries, "beginnings": ranked.select("start", "key", *SHOWN), "words": words, "word_counts": times}


def search(queries: DataFrame, tables: dict[str, DataFrame], overrides: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """query, position and what is shown, key, tier and score of the first ``limit`` results of every distinct query.

    overrides: key (of a query) and target (a candidate's key). Queries of under two characters and NULL find nothing.
    """
    if limit > MOST:
        raise ValueError(f"the index holds {MOST} results a query")
    asked = settled(queries.select("query").where(F.length(F.trim("query")) >= 2).distinct().withColumn("q", nz.canonical_key(F.trim("query"))).where("q <> ''"))
    keys = asked.select("q").distinct()
    entries = tables["entries"]
    shown = ["q", "key", *SHOWN, "tier", "score"]
    forced = keys.limit(0).select("q", F.lit(None).cast("string").alias("key"))
    if overrides is not None:
        forced = keys.join(overrides.select(F.col("key").alias("q"), F.col("target").alias("key")), "q").distinct()
    two = forced.join(entries, "key").select("q", "key", *SHOWN, F.lit(2).alias("tier"), F.lit(100.0).alias("score"))
    equal = keys.join(entries, F.col("q") == F.col("key")).select("q", "key", *SHOWN, F.when(F.col("kind") == "master", 0).otherwise(1).alias("tier"), F.lit(100.0).alias("score"))
    begins = keys.join(tables["beginnings"], F.col("q") == F.col("start")).where("q <> key").select("q", "key", *SHOWN, F.lit(3).alias("tier"), F.lit(90.0).alias("score"))
    found = settled(two.unionByName(_without(equal.unionByName(begins), forced)).select(*shown))

    left = _open(keys, found, limit)
    word = left.select("q", F.explode(F.array_distinct(F.filter(F.split("q", " "), lambda w: w != ""))).alias("word")).join(tables["word_counts"], "word", "left")
    rarest = word.groupBy("q").agg(F.min_by("word", F.struct(F.coalesce("times", F.lit(0)), "word")).alias("word"))
    has = F.size(F.array_except(F.filter(F.split("q", " "), lambda w: w != ""), F.split("key", " "))) == 0
    hits = rarest.join(tables["words"], "word").where(has & ~F.startswith("key", "q")).select("q", "key")
    four = _without(hits, forced).join(entries, "key").select("q", "key", *SHOWN, F.lit(4).alias("tier"), F.lit(80.0).alias("score"))
    found = settled(found.unionByName(_first(four, limit).select(*shown)))

    left = settled(_open(keys, found, limit))
    pairs = simjoin.similar(left.select(F.col("q").alias("key")), entries.select("key").distinct(), SIMILAR).select(F.col("key").alias("q"), F.col("other").alias("key"), "score")
    pairs = pairs.where(~F.startswith("key", "q") & ~has)
    five = _without(pairs, forced).join(entries, "key").select("q", "key", *SHOWN, F.lit(5).alias("tier"), "score")
    every = found.unionByName(_first(five, limit).select(*shown))
    position = F.row_number().over(Window.partitionBy("q").orderBy(*_order(F.col("tier"))))
    best = every.withColumn("position", position).where(F.col("position") <= limit)
    return asked.join(best, "q").select("query", "position", "key", *SHOWN, "tier", "score")


def _without(rows: DataFrame, forced: DataFrame) -> DataFrame:
    """Candidates that an override has not placed already."""
    return rows.join(forced.select("q", "key"), ["q", "key"], "left_anti")


def _open(keys: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Queries that have fewer results than they may show."""
    full = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    return keys.join(full, "q", "left_anti")


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of a tier: later ones cannot be shown."""
    n = F.row_number().over(Window.partitionBy("q").orderBy(*_order()))
    return rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def suggest(queries: list[str], masters: DataFrame, projects: DataFrame, overrides: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Search of some queries over the warehouse's dimensions, without an index written before."""
    asked = masters.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    return search(asked, index(candidates(masters, projects)), overrides, limit)
