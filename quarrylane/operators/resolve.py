"""Entity resolution of raw names against the catalogue: overrides, exact keys, then name similarity.

Confidence is exact, fuzzy_high (90 and up: linked), fuzzy_low (75 and up: kept for review, not linked) or unmatched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import normalize as nz
from quarrylane.operators import ranks, similarity, simjoin
from quarrylane.operators.lineage import settled
from quarrylane.operators.medians import null_safe

HIGH, LOW = 90.0, 75.0


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def _pool(parts: list[DataFrame]) -> DataFrame:
    """(key, id) from (name, id, row) tables in order of precedence; the first writer of a key wins."""
    rows = None
    for rank, part in enumerate(parts):
        part = part.select(nz.canonical_key("name").alias("key"), "id", "row", F.lit(rank).alias("rank")).where("key <> ''")
        rows = part if rows is None else rows.unionByName(part)
    return first_by(rows, ["key"], "rank", "row", "id").select("key", "id")


def area_candidates(areas: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """Names, registered names and aliases of areas (in row order), then sub-communities, which stand for their parent."""
    named = areas.select("id", F.posexplode(F.concat(F.array("name", "dld_community_name_en"), nz.split_names("also_known_as"))).alias("at", "name"))
    rows = named.where("name is not null").select("name", "id", F.struct("id", "at").alias("row"))
    parts = [rows]
    if subs is not None:
        parts.append(subs.select("name", F.col("parent_area_id").alias("id"), F.struct(F.col("id").alias("id"), F.lit(0).alias("at")).alias("row")))
    return _pool(parts)


def project_candidates(developments: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(development keys, building keys with id and development_id)."""
    row = F.struct(F.col("id").alias("id"), F.lit(0).alias("at")).alias("row")
    devs = _pool([developments.select("name", "id", row)])
    built = _pool([buildings.select("name", "id", row)])
    return devs, built.join(buildings.select("id", "development_id"), "id")


def best_match(keys: DataFrame, candidates: DataFrame, least: float = LOW) -> DataFrame:
    """(key, id, score) of the most similar candidate of every key that has one of ``least`` or more; ties go to the least
    candidate key. Keys without such a candidate have no row, however many candidates there are."""
    pairs = simjoin.similar(keys, candidates, least).join(candidates.select(F.col("key").alias("other"), "id"), "other")
    return pairs.groupBy("key").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("other"))).alias("_b")).select("key", "_b.id", "_b.score")


def match(keys: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(key, matched_id, confidence, score) of distinct canonical keys. An override without an id confirms that there is no match.

    The score of an unmatched key is NULL: by definition no candidate of 75 or more exists, and lower ones are not ranked.
    An empty key and one that an override leaves without a match have 0.
    """
    rows = keys.select("key").distinct()
    if overrides is None:
        rows = rows.withColumn("_o", F.lit(None).cast("long")).withColumn("_has", F.lit(False))
    else:
        rows = rows.join(overrides.select("key", F.col("id").alias("_o"), F.lit(True).alias("_has")), "key", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    rows = rows.join(candidates.select("key", F.col("id").alias("_e")), "key", "left")
    open_ = rows.where("not _has and _e is null and key <> ''")
    fuzzy = best_match(open_, candidates).select("key", F.col("id").alias("_f"), F.col("score").alias("_s"))
    rows = rows.join(fuzzy, "key", "left")
    exact = (F.col("_has") & F.col("_o").isNotNull()) | (~F.col("_has") & F.col("_e").isNotNull() & (F.col("key") != ""))
    high = ~F.col("_has") & (F.col("_s") >= HIGH)
    return rows.select(
        "key", F.when(exact, F.coalesce("_o", "_e")).when(high, F.col("_f")).alias("matched_id"),
        F.when(exact, "exact").when(high, "fuzzy_high").when(~F.col("_has") & (F.col("_s") >= LOW), "fuzzy_low").otherwise("unmatched").alias("confidence"),
        F.when(exact, 100.0).when(F.col("_has") | (F.col("key") == ""), 0.0).otherwise(F.col("_s")).alias("score"),
    )


def resolve_projects(keys: DataFrame, devs: DataFrame, buildings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(key, development_id, building_id, confidence, score): an override first, then a linked building, else a development."""
    b = match(keys, buildings.select("key", "id"))
    b = b.join(buildings.select(F.col("id").alias("matched_id"), "development_id").distinct(), "matched_id", "left").where(F.col("confidence").isin("exact", "fuzzy_high"))
    b = b.select("key", F.col("matched_id").alias("_b"), F.col("development_id").alias("_bd"), F.col("confidence").alias("_bc"), F.col("score").alias("_bs"))
    d = match(keys, devs, overrides).join(b, "key", "left")
    if overrides is not None:
        d = d.join(overrides.select("key", F.lit(True).alias("_has")), "key", "left")
    else:
        d = d.withColumn("_has", F.lit(None).cast("boolean"))
    use = F.col("_bd").isNotNull() & F.col("_has").isNull()
    return d.select("key", F.when(use, F.col("_bd")).otherwise(F.col("matched_id")).alias("development_id"), F.when(use, F.col("_b")).alias("building_id"), F.when(use, F.col("_bc")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, F.col("_bs")).otherwise(F.col("score")).alias("score"))


# -- dimensions -------------------------------------------------------------------------------------------------------


def _resolved(rows: DataFrame, known: DataFrame | None, same: list[str], how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what ``how`` finds for their keys; rows that are in known with the same columns keep what they had."""
    if known is None:
        return rows.join(how(rows), "key")
    old = null_safe(rows, known, same, "inner")
    new = settled(null_safe(rows, known.select(*same).distinct(), same, "left_anti"))
    return old.unionByName(new.join(how(new), "key").select(*old.columns))


def dim_area(raw_names: DataFrame, areas: DataFrame, subs: DataFrame | None = None, overrides: DataFrame | None = None, known: DataFrame | None = None, same_catalogue: bool = False) -> DataFrame:
    """Areas of the facts (column name) and of the catalogue. Keys collapse spellings; unmatched names stay rows.

    community_key is s and the catalogue id where there is one, else a and the area id. Ids are those that ``known``, an earlier
    dim_area, has for the keys; new keys come behind them in order. With ``same_catalogue`` its matches are kept too.
    """
    names = raw_names.where("name is not null").groupBy(nz.canonical_key("name").alias("key")).agg(F.min("name").alias("dld_area_name")).where("key <> ''")
    old = only_old = most = None
    if known is not None:
        own_old = known.where("match_confidence <> 'scraped_only'")
        most = known.agg(F.coalesce(F.max("area_id"), F.lit(0))).first()[0]
        ids = own_old.select(F.col("canonical_key").alias("key"), "area_id")
        only_old = known.where("match_confidence = 'scraped_only'").select(F.col("scraped_area_id").alias("id"), "area_id")
        if same_catalogue:
            old = own_old.select(F.col("canonical_key").alias("key"), F.col("scraped_area_id").alias("matched_id"), F.col("match_confidence").alias("confidence"), F.col("match_score").alias("score"))
    candidates = settled(area_candidates(areas, subs))
    matched = _resolved(settled(names), old, ["key"], lambda rows: match(rows, candidates, overrides))
    own = settled(ranks.kept(matched, "key", "area_id", None if known is None else ids, most))
    only = areas.select("id", "name", nz.canonical_key("name").alias("key")).join(own.select(F.col("matched_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    start = own.agg(F.coalesce(F.max("area_id"), F.lit(0))).first()[0]
    only = ranks.kept(only.withColumn("id", F.col("id").cast("long")), "id", "area_id", only_old, max(start, most or 0))
    only = only.select("area_id", F.lit(None).cast("string").alias("dld_area_name"), "key", F.col("id").alias("matched_id"), F.lit("scraped_only").alias("confidence"), F.lit(100.0).alias("score"))
    both = own.select("area_id", "dld_area_name", "key", F.col("matched_id").cast("long").alias("matched_id"), "confidence", "score").unionByName(only)
    both = both.join(areas.select(F.col("id").cast("long").alias("matched_id"), F.col("name").alias("_name")), "matched_id", "left")
    linked = F.col("matched_id").isNotNull()
    return both.select(
        "area_id", "dld_area_name", F.col("key").alias("canonical_key"), F.col("matched_id").alias("scraped_area_id"), F.col("confidence").alias("match_confidence"), F.col("score").alias("match_score"),
        F.when(linked, F.concat(F.lit("s"), "matched_id")).otherwise(F.concat(F.lit("a"), "area_id")).alias("community_key"), F.coalesce("_name", "dld_area_name").alias("community_name"),
    )


def dim_project(raw: DataFrame, developments: DataFrame, buildings: DataFrame, overrides: DataFrame | None = None, known: DataFrame | None = None, same_catalogue: bool = False) -> DataFrame:
    """Projects of the facts (columns name, master): one row per key; the master's name is tried where the own name has no match.

    Ids are those that ``known``, an earlier dim_project, has for the keys; with ``same_catalogue`` rows of the same name and master
    keep their matches too.
    """
    rows = raw.where("name is not null").withColumn("key", nz.canonical_key("name")).where("key <> ''")
    rows = first_by(rows, ["key"], F.asc_nulls_last("name"), F.asc_nulls_last("master")).withColumn("mkey", nz.canonical_key("master"))
    devs, built = project_candidates(developments, buildings)
    rows, devs, built = settled(rows), settled(devs), settled(built)

    def found(rows: DataFrame) -> DataFrame:
        own = settled(resolve_projects(rows, devs, built, overrides))
        open_ = own.where("development_id is null").join(rows.select("key", "mkey"), "key").where("mkey <> ''")
        by_master = resolve_projects(open_.select(F.col("mkey").alias("key")).distinct(), devs, built).where("development_id is not null")
        by_master = by_master.select(F.col("key").alias("mkey"), F.col("development_id").alias("_d"), F.col("building_id").alias("_b"), F.col("confidence").alias("_c"), F.col("score").alias("_s"))
        out = rows.select("key", "mkey").join(own, "key").join(by_master, "mkey", "left")
        use = F.col("development_id").isNull() & F.col("_d").isNotNull()
        pick = lambda a, b: F.when(use, F.col(a)).otherwise(F.col(b))
        return out.select("key", pick("_d", "development_id").alias("matched_development_id"), pick("_b", "building_id").alias("matched_building_id"), pick("_c", "confidence").alias("match_confidence"), pick("_s", "score").alias("match_score"))

    old = ids = None
    if known is not None:
        ids = known.select(F.col("canonical_key").alias("key"), "project_id")
        if same_catalogue:
            old = known.select(F.col("canonical_key").alias("key"), F.col("dld_project_name").alias("name"), F.col("dld_master_project_name").alias("master"), "matched_development_id", "matched_building_id", "match_confidence", "match_score")
    out = ranks.kept(_resolved(rows, old, ["key", "name", "master"], found), "key", "project_id", ids)
    return out.select("project_id", F.col("name").alias("dld_project_name"), F.col("master").alias("dld_master_project_name"), F.col("key").alias("canonical_key"), "matched_development_id", "matched_building_id", "match_confidence", "match_score")


def unique_slugs(rows: DataFrame, slug: str, order: str, within: list[str] | None = None) -> DataFrame:
    """slug made unique with -2, -3 ... in order; a suffixed slug that another row has by itself is moved on."""
    keys = [*(within or []), slug]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = rows.withColumn("_n", n).withColumn("_u", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("_n").cast("string"))))
    k = F.row_number().over(Window.partitionBy(*(within or []), "_u").orderBy("_n", order))
    out = out.withColumn("_k", k).withColumn("_u", F.when(F.col("_k") == 1, F.col("_u")).otherwise(F.concat_ws("-", "_u", F.lit("x"), F.col(order).cast("string"))))
    return out.withColumn(slug, F.col("_u")).drop("_n", "_u", "_k")


def hierarchy(projects: DataFrame, overrides: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(projects with master_project_id, building_label, building_slug, grouping_method; master projects).

    overrides (key, master_key) move a project to another family. Families with a hyphen split or an override need review.
    Families keep the ids that ``known``, earlier master projects, has for their keys.
    """
    p = projects.withColumn("_s", nz.building_suffix(F.col("dld_project_name"), F.col("canonical_key")))
    p = p.select(*projects.columns, F.col("_s.master_key").alias("_m"), F.col("_s.label").alias("building_label"), F.col("_s.method").alias("grouping_method"))
    if overrides is not None:
        p = p.join(overrides.select(F.col("key").alias("canonical_key"), F.col("master_key").alias("_o")), "canonical_key", "left")
        p = p.withColumn("grouping_method", F.when(F.col("_o").isNotNull(), "manual_override").otherwise(F.col("grouping_method"))).withColumn("_m", F.coalesce("_o", "_m")).drop("_o")
    families = p.groupBy("_m").agg(F.count(F.lit(1)).alias("building_count"), F.max(F.col("grouping_method").isin("hyphen_split", "manual_override")).alias("needs_review"))
    ids = None if known is None else known.select(F.col("canonical_key").alias("_m"), "master_project_id")
    families = settled(ranks.kept(families, "_m", "master_project_id", ids)).withColumn("slug", nz.slugify("_m"))
    masters = unique_slugs(families, "slug", "master_project_id").select("master_project_id", F.col("_m").alias("canonical_key"), nz.display_name("_m").alias("display_name"), "slug", "building_count", "needs_review")
    p = p.join(families.select("_m", "master_project_id"), "_m").drop("_m").withColumn("building_slug", nz.slugify(F.coalesce("dld_project_name", F.lit(""))))
    return unique_slugs(p, "building_slug", "project_id"), masters


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key, the least on ties; NULL values do not count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def enrich_masters(masters: DataFrame, sales: DataFrame, rentals: DataFrame, projects: DataFrame, area: DataFrame, developments: DataFrame, developers: DataFrame) -> DataFrame:
    """masters with developer_name and area_name: the mode over sales, over rentals where sales have none."""
    dev = projects.select("project_id", "master_project_id", F.col("matched_development_id").alias("_d")).join(developments.select(F.col("id").alias("_d"), F.col("developer_id").alias("_v")), "_d", "left").join(developers.select(F.col("id").alias("_v"), F.col("name").alias("developer_name")), "_v", "left")

    def side(facts: DataFrame) -> DataFrame:
        f = facts.select("project_id", "area_id").join(dev.select("project_id", "master_project_id", "developer_name"), "project_id").join(area.select("area_id", F.col("community_name").alias("area_name")), "area_id", "left")
        return mode_by(f, "master_project_id", "developer_name").join(mode_by(f, "master_project_id", "area_name"), "master_project_id", "full_outer")

    s, r = side(sales), side(rentals).select("master_project_id", F.col("developer_name").alias("_d"), F.col("area_name").alias("_a"))
    out = masters.join(s, "master_project_id", "left").join(r, "master_project_id", "left")
    return out.withColumn("developer_name", F.coalesce("developer_name", "_d")).withColumn("area_name", F.coalesce("area_name", "_a")).drop("_d", "_a")


# -- search, review, late links ---------------------------------------------------------------------------------------


def rank_search(query: str, candidates: DataFrame, overrides: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Candidates (key, name, kind master or building) that match a query, by tier: override 2 (looked up first), exact
    master 0, exact building 1, prefix 3, all tokens 4, similarity of 70 or more 5. Queries under two characters find nothing.
    One query over a small list; ``search`` serves many queries over an index."""
    rows = candidates.withColumn("_q", nz.canonical_key(F.lit(query)))
    rows = rows.withColumn("score", similarity.token_sort("_q", "key"))
    forced = F.lit(False)
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("key").alias("_q"), F.col("target").alias("_t")), "_q", "left")
        forced = F.coalesce(F.col("_t") == F.col("key"), F.lit(False))
    tokens = F.size(F.array_except(F.split("_q", " "), F.split("key", " "))) == 0
    tier = (
        F.when(forced, 2).when((F.col("key") == F.col("_q")) & (F.col("kind") == "master"), 0).when(F.col("key") == F.col("_q"), 1)
        .when(F.startswith("key", "_q"), 3).when(tokens, 4).when(F.col("score") >= 70, 5)
    )
    rows = rows.where(F.length("_q") >= 2).withColumn("tier", tier).where("tier is not null")
    rows = rows.withColumn("score", F.when(F.col("tier") <= 2, 100.0).when(F.col("tier") == 3, 90.0).when(F.col("tier") == 4, 80.0).otherwise(F.col("score")))
    order = ["tier", F.when(F.col("kind") == "master", 0).otherwise(1), F.desc("score"), "name"]
    return rows.orderBy(*order).limit(limit).select("name", "kind", "key", "tier", "score")


def review_queue(dimension: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return dimension.where("match_confidence = 'fuzzy_low'").orderBy(F.desc_nulls_last("match_score"), key).limit(limit)


def write_override(overrides: DataFrame, key: str, **values: object) -> DataFrame:
    """overrides with the entry of a name replaced."""
    spark = overrides.sparkSession
    new = spark.createDataFrame([(key, *values.values())], f"raw string, {', '.join(f.simpleString().replace(':', ' ') for f in overrides.schema if f.name != 'key')}")
    new = new.select(nz.canonical_key("raw").alias("key"), *[F.col(c) for c in new.columns if c != "raw"])
    return overrides.join(new.select("key"), "key", "left_anti").select(*overrides.columns).unionByName(new.select(*overrides.columns))


def link_areas(developments: DataFrame, areas: DataFrame) -> DataFrame:
    """developments with missing area_id filled by the area's name, else by its registered name; the least id on ties."""
    by = lambda c, name: areas.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("area_raw")).agg(F.min("id").alias(name))
    out = developments.join(by("name", "_a"), "area_raw", "left").join(by("dld_community_name_en", "_b"), "area_raw", "left")
    return out.withColumn("area_id", F.coalesce("area_id", "_a", "_b")).select(*developments.columns)
