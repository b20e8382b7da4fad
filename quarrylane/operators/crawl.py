"""Walk of a site's stored pages to a fixed point, for many jobs at once, and the routes of pages by kind.

A job starts at its seeds, which are trusted. A page that is found is visited; what it links to is found through it if the
page expands:

- an area expands when it is trusted, or when the job covers everywhere (one of its seeds is the index of all areas);
- an expanding area trusts the sub-areas it declares, and nothing else gives trust; only areas hold it, everywhere all do;
- pages of kind ``unknown`` never expand, listings of buildings do not in mode ``discover``, all other pages do.

An area that was visited before it became trusted expands then, so what is reached does not depend on the order of visits.
Rounds are semi-naive: only pages that begin to expand in a round meet the links, which hold the kind of their targets. Rows that cannot change any more are set
aside as they are; those of pages to visit and of areas without trust are the only ones written again.

Urls are canonical. Defined cases: seeds, pages and links that repeat count once (of several kinds of a page, the least);
links with a null end are ignored; a page of null kind is ``unknown``; a page without a stored row has failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import urls
from quarrylane.operators import incremental
from quarrylane.operators import pages as pg
from quarrylane.operators.lineage import on_disk, settled

QUEUE = "job_id long, url string, depth int, discovered_from string, status string, kind string, trusted boolean, mode string, everywhere boolean"
COLUMNS = [c.split()[0] for c in QUEUE.split(", ")]
MODES = ("full", "discover", "enrich", "update")
#: So many rounds' final rows are kept as separate pieces.
PIECES = 8
#: Up to so many pages that expand in a round are sent to all links; more are joined by a shuffle of both.
MOST_SENT = 50_000


def first_rows(rows: DataFrame, keys: list[str], order: list[str], k: int, parts: int = 64) -> DataFrame:
    """The first k rows of each group with their rank: first in parts of a group, then of what the parts leave."""
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return ranked(ranked(rows.withColumn("_part", part), [*keys, "_part"]).drop("rank", "_part"), keys)


def seeds(mode: str, job_id: int, start: DataFrame, limit: int | None = None) -> DataFrame:
    """(job_id, url, mode) of a job.

    Full and discover start at the urls of ``start``; enrich visits stubs and update the likeliest to have changed of
    ``start``, a table of developments.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    if mode == "enrich":
        start = incremental.stubs(start, limit)
    elif mode == "update":
        start = incremental.update_candidates(start, limit)
    return start.select(F.lit(job_id).cast("long").alias("job_id"), "url", F.lit(mode).alias("mode"))


def opened(start: DataFrame) -> DataFrame:
    """The queue of new jobs from their seeds (job_id, url, mode)."""
    known = start.where("url is not null").groupBy("job_id", "url").agg(F.min("mode").alias("mode"))
    everywhere = known.groupBy("job_id").agg(F.bool_or(urls.is_area_index("url")).alias("everywhere"))
    null = F.lit(None).cast("string")
    rows = known.join(everywhere, "job_id").withColumns({"depth": F.lit(0), "discovered_from": null, "status": F.lit("pending"), "kind": null, "trusted": F.lit(True)})
    return rows.select(*COLUMNS)


def expands() -> Column:
    kind = F.coalesce("kind", F.lit("unknown"))
    listing = (kind == "buildings") & (F.col("mode") == "discover")
    return (F.col("status") == "done") & (kind != "unknown") & ~listing & ((kind != "area") | F.col("everywhere") | F.col("trusted"))


def _chosen(pending: DataFrame, used: DataFrame | None, budget: int | None, per_host: int | None) -> DataFrame:
    """What a round visits: of each job and host the first ``per_host``, of each job what is left of its budget."""
    order = ["depth", "url"]
    if per_host is not None:
        pending = first_rows(pending.withColumn("_host", urls.host("url")), ["job_id", "_host"], order, per_host)
    if budget is not None:
        pending = first_rows(pending, ["job_id"], order, budget).join(used, "job_id", "left").where(F.col("rank") <= budget - F.coalesce("used", F.lit(0)))
    return pending.select(*COLUMNS, "_kind")


def walk(queue: DataFrame, pages: DataFrame, links: DataFrame, budget: int | None = None, per_host: int | None = None, most_rounds: int = 10_000) -> DataFrame:
    """The queue after a run over stored pages (url, kind) and links (source, url, child: the source declares url as its sub-area).

    ``budget`` bounds the visits of each job in this run, ``per_host`` those of a job to a host in a round; what they leave is
    pending, and a later run with the returned queue goes on from there.
    """
    if "child" not in links.columns:
        links = links.withColumn("child", F.lit(False))
    pages = settled(pages.where("url is not null").groupBy("url").agg(F.min(F.coalesce("kind", F.lit("unknown"))).alias("_kind")))
    links = links.where("source is not null and url is not null").groupBy("source", "url").agg(F.bool_or(F.coalesce("child", F.lit(False))).alias("child"))
    links = on_disk(links.join(pages, "url", "left"))
    queue = settled(queue.select(*COLUMNS).join(pages, "url", "left"))
    # an area waits for trust; what has expanded, cannot expand or has failed is final
    waits = (F.col("status") == "done") & (F.col("kind") == "area") & ~F.col("everywhere") & ~F.col("trusted")
    live, final = queue.where((F.col("status") == "pending") | waits), [queue.where((F.col("status") != "pending") & ~waits).select(*COLUMNS)]
    limited = budget is not None or per_host is not None
    used = live.select("job_id", F.lit(0).cast("long").alias("used")).distinct() if budget is not None else None
    for _ in range(most_rounds):
        pending = live.where("status = 'pending'")
        stored = F.col("_kind").isNotNull()
        visited = _chosen(pending, used, budget, per_host).withColumns({
            "status": F.when(stored, "done").otherwise("failed"), "kind": F.col("_kind"), "trusted": F.col("trusted") & F.coalesce(F.col("_kind") == "area", F.lit(False)), "new": F.lit(True),
        })
        now = visited.unionByName(live.where("status = 'done'").withColumn("new", F.lit(False))).withColumn("open", expands())
        now = settled(now) if limited else now
        done = now.agg(F.count_if("new").alias("new"), F.count_if("open").alias("open")).first()
        if not done["new"] and not done["open"]:
            break
        if used is not None:
            used = settled(used.unionByName(now.where("new").groupBy("job_id").agg(F.count("*").alias("used"))).groupBy("job_id").agg(F.sum("used").alias("used")))
        through = now.where("open").select("job_id", F.col("url").alias("source"), (F.col("depth") + 1).alias("depth"), (F.col("kind") == "area").alias("area"), "mode", "everywhere")
        found = (F.broadcast(through) if done["open"] <= MOST_SENT else through).join(links, "source").groupBy("job_id", "url").agg(
            F.min(F.struct("depth", "source")).alias("_by"), F.bool_or(F.col("child") & F.col("area") | F.col("everywhere")).alias("_trusts"),
            F.min("mode").alias("_mode"), F.bool_or("everywhere").alias("_everywhere"), F.min("_kind").alias("_found"),
        )
        final.append(now.where(~waits).select(*COLUMNS))
        if len(final) > PIECES:
            final = [settled(reduce(DataFrame.unionByName, final))]
        left = now.where(waits).select(*COLUMNS, "_kind")
        if limited:
            left = left.unionByName(pending.join(now.where("new").select("job_id", "url"), ["job_id", "url"], "left_anti").select(*COLUMNS, "_kind"))
        met = left.join(found, ["job_id", "url"], "full").select(
            "job_id", "url", F.coalesce("depth", "_by.depth").alias("depth"), F.when(F.col("depth").isNull(), F.col("_by.source")).otherwise(F.col("discovered_from")).alias("discovered_from"),
            F.coalesce("status", F.lit("pending")).alias("status"), "kind", (F.coalesce("trusted", F.lit(False)) | F.coalesce("_trusts", F.lit(False))).alias("trusted"),
            F.coalesce("mode", "_mode").alias("mode"), F.coalesce("everywhere", "_everywhere").alias("everywhere"), F.coalesce("_kind", "_found").alias("_kind"),
        )
        known = reduce(DataFrame.unionByName, [f.select("job_id", "url") for f in final])
        live = settled(met.join(known, ["job_id", "url"], "left_anti"))
    else:
        raise RuntimeError("the walk has more rounds than allowed")
    return reduce(DataFrame.unionByName, [*final, live.select(*COLUMNS)])


def job_states(queue: DataFrame) -> DataFrame:
    """(job_id, state, done, failed, pending): completed where nothing is left to visit, else paused."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    state = F.when(F.count_if(F.col("status") == "pending") == 0, "completed").otherwise("paused").alias("state")
    return queue.groupBy("job_id").agg(state, n("done"), n("failed"), n("pending"))


# -- stored pages -----------------------------------------------------------------------------------------------------


def edges(pages: DataFrame, site: str) -> DataFrame:
    """(source, url, child) of all links within the crawled part of the site, from pages (url, html, kind)."""
    target = urls.canonical("url")
    linked = pg.links(pages).select("source", target.alias("url"), F.lit(False).alias("child"))
    declared = pg.extract(pages.where("kind = 'area'"), "area", ["sub_communities"]).select(F.col("url").alias("source"), F.explode("page.sub_communities.url").alias("url"))
    return linked.unionByName(declared.select("source", target.alias("url"), F.lit(True).alias("child"))).where(urls.allowed("url", site))


def routed(pages: DataFrame, areas: DataFrame, mode: str = "full") -> dict[str, DataFrame]:
    """What each kind of page (url, html) is stored as.

    Listings of buildings, amenities and schools belong to the area whose url they extend and are taken only if it is known:
    in ``areas`` (url) or among the pages. In mode discover a listing's buildings become stubs. Other kinds are only named.
    """
    pages = settled(pg.kinds(pages.select("url", "html")))
    of = lambda kind: pages.where(F.col("kind") == kind)
    known = areas.select("url").unionByName(of("area").select("url")).where("url is not null").distinct().withColumnRenamed("url", "area_url")
    within = lambda kind: of(kind).withColumn("area_url", F.regexp_replace("url", f"/{kind}$", "")).join(known, "area_url", "left_semi").select("url", "html")
    area_of = lambda rows, kind: rows.withColumn("area_url", F.regexp_replace("url", f"/{kind}$", "")).drop("url")
    cards = pg.extract(within("buildings"), "area", ["building_cards"]).select("url", F.explode("page.building_cards").alias("card"))
    cards = area_of(cards, "buildings").select("area_url", "card.*")
    out = {"areas": pg.areas(of("area")), "developments": pg.developments(of("development")), "buildings": cards}
    out |= {kind: area_of(pg.listing(within(kind), kind), kind) for kind in ("amenities", "schools")}
    if mode == "discover":
        out["stubs"] = cards.groupBy("url").agg(F.min(F.struct("area_url", "name", "raw_status")).alias("s")).select("url", "s.*", F.lit(True).alias("is_stub"))
    out["others"] = pages.where(~F.col("kind").isin("area", "development", "buildings", "amenities", "schools")).select("url", "kind")
    return out
