"""Walks against a page-by-page walk; routes of pages."""

import random

import pytest

from quarrylane.functions import vocabulary as v
from quarrylane.operators import crawl
from quarrylane.plans import crawl_registry, site_registry

HOME = f"https://site.example{v.PATH_PREFIX}"
KINDS = ["area", "area", "area", "development", "buildings", "unknown", None]


def site(seed, n, degree):
    """Pages (some not stored), links with declared sub-areas, repeated and null ends."""
    rng = random.Random(seed)
    name = lambda k: f"{HOME if k % 3 else HOME.replace('site', 'second')}p{k}"
    pages = [(name(k), rng.choice(KINDS)) for k in range(n) if rng.random() < 0.9]
    links = [(name(rng.randrange(n)), name(rng.randrange(n)), rng.random() < 0.4) for _ in range(n * degree)]
    return name, pages, [*links, *links[:5], (None, name(1), True), (name(1), None, False)]


def by_hand(seeds, pages, links):
    """{(job, url): trusted} of all visited pages: one page after the other until nothing changes."""
    kinds = {u: k or "unknown" for u, k in pages}
    index = HOME + v.AREA_INDEX
    out = {}
    for job in {j for j, _, _ in seeds}:
        mode = next(m for j, _, m in seeds if j == job)
        seen = {u: True for j, u, _ in seeds if j == job}
        everywhere = index in seen
        changed = True
        while changed:
            changed = False
            for source, url, child in links:
                kind = kinds.get(source)
                if source not in seen or url is None or kind in (None, "unknown") or kind == "buildings" and mode == "discover":
                    continue
                if kind == "area" and not (everywhere or seen[source]):
                    continue
                trusted = seen.get(url, False) or child and kind == "area" or everywhere
                if seen.get(url) != trusted:
                    seen[url], changed = trusted, True
        out |= {(job, u): t for u, t in seen.items()}
    return out


def frames(spark, seeds, pages, links):
    return (
        crawl.opened(spark.createDataFrame(seeds, "job_id long, url string, mode string")), spark.createDataFrame(pages, "url string, kind string"),
        spark.createDataFrame(links, "source string, url string, child boolean"),
    )


@pytest.mark.parametrize(("seed", "n", "degree"), [(1, 60, 2), (2, 40, 3)])
def test_walk_is_a_fixed_point(spark, seed, n, degree):
    name, pages, links = site(seed, n, degree)
    index = HOME + v.AREA_INDEX
    pages.append((index, "area_index"))
    links += [(index, name(k), True) for k in range(0, n, 9)]
    seeds = [(1, pages[0][0], "full"), (2, pages[1][0], "discover"), (2, pages[2][0], "discover"), (3, index, "full"), (1, pages[0][0], "full")]
    queue = crawl.walk(*frames(spark, seeds, pages, links))
    rows = queue.collect()
    expected = by_hand(seeds, pages, links)
    assert {(r.job_id, r.url): r.trusted for r in rows if r.kind == "area"} == {k: t for k, t in expected.items() if dict(pages).get(k[1]) == "area"}
    assert sorted((r.job_id, r.url) for r in rows) == sorted(expected)
    assert {r.status for r in rows if r.url not in dict(pages)} <= {"failed"} and all(r.status == "done" for r in rows if r.url in dict(pages))
    depth = {(r.job_id, r.url): r.depth for r in rows}
    assert all(r.depth == (0 if r.discovered_from is None else depth[r.job_id, r.discovered_from] + 1) for r in rows)


def test_budgets_pause_and_go_on(spark):
    name, pages, links = site(5, 24, 3)
    seeds = [(1, pages[0][0], "full"), (2, pages[3][0], "full")]
    queue, *rest = frames(spark, seeds, pages, links)
    whole = {(r.job_id, r.url, r.status) for r in crawl.walk(queue, *rest).collect()}
    before = {1: 0, 2: 0}
    for _ in range(40):
        queue = crawl.walk(queue, *rest, budget=9, per_host=3)
        state = {r.job_id: r for r in crawl.job_states(queue).collect()}
        for job, r in state.items():
            visits = r.done + r.failed - before[job]
            assert visits <= 9 and (visits == 9 or r.state == "completed")
            before[job] = r.done + r.failed
        if all(r.state == "completed" for r in state.values()):
            break
    assert {(r.job_id, r.url, r.status) for r in queue.collect()} == whole


def test_a_mention_gives_no_trust(spark):
    u = lambda x: HOME + x
    pages = [(u(x), "area") for x in ("seed", "child", "far", "far-child")]
    links = [(u("seed"), u("child"), True), (u("seed"), u("far"), False), (u("far"), u("far-child"), True), (u("child"), u("seed"), False)]
    rows = crawl.walk(*frames(spark, [(1, u("seed"), "full")], pages, links)).collect()
    assert {r.url.rsplit("/", 1)[1]: r.trusted for r in rows} == {"seed": True, "child": True, "far": False}
    later = [*links, (u("child"), u("far"), True)]
    assert crawl.walk(*frames(spark, [(1, u("seed"), "full")], pages, later)).count() == 4


def test_empty_tables(spark):
    queue, pages, links = frames(spark, [], [], [])
    assert crawl.walk(queue, pages, links).count() == 0
    alone, pages, links = frames(spark, [(1, HOME + "x", "full"), (1, None, "full")], [], [])
    assert [(r.url, r.status) for r in crawl.walk(alone, pages, links.drop("child")).collect()] == [(HOME + "x", "failed")]


def test_first_rows(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS g", "(id * 7919) % 5000 AS x")
    got = crawl.first_rows(rows, ["g"], ["x"], 10, parts=8).collect()
    want = {g: sorted(k * 7919 % 5000 for k in range(5000) if k % 3 == g)[:10] for g in range(3)}
    assert {g: [r.x for r in sorted(got, key=lambda r: r.rank) if r.g == g] for g in range(3)} == want


def test_modes(spark):
    rows = spark.createDataFrame([("a", True, True, "planned", None), ("b", False, True, "planned", "2026-01-01"), ("c", False, True, "completed", None)], "url string, is_stub boolean, is_active boolean, normalized_status string, last_seen_at string")
    urls = lambda mode, limit=None: [r.url for r in crawl.seeds(mode, 4, rows, limit).collect()]
    assert urls("enrich") == ["a"] and sorted(urls("update")) == ["b", "c"] and urls("update", 1) == ["b"] and len(urls("full")) == 3
    with pytest.raises(ValueError):
        crawl.seeds("all", 1, rows)


def test_routes(spark):
    part = spark.createDataFrame([(3, "blue steel", "Brand#1", "TIN", 7, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    area, schools = site_registry.pages(part, site_registry.AREA), site_registry.pages(part, site_registry.SCHOOLS, "/schools")
    listing = site_registry.pages(part, site_registry.AREA, "/buildings")
    lone = site_registry.pages(part.withColumn("p_partkey", part.p_partkey + 1), site_registry.SCHOOLS, "/schools")
    other = spark.createDataFrame([("https://site.example/dubai/zz", "<p>x</p>")], "url string, html string")
    pages = area.unionByName(schools).unionByName(listing).unionByName(lone).unionByName(other).unionByName(site_registry.DEV(part.withColumn("p_partkey", part.p_partkey + 2)))
    out = crawl.routed(pages, spark.createDataFrame([], "url string"), "discover")
    assert {k: df.count() for k, df in out.items()} == {"areas": 1, "developments": 1, "buildings": 2, "amenities": 0, "schools": 2, "stubs": 2, "others": 1}
    home = site_registry.HOME
    assert {r.area_url for r in out["schools"].collect()} == {home + "p3"} and {r.url for r in out["stubs"].collect()} == {home + "b3", home + "c3"}
    known = crawl.routed(pages, spark.createDataFrame([(home + "p4",)], "url string"))
    assert known["schools"].count() == 4 and "stubs" not in known
    found = {(r.url, r.child) for r in crawl.edges(site_registry.pages(part, site_registry.AREA).selectExpr("*", "'area' AS kind"), "site.example").collect()}
    assert (home + "sub-3", True) in found and (home + "sub-3", False) in found and all(u.startswith(home) for u, _ in found)


def test_query_is_not_trivial(spark):
    rows = crawl_registry.reached(spark, "/root/testdata/sf0.001").groupBy("kind", "trusted").count().collect()
    assert len(rows) >= 3
