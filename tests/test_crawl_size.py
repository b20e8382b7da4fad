"""Walks of large sites: links stay where they are, and a url's parts are found once."""

import pytest

from quarrylane.functions import urls
from quarrylane.functions import vocabulary as v
from quarrylane.operators import crawl

HOME = f"https://site.example{v.PATH_PREFIX}"


def frames(spark, links):
    seeds = spark.createDataFrame([(1, HOME + "p0", "full"), (2, HOME + "p1", "full")], "job_id long, url string, mode string")
    pages = spark.createDataFrame([(f"{HOME}p{k}", ["area", "area", "development", None][k % 4]) for k in range(40)], "url string, kind string")
    return crawl.opened(seeds), pages, spark.createDataFrame(links, "source string, url string, child boolean")


LINKS = [(f"{HOME}p{k}", f"{HOME}p{(k * m + 3) % 44}", m == 5) for k in range(40) for m in (2, 5, 7)]


@pytest.mark.parametrize(("budget", "per_host"), [(None, None), (7, 3)])
def test_both_ways_to_meet_the_links(spark, monkeypatch, budget, per_host):
    def rows():
        queue = crawl.walk(*frames(spark, LINKS), budget=budget, per_host=per_host)
        return sorted(map(str, queue.select(*crawl.COLUMNS).collect()))

    sent = rows()
    monkeypatch.setattr(crawl, "MOST_SENT", 0)
    assert rows() == sent and len(sent) > 10


def test_a_round_moves_neither_links_nor_pages(spark, monkeypatch):
    plans, real = [], crawl.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(crawl, "settled", seen)
    crawl.walk(*frames(spark, LINKS))
    rounds = [p for p in plans if "source#" in p and "_trusts" in p]
    assert len(rounds) > 2
    for p in rounds:
        assert p.count("FileScan parquet") == 1 and "hashpartitioning(source#" not in p and "hashpartitioning(url#" not in p


URLS = [None, "", "/", "/dubai", "/dubai/", "/dubai/x", "https://site.example/dubai/x", "https://SITE.example/dubai/x?q=.jpg", "https://site.example/dubai/x.JPG", "https://site.example/dubai/x.jpg?v", "https://other.example/dubai/x", "https://site.example/Dubai/x"]
URLS += ["/dubai" + part + "x" for part in v.EXCLUDED_PARTS] + [f"/dubai/a{end}{tail}" for end in v.ASSETS for tail in ("", "x", "\n", "#f")]


def test_the_path_is_found_once(spark):
    def by_hand(url):
        if url is None:
            return None
        host, rest = url.split("://", 1)[1].split("/", 1) if "://" in url else ("", None)
        path = (url if rest is None else "/" + rest).split("?")[0].split("#")[0]
        ok = host.lower() in ("", "site.example") and path.startswith(v.PATH_PREFIX) and path not in (v.PATH_PREFIX, v.PATH_PREFIX.rstrip("/"))
        return ok and not any(x in path for x in v.EXCLUDED_PARTS) and not any(path.lower().endswith(x) for x in v.ASSETS)

    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: r.ok or False for r in rows.select("url", urls.allowed("url", "site.example").alias("ok")).collect()} == {u: by_hand(u) or False for u in URLS}
    assert rows.where(urls.allowed("url", "site.example"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
