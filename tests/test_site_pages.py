"""Trees of pages against the library's parser; queries over pages read a page once, in as many tasks as the pages need."""

import random
import re
from urllib.parse import urljoin

import pytest

from quarrylane.operators import pages as pg
from quarrylane.plans import site_registry

PIECES = [
    *re.findall(r"<[^>]*>|[^<]+", site_registry.DEVELOPMENT.replace("<<", "").replace(">>", "")), "<!-- c -->", "<!---->", "<!--->", "<!-- a -- b -->", "<!doctype html>", "<script>", "</script>", "<script>a<b</script>",
    "<script>'</p>'</script>", "<title>a &amp; b</title>", "<title>T</title>", "<br/>", "<img src='a'>", "<a href=x>", '<a href="?q=1&amp;r=2&copy=3">', "<a href>", '<a HREF="/A" Class="group X">', "</p x>", "</>", "<p>",
    '<p class="a" class="b">', "<", "<3", "& &lt; &amp &#65;", "<?pi x>", "<![CDATA[x]]>", '<a b="x"c="y">', '<a b="<p>">', "<DIV>", "</DIV>", '<div class="relative"/>', "<textarea><b></textarea>", '<b x="1" / >', "<p \x0b>", '<a x="', "<!-- x",
]


def shape(node):
    return node.tag, node.attrs, node.classes, node.text(), [shape(c) if isinstance(c, pg.Node) else c for c in node.children]


def test_the_short_way_gives_the_same_tree():
    rng, short = random.Random(3), 0
    for _ in range(1500):
        page = "".join(rng.choice(PIECES) if rng.random() < 0.05 else PIECES[rng.randrange(60)] for _ in range(rng.randrange(40)))
        page = page[: rng.randrange(len(page) + 1)] if rng.random() < 0.1 else page
        short += pg._plain(page) is not None
        assert shape(pg.parse(page)) == shape(pg._parsed(page).done()), page
    assert 300 < short < 1450
    assert pg._plain(site_registry.DEVELOPMENT.replace("<<", "").replace(">>", "")) is not None


def test_deep_pages():
    depth = 5000
    root = pg.parse("<div class='a'>" * depth + "x" + "</div>" * depth)
    assert root.text() == "x" and len(root.all("div", "a")) == depth and root.first("div").text() == "x"


@pytest.mark.parametrize("base", ["", "https://site.example/dubai/p1", "http://H.example:80/a?b#c", "https://site.example", "rel/x", "https://u@h.example/z"])
def test_urls_are_joined_as_the_library_does(base):
    for href in ["/a", "/", "//h/x", "/a//b/", "/a/./b", "/a/../b", "/a/.b", "/..", "/a.b-c_d~e/", "/a?x", "/a;p", "/a#f", "b", "../b", "?q", "#f", "http://x.example", "http://x.example/a/../b.c", "https://x.example/a?b", "HTTP://x.example/", "mailto:a", "/é", "/a b", " /a", "/a\n"]:
        assert pg.joined(base, href) == urljoin(base, href), (base, href)


QUERIES = ["site_companies", "site_developments", "site_documents", "site_facts", "site_milestones", "site_timeline", "site_places", "site_sub_buildings", "site_transactions", "site_building_cards", "site_links", "site_areas", "site_sub_communities"]


@pytest.mark.parametrize("name", QUERIES)
def test_a_page_is_parsed_once_and_pages_are_dealt_out(spark, name, tmp_path):
    n = 2 * site_registry.PAGES + 1
    spark.range(n).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "id AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = site_registry.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|MapInPandas", plan)) == 1
    assert df.rdd.getNumPartitions() == 3


def test_only_the_named_records_are_read(spark):
    pages = spark.createDataFrame([("https://s.example/dubai/a", "<h1>A</h1><div><div class='font-bold'>The developer</div><div><a href='/d'>D</a></div></div>"), ("https://s.example/dubai/b", None), (None, "<h1>C</h1>")], "url string, html string")
    some, every = pg.extract(pages, "development", ["companies", "name"]), pg.extract(pages, "development")
    assert some.schema["page"].dataType.names == ["companies", "name"] and every.schema["page"].dataType.names == list(pg.BUILDING)
    rows = lambda df: sorted(str((r.url, r.page["name"], r.page["companies"])) for r in df.collect())
    assert rows(some) == rows(every) and "role='Developer'" in rows(some)[0]
    assert pg.links(pages).collect()[0]["url"] == "https://s.example/d"
