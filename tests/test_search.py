"""Search over an index, against ranking every candidate for every query."""

import random

import pytest

from quarrylane.operators import search
from quarrylane.operators.similarity import token_sort_ratio
from quarrylane.operators.versions import Store

COLUMNS = "key string, id long, kind string, name string, subtitle string, slug string, master_slug string"


def brute(query, entries, overrides, limit):
    q = " ".join("".join(c if c.isalnum() or c == "_" else " " for c in query.strip().lower()).split())
    if len(query.strip()) < 2 or not q:
        return []
    out = []
    for key, i, kind, name, *_ in entries:
        if q in overrides and overrides[q] == key:
            tier, score = 2, 100.0
        elif key == q:
            tier, score = (0 if kind == "master" else 1), 100.0
        elif key.startswith(q):
            tier, score = 3, 90.0
        elif set(q.split()) <= set(key.split()):
            tier, score = 4, 80.0
        else:
            tier, score = 5, token_sort_ratio(q, key)
            if score < 70:
                continue
        out.append((tier, 0 if kind == "master" else 1, -score, name, i))
    return [(k + 1, i, tier, round(-score, 9)) for k, (tier, _, score, _, i) in enumerate(sorted(out)[:limit])]


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(5)
    words = ["venice", "azizi", "marina", "gate", "tower", "palm", "bay", "business", "hills", "1", "2", "12", "b"]
    keys = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(160)})
    rows = [(k, n, "master" if n % 4 == 0 else "building", k.title(), f"s{n}", k.replace(" ", "-"), None) for n, k in enumerate(keys)]
    return rows + [(rows[1][0], 900, "master", "Same Key", None, None, None), (rows[1][0], 901, "building", "Same Key", None, None, None)]


@pytest.mark.parametrize("limit", [3, 12])
def test_results_equal_brute_force(spark, entries, tmp_path, limit):
    store = Store(spark, f"{tmp_path}/index")
    with store.write() as tx:
        for name, df in search.index(spark.createDataFrame(entries, COLUMNS)).items():
            tx.replace(name, df)
    held = store.snapshot()
    tables = {name: held.table(name) for name in held.tables}
    queries = ["Venice 12", "ve", "v", " b ", "12", "azizi venise", "marinagate", "palm, bay!", "!!", "  ", "zzzz", "business bay", "tower 1 gate", "bay bay", entries[1][0], entries[40][0].upper(), "hils", "gate marina tower"]
    overrides = {"venice 12": entries[7][0], "hils": entries[3][0], entries[1][0]: entries[1][0]}
    got = search.search(spark.createDataFrame([(q,) for q in queries + queries[:2]] + [(None,)], "query string"), tables, spark.createDataFrame(list(overrides.items()), "key string, target string"), limit).collect()
    for q in queries:
        mine = sorted((r["position"], r["id"], r["tier"], round(r["score"], 9)) for r in got if r["query"] == q)
        assert mine == brute(q, entries, overrides, limit), q
    assert {r["tier"] for r in got} == ({0, 1, 2, 3, 4, 5} if limit > 3 else {r["tier"] for r in got})


def test_limit_beyond_the_index(spark, entries):
    with pytest.raises(ValueError):
        search.search(spark.createDataFrame([("ab",)], "query string"), search.index(spark.createDataFrame(entries, COLUMNS)), limit=51)


def test_subtitles(spark):
    masters = spark.createDataFrame([(1, "azizi venice", "Azizi Venice", "azizi-venice", 3, "Azizi", "South"), (2, "palm", "Palm", "palm", 1, "Nakheel", None), (3, "creek", "Creek", "creek", 1, None, "Creek Harbour"), (4, "alone", "Alone", "alone", 1, None, "")], "master_project_id int, canonical_key string, display_name string, slug string, building_count long, developer_name string, area_name string")
    projects = spark.createDataFrame([(10, " Azizi Venice 12 ", "azizi venice 12", "azizi-venice-12", 1), (11, None, "x", "x", 1), (12, "Palm", "palm", None, 2)], "project_id int, dld_project_name string, canonical_key string, building_slug string, master_project_id int")
    rows = search.suggest(["azizi venice", "palm", "creek", "alone"], masters, projects).collect()
    assert sorted((r["query"], r["position"], r["name"], r["subtitle"], r["slug"], r["master_slug"]) for r in rows) == [
        ("alone", 1, "Alone", "Project", "alone", None), ("azizi venice", 1, "Azizi Venice", "Master Project · 3 buildings", "azizi-venice", None),
        ("azizi venice", 2, "Azizi Venice 12", "Building · Azizi Venice", "azizi-venice-12", "azizi-venice"), ("creek", 1, "Creek", "Project · Creek Harbour", "creek", None), ("palm", 1, "Palm", "Project · Nakheel", "palm", None),
    ]
