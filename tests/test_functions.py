"""Literal expectations of the normalising, metric and URL functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import metrics as m
from quarrylane.functions import normalize as nz
from quarrylane.functions import periods, urls

SITE = "site.example"


def value(spark, column, **inputs):
    df = spark.range(1)
    for k, x in inputs.items():
        df = df.withColumn(k, F.lit(x) if x is not None else F.lit(None).cast("string"))
    return df.select(column.alias("x")).first()["x"]


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("cur,prev,out", [(110, 100, 10.0), (90, 100, -10.0), (1, 0, None), (1, None, None), (None, 1, None)])
def test_pct_change(spark, cur, prev, out):
    assert value(spark, m.pct_change(num(cur), num(prev))) == out


@pytest.mark.parametrize("pct,out", [(10, "accelerating"), (-10, "slowing"), (1, "stable"), (-1, "stable"), (None, "insufficient_data")])
def test_momentum(spark, pct, out):
    assert value(spark, m.momentum(num(pct))) == out


@pytest.mark.parametrize("rent,price,out", [(60000, 1000000, 6.0), (None, 5, None), (5, 0, None), (0, 5, None)])
def test_yield(spark, rent, price, out):
    assert value(spark, m.gross_yield(num(rent), num(price))) == out


@pytest.mark.parametrize("units,demand,out", [(10, 100, "low"), (100, 100, "moderate"), (200, 100, "high"), (500, 100, "very_high"), (None, 1, "insufficient_data"), (0, 0, "insufficient_data"), (5, 0, "very_high")])
def test_oversupply(spark, units, demand, out):
    assert value(spark, m.oversupply_risk(num(units), num(demand))) == out


def test_liquidity_and_scores(spark):
    assert value(spark, m.liquidity(num(100000), 1.0, num(1))) == 100.0
    assert value(spark, m.liquidity(num(0), 6.0, num(0))) == 0.0
    assert 0 < value(spark, m.liquidity(num(300), 6.0, num(1))) <= 100
    assert value(spark, m.weighted_score({"a": num(None), "b": num(80)}, {"a": 0.5, "b": 0.5})) == 80.0
    assert value(spark, m.weighted_score({"a": num(None)}, {"a": 1.0})) is None
    assert value(spark, m.yield_score(num(None))) is None
    assert value(spark, m.appreciation_score(num(40))) == 100.0


def test_periods():
    low, high = date(2025, 1, 1), date(2026, 8, 15)
    p = periods.resolve(low, high, "30d")
    assert p.days == 30 and p.end == high and (p.start - p.prev_end).days == 1 and (p.prev_end - p.prev_start).days == 29
    assert periods.resolve(low, high, "180d").days == 180
    assert periods.resolve(low, high, "nonsense").days == 30
    every = periods.resolve(low, high, "all")
    assert every.start == low and every.prev_end < every.prev_start
    assert periods.resolve(low, high, "ytd").start == date(2026, 1, 1)
    own = periods.resolve(low, high, start="2026-01-01", end="2026-01-10")
    assert own.days == 10 and own.prev_start == date(2025, 12, 22)


@pytest.mark.parametrize("raw,out", [("Jumeirah Village Circle (JVC)", "jumeirah village circle jvc"), ("Café–Bar", "cafebar"), ("a_b  C!", "a_b c"), ("", ""), (None, "")])
def test_canonical_key(spark, raw, out):
    assert value(spark, nz.canonical_key("a"), a=raw) == out


@pytest.mark.parametrize("raw,out", [("Studio", "Studio"), ("5 B/R", "5BR+"), ("2 B/R", "2BR"), ("0 B/R", "0BR"), ("PENTHOUSE", "Other"), ("Office", "Other"), ("x", "Other"), (" ", None), (None, None)])
def test_bedroom_labels(spark, raw, out):
    assert value(spark, nz.bedroom_from_label("a"), a=raw) == out


@pytest.mark.parametrize("rooms,sub,out", [(3.0, "Villa", "3BR"), (None, "Flat", "Unknown"), (0.0, None, "Studio"), (7.0, None, "5BR+"), (2.0, " studio ", "Studio"), (float("nan"), None, "Unknown")])
def test_bedroom_rooms(spark, rooms, sub, out):
    assert value(spark, nz.bedroom_from_rooms(num(rooms), "b"), b=sub) == out


@pytest.mark.parametrize("raw,out", [
    ("AZIZI VENICE 14", ("azizi venice", "14", "trailing_number")), ("Azizi Venice Tower 14", ("azizi venice", "14", "trailing_number")),
    ("Creek Beach - Canopy - Moor", ("creek beach", "Canopy - Moor", "hyphen_split")), ("EMIRATES GARDEN 1 (LAVENDER - GARDENIA - ROSE)", ("emirates garden 1 lavender gardenia rose", None, "none")), (None, ("", None, "none")),
])
def test_building_suffix(spark, raw, out):
    df = spark.createDataFrame([(raw,)], "a string").select(nz.building_suffix(F.col("a"), nz.canonical_key("a")).alias("s")).select("s.*")
    assert tuple(df.first()) == out


@pytest.mark.parametrize("raw,out", [("Azizi Venice - 15!!", "azizi-venice-15"), ("  ", "project"), (None, "project")])
def test_slug(spark, raw, out):
    assert value(spark, nz.slugify("a"), a=raw) == out


@pytest.mark.parametrize("raw,out", [("Under development (Cancelled)", "cancelled"), ("Under development (On hold)", "on_hold"), ("Complete", "completed"), ("Design stage", "planned"), ("?", "other"), (None, "other")])
def test_status(spark, raw, out):
    assert value(spark, nz.status("a"), a=raw) == out


@pytest.mark.parametrize("raw,out", [("since June 2015", "2015-06"), ("Q1 2025", "2025-Q1"), ("in 2021", "2021"), ("May 2020", "2020-05"), ("none", None), (None, None)])
def test_fuzzy_date(spark, raw, out):
    assert value(spark, nz.fuzzy_date("a"), a=raw) == out


def test_free_text_numbers(spark):
    assert tuple(value(spark, nz.project_value("a"), a="AED 203,168,000 (USD 55.3m)")) == (203168000.0, 55300000.0)
    assert value(spark, nz.size_sqft("a"), a="951 sq. ft") == 951.0
    assert value(spark, nz.transaction_date("a"), a="31st Jul 2026") == date(2026, 7, 31)
    assert value(spark, nz.transaction_date("a"), a="31 Feb 2026") is None
    assert value(spark, nz.total_units("a"), a="contains a total of 491 units.")["units"] == 491
    assert value(spark, nz.total_units("a"), a="unknown")["units"] is None
    assert value(spark, nz.first_int("a"), a=",,") is None
    assert value(spark, nz.safe_double("a"), a="12d") is None
    assert value(spark, nz.iso_date("a"), a="2026-13-45") is None
    assert value(spark, nz.word_to_int("a"), a="Two") == 2
    assert value(spark, nz.per_sqft(num(0), num(5))) is None
    got = value(spark, nz.coordinates("a"), a='src="https://g/maps/embed/v1/place?key=1&q=25.0547,55.204703"')
    assert (got["lat"], got["lng"]) == (25.0547, 55.204703)


@pytest.mark.parametrize("raw,out", [("Mall of the Emirates", "mall"), ("Ski Dubai", "landmark"), ("The Springs", "community"), ("Emallville", "community"), (None, "community")])
def test_area_type(spark, raw, out):
    assert value(spark, nz.area_type("a"), a=raw) == out


def test_aliases(spark):
    assert value(spark, nz.split_aliases("a"), a="JVC/JVT; Jumeirah Village") == ["JVC", "JVT", "Jumeirah Village"]
    assert value(spark, nz.split_aliases("a"), a=" ") == []
    assert value(spark, nz.split_names("a"), a="x and y|z") == ["x", "y", "z"]


def test_blocked(spark):
    assert value(spark, nz.looks_blocked("a"), a="<p>Checking your browser</p>") is True
    assert value(spark, nz.looks_blocked("a"), a="<script src=recaptcha></script>") is False


def test_urls(spark):
    assert urls.canonical_url("HTTP://Site.Example/dubai/x/?page=2&utm=1#f") == "https://site.example/dubai/x?page=2"
    assert urls.canonical_url("../b/", "https://site.example/dubai/x/") == "https://site.example/dubai/b"
    ok = lambda u: value(spark, urls.allowed("a", SITE), a=u)
    assert ok(f"https://{SITE}/dubai/x") and not ok(f"https://{SITE}/dubai/") and not ok("https://other/dubai/x") and not ok(f"https://{SITE}/dubai/a.PNG") and not ok(f"https://{SITE}/blog/x")
    assert value(spark, urls.slug("a"), a=f"https://{SITE}/dubai/marina/buildings") == "marina"
    assert value(spark, urls.slug("a"), a=f"https://{SITE}/dubai/area-guides") is None
    assert value(spark, urls.area_page("a"), a=f"https://{SITE}/dubai/marina/buildings") == "buildings"
    assert value(spark, urls.is_area_index("a"), a=f"https://{SITE}/dubai/area-guides/") is True
    assert value(spark, urls.seed("a", SITE), a=f"https://{SITE}/dubai") == f"https://{SITE}/dubai/area-guides"


@pytest.mark.parametrize("x,out", [(1.5e9, "AED 1.50B"), (2500000.0, "AED 2.50M"), (-1200.0, "-AED 1K"), (999.0, "AED 999"), (None, "N/A")])
def test_format_aed(spark, x, out):
    assert value(spark, m.format_aed(num(x))) == out


def test_display_helpers(spark):
    assert value(spark, m.format_number(num(1234567.5))) == "1,234,567.5"
    assert value(spark, m.format_pct(num(2.34), signed=True)) == "+2.3%"
    assert value(spark, m.format_psf(num(1500.4))) == "AED 1500/sqft"
    assert value(spark, m.format_pct(num(None))) == "N/A"
