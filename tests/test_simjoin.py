"""The similarity join and what stands on it, against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import resolve, simjoin
from quarrylane.operators.similarity import token_sort_ratio

SYLLABLES = ["ma", "ri", "na", "ga", "te", "al", "ba", "sha", "ver", "de", "tow", "er", "re", "si", "den", "ce", "x", "1", "2", "12"]


def names(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))]
        name = " ".join(words)
        out.add(name)
        for _ in range(rng.randint(0, 2)):  # near versions
            k = rng.randrange(len(name) + 1)
            name = name[:k] + rng.choice(["", "a", "er ", "z"]) + name[k + rng.randint(0, 2) :]
            if name.split():
                out.add(" ".join(name.split()))
    return sorted(out)


def keys(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "key string")


@pytest.mark.parametrize(("least", "most_pairs"), [(75.0, 20), (90.0, 5), (70.0, 0)])
def test_all_pairs_are_found_once(spark, least, most_pairs):
    """Without and with splitting of signatures, down to the deepest level."""
    left, right = names(1, 300), names(2, 300) + names(1, 300)[::5]
    got = [(r["key"], r["other"], round(r["score"], 9)) for r in simjoin.similar(keys(spark, left), keys(spark, right), least, most_pairs).collect()]
    want = {(x, y, round(s, 9)) for x in left for y in right if (s := token_sort_ratio(x, y)) >= least}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_short_and_odd_names(spark):
    odd = ["a", "b", "a b", "b a", "ab", "aa", "aaa", "aaaa", "", None, "é", "a1", "1a", "  x  y ", "y x", "aab", "abb", "q" * 300, "q" * 299 + "r"]
    plain = [x for x in odd if x and x.split()]
    for most_pairs, least in ((0, 75.0), (50_000, 67.0)):
        got = [(r["key"], r["other"]) for r in simjoin.similar(keys(spark, odd + odd), keys(spark, odd), least, most_pairs).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(x, y) for x in plain for y in plain if token_sort_ratio(x, y) >= least}


def test_bound_below_which_nothing_is_shared(spark):
    with pytest.raises(ValueError):
        simjoin.similar(keys(spark, ["a"]), keys(spark, ["a"]), 66.0)


def test_empty_sides(spark):
    assert simjoin.similar(keys(spark, []), keys(spark, ["a"]), 75.0).collect() == []
    assert simjoin.similar(keys(spark, ["a"]), keys(spark, []), 75.0).collect() == []


def test_best_match_ties_and_unmatched_scores(spark):
    cands = spark.createDataFrame([("tower ab", 3), ("tower ac", 2), ("palm", 9)], "key string, id long")
    got = {r["key"]: (r["id"], r["score"]) for r in resolve.best_match(keys(spark, ["tower a", "zz", "palm"]), cands).collect()}
    assert got["tower a"] == (3, token_sort_ratio("tower a", "tower ab")) and got["palm"] == (9, 100.0) and "zz" not in got
    rows = {r["key"]: (r["confidence"], r["score"]) for r in resolve.match(keys(spark, ["zz", "", "palm"]), cands).collect()}
    assert rows == {"zz": ("unmatched", None), "": ("unmatched", 0.0), "palm": ("exact", 100.0)}


def test_no_candidate_table_is_collected_or_crossed(spark):
    """Pools of any size take the same way: the plan holds neither a cross join nor a nested loop."""
    out = resolve.best_match(spark.range(300).select(F.concat(F.lit("tower number "), F.col("id").cast("string")).alias("key")), spark.range(2500).select(F.concat(F.lit("tower no "), F.hex("id")).alias("key"), "id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
