"""A lossless similarity join of names: all pairs whose token-sorted similarity reaches a bound, without comparing all pairs.

The similarity is 200 * LCS / (a + b) of the token-sorted names of lengths a and b. A common subsequence of L characters
leaves at least 3 * L - a - b + 1 of the padded bigrams (numbered where they repeat) in common: a deleted character takes two
of them away, an inserted one breaks one. Bigrams are ordered from rare to frequent, so the first common bigrams of a pair
stand within a prefix of either name. Names meet by the hash of their first common bigram; where its two lists would make more
than ``most_pairs`` pairs, they meet by the first two, then the first three instead. A pair is made under exactly one
signature, its own first common bigrams, so nothing is compared twice; lengths and the number of common bigrams are tested
before the similarity itself is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import similarity
from quarrylane.operators.lineage import settled

#: At most so many bigrams, the most frequent ones, are ordered by their counts; all others come before them.
ORDERED = 4096
DEEPEST = 3
#: Pairs of a greater total length meet by two bigrams at most, or by one: long names are few, and have many bigrams to combine.
LONG, LONGER = 120, 400
#: Below two thirds of the greatest similarity, a pair need not share a bigram.
LOWEST = 100 * 2 / 3


def token_sorted(key: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(key, r"\s+"), lambda t: t != "")), " ")


def bigrams(text: Column) -> Column:
    """Numbered bigrams of the padded text: the second `ab` is not the first one."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    plain = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, 2)))
    return F.transform(plain, lambda g, i: F.concat(g, (i + 2 - F.array_position(plain, g)).cast("string"), F.lit("\x04")))


def _needed(total: Column, least: float) -> Column:
    """Common bigrams that a pair of this total length has at least, from the greatest whole LCS bound."""
    return 3 * F.ceil(total * (least / 200) - F.lit(1e-9)) - total + 1


def _grams(keys: DataFrame) -> DataFrame:
    """key, n (length) and its bigrams, unordered."""
    rows = keys.select("key").where("key is not null").distinct().withColumn("_s", token_sorted(F.col("key"))).where("_s <> ''")
    return rows.select("key", F.length("_s").cast("long").alias("n"), bigrams(F.col("_s")).alias("grams"))


def _ordered(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Bigrams from rare to frequent; the table of frequent ones has at most ORDERED rows."""
    each = rows.select("side", "key", "n", F.explode("grams").alias("gram")).join(F.broadcast(frequent), "gram", "left")
    listed = each.groupBy("side", "key", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram"))).alias("_g"))
    return listed.select("side", "key", "n", F.transform("_g", lambda x: x["gram"]).alias("grams"))


def _floor(total: Column, least: float) -> Column:
    """Common bigrams of all pairs of at least this total length; two or more."""
    return F.ceil(1 + total * (3 * least / 200 - 1) - F.lit(1e-9)).cast("int")


def _depth(total: Column, least: float) -> Column:
    """How many bigrams a signature of a pair may have."""
    return F.when(total > LONGER, 1).when(total > LONG, 2).otherwise(F.least(F.lit(DEEPEST), _floor(total, least)))


def _depths(rows: DataFrame, least: float) -> DataFrame:
    """A row for each depth that partners of fitting length ask for, and the common bigrams that all of those have."""
    ratio = least / (200 - least)
    low, high = F.col("n") + F.ceil(F.col("n") * ratio - F.lit(1e-9)), F.col("n") + F.floor(F.col("n") / ratio + F.lit(1e-9))
    shallow = (low <= LONGER) & ((_floor(low, least) == 2) | (high > LONG))
    deep = (low <= LONG) & (_floor(F.least(high, F.lit(LONG)), least) >= DEEPEST)
    depths = F.filter(F.array(F.when(high > LONGER, 1), F.when(shallow, 2), F.when(deep, DEEPEST)), lambda d: d.isNotNull())
    rows = rows.withColumn("depth", F.explode(depths)).withColumn("common", F.greatest(_floor(low, least), "depth"))
    return rows.select("side", "key", "n", "grams", "depth", "common", F.lit(0).alias("at"), F.concat(F.col("depth").cast("string"), F.lit("|")).alias("sig"))


def _longer(rows: DataFrame, level: int) -> DataFrame:
    """Signatures with one more bigram behind the last one, as far as a pair's first common ones can stand."""
    size = F.size("grams")
    last = size - F.col("common") + level
    places = F.when(last > F.col("at"), F.sequence(F.col("at") + 1, last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_p", F.explode(places))
    return rows.withColumn("sig", F.concat("sig", F.element_at("grams", F.col("_p")))).withColumn("at", F.col("_p")).drop("_p")


def similar(left: DataFrame, right: DataFrame, least: float, most_pairs: int = 50_000) -> DataFrame:
    """key (of left), other (of right) and score of all pairs of distinct non-empty keys with a score of ``least`` or more."""
    if least <= LOWEST:
        raise ValueError(f"the bound must be above {LOWEST:.2f}")
    both = _grams(left).withColumn("side", F.lit(0)).unionByName(_grams(right).withColumn("side", F.lit(1)))
    both = settled(both)
    sizes = {r["side"]: (r["n"], r["g"]) for r in both.groupBy("side").agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("g")).collect()}
    if len(sizes) < 2:
        return left.sparkSession.createDataFrame([], "key string, other string, score double")
    if sizes[0][0] * sizes[1][0] <= most_pairs:
        # no list can be too large: any order of the bigrams serves, and the first level finds all pairs
        both = _depths(both.withColumn("grams", F.array_sort("grams")), least)
        pairs = _meet(*_sides(_longer(both, 1)), 1, least)
    else:
        pairs = _split_and_meet(both, sum(g for _, g in sizes.values()), least, most_pairs)
    scored = pairs.withColumn("score", similarity.token_sort("key", "other"))
    return scored.where(F.col("score") >= least - 1e-9)


def _sides(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.where("side = 0"), both.where("side = 1")


def _split_and_meet(both: DataFrame, grams: int, least: float, most_pairs: int) -> DataFrame:
    frequent = both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") > grams / ORDERED)
    both, pairs = _depths(_ordered(both, frequent), least), None
    for level in range(1, DEEPEST + 1):
        both = _longer(both, level)
        if level == DEEPEST:
            return pairs.unionByName(_meet(*_sides(both), level, least))
        both = settled(both)
        lists = both.groupBy("sig", "depth").agg(F.sum(1 - F.col("side")).alias("_l"), F.sum("side").alias("_r"))
        large = settled(lists.where((F.col("_l") * F.col("_r") > most_pairs) & (F.col("depth") > level)).select("sig"))
        found = _meet(*_sides(both.join(large, "sig", "left_anti")), level, least)
        pairs = found if pairs is None else pairs.unionByName(found)
        if large.isEmpty():
            return pairs
        both = both.join(large, "sig", "left_semi")


def _meet(a: DataFrame, b: DataFrame, level: int, least: float) -> DataFrame:
    """Pairs of one signature that may reach the bound."""
    other = b.select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("grams").alias("_h"), "sig")
    rows = a.join(other, "sig").where(F.greatest("n", "m") * least <= F.least("n", "m") * (200 - least) + 1e-6)
    rows = rows.withColumn("_c", F.array_intersect("grams", "_h"))
    total = F.col("n") + F.col("m")
    own = F.concat(F.col("depth").cast("string"), F.lit("|"), F.array_join(F.slice("_c", 1, level), ""))
    return rows.where((F.size("_c") >= _needed(total, least)) & (F.col("depth") == _depth(total, least)) & (F.col("sig") == own)).select("key", "other")
