"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Base columns are computed for every document. The further rules run in a CASE chain, so a rule is evaluated only for
documents that all earlier rules let pass; the chain is ordered by rejections per second of cost, both estimated on a
sample. The order never changes which documents are kept, only how soon a document is rejected.

Defined cases: null or empty text has zero words and fails the base rule; equal rows are judged alike; extra columns
are ignored by ``judge`` unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import let, space_words, text_or_empty, word_count_of_space

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the same text, the first occurrence included."""

    def covered(wins: Column) -> Column:
        by_hash = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return let(by_hash, lambda s: let(starts(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)))

    def windows(h: Column) -> Column:
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    distinct = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    counted = lambda h: let(windows(h), lambda w: F.when(distinct(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashed, counted))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: word_count_of_space(x) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_columns(text: Column) -> Column:
    """One struct with the base counts of a text."""

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), word_count_of_space(text).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).cast("long").alias("n_symbols"), duplicate_lines(text).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(space_words(text), counts)


#: The method's rules, each true for a text to reject; all need base columns b and may read the text again.
RULES: dict[str, object] = {
    "symbols": lambda text, b: 10 * b["n_symbols"] > 3 * b["n_words"],
    "exclamations": lambda text, b: 2 * count_of(text, "!") > b["n_words"],
    "repeated_lines": lambda text, b: 10 * b["n_dup_lines"] > 3 * (count_of(text, "\n") + 1),
    "word_length": lambda text, b: (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 20 * b["n_words"]),
    "capitals": lambda text, b: 2 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > b["word_chars"],
}


def cascade_order(docs: DataFrame, rules: dict = RULES, sample_rows: int = 1000, fraction: float = 0.05) -> list[str]:
    """Rule names by rejected share per second, measured rule by rule on at most sample_rows sampled documents."""
    text = F.col("_t")
    sample = docs.select(text_or_empty().alias("_t")).sample(fraction, 7).limit(sample_rows)
    sample = sample.select("_t", base_columns(text).alias("_b")).persist()
    try:
        n = max(1, sample.count())
        gains = {}
        for name, rule in rules.items():
            began = time.perf_counter()
            hits = sample.agg(F.count_if(rule(text, F.col("_b")))).first()[0]
            gains[name] = (hits + 0.5) / n / (time.perf_counter() - began)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda k: -gains[k])


def judge(docs: DataFrame, rules: dict = RULES, order: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the base counts, base_failed, kept and reject_rule (the first rule of the cascade that fired)."""
    order = order or cascade_order(docs, rules)
    text, b = F.col("_t"), F.col("_b")
    out = docs.select(*keep, text_or_empty().alias("_t"))
    out = out.select(*keep, "_t", F.explode(F.array(base_columns(text))).alias("_b"))
    failed = (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])
    fired = F.when(failed, F.lit("base"))
    for name in order:
        fired = fired.when(rules[name](text, b), F.lit(name))
    out = out.select(*keep, "_b.*", failed.alias("base_failed"), fired.alias("reject_rule"))
    return out.withColumn("kept", F.col("reject_rule").isNull())


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that all rules keep, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return judge(own, order=cascade_order(docs), keep=("_row",)).where("kept").select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > 3 * n_words
    OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words
    OR 10 * n_dup_lines > 3 * (length(t) - length(replace(t, chr(10), '')) + 1)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > word_chars AS by_method
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT by_method AS kept
FROM judged
"""
