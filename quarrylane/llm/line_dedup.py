"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions only.

A line is dropped when an equal line, or a line within one edit (character inserted, deleted or replaced), comes earlier
in (doc_id, line number) order. Lines are compared without surrounding ASCII white space; blank lines always stay; lines
shorter than ``near_from`` characters only match equal lines.

1. Equal lines meet by a 96-bit hash; each distinct line keeps its first position.
2. Two lines one edit apart share the half that the edit leaves alone. Lines that share no half with another line have
   no near line; the rest go on. The same holds for all but one of 16 or more segments, so only segments remain in
   which a near line may differ.
3. Deletion neighbourhood: the longer or equally long line emits its segment with each single character deleted, the
   shorter one its segment as it is, as hashed keys that include the rest of the line. Equal keys at equal places are
   one replacement apart, a deletion and a whole segment one insertion apart, so the least position in a key's group is
   the only partner that needs a look. Groups are bounded by segment length times alphabet, as the lines are distinct.
4. The edit distance to that partner is verified.

Defined cases: null text has no lines and stays null; a document whose lines were all dropped keeps empty text in
``dedup`` (and leaves in ``dedup_documents``); rows that repeat a doc_id share positions, so a line kept for one of
them is kept for all; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.common import OTHER_SPACE, checkpointed, let

NEAR_FROM = 20
SEGMENTS = 16


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def compared(line: Column) -> Column:
    return F.trim(line, F.lit(" " + OTHER_SPACE))


def _half_keys(line: Column, near_from: int) -> Column:
    """Hashes of the halves that survive an edit, for pairs whose longer line has this length or one more."""
    keys = []
    for more in (0, 1):
        n = F.length(line) + more
        half = F.floor(n / 2).cast("int")
        keys += [F.xxhash64(n, F.lit("p"), F.substring(line, F.lit(1), half)), F.xxhash64(n, F.lit("s"), F.right(line, n - half))]
    return F.when(F.length(line) >= near_from, F.array(*keys))


def _distinct(docs: DataFrame, near_from: int) -> DataFrame:
    """Distinct lines: hash words h1 and h2, first position, half keys."""
    rows = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "_raw"))
    rows = rows.select("doc_id", "line_no", compared(F.col("_raw")).alias("_line")).where(F.col("_line") != "")
    k = _half_keys(F.col("_line"), near_from)
    rows = rows.select(F.xxhash64("_line").alias("h1"), F.hash("_line").alias("h2"), F.struct("doc_id", "line_no").alias("_at"), *[F.get(k, j).alias(f"k{j}") for j in range(4)])
    out = rows.groupBy("h1", "h2").agg(F.min("_at").alias("_at"), *[F.min(f"k{j}").alias(f"k{j}") for j in range(4)])
    return out.select("h1", "h2", F.col("_at.doc_id").alias("doc_id"), F.col("_at.line_no").alias("line_no"), *[f"k{j}" for j in range(4)])


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another distinct line has too."""
    twice = rows.groupBy(key).agg(F.min("h1").alias("_low"), F.max("h1").alias("_high")).where("_low <> _high").select(key)
    return rows.join(twice, key, "left_semi")


def _segments(line: Column) -> Column:
    """(full, key, seg) for every segment, for pairs whose longer line has this length (full) or one more."""
    n = F.length(line)

    def of_size(more: int) -> Column:
        size = n + more
        parts = F.greatest(F.lit(SEGMENTS), F.floor(F.cbrt(size)).cast("int"))
        cut = lambda t: F.floor(size.cast("long") * t / parts).cast("int")

        def one(t: Column) -> Column:
            start, rest = cut(t), size - cut(t + 1)
            key = F.xxhash64(size, t, F.substring(line, F.lit(1), start), F.right(line, rest))
            return F.struct(F.lit(more == 0).alias("full"), key.alias("key"), F.substring(line, start + 1, n - start - rest).alias("seg"))

        return F.transform(F.sequence(F.lit(0), parts - 1), one)

    return F.concat(of_size(0), of_size(1))


def _variants(full: Column, key: Column, seg: Column) -> Column:
    """(pos, v): the segment with the character at pos deleted, or at -1 the whole segment, hashed with the rest's key."""
    n = F.length(seg)
    cut = lambda i: F.concat(F.substring(seg, F.lit(1), i), F.substring(seg, i + 2, n))
    deleted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.xxhash64(key, cut(i)).alias("v")))
    return F.when(full, deleted).otherwise(F.array(F.struct(F.lit(-1).alias("pos"), F.xxhash64(key, seg).alias("v"))))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line exactly one edit away."""
    halves = distinct.select("h1", "h2", "doc_id", "line_no", F.explode(F.array(*[f"k{j}" for j in range(4)])).alias("_k")).where("_k is not null")
    found = _shared(halves, "_k").select("h1", "h2", "doc_id", "line_no").distinct()
    asked = found.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("_asked"))
    texts = docs.select("doc_id", "text")
    both = texts.join(asked.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    pick = let(lines_of(F.col("text")), lambda x: F.transform("_asked", lambda a: F.struct(a["h1"], a["h2"], a["line_no"], compared(F.get(x, a["line_no"])).alias("line"))))
    lines = checkpointed(both.select("doc_id", F.inline(pick)).where(F.xxhash64("line") == F.col("h1")))
    segments = lines.select("h1", "h2", "doc_id", "line_no", F.inline(_segments(F.col("line"))))
    left = _shared(segments, "key")
    rows = left.select("h1", "doc_id", "line_no", "h2", "seg", F.inline(_variants(F.col("full"), F.col("key"), F.col("seg"))))
    by_v = Window.partitionBy("v")
    own = F.struct("doc_id", "line_no", "h1", "seg")
    rows = rows.select(
        "h1", "h2", "pos", "seg", own.alias("_own"), F.min(own).over(Window.partitionBy("v", "pos")).alias("_same"),
        F.min(F.when(F.col("pos") < 0, own)).over(by_v).alias("_whole"), F.min(F.when(F.col("pos") >= 0, own)).over(by_v).alias("_cut"),
    )
    before = lambda c: (F.col(c) < F.col("_own")) & (F.levenshtein(F.col(f"{c}.seg"), F.col("seg"), 1) == 1)
    near = F.when(F.col("pos") < 0, before("_cut")).otherwise(F.coalesce(before("_same"), F.lit(False)) | F.coalesce(before("_whole"), F.lit(False)))
    return rows.where(near).select("h1", "h2").distinct()


def dedup(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """docs with ``text`` deduplicated, plus n_lines and n_kept (lines with a word)."""
    distinct = checkpointed(_distinct(docs, near_from))
    kept = distinct.select("h1", "h2", "doc_id", "line_no").join(near_lines(docs, distinct), ["h1", "h2"], "left_anti")
    kept = kept.groupBy("doc_id").agg(F.collect_set("line_no").alias("_kept")).withColumnRenamed("doc_id", "_id")
    both = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = lines_of(F.col("text"))
    numbered = lambda x: F.transform(x, lambda y, i: F.struct(i.alias("i"), (compared(y) == "").alias("blank")))

    def result(x: Column) -> Column:
        full = F.transform(F.filter(numbered(x), lambda y: ~y["blank"]), lambda y: y["i"])
        blank = F.transform(F.filter(numbered(x), lambda y: y["blank"]), lambda y: y["i"])
        own = lambda f: F.array_intersect(f, F.coalesce("_kept", F.array().cast("array<int>")))
        text = lambda k: F.array_join(F.transform(F.sort_array(F.concat(blank, k)), lambda i: F.get(x, i)), "\n")
        return let(full, lambda f: let(own(f), lambda k: F.struct(F.size(f).cast("long").alias("n_lines"), F.size(k).cast("long").alias("n_kept"), F.when(F.size(k) == F.size(f), F.col("text")).otherwise(text(k)).alias("text"))))

    empty = F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_kept"), F.col("text").alias("text"))
    both = both.withColumn("_r", F.when(F.col("text").isNull(), empty).otherwise(let(lines, result)))
    return both.select(*[F.col("_r.text").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col("_r.n_lines").alias("n_lines"), F.col("_r.n_kept").alias("n_kept"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with deduplicated text and n_chars to match; documents that lost all their lines leave."""
    out = dedup(docs.select(*docs.columns)).where((F.col("n_kept") > 0) | (F.col("n_lines") == 0)).drop("n_lines", "n_kept")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(10)) AS line FROM raw),
d AS (SELECT line, min((doc_id, i)) AS pos, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
near AS (SELECT line, pos, n, n + x AS m FROM d CROSS JOIN (SELECT unnest([0, 1]) AS x) WHERE n >= 20),
pairs AS (
  SELECT a.line, b.line AS other, a.pos, b.pos AS earlier FROM near a JOIN near b ON a.m = b.m AND left(a.line, (a.m // 2)::INT) = left(b.line, (b.m // 2)::INT)
  UNION
  SELECT a.line, b.line, a.pos, b.pos FROM near a JOIN near b ON a.m = b.m AND right(a.line, (a.m - a.m // 2)::INT) = right(b.line, (b.m - b.m // 2)::INT)),
gone AS (SELECT DISTINCT line FROM pairs WHERE earlier < pos AND levenshtein(line, other) = 1),
kept AS (SELECT pos.doc_id AS doc_id, pos.i AS i FROM (SELECT struct_pack(doc_id := pos[1], i := pos[2]) AS pos FROM d WHERE line NOT IN (SELECT line FROM gone))),
j AS (SELECT l.*, line = '' OR kept.i IS NOT NULL AS stays FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id AND kept.i = l.i)
SELECT doc_id, count(*) FILTER (line <> '')::BIGINT AS n_lines, count(*) FILTER (line <> '' AND stays)::BIGINT AS n_kept,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (stays), '')) AS text_sha256
FROM j GROUP BY doc_id
"""
