"""Document fingerprints by SimHash, and search within a Hamming radius by permuted block tables.

A term is five consecutive words; its 128-bit hash votes on every bit, once per occurrence. Two vote counters share a
long (31 bits each), so 64 sums per document replace 128. Documents are dealt by ranges of their id (quantiles, not
widths), so the neighbour by id, the edited text, the votes and the neighbour's fingerprint all use one exchange of the
texts.

Defined cases: null text is empty; an empty text has no terms and the zero fingerprint; a text of fewer than five words
is one term; a null id comes before all others; rows that repeat an id are ordered by a hash of their text, so each
still has one next row and a hot id spreads over ranges; a table with one row is its own next; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.common import checkpointed, let, space_words

SHINGLE = 5
BITS = 128
#: At most so many id ranges; their heads are the only rows that are ever broadcast (24 bytes each).
MOST_RANGES = 16384
#: Pairs of counters: bit 0 and bit 32 of a shifted hash.
PAIR = (1 << 32) | 1


def term_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; of all words at once when there are fewer."""

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        few = F.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= size, many).otherwise(few)

    return let(F.transform(space_words(F.lower(text)), lambda w: F.xxhash64(w)), shingles)


def _votes() -> list[Column]:
    votes = []
    for word, h in (("a", F.col("_h")), ("b", F.xxhash64(F.col("_h"), F.lit(1)))):
        votes += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR))).alias(f"{word}{j}") for j in range(32)]
    return votes


def _word(prefix: str) -> Column:
    """64 bits from 32 counter pairs: a bit is set when more than half of the terms have it."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"{prefix}{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"{prefix}{j}", 32)
        for at, count in ((j, low), (j + 32, high)):
            bit = (1 << at) - (1 << 64 if at == 63 else 0)
            out = out.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return out


def voted(rows: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """keys with the fingerprint words f1 and f2 of the terms; keys identify a row."""
    each = rows.select(*keys, F.explode_outer(terms).alias("_h"))
    out = each.groupBy(*keys).agg(F.count("_h").alias("_n"), *_votes())
    return out.select(*keys, F.coalesce(_word("a"), F.lit(0)).alias("f1"), F.coalesce(_word("b"), F.lit(0)).alias("f2"))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, f1, f2 for documents whose keys identify a row."""
    return voted(docs.select(*keys, term_hashes(F.coalesce(text, F.lit(""))).alias("_terms")), keys, "_terms")


def as_text(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(f1)), 16, "0"), F.lpad(F.hex(F.col(f2)), 16, "0")))


def distance(a1: str, a2: str, b1: str, b2: str) -> Column:
    return F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))


def likeness(a1: str, a2: str, b1: str, b2: str) -> Column:
    """The cosine that the share of differing bits stands for, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(distance(a1, a2, b1, b2) * F.lit(3.141592653589793 / BITS)))


def range_bounds(rows: DataFrame, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """The least (_at, _tie) of every range but the first: quantiles of a random sample of about 16 rows a range.

    They only say which rows share a task, so results do not depend on the sample. Ranges hold about 64 rows or more;
    the sample has at most about 16 * most rows of 16 bytes.
    """
    n = rows.count()
    ranges = max(1, min(most, n // 64))
    if ranges == 1:
        return []
    sample = sorted((r[0], r[1]) for r in rows.where(F.rand(7) < 16 * ranges / n).select("_at", "_tie").collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds that are not above (_at, _tie), by halving steps over two arrays."""
    if not bounds:
        return F.lit(0)
    column = lambda k: F.expr("array(" + ", ".join(f"{b[k]}L" if b[k] > -(1 << 63) else "bigint('-9223372036854775808')" for b in bounds) + ")")
    at, tie, steps = column(0), column(1), range(len(bounds).bit_length() - 1, -1, -1)

    def step(below: Column, size: Column) -> Column:
        k = below + size - 1
        bound, own = F.get(at, k), F.col("_at")
        fits = (bound < own) | ((bound == own) & (F.get(tie, k) <= F.col("_tie")))
        return F.when(fits, below + size).otherwise(below)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in steps]), F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, the next row's text, and _range and _row, which identify a row and order rows by id within a range.

    The first row of a range also goes to the range before it as a ghost, so no range needs another range's rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("_at"), F.xxhash64("text").alias("_tie"))
    rows = rows.withColumn("_range", _range_of(range_bounds(rows)))
    heads = rows.groupBy("_range").agg(F.min(F.struct("_at", "_tie")).alias("_key")).select("_range", "_key._at", "_key._tie")
    whole = Window.orderBy("_range")
    last = F.max("_range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_at", "_tie", F.coalesce(F.lag("_range").over(whole), last).alias("_range"))
    ghosts = rows.drop("_range").join(F.broadcast(heads), ["_at", "_tie"]).select("doc_id", "text", "_at", "_tie", "_range")
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    order = Window.partitionBy("_range").orderBy("_ghost", "_at", "_tie", "text")
    return both.select("doc_id", "text", "_range", "_ghost", F.row_number().over(order).alias("_row"), F.lead("text").over(order).alias("_next"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints (f1, f2) and edited ones (e1, e2) of all documents with their likeness to the edited and next text."""
    rows = with_next(docs)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 4)))"), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), quarter))
    rows = rows.select("_range", "_row", "_ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("_edited"))
    keys = ["_range", "_row", "_ghost", "doc_id", "n_chars", "_sha"]
    rows = rows.select(*keys[:-1], F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)).alias("_sha"), F.posexplode(F.array("text", "_edited")).alias("_side", "_text"))
    sides = voted(rows.select(*keys, "_side", term_hashes(F.col("_text")).alias("_terms")), [*keys, "_side"], "_terms")
    side = lambda k, c: F.max(F.when(F.col("_side") == k, F.col(c)))
    own = sides.groupBy(*keys).agg(side(0, "f1").alias("f1"), side(0, "f2").alias("f2"), side(1, "f1").alias("e1"), side(1, "f2").alias("e2"))
    order = Window.partitionBy("_range").orderBy("_row")
    own = own.select(*keys, "f1", "f2", "e1", "e2", F.lead("f1").over(order).alias("x1"), F.lead("f2").over(order).alias("x2"))
    return own.where(~F.col("_ghost")).select(
        "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "f1", "f2", "e1", "e2",
        likeness("f1", "f2", "e1", "e2").alias("near_edited"), likeness("f1", "f2", "x1", "x2").alias("near_next"),
    )


def block_masks(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Masks (two signed words) of every choice of blocks - radius blocks: texts within the radius agree on one of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        masks.append((signed(m >> 64), signed(m & ((1 << 64) - 1))))
    return masks


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Pairs (q1, q2, f1, f2, bits) of distinct query and index fingerprints at most ``radius`` bits apart, equal ones left out.

    Each permuted table is keyed by the blocks it brings to the front; both sides are distinct before they meet.
    """

    def tabled(df: DataFrame, a: str, b: str) -> DataFrame:
        keys = [F.xxhash64(F.lit(k), F.col(a).bitwiseAND(F.lit(m1).cast("long")), F.col(b).bitwiseAND(F.lit(m2).cast("long"))) for k, (m1, m2) in enumerate(block_masks(radius, blocks))]
        return df.select(a, b, F.explode(F.array(*keys)).alias("_key"))

    q = tabled(queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct(), "q1", "q2")
    x = tabled(index.select("f1", "f2").distinct(), "f1", "f2")
    pairs = q.join(x, "_key").select("q1", "q2", "f1", "f2", distance("q1", "q2", "f1", "f2").alias("bits"))
    return pairs.where(F.col("bits").between(1, radius)).distinct()


def fingerprint_documents(docs: DataFrame, radius: int = 4, every: int = 50) -> DataFrame:
    """The comparison of all documents; n_near counts, for ids divisible by ``every``, the other fingerprints in the radius."""
    rows = checkpointed(compare_with_next(docs))
    asked = rows.where(F.col("doc_id") % every == 0)
    near = within_radius(asked, rows, radius).groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("_near"))
    near = near.select(F.col("q1").alias("f1"), F.col("q2").alias("f2"), "_near")
    out = rows.join(near, ["f1", "f2"], "left")
    counted = F.when(F.col("doc_id") % every == 0, F.coalesce("_near", F.lit(0))).cast("long")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("f1", "f2").alias("fingerprint"), as_text("e1", "e2").alias("edited_fingerprint"), "near_edited", "near_next", counted.alias("n_near"))
