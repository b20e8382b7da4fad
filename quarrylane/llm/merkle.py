"""Merkle manifest of a dataset: one tree a group over ordered leaves, one tree over the groups' roots, a proof a leaf.

Leaves are range-sorted by group, order and a tie-break, and every range keeps its number with its rows. Counts by range and
group, summed along the ranges, place each leaf in its group. A task then builds all complete aligned subtrees of its range;
the largest of them, the ragged nodes at the range's ends, are shuffled by the coordinate of a common ancestor and joined
upwards, 32 ranges at a time, until each group is at its root. The same code puts the groups' roots under one root. For the
proofs every range asks for the few nodes outside it that its leaves have as siblings, about four a level; these rows meet
the leaves by range number, and one stream a range folds leaf after leaf.

Memory of a task is that of one range (``rows`` leaves) and its outside nodes. Equal leaves are split over ranges by the
tie-break, so a group or a copied row of any size is no hot spot; equal leaves are interchangeable in the tree.

Defined cases: a null doc_id comes first in its language, is written `-` and never tampered with; rows that repeat a doc_id
are leaves each, ordered by their digests; a null language is a group of its own, the first; a lone leaf is its subroot, a
lone subroot the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import checkpointed

#: Ragged nodes of 2**FAN ranges meet in one task.
FAN = 5
NODE = "grp string, n long, depth int, level int, at long, digest string"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def group_key(name: Column) -> Column:
    """A key that is never null, in the names' order with null first."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    return F.sha2(F.concat(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))).cast("binary"), 256)


class Shape:
    """Which nodes of a tree of n leaves are complete within its run of leaves [a, a + m): ``spans`` has their first and last by level."""

    def __init__(self, a: int, m: int, n: int):
        self.a, self.b, self.n = a, a + m, n
        self.spans = [(a, a + m)]
        for level in range(1, depth_of(n) + 1):
            first, last = self.spans[-1]
            # the last node of a level needs no second child
            span = (first + 1) // 2, self.width(level) if last == self.width(level - 1) else last // 2
            if span[0] >= span[1]:
                break
            self.spans.append(span)

    def width(self, level: int) -> int:
        return ((self.n - 1) >> level) + 1

    def has(self, level: int, at: int) -> bool:
        return level < len(self.spans) and self.spans[level][0] <= at < self.spans[level][1]

    def ragged(self) -> Iterator[tuple[int, int]]:
        """The complete nodes without a complete parent: the root alone where the run is the whole tree."""
        for level, (first, last) in enumerate(self.spans):
            up = self.spans[level + 1] if level + 1 < len(self.spans) else (last, last)
            yield from ((level, at) for at in range(first, min(2 * up[0], last)))
            yield from ((level, at) for at in range(max(2 * up[1], first), last))

    def outside(self) -> Iterator[tuple[int, int]]:
        """Siblings on the way up from the run's leaves that are not complete within it."""
        for level in range(depth_of(self.n)):
            low, high = self.a >> level, (self.b - 1) >> level
            for at in sorted({low ^ 1, high ^ 1, low, high} if high > low else {low ^ 1}):
                if at < self.width(level) and low <= at ^ 1 <= high and not self.has(level, at):
                    yield level, at


class Run(Shape):
    """A run with the digests of its complete nodes."""

    def __init__(self, a: int, n: int, leaves: list[str]):
        super().__init__(a, len(leaves), n)
        self.levels = [leaves]
        for (first, _), (begin, end) in zip(self.spans, self.spans[1:], strict=False):
            below = self.levels[-1]
            self.levels.append([digest_of("".join(below[2 * at - first : 2 * at - first + 2])) for at in range(begin, end)])

    def digest(self, level: int, at: int) -> str:
        return self.levels[level][at - self.spans[level][0]]

    def siblings(self, at: int, others: dict[tuple[int, int], str]) -> list[str]:
        """From below: the sibling's digest after `<` or `>` for its side, or nothing where a node is alone."""
        found = []
        for level in range(depth_of(self.n)):
            x = at >> level
            other = x ^ 1
            if other >= self.width(level):
                found.append("")
            else:
                found.append("<>"[other > x] + (self.digest(level, other) if self.has(level, other) else others[level, other]))
        return found


def fold(leaf: str, siblings: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in siblings:
        leaf = digest_of(s[1:] + leaf if s[:1] == "<" else leaf + s[1:])
    return leaf


def proof_digest(siblings: list[str]) -> str:
    return digest_of("".join(s[1:] for s in siblings))


def _range_sorted(leaves: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Leaves sorted into ranges of about ``rows``, each row with the number of its range."""
    spark = leaves.sparkSession
    leaves = checkpointed(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // rows))
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "leaf", "_tie")]
    return checkpointed(leaves.repartitionByRange(parts, *keys).withColumn("range", F.spark_partition_id()))


def _offsets(ranges: DataFrame) -> DataFrame:
    """range, grp, a (leaves of the group in earlier ranges), m (in this one), n (in all)."""
    counts = ranges.groupBy("range", "grp").agg(F.count("*").alias("m"))
    group = Window.partitionBy("grp")
    return counts.select("range", "grp", (F.sum("m").over(group.orderBy("range")) - F.col("m")).alias("a"), "m", F.sum("m").over(group).alias("n"))


def _by_range(ranges: DataFrame, order: list[str], *first: DataFrame) -> DataFrame:
    """Leaves by range in their order, behind the rows of ``first`` for their group."""
    spark = ranges.sparkSession
    rows = ranges.withColumn("kind", F.lit(1))
    for df in first:
        rows = rows.unionByName(df.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    keys = [F.col(c).asc_nulls_first() for c in ("range", "grp", "kind", *order, "leaf", "_tie")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges.rdd.getNumPartitions())
    return rows.repartition(parts, "range").sortWithinPartitions(*keys)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[tuple[int, int], str], list[dict]]]:
    """For each group of each range its head row, the digests of nodes outside and the leaves' rows."""
    head, others, leaves = None, {}, []
    for batch in batches:
        for row in batch.to_pylist():
            if head is None or (row["range"], row["grp"]) != (head["range"], head["grp"]):
                if head is not None:
                    yield head, others, leaves
                head, others, leaves = row, {}, []
            if row["kind"]:
                leaves.append(row)
            elif row["level"] is None:
                head = row
            else:
                others[row["level"], row["at"]] = row["digest"]
    if head is not None:
        yield head, others, leaves


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(spark_schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spark_schema.split(", ")])


def _ragged_nodes(rows: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, _, leaves in _runs(batches):
            run = Run(head["a"], head["n"], [r["leaf"] for r in leaves])
            yield _batch([(head["grp"], head["n"], depth_of(head["n"]), level, at, run.digest(level, at)) for level, at in run.ragged()], schema)

    schema = _arrow(NODE)
    return rows.mapInArrow(each, NODE)


def _joiner(height: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Joins the nodes below one ancestor of that height, up to it."""
    schema = _arrow(NODE)

    def each(key: tuple, block: pa.Table) -> pa.Table:
        grp, n, depth = (x.as_py() for x in key[:3])
        levels: dict[int, dict[int, str]] = {}
        for level, at, digest in zip(*(block.column(c).to_pylist() for c in ("level", "at", "digest")), strict=True):
            levels.setdefault(level, {})[at] = digest
        made = []
        for level in range(min(levels), min(height, depth)):
            below, last = levels.get(level, {}), (n - 1) >> level
            for at in sorted({x >> 1 for x in below}):
                digest = digest_of(below[2 * at] + (below[2 * at + 1] if 2 * at < last else ""))
                levels.setdefault(level + 1, {})[at] = digest
                made.append((grp, n, depth, level + 1, at, digest))
        return pa.Table.from_batches([_batch(made, schema)])

    return each


def _with_upper_nodes(nodes: DataFrame, height: int) -> DataFrame:
    """The ragged nodes and all above them: by common ancestors FAN levels higher each time, until every group is at its root."""
    known, waiting = nodes, nodes.where("level < depth")
    while not waiting.isEmpty():
        height += FAN
        ready, later = waiting.where(F.col("level") < height), waiting.where(F.col("level") >= height)
        block = F.expr(f"shiftright(at, {height} - level)").alias("block")
        made = checkpointed(ready.groupBy("grp", "n", "depth", block).applyInArrow(_joiner(height), NODE))
        known = known.unionByName(made)
        waiting = later.unionByName(made.where((F.col("level") == height) & (F.col("level") < F.col("depth"))))
    return known


def _outside(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """range, grp, level, at, digest of the nodes that a range's leaves have as siblings and the range has not."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(r["range"], r["grp"], level, at) for r in batch.to_pylist() for level, at in Shape(r["a"], r["m"], r["n"]).outside()], schema)

    columns = "range int, grp string, level int, at long"
    schema = _arrow(columns)
    return offsets.mapInArrow(each, columns).join(nodes.select("grp", "level", "at", "digest"), ["grp", "level", "at"])


class Forest:
    """One tree for each group of leaves (columns grp, leaf, those of ``order``, and others)."""

    def __init__(self, leaves: DataFrame, order: list[str], rows: int):
        self.order = order
        self.ranges = _range_sorted(leaves, order, rows)
        self.offsets = checkpointed(_offsets(self.ranges))
        fill = self.offsets.agg(F.coalesce(F.avg("m"), F.lit(1)).alias("m")).first()["m"]
        nodes = checkpointed(_ragged_nodes(_by_range(self.ranges, order, self.offsets.select("range", "grp", "a", "n", F.lit(None).cast("int").alias("level")))))
        self.nodes = _with_upper_nodes(nodes, depth_of(int(fill)))
        self.roots = self.nodes.where("level = depth").select("grp", F.col("digest").alias("subroot"))

    def with_siblings(self, each_leaf: Callable[[dict, dict, list[str]], tuple], schema: str, heads: DataFrame | None = None) -> DataFrame:
        """Rows that each_leaf makes of a leaf's row, its group's row (of ``heads``) and its siblings from below."""
        offsets = self.offsets.select("range", "grp", "a", "n")
        offsets = offsets.join(heads, "grp") if heads is not None else offsets
        rows = _by_range(self.ranges, self.order, offsets, _outside(self.offsets, self.nodes))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head, others, leaves in _runs(batches):
                run = Run(head["a"], head["n"], [r["leaf"] for r in leaves])
                for k in range(0, len(leaves), 4096):
                    yield _batch([each_leaf(r, head, run.siblings(run.a + k + j, others)) for j, r in enumerate(leaves[k : k + 4096])], made)

        made = _arrow(schema)
        return rows.mapInArrow(each, schema)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_documents(docs: DataFrame, rows: int = 50_000) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    number = F.col("doc_id").cast("long")
    tampered = F.coalesce(F.crc32(number.cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = docs.select(
        number.alias("doc_id"), group_key(F.col("lang")).alias("grp"), leaf_digest(F.col("n_chars")).alias("leaf"),
        F.when(tampered, leaf_digest(F.col("n_chars") + F.lit(1))).alias("changed"))
    forest = Forest(leaves, ["doc_id"], rows)
    top = Forest(forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("leaf")), ["name"], rows)
    heads = top.with_siblings(lambda row, head, up: (row["name"], row["leaf"], fold(row["leaf"], up), up), "grp string, subroot string, root string, above array<string>")

    def each_leaf(row: dict, head: dict, up: list[str]) -> tuple:
        up = up + head["above"]
        folded = fold(row["changed"] or row["leaf"], up)
        return row["doc_id"], row["leaf"], head["subroot"], head["root"], proof_digest(up), folded, folded == head["root"]

    return forest.with_siblings(each_leaf, RESULT, checkpointed(heads))


def _sql_crc32(text: str) -> str:
    bits = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {bits})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _sql_leaf(n_chars: str) -> str:
    field = lambda c: f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
         CASE WHEN {_sql_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_sql_leaf('n_chars + 1')} END AS changed
  FROM documents),
leaves AS (
  SELECT *, COALESCE('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM base),
nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, n AS wide FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(wide) + 1) // 2 FROM nodes WHERE wide > 1 GROUP BY grp, level, pos // 2),
subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE wide = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest, n AS wide FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(wide) + 1) // 2 FROM tops WHERE wide > 1 GROUP BY level, pos // 2),
top AS (SELECT digest AS root FROM tops WHERE wide = 1),
start AS (SELECT row_number() OVER () AS id, l.*, s.subroot, s.pos AS top_at FROM leaves l JOIN subroots s USING (grp)),
steps AS (
  SELECT s.id, w.level, s.pos >> w.level AS x, b.digest AS sibling
  FROM start s JOIN (SELECT DISTINCT grp, level FROM nodes WHERE wide > 1) w ON w.grp = s.grp LEFT JOIN nodes b ON b.grp = s.grp AND b.level = w.level AND b.pos = xor(s.pos >> w.level, 1)
  UNION ALL
  SELECT s.id, 1000 + w.level, s.top_at >> w.level, b.digest
  FROM start s CROSS JOIN (SELECT DISTINCT level FROM tops WHERE wide > 1) w LEFT JOIN tops b ON b.level = w.level AND b.pos = xor(s.top_at >> w.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM steps),
folds AS (
  SELECT id, 0 AS step, COALESCE(changed, leaf) AS digest FROM start
  UNION ALL
  SELECT f.id, n.step, sha256(CASE WHEN n.x & 1 = 1 THEN COALESCE(n.sibling, '') || f.digest ELSE f.digest || COALESCE(n.sibling, '') END)
  FROM folds f JOIN numbered n ON n.id = f.id AND n.step = f.step + 1),
ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, sha256(COALESCE(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM start LEFT JOIN numbered USING (id) GROUP BY id)
SELECT s.doc_id, s.leaf, s.subroot, top.root, p.proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM start s JOIN proofs p USING (id) JOIN ends e USING (id) CROSS JOIN top
"""
