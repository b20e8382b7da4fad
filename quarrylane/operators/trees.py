"""Rollups over the tree of areas, which name their parent by text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import ranks
from quarrylane.operators.lineage import settled


def _links(nodes: DataFrame) -> DataFrame:
    """(parent, child) ids; several nodes of one name are all parents, nobody is their own."""
    links = nodes.where("parent_name is not null").select(F.col("id").alias("child"), "parent_name")
    return links.join(nodes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent_name").select("parent", "child").where("parent <> child").distinct()


def below(nodes: DataFrame, roots: DataFrame, most_levels: int = 50) -> DataFrame:
    """(id) of the given roots (id) and of all nodes below them, found from the roots down; nothing else is followed."""
    links = settled(_links(nodes))
    known = settled(nodes.select("id").join(roots.select("id").distinct(), "id", "left_semi").distinct())
    last = known
    for _ in range(most_levels):
        step = last.join(links, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct().join(known, "id", "left_anti")
        step = settled(step)
        if step.isEmpty():
            return known
        known, last = known.unionByName(step), step
    raise RuntimeError("the tree has more levels than allowed")


def _unrolled(starts: DataFrame, links: DataFrame, most_levels: int) -> tuple[DataFrame, DataFrame]:
    """Every path (array of ids) from the starts down without a repeated node, and the nodes found to lie on cycles."""
    last = settled(starts.select(F.array("id").alias("path")))
    paths, cycles = last, None
    for _ in range(most_levels):
        step = settled(last.join(links, F.element_at("path", -1) == F.col("parent")).select("path", "child", F.array_position("path", F.col("child")).alias("at")))
        back = step.where("at > 0").select(F.explode(F.slice("path", F.col("at"), F.size("path"))).alias("id"))
        cycles = back if cycles is None else cycles.unionByName(back)
        last = step.where("at = 0").select(F.concat("path", F.array("child")).alias("path"))
        if last.isEmpty():
            return paths, cycles.distinct()
        paths = paths.unionByName(last)
    raise RuntimeError("the tree has more levels than allowed")


def labels(nodes: DataFrame, most_levels: int = 50) -> DataFrame:
    """Interval labels, to be kept with the tree: (id, first, last, own) of every place that a node has in it.

    Places are numbered in the order of a walk; a place and those below it are first to last. A node under several parents
    has a place under each. ``own`` marks the one place whose interval is the node's whole subtree: any of its places, or for
    a node on a cycle the one where it stands at the top, as there the cycle is cut before it returns.
    """
    nodes = settled(nodes.select("id", "name", "parent_name"))
    links = settled(_links(nodes))
    tops = nodes.select("id").distinct().join(links.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
    paths, cycles = _unrolled(tops, links, most_levels)
    reached = paths.select(F.element_at("path", -1).alias("id")).distinct()
    more = nodes.select("id").distinct().join(reached, "id", "left_anti").unionByName(cycles).distinct()
    others, again = _unrolled(more, links, most_levels)
    cycles = settled(cycles.unionByName(again).distinct().withColumn("cyclic", F.lit(True)))
    places = paths.unionByName(others).withColumn("key", F.concat(F.array_join(F.transform("path", lambda x: F.hex(F.encode(x.cast("string"), "UTF-8"))), "/"), F.lit("/")))
    places = settled(ranks.numbered(places, "key", "first"))
    upper = places.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    sizes = upper.groupBy("path").agg(F.count("*").alias("size"))
    out = places.join(sizes, "path").select(F.element_at("path", -1).alias("id"), "first", (F.col("first") + F.col("size") - 1).alias("last"), F.size("path").alias("level"))
    out = out.join(cycles, "id", "left")
    fit = F.when(F.coalesce("cyclic", F.lit(False)) & (F.col("level") > 1), None).otherwise(F.col("first"))
    chosen = settled(out.withColumn("_f", fit))
    best = chosen.groupBy("id").agg(F.min("_f").alias("_b"))
    return chosen.join(best, "id").select("id", "first", "last", (F.col("first") == F.col("_b")).alias("own"))


def subtrees(labelled: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of the given roots (id) by one range join of labels, cycles and repeated names as in ``closure``."""
    own = labelled.where("own").join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("first").alias("_a"), F.col("last").alias("_z"))
    return own.join(labelled.select(F.col("id").alias("node"), "first"), F.col("first").between(F.col("_a"), F.col("_z"))).select("root", "node").distinct()


def closure(nodes: DataFrame, most_levels: int = 50) -> DataFrame:
    """(root, node) pairs of every node with itself and all below it. nodes: id, name, parent_name.

    Levels are joined until none adds a pair; pairs already known are not followed again, so cycles end. Several nodes
    of one name are all parents.
    """
    links = _links(nodes)
    known = nodes.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    last = known
    for _ in range(most_levels):
        step = last.join(links, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct().join(known, ["root", "node"], "left_anti")
        step = settled(step)
        if step.isEmpty():
            return known
        known, last = known.unionByName(step), step
    raise RuntimeError("the tree has more levels than allowed")


def closure_recursive(spark, nodes: DataFrame) -> DataFrame:
    """The same as one recursive query; the path taken guards against cycles."""
    nodes.createOrReplaceTempView("_tree_nodes")
    return spark.sql("""
        WITH RECURSIVE below (root, node, name, path) AS (
          SELECT id, id, name, array(id) FROM _tree_nodes
          UNION ALL
          SELECT b.root, n.id, n.name, concat(b.path, array(n.id)) FROM below b JOIN _tree_nodes n ON n.parent_name = b.name WHERE NOT array_contains(b.path, n.id))
        SELECT DISTINCT root, node FROM below""")


def subtree_counts(nodes: DataFrame, items: DataFrame, key: str, levels: int = 50) -> DataFrame:
    """id, name and the number of items (by their node key) in each node's subtree, largest first."""
    per = items.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("c"))
    total = closure(nodes, levels).join(per, "node").groupBy(F.col("root").alias("id")).agg(F.sum("c").alias("n"))
    return nodes.select("id", "name").join(total, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), "name")
