"""Interval labels and descents against a walk of the graph."""

import random

import pytest

from quarrylane.operators import trees


def graph(seed, n, parents):
    """Nodes with repeated names, cycles, several roots and parents that do not exist."""
    rng = random.Random(seed)
    names = [f"n{rng.randrange(n - 2)}" for _ in range(n)]
    return [(f"i{k:02d}", names[k], rng.choice([None, "nowhere", *names[: max(1, k * parents // 2)]])) for k in range(n)]


def walk(nodes, root):
    seen, todo = {root}, [root]
    names = {i: name for i, name, _ in nodes}
    while todo:
        here = todo.pop()
        for i, _, parent in nodes:
            if parent is not None and parent == names[here] and i not in seen:
                seen.add(i)
                todo.append(i)
    return seen


def frame(spark, nodes):
    return spark.createDataFrame(nodes, "id string, name string, parent_name string")


@pytest.mark.parametrize("nodes", [
    graph(3, 14, 1), graph(8, 12, 2),
    [("a", "JVC", None), ("b", "District 11", "JVC"), ("c", "X", "Y"), ("d", "Y", "X"), ("e", "Z", "X"), ("f", "JVC", None), ("g", "G", "District 11"), ("h", "H", "H")],
])
def test_subtrees_equal_a_walk(spark, nodes):
    df = frame(spark, nodes)
    labelled = trees.labels(df)
    got = labelled.collect()
    assert sorted(r["id"] for r in got if r["own"]) == sorted(i for i, _, _ in nodes)
    pairs = {tuple(r) for r in trees.subtrees(labelled, df).collect()}
    want = {(root, x) for root, _, _ in nodes for x in walk(nodes, root)}
    assert pairs == want == {tuple(r) for r in trees.closure(df).collect()}
    some = nodes[2][0]
    assert {r[0] for r in trees.below(df, df.where(df.id == some)).collect()} == walk(nodes, some)
    assert trees.below(df, df.limit(0)).collect() == []


def test_labels_of_a_plain_tree_nest(spark):
    nodes = [("r", "R", None), ("a", "A", "R"), ("b", "B", "R"), ("c", "C", "A")]
    got = {r["id"]: (r["first"], r["last"]) for r in trees.labels(frame(spark, nodes)).collect()}
    assert got == {"r": (1, 4), "a": (2, 3), "c": (3, 3), "b": (4, 4)}
