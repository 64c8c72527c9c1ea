"""Euler tours against walks in Python, on high and flat trees."""

import random

import pytest

from arbora.operators import euler, trees

HIGH = 1000


def walk(parents):
    """node -> (parent, depth, enter, size, opens, closes), children by number, without recursion."""
    below = {}
    for v, p in sorted(parents.items()):
        below.setdefault(p, []).append(v)
    out, place, entered, todo = {}, 0, 0, [(0, None, 0, False)]
    while todo:
        v, p, depth, leaving = todo.pop()
        if leaving:
            old = out[v]
            out[v] = (*old[:3], entered - old[2], old[4], place)
        else:
            out[v] = (p, depth, entered, 0, place, 0)
            entered += 1
            todo.append((v, p, depth, True))
            todo += [(c, v, depth + 1, False) for c in reversed(below.get(v, []))]
        place += 1
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(2)
    shapes = {
        "chain": {v: v - 1 for v in range(1, HIGH + 1)}, "back": {v: v + 1 if v < 40 else 0 for v in range(1, 41)}, "star": dict.fromkeys(range(1, 60), 0),
        "random": {v: rng.randrange(v) for v in range(1, 200)}, "one": {1: 0}, "heap": {v: v // 2 for v in range(1, 32)},
    }
    edges = spark.createDataFrame([(t, v, p) for t, tree in shapes.items() for v, p in tree.items()], "t string, node int, parent int")
    return shapes, edges


def test_tour(forest):
    shapes, edges = forest
    got = {(r.t, r.node): (r.parent, r.depth, r.enter, r["size"], r.opens, r.closes) for r in euler.tour(edges, ["t"]).collect()}
    assert got == {(t, v): x for t, tree in shapes.items() for v, x in walk(tree).items()}


def test_newick_and_sums_of_high_trees(spark, forest):
    shapes, edges = forest
    text = {r.t: r.newick for r in trees.newick(edges, ["t"]).collect()}
    assert text["chain"] == "(" * HIGH + ")".join(str(v) for v in range(HIGH, -1, -1)) + ";"
    assert text["one"] == "(1)0;" and text["star"] == "(" + ",".join(map(str, range(1, 60))) + ")0;"
    rng = random.Random(3)
    eta = {(t, v, s): rng.random() for t, tree in shapes.items() for v in [0, *tree] for s in (0, 1)}
    values = spark.createDataFrame([(*k, x) for k, x in eta.items()], "t string, node int, sample int, eta double")
    want = dict(eta)
    for t, tree in shapes.items():
        for v in sorted(tree, key=lambda v: -walk_depth(tree, v)):
            for s in (0, 1):
                want[t, tree[v], s] += want[t, v, s]
    got = {(r.t, r.node, r.sample): r.f for r in trees.f_from_eta(edges, values, ["t"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def walk_depth(tree, v):
    n = 0
    while v:
        v, n = tree[v], n + 1
    return n


def test_lineages_of_high_trees(forest):
    _, edges = forest
    got = {}
    for r in trees.lineages(edges, ["t"]).collect():
        got.setdefault(r.t, []).append((r["head"], r.parent, r.nodes))
    assert got["chain"] == [(1, 0, list(range(1, HIGH + 1)))] and got["back"] == [(40, 0, list(range(1, 41)))]
    assert sorted(got["star"]) == [(v, 0, [v]) for v in range(1, 60)]


def test_ancestors_are_intervals(forest):
    shapes, edges = forest
    rows = euler.tour(edges.where("t = 'random'").drop("t"))
    pairs = rows.alias("a").join(rows.alias("b"), euler.is_ancestor("a", "b")).selectExpr("a.node as anc", "b.node as node", "b.depth - a.depth as depth")
    want = trees.ancestry(edges.where("t = 'random'").drop("t")).select("anc", "node", "depth")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))


def test_circles_and_no_trees(spark, forest):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "item int, to int")
    with pytest.raises(ValueError):
        euler.jump(circle)
    assert trees.newick(forest[1].limit(0), ["t"]).count() == 0
