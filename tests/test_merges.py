"""Merge rounds with updated distances against distances from all members."""

import itertools

import numpy as np
import pytest

from arbora.operators.cluster import merge_rounds


def slow(parents, x, kind):
    """Clone trees of one tree, every distance from the members themselves."""
    parents, clusters, linear = list(parents), [[i] for i in range(len(parents))], True
    out = [(list(parents), [[i + 1] for i in range(len(parents))])]
    square = ((x[:, None] - x[None]) ** 2).sum(2)

    def dist(a, b):
        if kind == "ward":
            n, m = len(clusters[a]), len(clusters[b])
            return n * m / (n + m) * float(((x[clusters[a]].mean(0) - x[clusters[b]].mean(0)) ** 2).sum())
        d = np.sqrt(square[np.ix_(clusters[a], clusters[b])])
        return float(d.min() if kind == "min" else d.mean())

    while sum(p >= 0 for p in parents) > 1:
        live = [i for i, p in enumerate(parents) if p >= 0]
        if all(parents[i] == 0 for i in live):
            pairs = list(itertools.combinations(live, 2))
        else:
            pairs = [(i, parents[i] - 1) for i in live if parents[i] > 0 and not (linear and parents.count(parents[i]) > 1)]
        if not pairs:
            linear = False
            continue
        _, one, two = min((round(dist(a, b), 12), a, b) for a, b in pairs)
        parents = [parents[two] if p == two + 1 else p for p in parents]
        parents[two] = -1
        clusters[one], clusters[two] = sorted(clusters[one] + clusters[two]), []
        out.append((list(parents), [[i + 1 for i in c] for c in clusters]))
    return out


def start(x, kind):
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    return square / 2 if kind == "ward" else np.sqrt(square)


@pytest.mark.parametrize("kind", ["min", "avg", "ward"])
def test_small_trees(kind):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 6, 9, 13):
        for _ in range(12):
            parents = np.array([rng.integers(0, i + 1) if rng.random() < 0.7 else i for i in range(n)])
            x = rng.uniform(size=(n, 4))
            assert list(merge_rounds(parents, start(x, kind), kind)) == slow(parents, x, kind)


@pytest.mark.parametrize(("kind", "shape"), [("avg", "random"), ("ward", "chain"), ("min", "star")])
def test_two_hundred_nodes(kind, shape):
    rng = np.random.default_rng(6)
    n = 200 if shape != "star" else 60
    parents = np.array([{"random": rng.integers(0, i + 1), "chain": i, "star": 0}[shape] for i in range(n)])
    x = rng.uniform(size=(n, 3))
    got, want = list(merge_rounds(parents, start(x, kind), kind)), slow(parents, x, kind)
    assert len(got) == n and got == want


def test_nodes_that_are_not_placed_and_ties():
    got = list(merge_rounds(np.array([0, -1, 0, 1]), np.ones((4, 4)), "avg"))
    assert got[0] == ([0, -1, 0, 1], [[1], [], [3], [4]]) and got[1] == ([-1, -1, 0, 0], [[], [], [3], [1, 4]]) and got[-1] == ([-1, -1, 0, -1], [[], [], [1, 3, 4], []])
    infinite = np.full((3, 3), np.inf)
    assert [c for _, c in merge_rounds(np.array([0, 0, 0]), infinite, "min")][-1] == [[1, 2, 3], [], []]
