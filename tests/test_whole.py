"""Queries and operators against brute force over all that they are asked for, where a twin covers less or there is none."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from arbora import catalog
from arbora.operators import placement, trees
from arbora.sources.views import cells, tree_set


def test_powerset_has_the_child_sets_of_every_tree(spark, sf):
    kids = {}
    for r in tree_set(spark, sf).collect():
        kids.setdefault((r.t, r.parent), []).append(r.node)
    want = [(t, v, c) for (t, v), own in kids.items() for n in (1, 2) for c in itertools.combinations(sorted(own), n)]
    got = [(r.t, r.v, tuple(r.c)) for r in catalog.queries()["powerset"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(t in (3, 7) for t, *_ in got) == 650


def test_betainc_tail_has_all_pairs(spark, sf):
    reads = {(r.node, r.sample): r for r in cells(spark, sf).collect()}

    def tail(v, n, x):  # at least v + 1 of n + 1 draws
        log = lambda j: math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n - j + 2) + j * math.log(x) + (n + 1 - j) * math.log1p(-x)
        return float(x >= 1) if not 0 < x < 1 else math.fsum(math.exp(log(j)) for j in range(v + 1, n + 2))

    want = {}
    for (u, s), a in reads.items():
        for (w, other), b in reads.items():
            if s == other and u != w:
                want[u, w, s] = tail(a.v, a.n, 0.5 * min(1.0, b.v / (b.omega * b.n)))
    rows = catalog.queries()["betainc_tail"](spark, sf).collect()
    got = {(r.u, r.w, r.sample): r.p for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1.1e-6


@pytest.mark.parametrize(("n", "largest"), [(21, 4), (25, 3), (31, 2), (32, 2), (40, 1), (70, 2), (6, 10)])
def test_candidates_take_all_sets_of_the_asked_size(spark, n, largest):
    star = spark.createDataFrame([([0] * n + [-1], n + 1)], "parents array<int>, u int")
    got = [(r.v, tuple(r.c), r.model) for r in placement.candidates(star, largest).select("v", "c", "model").collect()]
    sets = [c for k in range(1, min(n, largest) + 1) for c in itertools.combinations(range(1, n + 1), k)]
    want = [(0, c, placement.SPLIT) for c in sets] + [(v, (), placement.LEAF) for v in range(n + 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("n", "largest"), [(32, 2), (21, 4)])
def test_subsets_of_many_children(spark, n, largest):
    one = spark.range(1).select(trees.subsets(F.sequence(F.lit(1), F.lit(n)), largest).alias("s")).first()
    assert sorted(map(tuple, one.s)) == sorted(c for k in range(1, largest + 1) for c in itertools.combinations(range(1, n + 1), k))
