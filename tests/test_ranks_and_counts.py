"""Ranks and quantiles of whole tables, and enumeration by merged states and depth first, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import enumerate as E
from arbora.operators import rank


def test_global_rank_and_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(40), rng.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int, c string").repartition(7)
    got = rank.global_rank(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.v, r.c) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 501))
    after = {r.id: r.next and tuple(r.next) for r in rank.neighbours(df, [F.desc("v"), F.asc("id")], ["id", "c"]).collect()}
    assert after == {a[0]: b and (b[0], b[2]) for a, b in zip(want, [*want[1:], None])}
    assert rank.global_rank(df.limit(0), [F.asc("id")]).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_exact_quantiles(spark, monkeypatch, block):
    monkeypatch.setattr(rank, "_SUM_ROWS", block)
    rng = random.Random(2)
    rows = [(k, "p", None if rng.random() < 0.1 else round(rng.gauss(0, 1), rng.randrange(3))) for k in range(5) for _ in range(rng.randrange(1, 150))] + [(9, "p", 3.0)] * 2000 + [(8, "q", None)]
    shares = {"low": 0.1, "half": 0.5, "most": 0.99, "top": 1.0}
    got = {r.k: r for r in rank.exact_quantiles(spark.createDataFrame(rows, "k int, g string, v double"), ["k", "g"], "v", shares).collect()}
    for k in {r[0] for r in rows if r[2] is not None}:
        values = [r[2] for r in rows if r[0] == k and r[2] is not None]
        assert all(abs(got[k][name] - np.quantile(values, q)) < 1e-12 for name, q in shares.items())
    assert 8 not in got


def frequencies(spark, f):
    return spark.createDataFrame([(v, s, float(x)) for v, row in enumerate(f) for s, x in enumerate(row)], "node int, sample int, f double")


def slow(f):
    """All parents vectors that keep the sums, by placing nodes of falling sums."""
    order = sorted(range(len(f)), key=lambda v: (-round(sum(f[v]), 12), v))
    states, sizes = [([-1] * (len(f) - 1), {0: list(f[0])})], []
    for u in order[1:]:
        new = []
        for parents, left in states:
            for v, r in left.items():
                if all(b <= a + 1e-10 for a, b in zip(r, f[u])):
                    p = list(parents)
                    p[u - 1] = v
                    new.append((p, {**left, v: [a - b for a, b in zip(r, f[u])], u: list(f[u])}))
        states = new
        sizes.append(len(states))
    return sorted(p for p, _ in states), sizes


def some(n, samples, seed):
    rng = np.random.default_rng(seed)
    parents = [int(rng.integers(0, i + 1)) for i in range(n)]
    eta = rng.dirichlet(np.ones(n + 1), samples).T
    f = eta.copy()
    for i in range(n, 0, -1):
        f[parents[i - 1]] += f[i]
    f[0] = 1.0
    return f.tolist()


@pytest.mark.parametrize(("n", "samples", "seed"), [(5, 2, 1), (6, 1, 2)])
def test_counts_and_trees(spark, n, samples, seed):
    f = some(n, samples, seed)
    want, _ = slow(f)
    freq = frequencies(spark, f)
    assert E.count_trees(freq).first().n_trees == len(want)
    assert sorted(r.parents for r in E.enumerate_trees(freq).collect()) == want
    assert sorted(r.parents for r in E.enumerate_trees(freq, frontier=4).collect()) == want
    few = [r.parents for r in E.enumerate_trees(freq, stop=3, frontier=5).collect()]
    assert len(few) == min(3, len(want)) and all(p in want for p in few)
    with pytest.raises(RuntimeError):
        E.enumerate_trees(freq, max_trees=len(want) - 1)


def test_merged_states_are_far_fewer_than_trees(spark, monkeypatch):
    f = [[1.0]] + [[0.125]] * 8  # any of the 8 nodes fits everywhere once: nodes are alike
    want, sizes = slow(f)
    written, real = [], E.stash

    def counted(df, name, **more):
        out = real(df, name, **more)
        if name == "partial":
            written.append(out.count())
        return out

    monkeypatch.setattr(E, "stash", counted)
    assert E.count_trees(frequencies(spark, f)).first().n_trees == len(want)
    assert len(written) == 8 and sum(written) * 20 < sum(sizes)


def test_depth_first_keeps_the_frontier_small(spark, monkeypatch):
    f, grown, real = some(5, 1, 7), [], E.stash
    monkeypatch.setattr(E, "stash", lambda df, name, **more: (out := real(df, name, **more), grown.append(out.count()) if name == "partial" else None)[0])
    want, _ = slow(f)
    assert len(E.enumerate_trees(frequencies(spark, f), frontier=3).collect()) == len(want) > 4
    assert max(grown) <= 3 * 5 * 3  # three at a time, with slack for uneven parts
