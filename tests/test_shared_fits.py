"""Fits that share subtrees equal fits of each tree alone, and compute little for trees that differ in one node."""

import numpy as np
import pyarrow as pa

from arbora.operators import fit


def random_tree(rng, n):
    parents = [int(rng.integers(0, i + 1)) for i in range(n)]
    return [p if rng.random() < 0.9 or i == 0 or i + 1 in parents else -1 for i, p in enumerate(parents)]


def test_batches_equal_single_fits(monkeypatch):
    rng = np.random.default_rng(4)
    for kept in (200_000, 30):
        monkeypatch.setattr(fit, "KEPT", kept)
        trees = [random_tree(rng, 12) for _ in range(40)]
        data = [(rng.uniform(0, 1, (3, 12)), rng.uniform(1e-4, 0.1, (3, 12))) for _ in range(2)]
        own = [data[k % 2] for k in range(len(trees))]
        got = fit._fit_batch(pa.array(trees, pa.list_(pa.int32())), pa.array([t.tolist() for t, _ in own]), pa.array([w.tolist() for _, w in own])).to_pylist()
        for parents, (t, w), fits in zip(trees, own, got):
            for s in range(3):
                f, eta = fit.fit_sample(np.array(parents), t[s], w[s])
                assert np.array_equal(np.array(fits[s]["f"]), f, equal_nan=True) and np.array_equal(np.array(fits[s]["eta"]), eta, equal_nan=True)
                placed = [0] + [i + 1 for i, p in enumerate(parents) if p >= 0]
                assert abs(sum(eta[v] for v in placed) - 1) < 1e-9 and min(eta[v] for v in placed) >= 0


def test_siblings_share_all_but_the_way_to_the_root():
    base = [i // 2 for i in range(1, 64)] + [-1]  # a heap of 63 nodes, one to place
    one, forest = fit.SampleFit(np.full(64, 0.02), np.full(64, 0.01)), fit.Forest()
    one.fit(*forest.add(base))
    before = len(one.total)
    for v in range(64):
        one.fit(*forest.add([*base[:-1], v]))
    assert before == 64 and len(one.total) - before <= 64 * 8  # the new leaf, and at most seven nodes above it


def test_no_nodes_at_all():
    f, eta = fit.fit_sample(np.array([-1, -1]), np.array([0.5, 0.5]), np.array([0.1, 0.1]))
    assert f[0] == eta[0] == 1.0 and np.isnan(f[1:]).all() and np.isnan(eta[1:]).all()
