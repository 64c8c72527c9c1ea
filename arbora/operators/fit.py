"""Tree-constrained frequencies: the weighted least-squares projection of implied frequencies onto a tree's polytope."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import clip, safe_divide
from arbora.functions.numeric import LLH_CLIP, log_choose
from arbora.operators.reads import variance_weight


class Forest:
    """Trees that share their subtrees: a subtree is a node with its subtrees below, and has one number in all trees."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}

    def add(self, parents: Sequence[int]) -> tuple[list[int], list[list[int]], list[int]]:
        """(nodes from the root down, children of each, number of each one's subtree) of a parents vector."""
        below: list[list[int]] = [[] for _ in range(len(parents) + 1)]
        for i, p in enumerate(parents):
            if p >= 0:
                below[p].append(i + 1)
        order = [0]
        for v in order:
            order.extend(below[v])
        own = [-1] * len(below)
        for v in reversed(order):
            own[v] = self.numbers.setdefault((v, *(own[c] for c in below[v])), len(self.numbers))
        return order, below, own


def _between(x: list[float], y: list[float], at: float) -> float:
    """The piecewise-linear function through ascending x, constant beyond its ends."""
    k = bisect_right(x, at)
    if k == 0 or k == len(x):
        return y[0] if k == 0 else y[-1]
    return y[k - 1] + (y[k] - y[k - 1]) * ((at - x[k - 1]) / (x[k] - x[k - 1]))


class SampleFit:
    """Fits of many trees to one sample's targets and weights (one value for each node 1..n).

    A fit minimises sum (f - target)^2 / weight with f[0] = 1 and f[v] >= sum of v's children. Exact, by the multipliers of the
    constraints. Given the multiplier of the constraint above it, a node's frequency is a falling piecewise-linear function;
    bottom up, the functions of a node's children are added and shifted by the node's own term; the root's frequency fixes the
    first multiplier, and the rest follow top down. The functions of a subtree depend on it alone and are kept: trees that
    differ in one node are new only on the way from there to the root.
    """

    def __init__(self, target: np.ndarray, weight: np.ndarray):
        self.target, self.weight = target, weight
        self.total: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # subtree -> multiplier below, what the children then sum to
        self.knots: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # subtree -> multiplier above, its frequency
        self.lists: dict[int, tuple[list[float], list[float], list[float]]] = {}  # the same, and the multiplier below, for single values

    def _at(self, v: int, own: int, above: np.ndarray) -> np.ndarray:
        lam, t = self.knots[own]
        return np.where(above < lam[0], self.target[v - 1] - above * self.weight[v - 1] / 2, np.interp(above, lam, t))

    def _add(self, v: int, children: list[int], own: list[int]) -> None:
        if children:
            mu = np.unique(np.concatenate([[0.0], *(self.knots[own[c]][0] for c in children)]))
            mu = mu[mu >= 0]
            x = np.maximum(sum(self._at(c, own[c], mu) for c in children), 0.0)
        else:
            mu, x = np.zeros(1), np.zeros(1)
        self.total[own[v]] = mu, x
        if v:
            lam = mu - (x - self.target[v - 1]) * 2 / self.weight[v - 1]
            self.knots[own[v]] = lam, x
            self.lists[own[v]] = lam.tolist(), x.tolist(), mu.tolist()

    def fit(self, order: list[int], below: list[list[int]], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(f, eta) of a tree of ``Forest``; NaN for nodes that are not placed."""
        for v in reversed(order):
            if own[v] not in self.total:
                self._add(v, below[v], own)
        f, multiplier = [math.nan] * len(below), [0.0] * len(below)
        f[0] = 1.0
        mu, x = self.total[own[0]]
        multiplier[0] = 0.0 if x[0] <= 1 else float(np.interp(-1.0, -x, mu))
        for v in order:
            m = multiplier[v]
            for c in below[v]:
                lam, t, under = self.lists[own[c]]
                free = m < lam[0]
                f[c] = max(0.0, float(self.target[c - 1] - m * self.weight[c - 1] / 2) if free else _between(lam, t, m))
                multiplier[c] = 0.0 if m <= lam[0] else _between(lam, under, m)
        eta = [max(0.0, x - math.fsum(f[c] for c in kids)) if kids else x for x, kids in zip(f, below)]
        return np.array(f), np.array(eta)


def fit_sample(parents: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(f, eta) for one tree and sample, see ``SampleFit``. ``parents[i]`` is the parent of node i + 1, below 0 for nodes that are
    not placed."""
    return SampleFit(target, weight).fit(*Forest().add(parents.tolist()))


#: Subtrees of a batch whose functions are kept before a batch starts anew, over all samples.
KEPT = 200_000


def _fit_batch(parents: pa.Array, target: pa.Array, weight: pa.Array) -> pa.Array:
    """One fit for each tree and sample; targets and weights are arrays over samples of arrays over nodes.

    The children of a branch stand side by side in a batch, so most of their subtrees are shared.
    """
    out, forest, samples = [], Forest(), {}
    for tree, targets, weights in zip(parents, target, weight):
        if len(forest.numbers) * max(1, len(samples)) > KEPT:
            forest, samples = Forest(), {}
        shape, fits = forest.add(tree.as_py()), []
        for t, w in zip(targets, weights):
            t, w = t.values.to_numpy(), w.values.to_numpy()
            key = t.tobytes(), w.tobytes()
            if key not in samples:
                samples[key] = SampleFit(t, w)
            f, eta = samples[key].fit(*shape)
            fits.append({"f": f, "eta": eta})
        out.append(fits)
    return pa.array(out, pa.list_(pa.struct([("f", pa.list_(pa.float64())), ("eta", pa.list_(pa.float64()))])))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def pack(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each problem (``keys``): samples array<struct<sample, v, n, omega, target, weight, choose>>, each an array over nodes 1..n.

    ``choose`` is the log of the binomial coefficient, the part of a likelihood that no tree changes.

    Its size is nodes times samples of one problem, a few MB at most, and doesn't grow with the number of trees.
    """
    target = clip(safe_divide(F.col("v"), F.col("omega") * F.col("n")), 0.0, 1.0)
    rows = cells.select(*keys, "node", "sample", "v", "n", "omega", target.alias("target"), variance_weight(F.col("v"), F.col("n"), F.col("omega")).alias("weight"), log_choose(F.col("n"), F.col("v")).alias("choose"))
    names = ["v", "n", "omega", "target", "weight", "choose"]
    one = rows.groupBy(*keys, "sample").agg(F.array_sort(F.collect_list(F.struct("node", *names))).alias("x"))
    one = one.select(*keys, F.struct("sample", *[F.transform("x", _field(c)).alias(c) for c in names]).alias("s"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("samples"))


def with_data(trees: DataFrame, packed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``trees`` with the row of ``pack`` of their problem beside each. Spark broadcasts the problems while they are small."""
    one = F.lit(1).alias("_one")
    return trees.join(packed, list(keys)) if keys else trees.select("*", one).join(packed.select("*", one), "_one").drop("_one")


def placed_llh(parents: Column, s: Column, f: Column) -> Column:
    """Log likelihood of the placed nodes of one sample."""
    p = F.zip_with(s["omega"], F.slice(f, 2, F.size(parents)), lambda o, x: clip(o * x, LLH_CLIP, 1 - LLH_CLIP))
    rows = F.arrays_zip(parents.alias("up"), s["v"].alias("v"), s["n"].alias("n"), s["choose"].alias("c"), p.alias("p"))
    term = lambda r: F.when(r["up"] >= 0, r["c"] + r["v"] * F.ln(r["p"]) + (r["n"] - r["v"]) * F.ln(1.0 - r["p"])).otherwise(0.0)
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + term(r))


def fit_trees(trees: DataFrame, packed: DataFrame, keys: Sequence[str] = (), columns: dict[str, Column] | None = None) -> DataFrame:
    """``trees`` (parents, ...) with llh and fits array<struct<sample, f, eta>>, by sample.

    A tree is one row with all its samples, so nothing is shuffled; sets of trees spread over tasks as they come.
    """
    return _fitted(with_data(trees, packed, keys), trees.columns, columns)


def fit_own(trees: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """As ``fit_trees`` where each tree (unique ``keys``) has cells (keys, node, sample, v, n, omega) of its own."""
    return _fitted(trees.join(pack(cells, keys), keys), trees.columns)


def fit_columns() -> dict[str, Column]:
    """The columns that a fit adds; loops build them once."""
    fit = F.arrow_udf(_fit_batch, "array<struct<f: array<double>, eta: array<double>>>")
    both = F.arrays_zip(F.col("samples").alias("s"), F.col("fitted").alias("r"))
    llh = F.aggregate(both, F.lit(0.0), lambda total, z: total + placed_llh(F.col("parents"), z["s"], z["r"]["f"]))
    fits = F.transform(both, lambda z: F.struct(z["s"]["sample"].alias("sample"), z["r"]["f"].alias("f"), z["r"]["eta"].alias("eta")))
    return {"fitted": fit("parents", "samples.target", "samples.weight"), "llh": llh, "fits": fits}


def _fitted(with_samples: DataFrame, names: list[str], columns: dict[str, Column] | None = None) -> DataFrame:
    x = columns or fit_columns()
    return with_samples.withColumn("fitted", x["fitted"]).select(*names, x["llh"].alias("llh"), x["fits"].alias("fits"))


def frequencies(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, sample, f, eta of the placed nodes and the root, from ``fit_trees``."""
    rows = fitted.select(*keys, F.explode("fits").alias("fit")).select(*keys, "fit.sample", F.posexplode(F.arrays_zip("fit.f", "fit.eta")).alias("node", "x"))
    return rows.where(~F.isnan("x.f")).select(*keys, "node", "sample", F.col("x.f").alias("f"), F.col("x.eta").alias("eta"))
