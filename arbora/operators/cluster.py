"""Phylogeny-aware clustering: distances, linkages, the constrained agglomeration of whole tree sets, and model selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import clip
from arbora.functions.numeric import PAC_CLIP
from arbora.operators.reads import cluster_llh
from arbora.operators.trees import lineages
from arbora.sources.formats import require

METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra", "braycurtis", "cosine", "correlation", "hamming")
LINKAGES = ("min", "avg", "ward")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of the same length. Null where it has no value: cosine of a zero vector, correlation of a constant
    one, braycurtis of two that cancel out. Places where both are 0 add nothing to canberra."""
    both = lambda f: F.zip_with(a, b, f)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    if metric in ("euclidean", "sqeuclidean"):
        square = total(both(lambda x, y: (x - y) * (x - y)))
        return F.sqrt(square) if metric == "euclidean" else square
    if metric == "cityblock":
        return total(both(lambda x, y: F.abs(x - y)))
    if metric == "canberra":
        return total(both(lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))
    if metric == "braycurtis":
        return F.try_divide(total(both(lambda x, y: F.abs(x - y))), total(both(lambda x, y: F.abs(x + y))))
    if metric == "hamming":
        return total(both(lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(a)
    if metric == "correlation":
        centered = lambda v: F.transform(v, lambda x: x - total(v) / F.size(v))
        return distance(centered(a), centered(b), "cosine")
    if metric == "chebyshev":
        return F.array_max(both(lambda x, y: F.abs(x - y)))
    if metric == "cosine":
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
        return 1.0 - F.try_divide(total(both(lambda x, y: x * y)), norm(a) * norm(b))
    raise ValueError(f"metric is one of {METRICS}")


def pairwise_distance(rows: DataFrame, metric: str = "euclidean", id_col: str = "id", vec_col: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """keys, a, b, dist for all pairs a < b of one problem: quadratic in its nodes by definition."""
    left = rows.select(*keys, F.col(id_col).alias("a"), F.col(vec_col).alias("xa"))
    right = rows.select(*keys, F.col(id_col).alias("b"), F.col(vec_col).alias("xb"))
    both = left.join(right, list(keys)) if keys else left.join(right, F.col("a") < F.col("b"))
    return both.where("a < b").select(*keys, "a", "b", distance(F.col("xa"), F.col("xb"), metric).alias("dist"))


def linkage(pairs: DataFrame, members: DataFrame, kind: str = "min") -> DataFrame:
    """c1, c2, dist for all pairs of clusters (c1 < c2) of members (cluster, id), from distances (a < b)."""
    a, b = (members.select(F.col("cluster").alias(f"c{x}"), F.col("id").alias(x)) for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").where("ca <> cb")
    dist = F.min("dist") if kind == "min" else F.avg("dist")
    return rows.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(dist.alias("dist"))


def ward(members: DataFrame) -> DataFrame:
    """c1, c2, dist for members (cluster, id, sample, f): n1 n2 / (n1 + n2) times the squared distance of the clusters' means."""
    mean = members.groupBy("cluster", "sample").agg(F.avg(clip(F.col("f"), PAC_CLIP, 1 - PAC_CLIP)).alias("m"), F.count(F.lit(1)).alias("n"))
    a, b = (mean.select(F.col("cluster").alias(c), "sample", F.col("m").alias(f"m{c}"), F.col("n").alias(f"n{c}")) for c in ("c1", "c2"))
    rows = a.join(b, "sample").where("c1 < c2")
    part = F.col("nc1") * F.col("nc2") / (F.col("nc1") + F.col("nc2")) * F.pow(F.col("mc1") - F.col("mc2"), 2)
    return rows.groupBy("c1", "c2").agg(F.sum(part).alias("dist"))


def merge_rounds(parents: np.ndarray, dist: np.ndarray, kind: str) -> Iterator[tuple[list[int], list[list[int]]]]:
    """(parents, clusters) of one tree after each merge, the tree itself first; ``dist`` holds the distances of its nodes.

    If all live nodes hang off the root any two may merge; else a node may merge with its parent, at first only one without
    other children (linear segments), then any. The closest two merge; of equal distances (to 12 places) the smallest pair. The
    clone keeps the child's (or the smaller) place. A merge changes the distances of the merged clone alone, by the recurrences of
    Lance and Williams (1967).
    """
    parents, d = parents.copy(), dist.copy()
    size = np.ones(len(parents))
    clusters = [[i + 1] if p >= 0 else [] for i, p in enumerate(parents.tolist())]
    linear = True
    while True:
        yield parents.tolist(), [list(c) for c in clusters]
        while True:
            low, top = np.flatnonzero(parents > 0), np.flatnonzero(parents == 0)
            if len(low):
                alone = np.bincount(parents[low], minlength=len(parents) + 1) == 1
                one = low[alone[parents[low]]] if linear else low
                two = parents[one] - 1
            else:
                i, j = np.triu_indices(len(top), 1)
                one, two = top[i], top[j]
            if len(one) or not linear:
                break
            linear = False
        if not len(one):
            return
        k = np.lexsort((two, one, np.round(d[one, two], 12)))[0]
        a, b = int(one[k]), int(two[k])
        if kind == "min":
            new = np.minimum(d[a], d[b])
        elif kind == "avg":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        d[a] = d[:, a] = new
        size[a] += size[b]
        parents[parents == b + 1] = parents[b]
        parents[b] = -1
        clusters[a], clusters[b] = sorted(clusters[a] + clusters[b]), []


def _rounds(kind: str) -> Callable:
    def run(parents: pa.Array, dist: pa.Array) -> pa.Array:
        out = []
        for tree, rows in zip(parents, dist):
            up = np.array(tree.as_py(), np.int64)
            out.append([{"parents": p, "clusters": [c for c in own if c]} for p, own in merge_rounds(up, rows.values.flatten().to_numpy().reshape(len(up), -1), kind)])
        return pa.array(out, pa.list_(pa.struct([("parents", pa.list_(pa.int32())), ("clusters", pa.list_(pa.list_(pa.int32())))])))

    return run


def agglomerate(trees: DataFrame, freq: DataFrame, kind: str = "min", metric: str = "euclidean") -> DataFrame:
    """tree, size, parents, clusters: every clone tree of each tree, from all its nodes to one.

    ``trees``: tree, parents; ``freq``: tree, node, sample, f for its nodes 1..n. A tree is one row with the matrix of its nodes'
    distances (n * n numbers), so trees spread over tasks, and no round is a job of its own: see ``merge_rounds``. A distance
    without a value (see ``distance``) counts as infinite. Ward starts from half the squared distance of two nodes.
    """
    if kind not in LINKAGES or metric not in METRICS or (kind == "ward" and metric != "euclidean"):
        raise ValueError(f"linkage is one of {LINKAGES}, metric one of {METRICS}; ward needs euclidean")
    f = clip(F.col("f"), PAC_CLIP, 1 - PAC_CLIP) if kind == "ward" else F.col("f")
    vec = freq.groupBy("tree", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", f.alias("f")))), lambda s: s["f"]).alias("x"))
    rows = vec.groupBy("tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "x"))), lambda s: s["x"]).alias("x"))
    far = F.lit(float("inf"))
    value = lambda a, b: distance(a, b, "sqeuclidean") / 2 if kind == "ward" else F.coalesce(distance(a, b, metric), far)
    matrix = F.transform("x", lambda a: F.transform("x", lambda b: value(a, b)))
    rounds = F.arrow_udf(_rounds(kind), "array<struct<parents: array<int>, clusters: array<array<int>>>>")
    rows = trees.join(rows, "tree").select("tree", "parents", matrix.alias("dist")).select("tree", F.explode(rounds("parents", "dist")).alias("r"))
    return rows.select("tree", F.size("r.clusters").alias("size"), "r.parents", "r.clusters")


def lineage_clusterings(edges: DataFrame, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """keys, size, llh, parents, clusters: the clone tree whose clones are the lineages (see ``trees.lineages``) of each tree.

    Clones are numbered by their heads; ``parents`` holds the number (from 1, 0 for the root) of the clone that a clone hangs
    off. Nothing is scored: llh is 0.
    """
    keys = list(keys)
    rows = lineages(edges, keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("head"))
    rows = rows.withColumn("clone", number)
    of_node = rows.select(*keys, F.col("clone").alias("up"), F.explode("nodes").alias("parent"))
    rows = rows.join(of_node, [*keys, "parent"], "left").select(*keys, "clone", F.coalesce("up", F.lit(0)).alias("up"), "nodes")
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("clone", "up", "nodes"))).alias("x"))
    field = lambda c: F.transform("x", lambda y: y[c])
    return packed.select(*keys, F.size("x").alias("size"), F.lit(0.0).alias("llh"), field("up").alias("parents"), field("nodes").alias("clusters"))


def clustering_llh(clusterings: DataFrame, cells: DataFrame) -> DataFrame:
    """``clusterings`` (tree, size, clusters, ...) with llh, from cells (tree, node, sample, v, n, omega, f)."""
    rows = clusterings.select("tree", "size", F.posexplode("clusters").alias("place", "ids")).select("tree", "size", "place", F.explode("ids").alias("node"))
    rows = rows.join(cells, ["tree", "node"]).withColumn("cluster", F.struct("tree", "size", "place"))
    llh = cluster_llh(rows).groupBy("cluster.tree", "cluster.size").agg(F.sum("llh").alias("llh"))
    return clusterings.join(llh, ["tree", "size"])


def information_criterion(llh: Column, size: Column, n: Column, m: Column, kind: str = "bic") -> Column:
    """2 size m g - 2 llh with g = ln n (bic) or ln n ln m (gic), which is 0 for one sample."""
    g = {"bic": F.ln(n), "gic": F.ln(n) * F.ln(m)}[kind]
    return 2.0 * size * m * g - 2.0 * llh


def select_clustering(clusterings: DataFrame, n: Column, m: Column, kind: str = "bic", num_clones: int | None = None) -> DataFrame:
    """For each tree the clustering with the least criterion, the larger of equal ones; or the one of ``num_clones`` clones, and an
    error if a tree has none of that size."""
    rows = clusterings.withColumn("criterion", information_criterion(F.col("llh"), F.col("size"), n, m, kind))
    if num_clones is not None:
        lacking = rows.groupBy("tree").agg(F.bool_or(F.col("size") == num_clones).alias("has")).where(~F.col("has"))
        require(lacking, f"trees without a clustering of {num_clones} clones")
        return rows.where(F.col("size") == num_clones)
    first = Window.partitionBy("tree").orderBy("criterion", F.desc("size"))
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def assignment(clusterings: DataFrame, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """keys, id, clusters: the clone number (from 0) of each member."""
    return clusterings.select(*keys, F.posexplode("clusters").alias("clusters", "ids")).select(*keys, F.explode("ids").alias("id"), "clusters")
