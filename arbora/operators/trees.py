"""Tree operators on edge tables (node, parent; root 0) and on parents vectors (array<int>, node i at place i - 1).

Tables may hold many trees: pass the columns that tell them apart as ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.numeric import ISA_SLACK
from arbora.operators.euler import jump, subtree_sums, tour
from arbora.operators.rank import global_rank
from arbora.plans import drop, stash


def edges_of(trees: DataFrame, parents: str = "parents", keys: Sequence[str] = ()) -> DataFrame:
    """node, parent for each placed node of a parents vector (parents below 0 are not placed)."""
    rows = trees.select(*keys, F.posexplode(parents).alias("i", "parent"))
    return rows.where("parent >= 0").select(*keys, (F.col("i") + 1).alias("node"), "parent")


def parents_of(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, parents: the inverse of ``edges_of`` for trees whose nodes are 1..n."""
    rows = edges.groupBy(*keys) if keys else edges.groupBy()
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "parent"))), lambda e: e["parent"]).alias("parents"))


def ancestry(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, anc, node, depth: every node with itself (depth 0) and each ancestor, the root too.

    Doubles the reach each round (joins of ancestor pairs), so the rounds grow with the logarithm of the height; each round is
    written to shared storage.
    """
    keys = list(keys)
    root = edges.select(*keys, F.lit(0).alias("anc"), F.lit(0).alias("node"), F.lit(0).alias("depth")).distinct()
    own = edges.select(*keys, F.col("node").alias("anc"), "node", F.lit(0).alias("depth"))
    step = stash(edges.select(*keys, F.col("parent").alias("anc"), "node", F.lit(1).alias("depth")), "ancestry", release=False)
    reach = 1
    while True:
        far = step.where(F.col("depth") == reach).select(*keys, F.col("anc").alias("mid"), "node")
        up = step.select(*keys, F.col("anc"), F.col("node").alias("mid"), F.col("depth").alias("more"))
        new = far.join(up, [*keys, "mid"]).select(*keys, "anc", "node", (F.col("more") + reach).alias("depth"))
        longer = stash(step.unionByName(new), "ancestry", release=False)
        drop(edges.sparkSession, step)
        top = longer.agg(F.max("depth")).first()[0]
        step, before, reach = longer, reach, reach * 2
        if top is None or top < reach or top == before:
            break
    return step.unionByName(own).unionByName(root)


def children(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, parent, children (sorted)."""
    return edges.groupBy(*keys, "parent").agg(F.array_sort(F.collect_list("node")).alias("children"))


def partial_parents(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, rank, parent_rank: placed nodes (parent >= 0) renumbered 1, 2, ... in node order; the root stays 0."""
    placed = edges.where("parent >= 0")
    if keys:
        ranked = placed.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("node")))
    else:
        ranked = stash(global_rank(placed, [F.asc("node")]).withColumn("rank", F.col("rank").cast("int")), "ranked_nodes", release=False)
    up = ranked.select(*keys, F.col("node").alias("parent"), F.col("rank").alias("r"))
    return ranked.join(up, [*keys, "parent"], "left").select(*keys, "node", "rank", F.coalesce("r", F.lit(0)).alias("parent_rank"))


def newick(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, newick: ``(children)node``, siblings by number, ended by a semicolon: the pieces of an Euler tour in its order."""
    keys = list(keys)
    rows = tour(edges, keys)
    inner = F.col("size") > 1
    opening = F.concat(F.when(F.col("first"), "").otherwise(","), F.when(inner, "(").otherwise(""))
    closing = F.concat(F.when(inner, ")").otherwise(""), F.col("node").cast("string"))
    pieces = F.array(F.struct(F.col("opens").alias("at"), opening.alias("text")), F.struct(F.col("closes").alias("at"), closing.alias("text")))
    listed = rows.select(*keys, F.explode(pieces).alias("piece")).groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return listed.select(*keys, F.concat(F.array_join("pieces.text", ""), F.lit(";")).alias("newick"))


def lineages(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, head, parent, nodes: maximal unbranched paths. A head hangs off the root or off a node with several children.

    Every other node points to its parent; the chains of pointers end at the heads.
    """
    keys = list(keys)
    count = edges.groupBy(*keys, "parent").agg(F.count(F.lit(1)).alias("siblings"))
    rows = stash(edges.join(count, [*keys, "parent"]).withColumn("is_head", (F.col("parent") == 0) | (F.col("siblings") > 1)), "lineage_heads", release=False)
    ends = jump(rows.select(*keys, F.col("node").alias("item"), F.when(~F.col("is_head"), F.col("parent")).alias("to")), keys)
    heads = rows.where("is_head").select(*keys, F.col("node").alias("end"), "parent")
    return ends.join(heads, [*keys, "end"]).groupBy(*keys, F.col("end").alias("head"), "parent").agg(F.array_sort(F.collect_list("item")).alias("nodes"))


def contract(edges: DataFrame, into: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Edges after node ``into`` is merged into one of its children: the merged clone keeps the child's number, all children of
    ``into`` hang off its parent, and ``into`` is gone."""
    grand = F.max(F.when(F.col("node") == into, F.col("parent"))).over(Window.partitionBy(*keys))
    rows = edges.withColumn("grand", grand).where(F.col("node") != into)
    return rows.select(*keys, "node", F.when(F.col("parent") == into, F.col("grand")).otherwise(F.col("parent")).alias("parent"))


def eta_from_f(edges: DataFrame, freq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, sample, eta: a node's frequency less those of its children."""
    on = [*keys, "node"]
    below = edges.join(freq, on).groupBy(*keys, F.col("parent").alias("node"), "sample").agg(F.sum("f").alias("below"))
    return freq.join(below, [*on, "sample"], "left").select(*on, "sample", (F.col("f") - F.coalesce("below", F.lit(0.0))).alias("eta"))


def f_from_eta(edges: DataFrame, eta: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, sample, f: the sum of eta over a node's subtree. ``eta`` has a row for each node, the root too, and sample."""
    return subtree_sums(tour(edges, keys), eta, "eta", keys, ["sample"]).withColumnRenamed("total", "f")


def isa_violations(edges: DataFrame, freq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, sample, f, below: where the children's frequencies sum to more than the node's."""
    below = edges.join(freq, [*keys, "node"]).groupBy(*keys, F.col("parent").alias("node"), "sample").agg(F.sum("f").alias("below"))
    return freq.join(below, [*keys, "node", "sample"]).where(F.col("below") > F.col("f") + ISA_SLACK)


def dominance(freq: DataFrame) -> DataFrame:
    """u, v: ordered pairs of nodes where u is at least as frequent as v in every sample."""
    a, b = (freq.select(F.col("node").alias(x), "sample", F.col("f").alias(f"f{x}")) for x in "uv")
    both = a.join(b, "sample").where("u <> v").groupBy("u", "v").agg(F.bool_and(F.col("fu") >= F.col("fv")).alias("over"))
    return both.where("over").select("u", "v")


def apply_action(parents: str, u: Column, v: Column, c: Column) -> Column:
    """The parents vector with u under v, and the nodes of c (an array, may be empty) under u."""
    return F.transform(parents, lambda p, i: F.when(i + 1 == u, v).when(F.array_contains(c, i + 1), u).otherwise(p).cast("int"))


def subsets(children: Column, largest: int) -> Column:
    """All non-empty subsets of a sorted array of distinct nodes with at most ``largest`` members, as an array of arrays.

    They grow by one larger member a round, so the work follows their number, but all of them are in one row: see ``child_sets``.
    """
    single = F.transform(children, lambda x: F.array(x))
    larger = lambda s: F.transform(F.filter(children, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))
    grown = lambda sets, size: F.concat(sets, F.flatten(F.transform(F.filter(sets, lambda s: F.size(s) == size), larger)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(largest - 1)), single, grown) if largest > 1 else single


def child_sets(rows: DataFrame, largest: int, children: str = "children", also: Column | None = None) -> DataFrame:
    """``rows`` with c: one row for each non-empty set of at most ``largest`` (1 at least) members of ``children``, a sorted array
    of distinct nodes. The arrays of ``also``, if given, come with them as they are; none may be as long as a set that grows.

    Each round explodes the sets of the round before with one more, larger member, so the work follows the number of sets and no
    row holds more than one of them.
    """
    single = F.transform(children, lambda x: F.array(x))
    out = rows.withColumn("c", F.explode(single if also is None else F.concat(also, single)))
    for size in range(1, largest):
        out = out.withColumn("c", F.explode(F.expr(f"concat(array(c), transform(filter({children}, x -> size(c) = {size} AND x > element_at(c, -1)), x -> concat(c, array(x))))")))
    return out


def parsimony(parents: str) -> Column:
    """Number of nodes less the number of distinct parents."""
    return F.size(parents) - F.size(F.array_distinct(parents))
