"""Exhaustive enumeration of the trees that a frequency matrix allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.numeric import ISA_SLACK
from arbora.operators.rank import global_rank
from arbora.plans import drop, stash

#: Partial trees that a depth-first enumeration expands together.
FRONTIER = 100_000


def _ordered(freq: DataFrame) -> tuple[DataFrame, int]:
    """(node, f array, place, later, _one; the number of nodes besides the root): nodes by falling frequency sum, and for each
    the frequencies of those after it."""
    vec = freq.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "f"))), lambda s: s["f"]).alias("f"))
    vec = vec.withColumns({"weight": F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 12), "_one": F.lit(1)})
    vec = global_rank(vec, [F.desc("weight"), F.asc("node")], "place").withColumn("place", F.col("place") - 1)
    every = vec.groupBy("_one").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "f"))), lambda x: x["f"]).alias("all"))  # one matrix
    vec = stash(vec.join(every, "_one").withColumn("later", F.expr("slice(all, int(place) + 2, size(all))")).drop("all", "weight"), "ordered", release=False)
    n = vec.count() - 1
    if n < 0 or vec.where("place = 0").first()["node"] != 0:
        raise ValueError("the root, node 0, must have the largest frequencies")
    return vec, n


def _fits(left: Column, need: Column) -> Column:
    """Whether a node's frequencies fit into what another has left, in every sample."""
    return F.forall(F.zip_with(left, need, lambda a, b: b <= a + ISA_SLACK), lambda x: x)


def _next(rows: DataFrame, vec: DataFrame, place: int) -> DataFrame:
    """``rows`` with the next node u, its frequencies fu and those of the nodes after it; one row beside all."""
    one = vec.where(F.col("place") == place).select(F.col("node").alias("u"), F.col("f").alias("fu"), "later", "_one")
    return rows.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def count_trees(freq: DataFrame, max_trees: int | None = None) -> DataFrame:
    """n_trees: one row, the number of trees of ``enumerate_trees``, without the trees.

    What can still be built depends only on what the placed nodes have left, and of those only on the nodes that can take a later
    one. So partial trees that agree in that, whichever nodes hold it, are one row with a multiplicity, and rows are far fewer
    than partial trees. Numbers beyond 2**63 are an error of Spark's arithmetic. ``max_trees`` stops with an error once more
    partial trees than that are counted.
    """
    vec, n = _ordered(freq)
    spark = freq.sparkSession
    state = vec.where("place = 0").select(F.array("f").alias("rest"), F.lit(1).cast("long").alias("times"))
    for place in range(1, n + 1):
        rows = _next(state, vec, place)
        rows = rows.withColumn("i", F.explode(F.filter(F.transform("rest", lambda x, i: F.when(_fits(x, F.col("fu")), i)), lambda i: i.isNotNull())))
        less = lambda x: F.zip_with(x, F.col("fu"), lambda a, b: a - b)
        rest = F.concat(F.transform("rest", lambda x, i: F.when(i == F.col("i"), less(x)).otherwise(x)), F.array("fu"))
        alive = F.array_sort(F.filter(rest, lambda x: F.exists("later", lambda u: _fits(x, u))))
        before = state
        state = stash(rows.select(alive.alias("rest"), "times").groupBy("rest").agg(F.sum("times").alias("times")), "partial", release=False)
        if place > 1:
            drop(spark, before)
        if max_trees is not None and (state.agg(F.sum("times")).first()[0] or 0) > max_trees:
            raise RuntimeError(f"over {max_trees} partial trees at node {place} of {n}")
    return state.agg(F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("n_trees"))


def _grown(state: DataFrame, vec: DataFrame, place: int) -> DataFrame:
    """Partial trees (parents, rest array<struct<node, left>>) with the node of the next place under each node that can take it."""
    rows = _next(state, vec, place)
    rows = rows.withColumn("r", F.explode(F.filter("rest", lambda r: _fits(r["left"], F.col("fu")))))
    less = F.zip_with(F.col("r.left"), F.col("fu"), lambda a, b: a - b)
    rest = F.transform("rest", lambda x: F.when(x["node"] == F.col("r.node"), F.struct(x["node"].alias("node"), less.alias("left"))).otherwise(x))
    parents = F.transform("parents", lambda p, i: F.when(i + 1 == F.col("u"), F.col("r.node")).otherwise(p).cast("int"))
    return rows.select(parents.alias("parents"), F.concat(rest, F.array(F.struct(F.col("u").alias("node"), F.col("fu").alias("left")))).alias("rest"))


def enumerate_trees(freq: DataFrame, max_trees: int | None = None, stop: int | None = None, frontier: int = FRONTIER) -> DataFrame:
    """parents array<int>: every tree in which no node's children sum to more than it in any sample.

    ``freq`` (node, sample, f) holds nodes 0..n, node 0 the root. Nodes are placed by falling frequency sum. A step joins partial
    trees with their next node's possible parents: those placed before it that have enough left. About ``frontier`` partial trees
    take a step together, the largest first, so no more than ``frontier`` times the nodes are grown at once and complete trees
    come early. Partial trees are rows in shared storage.

    ``stop`` ends the enumeration when so many trees are complete and returns that many (which, is not said); ``max_trees`` ends
    it with an error once there are more, and never returns part of the trees.
    """
    vec, n = _ordered(freq)
    spark = freq.sparkSession
    root = vec.where("place = 0").select(F.array_repeat(F.lit(-1), n).alias("parents"), F.array(F.struct("node", F.col("f").alias("left"))).alias("rest"))
    todo: list[tuple[int, DataFrame, int, int, list]] = [(1, root, 0, 1, [])] if n else []
    done, found = [], 0
    while todo:
        place, table, part, parts, kept = todo.pop()
        rows = table.where(F.pmod(F.xxhash64("parents"), F.lit(parts)) == part) if parts > 1 else table
        grown = stash(_grown(rows, vec, place), "partial", release=False)
        if part == 0 and kept:  # parts are taken from the last to the first
            drop(spark, table)
        count = grown.count()
        if place == n:
            done.append(grown.select("parents"))
            found += count
            if max_trees is not None and found > max_trees:
                raise RuntimeError(f"over {max_trees} trees")
            if stop is not None and found >= stop:
                break
        elif count:
            pieces = -(-count // frontier)
            todo += [(place + 1, grown, k, pieces, [grown]) for k in range(pieces)]
        else:
            drop(spark, grown)
    if not n:
        return root.select("parents")
    out = reduce(DataFrame.unionByName, done) if done else root.select("parents").limit(0)
    return out.limit(stop) if stop is not None else out
