"""Tables behind the plots, and the refit of selected clone trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import trees as T
from arbora.operators.fit import fit_own, frequencies
from arbora.operators.reads import supervariants, vaf_over_omega


def prevalence_table(cells: DataFrame, freq: DataFrame) -> DataFrame:
    """node, sample, data, tree, error in percent: implied and fitted frequencies side by side."""
    data = vaf_over_omega(cells).withColumnRenamed("f", "hat")
    rows = data.join(freq, ["node", "sample"])
    return rows.select("node", "sample", (100 * F.col("hat")).alias("data"), (100 * F.col("f")).alias("tree"), (100 * F.abs(F.col("hat") - F.col("f"))).alias("error"))


def total_error(table: DataFrame) -> DataFrame:
    """error: the sum of a prevalence table's errors."""
    return table.agg(F.sum("error").alias("error"))


def subpopulation_table(edges: DataFrame, freq: DataFrame) -> DataFrame:
    """sample, node, percent: subpopulation frequencies, as stacked bars show them."""
    return T.eta_from_f(edges, freq).select("sample", "node", (100 * F.col("eta")).alias("percent"))


def refit(selected: DataFrame, cells: DataFrame) -> DataFrame:
    """tree, size, clone, sample, f, eta for selected clusterings (tree, size, parents, clusters): each clone's reads are pooled
    into one pseudo-variant, clones are renumbered 1, 2, ... as their nodes, and the frequencies are fitted anew."""
    edges = T.partial_parents(T.edges_of(selected, keys=["tree"]), ["tree"])
    live = T.edges_of(selected, keys=["tree"]).select("tree", "node")
    first = selected.select("tree", F.posexplode("clusters").alias("nth", "ids"))
    place = live.join(edges.select("tree", "node", "rank"), ["tree", "node"])
    clone = first.select("tree", (F.col("nth") + 1).alias("rank"), F.explode("ids").alias("member")).join(place, ["tree", "rank"])
    pooled = supervariants(clone.join(cells.withColumnRenamed("node", "member"), "member"), "tree", "rank", "sample")
    vectors = T.parents_of(edges.select("tree", F.col("rank").alias("node"), F.col("parent_rank").alias("parent")), ["tree"])
    fitted = fit_own(vectors, pooled.withColumnRenamed("rank", "node"), ["tree"])
    return selected.select("tree", "size").join(frequencies(fitted, ["tree"]).withColumnRenamed("node", "clone"), "tree")
