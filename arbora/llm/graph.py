"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans import drop, stash

EDGE = "a long, b long"
#: Joins of up to so many links are left to Spark, which may broadcast one side. A broadcast is built in the driver, and Spark
#: chooses it by bytes of files and shuffles, of which a hash table takes several times as many; so joins of more links are merged.
FEW = 100_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for each node that is not the smallest, for one batch of links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])


def thinned(edges: DataFrame) -> DataFrame:
    """The links a, b replaced, batch by batch, by a forest with the same components: dense groups shrink to their nodes."""
    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forests, EDGE)


def _with_minima(links: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """The links u, v with m, the smallest of u and its neighbours v.

    With a list ``held`` the join is merged; both its sides are written before, so that Spark can split a hub's rows, and added to
    the list. Without one, Spark chooses.
    """
    if held is not None:
        held.append(links := stash(links, "links"))
    low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if held is not None:
        held.append(low := stash(low, "minima"))
        low = low.hint("merge")
    return links.join(low, "u")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component: for every node of a link table (a, b), the smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), whose number of rounds grows with the logarithm
    of the component size. Each round is two joins against per-node minima (partial aggregates, so a hub does not meet in one
    task) and is written to shared storage; over ``FEW`` links are never broadcast. Nodes without links are not returned. Links with a null end and loops are ignored.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null and a <> b")
    e = stash(thinned(edges).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, few = None, e.count() <= FEW
    for _ in range(max_rounds):
        held = None if few else []
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minima(both, held).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_minima(large, held).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e, before = stash(small.where("u <> v").distinct(), "edges"), e
        drop(spark, before, *(held or ()))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
