"""Euler tours of rooted trees by list ranking: intervals for subtrees, whatever the height.

A tour enters and leaves every node once, children by number. Its links are known for each node from its siblings alone; their
order comes from pointer jumping, so a tree of n nodes takes about log2(2 n) rounds, each an equi-join on keys that are all
different, whether it is a star or a chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.plans import drop, stash


def jump(pointers: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """keys, item, end, carry: where the chain of pointers from each item ends, and what it gathers on the way.

    ``pointers``: keys, item, to (null at the end of a chain), carry (numbers that the step from the item to ``to`` adds, or at
    the end of a chain its own). Every round doubles the reach of the items that haven't arrived; a round is one join and is
    written to shared storage. A circle of pointers is an error.
    """
    spark, keys, carry = pointers.sparkSession, list(keys), list(carry)
    rows = pointers.select(*keys, "item", "to", F.coalesce("to", "item").alias("end"), *carry)
    rows = stash(rows, "pointers", release=False)
    most = rows.count()
    reach = 1
    while not rows.where("to is not null").isEmpty():
        if reach > 2 * most:
            raise ValueError("pointers run in a circle")
        ahead = rows.select(*keys, F.col("item").alias("to"), F.col("to").alias("_to"), F.col("end").alias("_end"), *[F.col(c).alias(f"_{c}") for c in carry])
        moved = rows.where("to is not null").join(ahead, [*keys, "to"]).select(*keys, "item", F.col("_to").alias("to"), F.col("_end").alias("end"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in carry])
        further = stash(moved.unionByName(rows.where("to is null")), "pointers", release=False)
        drop(spark, rows)
        rows, reach = further, reach * 2
    return rows.select(*keys, "item", "end", *carry)


def tour(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, parent (null for the root, node 0), depth, enter, size, first, opens, closes.

    ``edges``: keys, node, parent, each node once. ``enter`` numbers the nodes 0, 1, 2, ... as the tour meets them, so a node's
    subtree, itself included, is ``enter`` to ``enter + size - 1``. ``first``: whether it is its parent's first child. ``opens``
    and ``closes`` are its two places among all places of the tour.
    """
    keys = list(keys)
    root = edges.select(*keys).distinct() if keys else edges.limit(1)
    nodes = edges.select(*keys, F.col("node").cast("long"), F.col("parent").cast("long").alias("parent")).unionByName(root.select(*keys, F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent")))
    own = Window.partitionBy(*keys, "parent").orderBy("node")
    child = edges.groupBy(*keys, F.col("parent").cast("long").alias("node")).agg(F.min("node").cast("long").alias("child"))
    rows = nodes.withColumns({"sibling": F.lead("node").over(own), "first": F.row_number().over(own) == 1}).join(child, [*keys, "node"], "left")
    rows = stash(rows, "tour_nodes", release=False)
    enter, leave = 2 * F.col("node"), 2 * F.col("node") + 1
    after = F.when(F.col("sibling").isNotNull(), 2 * F.col("sibling")).otherwise(2 * F.col("parent") + 1)
    opening = F.struct(enter.alias("item"), F.coalesce(2 * F.col("child"), leave).alias("to"), F.lit(1).cast("long").alias("entered"))
    closing = F.struct(leave.alias("item"), after.alias("to"), F.lit(0).cast("long").alias("entered"))
    links = rows.select(*keys, F.explode(F.array(opening, closing)).alias("x")).select(*keys, "x.*", F.lit(1).cast("long").alias("places"))
    ranked = jump(links, keys, ["entered", "places"])
    ends = ranked.groupBy(*keys, F.shiftright("item", 1).alias("node")).agg(
        F.max(F.when(F.col("item") % 2 == 0, F.struct("entered", "places"))).alias("o"), F.max(F.when(F.col("item") % 2 == 1, F.struct("entered", "places"))).alias("c")
    )
    total = ranked.where("item = 0").select(*keys, F.col("entered").alias("n"))
    all_of = ends.join(total, keys) if keys else ends.withColumn("n", F.lit(total.first()["n"] if not edges.isEmpty() else 0))
    kind = edges.schema["node"].dataType
    numbered = all_of.select(
        *keys, "node", (2 * F.col("o.entered") - F.col("o.places")).alias("_less"), (F.col("n") - F.col("o.entered")).alias("enter"), (F.col("o.entered") - F.col("c.entered")).alias("size"),
        (2 * F.col("n") - F.col("o.places")).alias("opens"), (2 * F.col("n") - F.col("c.places")).alias("closes"),
    )
    out = rows.select(*keys, "node", "parent", "first").join(numbered, [*keys, "node"])
    return out.select(*keys, F.col("node").cast(kind).alias("node"), F.col("parent").cast(kind).alias("parent"), (-F.col("_less")).cast("int").alias("depth"), "enter", "size", "first", "opens", "closes")


def is_ancestor(above: str, below: str):
    """Whether one node of a tour (a struct column or the alias of a table) is an ancestor of another of its tree, or is it."""
    return F.col(f"{below}.enter").between(F.col(f"{above}.enter"), F.col(f"{above}.enter") + F.col(f"{above}.size") - 1)


def subtree_sums(toured: DataFrame, values: DataFrame, value: str, keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """keys, node, by, total: the sum of ``value`` (keys, node, by, value) over each node's subtree.

    Running sums in the order of the tour; a subtree is the difference of two of them. A node must have one value for each
    ``by`` of its tree. The running sums of one tree and ``by`` are one task's.
    """
    keys, by = list(keys), list(by)
    so_far = F.sum(value).over(Window.partitionBy(*keys, *by).orderBy("enter").rowsBetween(Window.unboundedPreceding, 0))
    rows = toured.select(*keys, "node", "enter", "size").join(values, [*keys, "node"])
    rows = stash(rows.select(*keys, *by, "node", "enter", "size", F.col(value).alias("_own"), so_far.alias("_sum")), "running_sums", release=False)
    last = rows.select(*keys, *by, F.col("enter").alias("_last"), F.col("_sum").alias("_end"))
    out = rows.withColumn("_last", F.col("enter") + F.col("size") - 1).join(last, [*keys, *by, "_last"])
    return out.select(*keys, "node", *by, (F.col("_end") - F.col("_sum") + F.col("_own")).alias("total"))
