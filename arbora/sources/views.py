"""Phylogeny inputs derived from the driver's tables: read cells, memberships, trees and candidate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each read: part key, node (the brand's number), sample (the supplier's region), whether it is variant."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("node"))
    place = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place.select("s_suppkey", F.col("n_regionkey").cast("int").alias("sample")), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("p_partkey", "node", "sample", (F.col("l_returnflag") == "R").alias("variant"))


def _counted(reads: DataFrame, *keys: str) -> DataFrame:
    return reads.groupBy(*keys).agg(F.count_if("variant").alias("v"), F.count(F.lit(1)).alias("n")).withColumn("omega", F.lit(0.5))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, sample, v, n, omega: variant and total reads of 25 nodes in 5 samples."""
    return _counted(_reads(spark, sf_dir), "node", "sample")


def mut_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mut, node, sample, v, n, omega: the same reads by mutation, two mutations for each node."""
    mut = (F.col("node") * 2 + F.pmod(F.col("p_partkey"), F.lit(2)).cast("int") - 2).alias("mut")
    return _counted(_reads(spark, sf_dir).select(mut, "node", "sample", "variant"), "mut", "node", "sample")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 9).cast("int").alias("node")).distinct()


def tree_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent: a branching tree under root 0."""
    return nodes(spark, sf_dir).select("node", F.floor(F.col("node") / 2).cast("int").alias("parent"))


def tree_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent: five linear lineages."""
    return nodes(spark, sf_dir).select("node", F.when(F.col("node") % 5 == 1, 0).otherwise(F.col("node") - 1).cast("int").alias("parent"))


def tree_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, node, parent: eight sampled trees, four distinct ones, each found twice."""
    n = F.col("node")
    kinds = [F.floor(n / 2), F.floor(n / 3), F.when(n % 5 == 1, 0).otherwise(n - 1), F.lit(0)]
    rows = nodes(spark, sf_dir).select("node", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    parent = F.element_at(F.array(*[k.cast("int") for k in kinds]), (F.col("t") % 4 + 1).cast("int"))
    return rows.select("t", "node", parent.alias("parent"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch, i, event_type, value: candidate actions of four branches with their scores."""
    e = table(spark, sf_dir, "events")
    return e.select(F.pmod("event_id", F.lit(4)).cast("int").alias("branch"), F.col("event_id").cast("int").alias("i"), "event_type", "value")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: vectors as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


# The same views as SQL, for the queries' twins.
SQL = {
    "cells": """cells AS (SELECT CAST(substr(p_brand, 7) AS INT) AS node, CAST(n_regionkey AS INT) AS sample,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS v, count(*) AS n, CAST(0.5 AS DOUBLE) AS omega
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
    "mut_cells": """mut_cells AS (SELECT CAST(substr(p_brand, 7) AS INT) * 2 + CAST(p_partkey % 2 AS INT) - 2 AS mut, CAST(substr(p_brand, 7) AS INT) AS node,
  CAST(n_regionkey AS INT) AS sample, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS v, count(*) AS n, CAST(0.5 AS DOUBLE) AS omega
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "nodes": "nodes AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS node FROM part)",
    "tree_heap": "tree_heap AS (SELECT node, CAST(floor(node / 2) AS INT) AS parent FROM nodes)",
    "tree_chain": "tree_chain AS (SELECT node, CAST(CASE WHEN node % 5 = 1 THEN 0 ELSE node - 1 END AS INT) AS parent FROM nodes)",
    "tree_set": """tree_set AS (SELECT t.t, node, CAST(CASE t.t % 4 WHEN 0 THEN floor(node / 2) WHEN 1 THEN floor(node / 3)
  WHEN 2 THEN (CASE WHEN node % 5 = 1 THEN 0 ELSE node - 1 END) ELSE 0 END AS INT) AS parent
  FROM nodes CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) t(t))""",
    "actions": "actions AS (SELECT CAST(event_id % 4 AS INT) AS branch, CAST(event_id AS INT) AS i, event_type, value FROM events)",
    "vectors": "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
}


def with_views(names: str, query: str, recursive: bool = False) -> str:
    """A SQL query with the named views, in this order, before it."""
    needs = [n for n in names.split()]
    if any(n in needs for n in ("tree_heap", "tree_chain", "tree_set")) and "nodes" not in needs:
        needs.insert(0, "nodes")
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in needs) + query
