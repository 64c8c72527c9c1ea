"""Incremental read-count roll-ups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_reads(reads: DataFrame) -> DataFrame:
    """node, sample, v, n, omega for a stream (or table) of reads (node, sample, variant): one state row for each cell.

    Write it in update or complete mode; on a table it gives the same counts at once. Reads without node or sample, and those
    whose ``variant`` is null, are left out, as there is nothing to count them by.
    """
    rows = reads.where("node is not null and sample is not null and variant is not null")
    return rows.groupBy("node", "sample").agg(F.count_if("variant").alias("v"), F.count(F.lit(1)).alias("n")).withColumn("omega", F.lit(0.5))
