"""Ranks over whole tables without a task that holds the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.plans import stash

#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
_PLACE_BITS = 33
#: Rows of one block of running sums.
_SUM_ROWS = 1 << 20


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name`` (long): 1, 2, 3, ... in the order of ``order``, over all rows.

    Rows are dealt into ranges of the order and sorted there; a range's first rank is one more than the number of rows in the
    ranges before it. Only those numbers, one for each partition, pass through the driver. Rows that ``order`` doesn't tell
    apart get ranks in any order, and stay in one range: give it enough columns. An empty table gives an empty table. The rows
    are written to shared storage once.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stash(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges", release=False)
    part = F.shiftrightunsigned("_at", _PLACE_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, before = [], 0
    for p in sorted(counts):
        first.append((p, before))
        before += counts[p]
    starts = F.broadcast(spark.createDataFrame(first, "_part int, _before long"))
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return dealt.withColumn("_part", part).join(starts, "_part").select(*rows.columns, (F.col("_before") + place).alias(name))


def neighbours(rows: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``next``: a struct of ``columns`` of the row that follows in the order, null on the last row.

    Built on ``global_rank``: each row meets the one of the next rank, an equi-join on numbers that are all different.
    """
    ranked = global_rank(rows, order, "_rank")
    after = ranked.select((F.col("_rank") - 1).alias("_rank"), F.struct(*columns).alias("next"))
    return ranked.join(after, "_rank", "left").drop("_rank")


def running_sums(rows: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (whole numbers) over all rows up to this one in the order.

    As ``global_rank``, with the sums of the ranges in place of their sizes.
    """
    spark = rows.sparkSession
    ranked = global_rank(rows, order, "_place")
    bounds = ranked.withColumn("_part", F.floor((F.col("_place") - 1) / _SUM_ROWS))
    bounds = stash(bounds, "blocks", release=False)
    sums = {r["_part"]: r["s"] for r in bounds.groupBy("_part").agg(F.sum(value).alias("s")).collect()}  # one number for each block
    before, first = 0, []
    for p in sorted(sums):
        first.append((p, before))
        before += sums[p]
    starts = F.broadcast(spark.createDataFrame(first, "_part long, _before long"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return bounds.join(starts, "_part").select(*rows.columns, (F.col("_before") + own).alias(name))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name of ``shares``, that quantile of ``value``, interpolated between its neighbours; nulls don't count.

    Equal values are one row with a count, so a value that fills a third of the table is one row. Running counts in the order of
    keys and values give each value the ranks that it holds; a key's quantile lies at one or two ranks. No task holds a key.
    """
    keys = list(keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = stash(running_sums(counted, [*map(F.asc, keys), F.asc(value)], "_n", "_end"), "ranks", release=False)
    size = summed.groupBy(*keys).agg(F.min(F.col("_end") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    at = summed.join(size, keys).withColumns({"_end": F.col("_end") - F.col("_start"), "_rank": F.col("_end") - F.col("_start") - F.col("_n")})
    holds = lambda rank: (F.col("_rank") <= rank) & (rank < F.col("_end"))
    out = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        near = lambda rank: F.max(F.when(holds(rank), F.col(value).cast("double")))
        part = F.max(place - F.floor(place))
        out.append((near(low) + (near(high) - near(low)) * part).alias(name))
    return at.groupBy(*keys).agg(*out)
