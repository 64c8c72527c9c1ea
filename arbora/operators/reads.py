"""Read-count algebra: supervariants, implied frequencies, weights, intervals and likelihoods.

Inputs are long tables with one row for each node (or mutation) and sample: v variant reads, n total reads, omega the
probability that a read of a mutated cell is variant. Each operator is a projection or one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import EPSILON, clip, log_binom_pmf, safe_divide, wald_interval, wilson_interval
from arbora.functions.numeric import LLH_CLIP, MIN_OMEGA, MIN_VAR_READS, MIN_VARIANCE, PAC_CLIP
from arbora.operators.rank import global_rank


def supervariants(members: DataFrame, *keys: str) -> DataFrame:
    """keys, v, n, omega: one pseudo-variant for each cluster and sample; n = sum 2 n omega (whole reads), v at most n."""
    n = F.floor(F.sum(2.0 * F.col("n") * F.col("omega")))
    return members.groupBy(*keys).agg(F.least(F.sum("v"), n).cast("long").alias("v"), n.cast("long").alias("n")).withColumn("omega", F.lit(0.5))


def f_hat(cells: DataFrame) -> DataFrame:
    """node, sample, f: v / (omega n) within [0, 1], 0 without reads; the root, node 0, has frequency 1."""
    rows = cells.select("node", "sample", clip(safe_divide(F.col("v"), F.col("omega") * F.col("n")), 0.0, 1.0).alias("f"))
    return rows.unionByName(cells.select(F.lit(0).cast(cells.schema["node"].dataType).alias("node"), "sample", F.lit(1.0).alias("f")).distinct())


def variance_weight(v: Column, n: Column, omega: Column) -> Column:
    t = n + 2.0
    return F.greatest(F.lit(MIN_VARIANCE), (v + 1.0) * (1.0 - (v + 1.0) / t) / F.pow(t * omega, 2))


def var_weights(cells: DataFrame) -> DataFrame:
    """node, sample, w: the variance of the implied frequency, with one read of each kind added."""
    return cells.select("node", "sample", variance_weight(F.col("v"), F.col("n"), F.col("omega")).alias("w"))


def fsum_order(cells: DataFrame) -> DataFrame:
    """node, weight, rank: nodes by their summed implied frequency (not clipped), largest first, ties to the smaller node."""
    rows = cells.groupBy("node").agg(F.sum(safe_divide(F.col("v"), F.col("n") * F.col("omega"))).alias("weight"))
    return global_rank(rows, [F.desc(F.round("weight", 9)), F.asc("node")]).withColumn("rank", F.col("rank").cast("int"))


def random_order(cells: DataFrame, seed: int, instance: int = 0) -> DataFrame:
    """node, rank: a random order that depends on seed, instance and node alone."""
    from arbora.functions import key_uniform

    u = key_uniform(F.concat_ws("|", F.lit(str(seed)), F.lit(str(instance)), F.col("node").cast("string")))
    rows = cells.select("node").distinct().withColumn("_luck", u)
    return global_rank(rows, [F.asc("_luck"), F.asc("node")]).select("node", F.col("rank").cast("int").alias("rank"))


def depth_rescale(cells: DataFrame) -> DataFrame:
    """node, sample, v, n: every row's depth set to its sample's mean, v in proportion, both rounded."""
    mean = cells.groupBy("sample").agg(F.avg("n").alias("mean"))
    rows = cells.join(mean, "sample")
    return rows.select("node", "sample", F.round(safe_divide(F.col("v") * F.col("mean"), F.col("n"))).cast("long").alias("v"), F.round("mean").cast("long").alias("n"))


def cell_llh(cells: DataFrame, freq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, sample, llh: log mass of the reads under frequencies (keys, node, sample, f), clipped away from 0 and 1."""
    p = clip(F.col("omega") * F.col("f"), LLH_CLIP, 1 - LLH_CLIP)
    return cells.join(freq, ["node", "sample"]).select(*keys, "node", "sample", log_binom_pmf(F.col("v"), F.col("n"), p).alias("llh"))


def llh_per_sample(llh: DataFrame) -> DataFrame:
    """sample, nllh: minus the mean over nodes, the root counted as one of them."""
    return llh.groupBy("sample").agg((-F.sum("llh") / (F.count(F.lit(1)) + 1)).alias("nllh"))


def valid_samples(pairs: DataFrame) -> DataFrame:
    """``pairs`` (v1, omega1, v2, omega2) with u_parents_v and valid: which samples can order two nodes."""
    seen, lost = F.col("v1") > MIN_VAR_READS, F.col("v2") <= MIN_VAR_READS
    parents = seen & lost
    return pairs.withColumns({"u_parents_v": parents, "valid": ~(~seen | (F.col("omega1") < MIN_OMEGA) | (F.col("omega2") < MIN_OMEGA) | parents)})


def intervals(cells: DataFrame, kind: str = "wald") -> DataFrame:
    """node, sample, low, high: a 99 % interval of v / n."""
    low, high = {"wald": wald_interval, "wilson": wilson_interval}[kind](safe_divide(F.col("v"), F.col("n")), F.col("n"))
    return cells.select("node", "sample", low.alias("low"), high.alias("high"))


def max_log_sum(x: Column) -> Column:
    """Aggregate: sum of logs, each value raised to epsilon first."""
    return F.sum(F.ln(F.greatest(x, F.lit(EPSILON))))


def vaf_residual(cells: DataFrame, freq: DataFrame) -> DataFrame:
    """node, sample, residual: |(v + 1) / (n + 2) - omega f|."""
    return cells.join(freq, ["node", "sample"]).select("node", "sample", F.abs((F.col("v") + 1.0) / (F.col("n") + 2.0) - F.col("omega") * F.col("f")).alias("residual"))


def vaf_over_omega(cells: DataFrame) -> DataFrame:
    """node, sample, f: min(1, v / (n omega)), as drawn beside the fitted frequencies."""
    return cells.select("node", "sample", F.least(F.lit(1.0), safe_divide(F.col("v"), F.col("n") * F.col("omega"))).alias("f"))


def cluster_reads(members: DataFrame) -> DataFrame:
    """cluster rows with v = v' + 1 and n = n' + 2 for n' = 2 n omega, v' = min(v, n'), omega one half, and f clipped."""
    n = 2.0 * F.col("n") * F.col("omega")
    return members.withColumns({"v": F.least(F.col("v").cast("double"), n) + 1.0, "n": n + 2.0, "omega": F.lit(0.5), "f": clip(F.col("f"), PAC_CLIP, 1 - PAC_CLIP)})


def cluster_llh(members: DataFrame) -> DataFrame:
    """cluster, llh for members (cluster, mut, sample, v, n, omega, f): each cluster's reads under its read-weighted frequency."""
    rows = cluster_reads(members)
    p = rows.groupBy("cluster", "sample").agg((F.sum(F.col("omega") * F.col("f") * F.col("n")) / F.sum("n")).alias("p"))
    return rows.join(p, ["cluster", "sample"]).groupBy("cluster").agg(F.sum(log_binom_pmf(F.col("v"), F.col("n"), F.col("p"))).alias("llh"))
