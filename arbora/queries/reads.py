"""Read-count queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import betainc
from arbora.operators import reads as R
from arbora.sources.views import cells, mut_cells, with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


F_HAT_SQL = """, f_hat AS (SELECT node, sample, CASE WHEN omega * n = 0 THEN 0.0 ELSE least(greatest(v / (omega * n), 0.0), 1.0) END AS f FROM cells
  UNION ALL SELECT DISTINCT 0, sample, 1.0 FROM cells)"""
LLH_SQL = """, llh AS (SELECT node, sample, lgamma(n + 1.0) - lgamma(v + 1.0) - lgamma(n - v + 1.0) + v * ln(p) + (n - v) * ln(1.0 - p) AS llh
  FROM (SELECT c.node, c.sample, v, n, least(greatest(omega * f, 1e-5), 1 - 1e-5) AS p FROM cells c JOIN f_hat USING (node, sample)))"""


@query(with_views("cells", " SELECT * FROM cells"))
def read_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@query(with_views("mut_cells", " SELECT node, sample, CAST(least(sum(v), floor(sum(2.0 * n * omega))) AS BIGINT) AS v, CAST(floor(sum(2.0 * n * omega)) AS BIGINT) AS n, CAST(0.5 AS DOUBLE) AS omega FROM mut_cells GROUP BY node, sample"))
def supervariants(spark: SparkSession, d: str) -> DataFrame:
    return R.supervariants(mut_cells(spark, d), "node", "sample")


@query(with_views("cells", F_HAT_SQL + " SELECT node, sample, round(f, 6) + 0.0 AS f FROM f_hat"))
def f_hat(spark: SparkSession, d: str) -> DataFrame:
    return R.f_hat(cells(spark, d)).withColumn("f", r6("f"))


@query(with_views("cells", " SELECT node, sample, round(greatest(1e-4, (v + 1.0) * (1.0 - (v + 1.0) / (n + 2.0)) / pow((n + 2.0) * omega, 2)), 6) + 0.0 AS w FROM cells"))
def var_weights(spark: SparkSession, d: str) -> DataFrame:
    return R.var_weights(cells(spark, d)).withColumn("w", r6("w"))


@query(with_views("cells", " SELECT node, round(weight, 6) + 0.0 AS weight, CAST(row_number() OVER (ORDER BY round(weight, 9) DESC, node) AS INT) AS rank FROM (SELECT node, sum(v / (n * omega)) AS weight FROM cells GROUP BY node)"))
def fsum_order(spark: SparkSession, d: str) -> DataFrame:
    return R.fsum_order(cells(spark, d)).withColumn("weight", r6("weight"))


@query(with_views("cells", ", m AS (SELECT sample, avg(n) AS mean FROM cells GROUP BY sample) SELECT node, sample, CAST(round(v * mean / n) AS BIGINT) AS v, CAST(round(mean) AS BIGINT) AS n FROM cells JOIN m USING (sample)"))
def depth_rescale(spark: SparkSession, d: str) -> DataFrame:
    return R.depth_rescale(cells(spark, d))


@query(with_views("cells", F_HAT_SQL + LLH_SQL + " SELECT node, sample, round(llh, 6) + 0.0 AS llh FROM llh"))
def calc_llh(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return R.cell_llh(c, R.f_hat(c)).withColumn("llh", r6("llh"))


@query(with_views("cells", F_HAT_SQL + LLH_SQL + " SELECT round(sum(llh), 6) + 0.0 AS llh, count(*) AS n_cells FROM llh"))
def tree_llh(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return R.cell_llh(c, R.f_hat(c)).agg(r6(F.sum("llh")).alias("llh"), F.count(F.lit(1)).alias("n_cells"))


@query(with_views("cells", F_HAT_SQL + LLH_SQL + " SELECT sample, round(-sum(llh) / (count(*) + 1), 6) + 0.0 AS nllh FROM llh GROUP BY sample"))
def llh_per_sample(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return R.llh_per_sample(R.cell_llh(c, R.f_hat(c))).withColumn("nllh", r6("nllh"))


@query(
    with_views(
        "cells",
        """ SELECT a.node AS u, b.node AS w, a.sample, a.v > 3 AND b.v <= 3 AS u_parents_v,
  NOT (a.v <= 3 OR a.omega < 1e-3 OR b.omega < 1e-3 OR (a.v > 3 AND b.v <= 3)) AS valid FROM cells a JOIN cells b ON a.sample = b.sample AND a.node <> b.node""",
    )
)
def valid_samples(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    a = c.select(F.col("node").alias("u"), "sample", F.col("v").alias("v1"), F.col("omega").alias("omega1"))
    b = c.select(F.col("node").alias("w"), "sample", F.col("v").alias("v2"), F.col("omega").alias("omega2"))
    return R.valid_samples(a.join(b, "sample").where("u <> w")).select("u", "w", "sample", "u_parents_v", "valid")


@query(
    with_views(
        "cells",
        """ SELECT node, sample, round(greatest(exp(-30), p - q), 6) + 0.0 AS low, round(least(1 - exp(-30), p + q), 6) + 0.0 AS high
  FROM (SELECT node, sample, p, 2.576 * sqrt(greatest(exp(-30), p * (1 - p) / n)) AS q FROM (SELECT node, sample, n, v / n AS p FROM cells))""",
    )
)
def wald_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.intervals(cells(spark, d), "wald").withColumns({"low": r6("low"), "high": r6("high")})


@query(
    with_views(
        "cells",
        """ SELECT node, sample, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) + 0.0 AS low,
  round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) + 0.0 AS high
  FROM (SELECT node, sample, n, v / n AS p, 2.576::DOUBLE AS z FROM cells)""",
    )
)
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.intervals(cells(spark, d), "wilson").withColumns({"low": r6("low"), "high": r6("high")})


@query(
    with_views(
        "cells",
        """, q AS (SELECT a.node AS u, b.node AS w, a.sample, a.v, a.n, 0.5 * least(1.0, b.v / (b.omega * b.n)) AS x FROM cells a JOIN cells b ON a.sample = b.sample AND a.node <> b.node),
t AS (SELECT u, w, sample, n, x, unnest(range(v + 1, n + 2)) AS j FROM q WHERE x > 0 AND x < 1),
s AS (SELECT u, w, sample, sum(exp(lgamma(n + 2.0) - lgamma(j + 1.0) - lgamma(n - j + 2.0) + j * ln(x) + (n + 1 - j) * ln(1 - x))) AS p FROM t GROUP BY ALL)
SELECT q.u, q.w, q.sample, round(CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 ELSE p END, 6) + 0.0 AS p FROM q LEFT JOIN s USING (u, w, sample)""",
    )
)
def betainc_tail(spark: SparkSession, d: str) -> DataFrame:
    """The chance that node u's frequency is below that implied for w, for all ordered pairs."""
    c = cells(spark, d)
    b = c.select(F.col("node").alias("w"), "sample", (F.lit(0.5) * F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n")))).alias("x"))
    rows = c.select(F.col("node").alias("u"), "sample", "v", "n").join(b, "sample").where("u <> w")
    return rows.select("u", "w", "sample", r6(betainc(F.col("v") + 1, F.col("n") - F.col("v") + 1, F.col("x"))).alias("p"))


@query(with_views("cells", F_HAT_SQL + " SELECT node, sample, round(abs((v + 1.0) / (n + 2.0) - omega * f), 6) + 0.0 AS residual FROM cells JOIN f_hat USING (node, sample)"))
def vaf_residual(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return R.vaf_residual(c, R.f_hat(c)).withColumn("residual", r6("residual"))
