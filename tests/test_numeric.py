"""Numeric columns against the standard library and direct sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import functions as A
from arbora.functions import numeric


def column(spark, rows, names, expr):
    return [r[0] for r in spark.createDataFrame(rows, names).select(expr).collect()]


def test_lgamma(spark):
    xs = [0.001, 0.5, 1.0, 1.5, 2.0, 7.3, 40.0, 5500.0, 6e5]
    got = column(spark, [(x,) for x in xs], "x double", A.lgamma(F.col("x")))
    assert all(abs(g - math.lgamma(x)) <= 1e-10 * max(1, abs(g)) for g, x in zip(got, xs))


def test_binomial_mass_sums_to_one(spark):
    rows = [(v, 40) for v in range(41)]
    got = column(spark, rows, "v int, n int", A.log_binom_pmf(F.col("v"), F.col("n"), F.lit(0.3)))
    assert abs(sum(map(math.exp, got)) - 1) < 1e-9


def test_betainc_is_the_binomial_tail(spark):
    rng = random.Random(0)
    rows = [(b, b + rng.randrange(0, 300), rng.random()) for b in range(0, 200, 7)] + [(3, 9, 0.0), (3, 9, 1.0), (0, 0, 0.5), (None, 3, 0.5)]
    got = column(spark, rows, "b int, t int, x double", A.betainc(F.col("b") + 1, F.col("t") - F.col("b") + 1, F.col("x")))
    for (b, t, x), g in zip(rows[:-1], got):
        want = sum(math.comb(t + 1, j) * x**j * (1 - x) ** (t + 1 - j) for j in range(b + 1, t + 2))
        assert abs(g - want) < 1e-9
    assert got[-1] is None


def test_gumbels_below_a_maximum_keep_their_order(spark):
    g = [0.3, 2.0, 1.9999999, -5.0, 2.0]
    got = column(spark, [(x,) for x in g], "g double", A.gumbel_with_maximum(F.col("g"), F.lit(-1.0), F.lit(2.0)))
    assert got[1] == got[4] == -1.0 and got[3] < got[0] < got[2] <= -1.0
    want = -math.log(math.exp(1.0) - math.exp(-2.0) + math.exp(-0.3))
    assert abs(got[0] - want) < 1e-9


def test_uniforms_depend_on_the_key_alone(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    one = {r.k: r.u for r in df.repartition(7).select("k", A.key_uniform(F.col("k")).alias("u")).collect()}
    two = {r.k: r.u for r in df.coalesce(1).select("k", A.key_uniform(F.col("k")).alias("u")).collect()}
    assert one == two and all(0 < u < 1 for u in one.values()) and abs(np.mean(list(one.values())) - 0.5) < 0.05


def test_intervals(spark):
    rows = spark.createDataFrame([(0.2, 50), (0.0, 10), (1.0, 10), (0.5, 0)], "p double, n int")
    low, high = A.wald_interval(F.col("p"), F.col("n"))
    got = rows.select(low.alias("l"), high.alias("h")).collect()
    q = 2.576 * math.sqrt(0.2 * 0.8 / 50)
    assert abs(got[0].l - (0.2 - q)) < 1e-12 and abs(got[0].h - (0.2 + q)) < 1e-12
    assert all(numeric.EPSILON <= r.l <= r.h <= 1 for r in got)
    low, high = A.wilson_interval(F.col("p"), F.col("n"))
    assert rows.select(low.alias("l")).collect()[3].l is None


@pytest.mark.parametrize("b", [0, 5])
def test_safe_divide(spark, b):
    assert column(spark, [(10, b)], "a int, b int", A.safe_divide(F.col("a"), F.col("b"))) == [10 / b if b else 0.0]
