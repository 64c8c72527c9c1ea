"""Numeric column builders. All but ``betainc`` stay inside whole-stage code generation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Constants of the statistical model.
EPSILON = math.exp(-30)
MIN_VAR_READS = 3
MIN_OMEGA = 1e-3
Z_99 = 2.576
MIN_VARIANCE = 1e-4
LLH_CLIP = 1e-5
PAC_CLIP = 1e-4
ISA_SLACK = 1e-10


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def lgamma(x: Column) -> Column:
    """Log-gamma for x > 0: the argument is shifted by 8, then Stirling's series; about 1e-12 relative."""
    y = x + 8.0
    i2 = 1.0 / (y * y)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / y
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


def log_choose(n: Column, v: Column) -> Column:
    """Log of the binomial coefficient, continuous in v and n."""
    v, n = v.cast("double"), n.cast("double")
    return lgamma(n + 1.0) - lgamma(v + 1.0) - lgamma(n - v + 1.0)


def log_binom_pmf(v: Column, n: Column, p: Column) -> Column:
    """Log of the binomial mass, continuous in v and n; p strictly between 0 and 1."""
    return log_choose(n, v) + v * F.ln(p) + (n - v) * F.ln(1.0 - p)


def wald_interval(p: Column, n: Column, z: float = Z_99) -> tuple[Column, Column]:
    """Low and high end of the Wald interval, kept within [epsilon, 1 - epsilon]; no width where n is 0."""
    width = F.lit(z) * F.sqrt(F.greatest(F.lit(EPSILON), safe_divide(p * (1.0 - p), n)))
    return F.greatest(F.lit(EPSILON), p - width), F.least(F.lit(1 - EPSILON), p + width)


def wilson_interval(p: Column, n: Column, z: float = Z_99) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval; null where n is 0."""
    n = n.cast("double")
    scale = F.try_divide(F.lit(1.0), 1.0 + F.try_divide(F.lit(z * z), n))
    middle = p + F.try_divide(F.lit(z * z), 2.0 * n)
    width = F.lit(z) * F.sqrt(F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z * z), 4.0 * n * n))
    return scale * (middle - width), scale * (middle + width)


def softmax(x: Column, window: WindowSpec) -> Column:
    """exp(x) over its sum in the window, shifted by the largest x."""
    e = F.exp(x - F.max(x).over(window))
    return e / F.sum(e).over(window)


def key_uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 that depends on a string key alone, not on partitions: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))


def gumbel_with_maximum(g: Column, top: Column, largest: Column) -> Column:
    """Gumbels g conditioned on their maximum: ``largest`` becomes ``top``, the rest keep their order below it.

    -log(exp(-top) - exp(-largest) + exp(-g)), written so that nothing overflows and the maximum maps to ``top`` exactly.
    """
    v = top - g + F.ln(-F.expm1(F.least(g - largest, F.lit(-1e-300))))
    shifted = top - F.greatest(v, F.lit(0.0)) - F.log1p(F.exp(-F.abs(v)))
    return F.when(g >= largest, top).otherwise(shifted)


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction, on the side of the mean where it converges fast."""
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    log_beta = (log_gamma(a) + log_gamma(b) - log_gamma(a + b)).astype(float)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (a + b) * y / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 3000):
        for step in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * (d * c)
        if np.abs(d * c - 1).max(initial=0) < 1e-14:
            break
    value = np.exp(a * np.log(y) + b * np.log1p(-y) - log_beta) * h / a
    value = np.where(inside, value, np.where(x <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def _betainc_batch(a: pa.Array, b: pa.Array, x: pa.Array) -> pa.Array:
    a, b, x = (c.to_numpy(zero_copy_only=False).astype(float) for c in (a, b, x))
    gone = np.isnan(a) | np.isnan(b) | np.isnan(x)
    out = np.full(len(a), np.nan)
    if (~gone).any():
        out[~gone] = _betainc(a[~gone], b[~gone], x[~gone])
    return pa.array(out, mask=gone)


def betainc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); null if any argument is. An Arrow kernel: Spark has none."""
    return F.arrow_udf(_betainc_batch, "double")(a.cast("double"), b.cast("double"), x.cast("double"))


def _betainc_lists(a: pa.Array, b: pa.Array, x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())]), pa.int32()), _betainc_batch(a.flatten(), b.flatten(), x.flatten()))


def betainc_arrays(a: str, b: str, x: str) -> Column:
    """``betainc`` of three array columns of equal lengths, without null arrays, element by element."""
    return F.arrow_udf(_betainc_lists, "array<double>")(F.col(a), F.col(b), F.col(x))
