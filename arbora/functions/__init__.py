"""Column expressions and small Arrow kernels for read-count statistics."""

from arbora.functions.numeric import (
    EPSILON,
    betainc,
    clip,
    gumbel,
    gumbel_with_maximum,
    key_uniform,
    lgamma,
    log_binom_pmf,
    safe_divide,
    softmax,
    wald_interval,
    wilson_interval,
)

__all__ = ["EPSILON", "betainc", "clip", "gumbel", "gumbel_with_maximum", "key_uniform", "lgamma", "log_binom_pmf", "safe_divide", "softmax", "wald_interval", "wilson_interval"]
