"""Two-proportion z-test as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Abramowitz & Stegun, Handbook of Mathematical Functions, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
CONFIDENCE_95 = 1.96
SIGNIFICANCE = 0.05


def erf_of_magnitude(x: Column) -> Column:
    """erf(x) for x >= 0, absolute error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    polynomial = reduce(lambda acc, a: acc * t + F.lit(a), reversed(ERF_A), F.lit(0.0))
    return F.lit(1.0) - polynomial * t * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) = 1 - erf(|z| / sqrt 2)."""
    return F.lit(1.0) - erf_of_magnitude(F.abs(z) / F.sqrt(F.lit(2.0)))


def two_proportions(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> dict[str, Column]:
    """Statistics of rate a against rate b; NULL when a group is empty."""
    share = lambda hits, n: F.try_divide(hits.cast("double"), n.cast("double"))
    p_a, p_b, pooled = share(hits_a, n_a), share(hits_b, n_b), share(hits_a + hits_b, n_a + n_b)
    variance = pooled * (F.lit(1.0) - pooled) * (share(F.lit(1), n_a) + share(F.lit(1), n_b))
    z = F.when(variance > 0, (p_a - p_b) / F.sqrt(variance)).when(variance <= 0, 0.0)
    spread = F.sqrt(share(p_a * (F.lit(1.0) - p_a), n_a) + share(p_b * (F.lit(1.0) - p_b), n_b))
    return {
        "rate_a": p_a,
        "rate_b": p_b,
        "lift_pct": F.when(p_b > 0, (p_a - p_b) / p_b * 100.0).when(p_b.isNotNull() & p_a.isNotNull(), 0.0),
        "z": z,
        "p_value": two_sided_p(z),
        "ci_low": (p_a - p_b) - CONFIDENCE_95 * spread,
        "ci_high": (p_a - p_b) + CONFIDENCE_95 * spread,
        "cohens_h": F.abs(2.0 * F.asin(F.sqrt(p_a)) - 2.0 * F.asin(F.sqrt(p_b))),
    }
