"""Normal distribution as pure column expressions (no Python in the tasks)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The low-order Abramowitz-Stegun polynomials that the screening statistics use.
COARSE_CDF_T = 0.2316419
COARSE_CDF_D = 0.3989423
COARSE_CDF_POLY = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)
COARSE_Q_NUM = (2.515517, 0.802853, 0.010328)
COARSE_Q_DEN = (1.0, 1.432788, 0.189269, 0.001308)

# Hart's rational fit of the normal tail, good to double precision.
HART_NUM = (
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-02,
)
HART_DEN = (
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02,
)

# Acklam's rational fit of the normal quantile.
ACKLAM_A = (
    2.506628277459239e00, -3.066479806614716e01, 1.383577518672690e02,
    -2.759285104469687e02, 2.209460984245205e02, -3.969683028665376e01,
)
ACKLAM_B = (
    1.0, -1.328068155288572e01, 6.680131188771972e01, -1.556989798598866e02,
    1.615858368580409e02, -5.447609879822406e01,
)
ACKLAM_C = (
    2.938163982698783e00, 4.374664141464968e00, -2.549732539343734e00,
    -2.400758277161838e00, -3.223964580411365e-01, -7.784894002430293e-03,
)
ACKLAM_D = (
    1.0, 3.754408661907416e00, 2.445134137142996e00, 3.224671290700398e-01,
    7.784695709041462e-03,
)
ACKLAM_SPLIT = 0.02425


def polynomial(x: Column, coefs: tuple[float, ...]) -> Column:
    """Horner form, coefficients from the constant upwards."""
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def coarse_cdf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(COARSE_CDF_T) * F.abs(x))
    tail = F.lit(COARSE_CDF_D) * F.exp(-x * x / 2.0) * t * polynomial(t, COARSE_CDF_POLY)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def coarse_quantile(p: Column) -> Column:
    t = F.sqrt(F.lit(-2.0) * F.ln(F.when(p < 0.5, p).otherwise(1.0 - p)))
    z = t - polynomial(t, COARSE_Q_NUM) / polynomial(t, COARSE_Q_DEN)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))


def norm_sf_abs(x: Column) -> Column:
    """P(Z > |x|)."""
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    centre = e * polynomial(a, HART_NUM) / polynomial(a, HART_DEN)
    frac = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    far = e / frac / math.sqrt(2 * math.pi)
    return F.when(a < 7.07106781186547, centre).when(a <= 37.0, far).otherwise(F.lit(0.0))


def norm_cdf(x: Column) -> Column:
    return F.when(x > 0, 1.0 - norm_sf_abs(x)).otherwise(norm_sf_abs(x))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi)


def norm_quantile(p: Column) -> Column:
    """Quantile; relative error about 1e-9. NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    mid = q * polynomial(r, ACKLAM_A) / polynomial(r, ACKLAM_B)
    small = F.when(p < 0.5, p).otherwise(1.0 - p)
    s = F.sqrt(F.lit(-2.0) * F.ln(small))
    tail = polynomial(s, ACKLAM_C) / polynomial(s, ACKLAM_D)
    return F.when(
        (p > 0) & (p < 1),
        F.when(small >= ACKLAM_SPLIT, mid).when(p < 0.5, tail).otherwise(-tail),
    )
