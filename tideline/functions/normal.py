"""The normal distribution as SQL expressions, which Spark and other engines evaluate alike; Spark has no erf.

``cdf_sql`` and ``inverse_sql`` take an expression and give one; both are exact to about 1e-15 (published rational approximations, the
quantile with one step of Halley's method on top).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximations, highest power first.
CDF_UPPER = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_LOWER = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
MIDDLE_UPPER = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
MIDDLE_LOWER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_UPPER = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_LOWER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL, ROOT = 0.02425, 2.5066282746310002


def _polynomial(coefficients: list[float], x: str) -> str:
    out = f"{coefficients[0]:.17e}"
    for k in coefficients[1:]:
        out = f"({out} * {x} + {k:.17e})"
    return out


def cdf_sql(x: str) -> str:
    """P(Z <= x)."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2e0) * {_polynomial(CDF_UPPER, a)} / {_polynomial(CDF_LOWER, a)}"
    far = f"exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 6.5e-1))))) / {ROOT:.17e}"
    below = f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0e0 THEN 1e0 - ({below}) ELSE ({below}) END)"


def _start_sql(p: str) -> str:
    """The quantile to about 1e-9."""
    q = lambda e: f"sqrt(-2e0 * ln({e}))"
    low, high = q(p), q(f"(1e0 - {p})")
    middle = f"({p} - 5e-1)"
    square = f"({middle} * {middle})"
    return (
        f"(CASE WHEN NOT ({p} > 0e0 AND {p} < 1e0) THEN NULL WHEN {p} < {TAIL} THEN {_polynomial(TAIL_UPPER, low)} / {_polynomial(TAIL_LOWER, low)} "
        f"WHEN {p} > {1 - TAIL} THEN -({_polynomial(TAIL_UPPER, high)} / {_polynomial(TAIL_LOWER, high)}) "
        f"ELSE {middle} * {_polynomial(MIDDLE_UPPER, square)} / {_polynomial(MIDDLE_LOWER, square)} END)"
    )


def _step_sql(x: str, p: str) -> str:
    """``x`` after one step towards the quantile of ``p``."""
    error = f"(({cdf_sql(x)} - {p}) * {ROOT:.17e} * exp({x} * {x} / 2e0))"
    return f"({x} - {error} / (1e0 + {x} * {error} / 2e0))"


def inverse_sql(p: str) -> str:
    """The z with P(Z <= z) = p, null unless 0 < p < 1."""
    return _step_sql(_start_sql(p), p)


def cdf(x: str) -> Column:
    return F.expr(cdf_sql(x))


def inverse(p: str) -> Column:
    """As :func:`inverse_sql`; the first approximation is an element of an array, so it is computed once."""
    return F.expr(f"transform(array({_start_sql(p)}), tl_x -> {_step_sql('tl_x', p)})[0]")
