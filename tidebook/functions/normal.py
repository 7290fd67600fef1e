"""The normal distribution as column expressions, and the same as SQL text of DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the quantile (coefficients of falling powers), and where its branches meet.
MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# Hart's rational approximation of the distribution function, and where its continued fraction takes over.
HART_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_END = 7.07106781186547


def _polynomial(factors: tuple[float, ...], x):
    out = factors[0]
    for f in factors[1:]:
        out = out * x + f
    return out


def cdf(z: Column) -> Column:
    """The chance of a value of at most z, to about 1e-15; null of null, NaN of NaN."""
    y = F.abs(z)
    near = F.exp(-y * y / 2) * _polynomial(HART_OVER, y) / _polynomial(HART_UNDER, y)
    far = F.exp(-y * y / 2) / (y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))) / math.sqrt(2 * math.pi)
    beyond = F.when(y < HART_END, near).when(y < 37, far).otherwise(0.0)
    return F.when(F.isnan(z), z).when(z > 0, 1 - beyond).when(z.isNotNull(), beyond)


def quantile(p: Column) -> Column:
    """The z that a value exceeds with chance 1 - p; null outside 0 < p < 1.

    Three branches of a rational approximation (to 1.2e-9), then one step of Halley's method with cdf().
    """
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(TAIL_OVER, low) / _polynomial(TAIL_UNDER, low)
    q = p - 0.5
    middle = _polynomial(MIDDLE_OVER, q * q) * q / _polynomial(MIDDLE_UNDER, q * q)
    first = F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle)

    def refined(z: Column) -> Column:
        u = (cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
        return z - u / (1 + z * u / 2)

    one = F.transform(F.array(first), refined)[0]  # first is worked out once
    return F.when((p > 0) & (p < 1), one)


def _horner(factors: tuple[float, ...], x: str) -> str:
    out = f"{factors[0]!r}::DOUBLE"
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r}::DOUBLE)"
    return out


#: cdf and quantile as macros, to be put before a query.
CDF_SQL = f"""(CASE WHEN {{z}} > 0 THEN 1 ELSE 0 END + CASE WHEN {{z}} > 0 THEN -1 ELSE 1 END * CASE WHEN abs({{z}}) < {HART_END} THEN exp(-({{z}}) * ({{z}}) / 2) * {_horner(HART_OVER, "abs({z})")} / {_horner(HART_UNDER, "abs({z})")}
 WHEN abs({{z}}) < 37 THEN exp(-({{z}}) * ({{z}}) / 2) / (abs({{z}}) + 1 / (abs({{z}}) + 2 / (abs({{z}}) + 3 / (abs({{z}}) + 4 / (abs({{z}}) + 0.65))))) / sqrt(2 * pi()) ELSE 0 END)"""
FIRST_SQL = f"""CASE WHEN {{p}} < {TAIL} THEN 1 WHEN {{p}} > 1 - {TAIL} THEN -1 ELSE 0 END * {_horner(TAIL_OVER, "sqrt(-2 * ln(least({p}, 1 - {p})))")} / {_horner(TAIL_UNDER, "sqrt(-2 * ln(least({p}, 1 - {p})))")}
 + CASE WHEN {{p}} BETWEEN {TAIL} AND 1 - {TAIL} THEN 1 ELSE 0 END * {_horner(MIDDLE_OVER, "(({p} - 0.5) * ({p} - 0.5))")} * ({{p}} - 0.5) / {_horner(MIDDLE_UNDER, "(({p} - 0.5) * ({p} - 0.5))")}"""


def cdf_sql(z: str) -> str:
    """SQL of cdf of a column or number."""
    return CDF_SQL.replace("{z}", z)


def quantile_sql(rows: str, p: str, name: str) -> str:
    """SQL of the table rows with name, the quantile of its column p."""
    step = f"(({cdf_sql('_z')} - {p}) * sqrt(2 * pi()) * exp(_z * _z / 2))"
    return f"SELECT * EXCLUDE (_z, _u), _z - _u / (1 + _z * _u / 2) AS {name} FROM (SELECT *, {step} AS _u FROM (SELECT *, CASE WHEN {p} > 0 AND {p} < 1 THEN {FIRST_SQL.replace('{p}', f'CASE WHEN {p} > 0 AND {p} < 1 THEN {p} ELSE 0.5 END')} END AS _z FROM {rows}))"
