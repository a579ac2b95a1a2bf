"""Statistical column expressions.

Neither Spark SQL nor DuckDB has ``erf``, so the normal CDF and its inverse
are closed-form rational approximations. Each formula is written once as SQL
text that both engines parse; the Spark column and the oracle SQL therefore
evaluate the same arithmetic. Spark callers pass a column name (materialise
a computed argument with ``withColumn`` first).
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17 (normal upper tail, |error| < 7.5e-8).
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327

# P. J. Acklam's rational approximation of the normal quantile
# (relative error < 1.15e-9), coefficients in the published order.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
ACKLAM_PLOW = 0.02425


def _lit(x: float) -> str:
    """A DOUBLE literal in both dialects (bare decimals are DECIMAL in both)."""
    return f"CAST({x!r} AS DOUBLE)"


def _poly(coeffs, var: str) -> str:
    """Horner form of c0*v^(n-1) + ... + c_{n-1}."""
    expr = _lit(coeffs[0])
    for c in coeffs[1:]:
        expr = f"({expr} * {var} + {_lit(c)})"
    return expr


def _poly1(coeffs, var: str) -> str:
    """Horner form with a trailing ``* v + 1``."""
    return f"({_poly(coeffs, var)} * {var} + 1.0)"


def norm_cdf_sql(z: str) -> str:
    """SQL text of Phi(z) for a DOUBLE expression ``z``."""
    t = f"(1.0 / (1.0 + {_lit(AS_P)} * abs({z})))"
    poly = f"({t} * {_poly(AS_B[::-1], t)})"
    tail = f"(exp(-0.5 * ({z}) * ({z})) * {_lit(INV_SQRT_2PI)} * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def probit_sql(p: str) -> str:
    """SQL text of the standard normal quantile for ``p`` in (0, 1); null outside."""
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    low = f"({_poly(ACKLAM_C, ql)} / {_poly1(ACKLAM_D, ql)})"
    high = f"(-{_poly(ACKLAM_C, qh)} / {_poly1(ACKLAM_D, qh)})"
    mid = f"({_poly(ACKLAM_A, r)} * {q} / {_poly1(ACKLAM_B, r)})"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN ({p}) < {_lit(ACKLAM_PLOW)} THEN {low} "
            f"WHEN ({p}) > {_lit(1 - ACKLAM_PLOW)} THEN {high} ELSE {mid} END)")


def _ident(name: str) -> str:
    return f"`{name}`"


def norm_cdf(col_name: str) -> Column:
    """Phi of a DOUBLE column, as a JVM expression (whole-stage codegen)."""
    return F.expr(norm_cdf_sql(_ident(col_name)))


def probit(col_name: str) -> Column:
    """Normal quantile of a probability column."""
    return F.expr(probit_sql(_ident(col_name)))


def full_frame(agg, col: str, w: WindowSpec, start: int, end: int = 0) -> Column:
    """``agg(col)`` over rows [start, end], null until the frame is full.

    Matches pandas ``rolling(n)`` (min_periods = n) on a positional series.
    """
    frame = w.rowsBetween(start, end)
    n = end - start + 1
    return F.when(F.count(F.col(col)).over(frame) == n, agg(col).over(frame))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))
