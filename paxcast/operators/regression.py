"""Least squares for many groups at once, from cross-product matrices.

One grouped aggregate sums the products of all pairs of columns (partial sums
combine before the shuffle, whatever the group's size); every regression among
those columns is then a sweep of that small matrix, a built-in expression on
one row per group. Which columns enter a regression is data: an array of
positions, so fits of different control sets are rows of one table.

A column that depends on those swept before it (its diagonal falls to nothing)
is left out and has no coefficient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left of a column's sum of squares below which it counts as dependent.
TOLERANCE = 1e-9


def products(columns: list[str]) -> Column:
    """The cross-product matrix of ``columns`` as a flat array, row by row; an
    aggregate over rows in which no column is null."""
    m = len(columns)
    sums = {(i, j): F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(m) for j in range(i, m)}
    return F.array(*(sums[min(i, j), max(i, j)] for i in range(m) for j in range(m)))


def gram(df: DataFrame, keys: list[str], columns: list[str], *others: Column) -> DataFrame:
    """One row per key with its ``rows`` and cross-product matrix ``g`` of a
    constant (position 0) and ``columns`` (positions 1, 2, ...), plus ``others``."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    rest = [F.col(c) for c in df.columns if c not in columns]
    x = df.select(*rest, *doubles).withColumn("_one", F.lit(1.0))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), products(["_one", *columns]).alias("g"), *others)


def swept(g: str, pivots: str, m: int) -> Column:
    """The matrix ``g`` (m x m, flat) swept on the positions in ``pivots``, in their
    order. Entry (p, y) is then the coefficient of p for y, (y, y) what is left of
    y's squares, and -(p, p) the variance factor of p."""
    return F.expr(f"""aggregate({pivots}, {g}, (a, p) ->
      CASE WHEN a[p * {m} + p] > {TOLERANCE!r}D * {g}[p * {m} + p] THEN
        transform(a, (v, x) -> CASE
          WHEN x div {m} = p AND x % {m} = p THEN -1D / v
          WHEN x div {m} = p OR x % {m} = p THEN v / a[p * {m} + p]
          ELSE v - a[(x div {m}) * {m} + p] * a[p * {m} + x % {m}] / a[p * {m} + p] END)
      ELSE a END)""")


def coefficient(s: str, p: str, y: str, m: int) -> str:
    """SQL text: coefficient of position ``p`` for ``y`` in a swept matrix; 0 if left out."""
    return f"CASE WHEN {s}[{p} * {m} + {p}] < 0 THEN {s}[{p} * {m} + {y}] ELSE 0D END"


def fit(df: DataFrame, keys: list[str], features: list[str], target: str, *others: Column) -> DataFrame:
    """Regression of ``target`` on a constant and ``features`` for each key:
    ``rows``, ``beta`` (constant first), ``sse`` and ``rank``, plus ``others``."""
    m = len(features) + 2
    y = str(m - 1)
    names = [name for name in (*keys, "rows")]
    x = gram(df, keys, [*features, target], *others)
    kept = [c for c in x.columns if c not in (*names, "g")]
    x = x.withColumn("_pivots", F.sequence(F.lit(0), F.lit(m - 2))).withColumn("_s", swept("g", "_pivots", m))
    return x.select(
        *names, F.expr(f"transform(_pivots, p -> {coefficient('_s', 'p', y, m)})").alias("beta"),
        F.greatest(F.expr(f"_s[{m * m - 1}]"), F.lit(0.0)).alias("sse"),
        F.expr(f"size(filter(_pivots, p -> _s[p * {m} + p] < 0))").cast("long").alias("rank"), *kept)


def dot(beta: str, features: list[str]) -> Column:
    """``beta`` (constant first) applied to the columns ``features``."""
    out = F.element_at(beta, 1)
    for i, name in enumerate(features):
        out = out + F.element_at(beta, i + 2) * F.col(name).cast("double")
    return out
