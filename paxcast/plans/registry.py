"""Registry of named queries: a Spark builder and (optionally) DuckDB SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the input tables. Doubles
are rounded at the very end on both sides so floating-point summation order
does not decide the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name`` for SURVEY ids ``ids`` with oracle ``sql``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Presentation step of a registered query: round DOUBLEs, widen small ints to BIGINT.

    Rounding is ``rint(x * 10^p) / 10^p`` (IEEE half-even on the scaled
    double), the same operations as ``round_even(x, 0)`` in the DuckDB oracle, so a
    tie rounds the same way in both engines.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = float(10 ** places)
            cols.append((F.rint(F.col(f.name) * scale) / scale).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sql(inner: str, doubles: list[str], places: int = 4) -> str:
    """Wrap ``inner`` so the listed DOUBLE columns are rounded like ``round_doubles``."""
    scale = f"CAST({10 ** places} AS DOUBLE)"
    repl = ", ".join(f"round_even(CAST({c} AS DOUBLE) * {scale}, 0) / {scale} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{inner}\n) AS q"


def load_all() -> None:
    """Import the modules that register queries."""
    from paxcast.plans import (  # noqa: F401
        q_backtest,
        q_causal,
        q_features,
        q_forecast,
        q_models,
        q_orders,
        q_risk,
        q_signals,
        q_sources,
    )
