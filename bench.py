"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list, default the headline set),
``BENCH_REPEATS`` (default 3), ``BENCH_SCALING`` (0 leaves the scaling out).
Each query is run to completion with the ``noop`` sink (every row computed,
nothing collected to the driver): once untimed, then ``BENCH_REPEATS`` times;
the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from paxcast.operators import backtest, forecast  # noqa: E402
from paxcast.plans import registry  # noqa: E402
from paxcast.session import local_session  # noqa: E402
from paxcast.sources import fixtures  # noqa: E402
from paxcast.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "weekly_forecast",
    "backtest_summary",
    "next_week_forecast",
    "contract_choice",
    "feature_matrix",
    "daily_ledger_metrics",
    "portfolio_risk_report",
    "order_validation",
    "causal_effects",
    "book_depth",
]


class Replicated(Tables):
    """The input tables with every line item ``k`` times: the fact scan's output,
    the partial aggregates and the shuffles all see the larger table."""

    def __init__(self, spark, root, k: int):
        super().__init__(spark, root)
        self.k = k

    def table(self, name):
        df = super().table(name)
        if name == "lineitem" and self.k > 1:
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(self.k)))).drop("_copy")
        return df


def run(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def timed(make, repeats: int) -> float:
    run(make())
    return round(statistics.median(run(make()) for _ in range(repeats)), 3)


def fact_scaling(spark, sf_dir, repeats: int, factors=(1, 4, 16)) -> dict:
    """Forecast (I1) and backtest summary (N6) with the fact table k times as large."""
    out = {}
    for k in factors:
        def daily(k=k):
            return fixtures.daily_counts(Replicated(spark, sf_dir, k))

        def summary():
            weeks = backtest.weekly_backtest(daily(), fixtures.quotes, start="1993-01-01", step=100_000.0)
            return backtest.summary(weeks, daily())

        out[f"x{k}"] = {"weekly_forecast": timed(lambda: forecast.weekly_forecast(daily()), repeats),
                        "backtest_summary": timed(summary, repeats)}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    registry.load_all()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in (wanted.split(",") if wanted else HEADLINE) if n in registry.QUERIES]
    spark = local_session(cpus=cpus, shuffle_partitions=max(cpus, 8), app="paxcast-bench")
    times = {name: timed(lambda name=name: registry.QUERIES[name](spark, sf_dir), repeats) for name in names}
    scaling = None
    if os.environ.get("BENCH_SCALING", "1") != "0":
        try:
            scaling = fact_scaling(spark, sf_dir, repeats)
        except Exception as e:  # noqa: BLE001 - the headline line must still print
            scaling = {"error": f"{type(e).__name__}: {str(e)[:200]}"}
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "fact_scaling": scaling,
    }))


if __name__ == "__main__":
    main()
