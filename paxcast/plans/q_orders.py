"""Query: order validation (M6, the batch form of T3): static checks, a cooldown
between accepted orders, risk limits. The oracle walks every account's orders in
sequence with a recursive CTE; the Spark plan splits them into bursts instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.operators import resample, risk
from paxcast.plans.oracle_views import X6
from paxcast.plans.q_risk import PNL_SQL
from paxcast.plans.registry import query
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables
from paxcast.streaming import jobs

# Parameters of the registered query: a cooldown long enough to reject some of
# these orders (the original 5 s never binds at this event rate), and orders with
# faults in them, so that every check rejects some.
COOLDOWN_SECONDS = 600
MOST = jobs.MAX_CONTRACTS_PER_TRADE
SIZE = (f"CASE WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 43 = 0 THEN {MOST} + 1 "
        f"WHEN event_id % 7 = 0 THEN {MOST} ELSE size END")
PRICE = "CASE WHEN event_id % 47 = 0 THEN 1.0 WHEN event_id % 53 = 0 THEN 0.0 ELSE price END"
SIDE = "CASE WHEN event_id % 59 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'YES' ELSE 'no' END"
EXPOSURE = 5_000  # an account's exposure counts modulo this, so that the limits leave room
CAPITAL = 3_000.0  # and its capital is this, so that they bind for large orders

ORDERS_SQL = f"""
WITH RECURSIVE {X6},
{PNL_SQL},
raw AS (
  SELECT x.account, x.event_id, x.ts, epoch_us(x.ts) AS us, CAST({SIZE} AS BIGINT) AS osize, {PRICE} AS oprice, {SIDE} AS oside,
         s.exposure % {EXPOSURE} AS exposure, {CAPITAL} AS capital, s.last_pnl
  FROM x6 x LEFT JOIN state s ON x.account = s.account),
checked AS (
  SELECT *, CASE WHEN osize <= 0 THEN 'Size must be positive'
                 WHEN osize > {MOST} THEN 'Size exceeds maximum ({MOST} contracts)'
                 WHEN oprice <= 0 OR oprice >= 1 THEN 'Price must be between 0 and 1'
                 WHEN lower(oside) NOT IN ('yes', 'no') THEN 'Side must be ''yes'' or ''no''' END AS fault,
         CASE WHEN last_pnl < -{risk.MAX_DAILY_LOSS} * {risk.INITIAL_CAPITAL} THEN 'Daily loss limit reached'
              WHEN (exposure + abs(osize)) * oprice > capital * {risk.MAX_LEVERAGE} THEN 'Leverage limit exceeded'
              WHEN abs(osize) * oprice > capital * {risk.CONCENTRATION_LIMIT} THEN 'Concentration limit exceeded' END AS limit_hit
  FROM raw),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn FROM checked WHERE fault IS NULL),
r(account, rn, event_id, ts, message, last_us) AS (
  SELECT account, rn, event_id, ts, CASE WHEN limit_hit IS NULL THEN 'Order validated' ELSE 'Risk limit: ' || limit_hit END,
         CASE WHEN limit_hit IS NULL THEN us END
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.account, o.rn, o.event_id, o.ts,
         CASE WHEN o.us - r.last_us < {COOLDOWN_SECONDS * 1_000_000} THEN 'cooldown'
              WHEN o.limit_hit IS NULL THEN 'Order validated' ELSE 'Risk limit: ' || o.limit_hit END,
         CASE WHEN o.us - r.last_us < {COOLDOWN_SECONDS * 1_000_000} OR o.limit_hit IS NOT NULL THEN r.last_us ELSE o.us END
  FROM r JOIN o ON o.account = r.account AND o.rn = r.rn + 1)
SELECT account, event_id, ts, message = 'Order validated' AS accepted, message FROM r
UNION ALL
SELECT account, event_id, ts, FALSE, fault FROM checked WHERE fault IS NOT NULL"""


@query("order_validation", "M6 T3", ORDERS_SQL)
def q_order_validation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    orders = fixtures.order_stream(t).select(
        "account", "ts", "event_id", F.expr(SIZE).cast("bigint").alias("size"), F.expr(PRICE).cast("double").alias("price"),
        F.expr(SIDE).alias("side"))
    trades = fixtures.trades(t)
    state = risk.account_state(risk.net_positions(trades), resample.daily_pnl(trades))
    state = state.withColumn("exposure", F.col("exposure") % EXPOSURE).withColumn("capital", F.lit(CAPITAL))
    return jobs.order_cooldown_batch(orders, COOLDOWN_SECONDS, state)
