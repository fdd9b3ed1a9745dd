"""Shared inputs of the registered queries, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prices import day_known
from ..operators import replay
from ..schema import DAY_NS, NANO, TF_NS
from ..sources.bars import event_bars, lineitem_bars

HOUR = TF_NS["1h"]
TICK = 10_000_000
SPEC = replay.Spec()
COSTS = replay.Costs(half_ticks=2, fee=1_250_000_000, tick=TICK)
FAST, SLOW = 5, 20

_BAR = """SELECT instrument, ts_open, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {order}) AS close, CAST(count(*) AS BIGINT) AS volume FROM ({ticks}) GROUP BY 1, 2"""


def _event_ticks(step_us: int) -> str:
    return f"""SELECT event_type AS instrument, epoch_us(ts) // {step_us} * {step_us} * 1000 AS ts_open, epoch_us(ts) AS us, event_id,
  CAST(round(value * 100) AS BIGINT) * 10000000 AS price FROM events"""


B1H = "b1h AS (" + _BAR.format(order="us, event_id", ticks=_event_ticks(3_600_000_000)) + ")"
B1D = "b1d AS (" + _BAR.format(order="us, event_id", ticks=_event_ticks(86_400_000_000)) + ")"
LI1D = (
    "li1d AS ("
    + _BAR.format(
        order="l_orderkey, l_partkey, l_suppkey, l_linenumber, price",
        ticks="""SELECT l_returnflag || l_linestatus AS instrument, epoch_us(l_shipdate) // 86400000000 * 86400000000 * 1000 AS ts_open,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 AS price FROM lineitem""",
    )
    + ")"
)

#: Contracts made of the users of an event type, sessions of UTC days.
CONTRACT_BARS = f"""cb AS (SELECT root, contract, ts_open, first(price ORDER BY us, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY us, event_id) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM (SELECT event_type AS root, event_type || (user_id % 4) AS contract, epoch_us(ts) // 3600000000 * 3600000000 * 1000 AS ts_open,
    epoch_us(ts) AS us, event_id, CAST(round(value * 100) AS BIGINT) * 10000000 AS price FROM events) GROUP BY 1, 2, 3),
cs AS (SELECT root, contract, CAST((ts_open + {HOUR} - 1) // {DAY_NS} AS BIGINT) AS day, CAST(sum(volume) AS BIGINT) AS volume,
  last(close ORDER BY ts_open) AS close, max(ts_open) + {HOUR} AS avail_ts FROM cb GROUP BY 1, 2, 3)"""


def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.bars import cents_to_nanos, epoch_us, table, to_bars

    ticks = table(spark, sf_dir, "events").select(
        F.concat("event_type", (F.col("user_id") % 4).cast("string")).alias("instrument"),
        epoch_us("ts").alias("us"), "event_id", cents_to_nanos("value").alias("price"),
    )
    bars = to_bars(ticks, "1h", ["us", "event_id"]).withColumnRenamed("instrument", "contract")
    return bars.withColumn("root", F.expr("substring(contract, 1, length(contract) - 1)"))


def contract_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = day_known(HOUR)
    return contract_bars(spark, sf_dir).withColumn("day", day).groupBy("root", "contract", "day").agg(
        F.sum("volume").cast("long").alias("volume"), F.max_by("close", "ts_open").alias("close"), (F.max("ts_open") + HOUR).alias("avail_ts")
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, "1h")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir)


def sma_cross(spark: SparkSession, sf_dir: str, costs=COSTS, spec=SPEC) -> DataFrame:
    return replay.equity(replay.sma_cross_targets(bars_1h(spark, sf_dir), FAST, SLOW), spec, costs)


def _targets_sql(fast: int, slow: int) -> str:
    """SMA cross targets over b1h."""
    mean = lambda p: f"CASE WHEN row_number() OVER o >= {p} THEN avg(CAST(close AS DOUBLE)) OVER (PARTITION BY instrument ORDER BY ts_open ROWS {p - 1} PRECEDING) END"
    return f"""diffs AS (SELECT *, {mean(fast)} - {mean(slow)} AS diff FROM b1h WINDOW o AS (PARTITION BY instrument ORDER BY ts_open)),
signals AS (SELECT *, CASE WHEN lag(diff) OVER o <= 0 AND diff > 0 THEN 1 WHEN lag(diff) OVER o >= 0 AND diff < 0 THEN -1 END AS signal
  FROM diffs WINDOW o AS (PARTITION BY instrument ORDER BY ts_open)),
targets AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts_open ROWS UNBOUNDED PRECEDING), 0) AS target FROM signals)"""


def equity_sql(costs=COSTS, spec=SPEC, source: str = "targets") -> str:
    o = "(PARTITION BY instrument ORDER BY ts_open)"
    return f"""positions AS (SELECT *, coalesce(lag(target) OVER {o}, 0) * {spec.quantity} AS position FROM {source}),
changes AS (SELECT *, abs(position - coalesce(lag(position) OVER {o}, 0)) AS traded,
  coalesce(lag(position) OVER {o}, 0) * (open - coalesce(lag(close) OVER {o}, open)) * {spec.point_value} + position * (close - open) * {spec.point_value} AS gross FROM positions),
curve AS (SELECT *, CAST(CAST(traded AS HUGEINT) * {costs.fee} AS BIGINT) AS fee,
  CAST({spec.cash} + sum(gross - CAST(traded AS HUGEINT) * {costs.slip * spec.point_value + costs.fee}) OVER (PARTITION BY instrument ORDER BY ts_open ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM changes)"""


TARGETS = f"{B1H},\n{_targets_sql(FAST, SLOW)}"
CURVE = f"{TARGETS},\n{equity_sql()}"
CASH = SPEC.cash
assert CASH == 100_000 * NANO
