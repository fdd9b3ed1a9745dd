"""Queries over bars: scans, checks, indicators, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic, prices, symbols
from ..operators import asof, indicators, qa, resample
from ..schema import DAY_NS
from ..sources import bars as sources
from .views import B1D, B1H, HOUR, LI1D, bars_1d, bars_1h

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


O = "(PARTITION BY instrument ORDER BY ts_open)"


def frame(p: int) -> str:
    return f"(PARTITION BY instrument ORDER BY ts_open ROWS {p - 1} PRECEDING)"


@query("bars_events_1h", f"WITH {B1H} SELECT * FROM b1h")
def _(spark, d):
    return bars_1h(spark, d)


@query("bars_events_1d", f"WITH {B1D} SELECT * FROM b1d")
def _(spark, d):
    return sources.event_bars(spark, d, "1d")


@query("bars_lineitem_1d", f"WITH {LI1D} SELECT * FROM li1d")
def _(spark, d):
    return bars_1d(spark, d)


@query("avail_signal_view", f"WITH {B1H} SELECT instrument, ts_open, ts_open + {HOUR} AS avail_ts, close + 250000000 AS sig_close, round(close / 1e9, 9) AS close_points FROM b1h")
def _(spark, d):
    b = bars_1h(spark, d).withColumn("signal_offset", F.lit(250_000_000).cast("long"))
    return b.select("instrument", "ts_open", prices.avail_ts(HOUR).alias("avail_ts"), (F.col("close") + F.col("signal_offset")).alias("sig_close"), F.round(prices.points(F.col("close")), 9).alias("close_points"))


LO, HI = 1_704_672_000 * 10**9, 1_705_276_800 * 10**9


@query("range_scan", f"WITH {B1H} SELECT * FROM b1h WHERE ts_open >= {LO} AND ts_open < {HI}")
def _(spark, d):
    return bars_1h(spark, d).where((F.col("ts_open") >= LO) & (F.col("ts_open") < HI))


@query("instrument_list", f"WITH {LI1D} SELECT DISTINCT instrument FROM li1d")
def _(spark, d):
    return sources.instruments(bars_1d(spark, d))


@query("scan_integrity", f"""WITH {B1H}, p AS (SELECT *, lag(ts_open) OVER {O} AS prev FROM b1h)
SELECT instrument, count(*) AS row_count, min(ts_open) AS first_ts, max(ts_open) AS last_ts, CAST(sum(CAST(volume < 0 AS INT)) AS BIGINT) AS negative_volume,
CAST(sum(coalesce(CAST(ts_open <= prev AS INT), 0)) AS BIGINT) AS not_increasing FROM p GROUP BY 1""")
def _(spark, d):
    return sources.integrity(bars_1h(spark, d))


@query("raw_validation", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type IS NULL THEN 'unknown_id'
  WHEN event_id % 97 = 0 THEN 'undefined_price' WHEN epoch_us(ts) * 1000 % 60000000000 <> 0 THEN 'unaligned_ts'
  WHEN count(*) OVER (PARTITION BY event_type, ts) > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM events) GROUP BY 1""")
def _(spark, d):
    price = F.when(F.col("event_id") % 97 == 0, F.lit(sources.UNDEFINED_PRICE)).otherwise(sources.cents_to_nanos("value"))
    raw = sources.table(spark, d, "events").select(
        F.col("event_type").alias("instrument"), (sources.epoch_us("ts") * 1000).alias("ts_open"), *[price.alias(c) for c in ("open", "high", "low", "close")]
    )
    return sources.validate_raw(raw, "1m").groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("spread_filter", """SELECT regexp_matches(s, '[-: ]') AS spread, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name || '-' || c_mktsegment ELSE replace(c_name, '#', '') END AS s FROM customer) GROUP BY 1""")
def _(spark, d):
    s = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("-"), "c_mktsegment")).otherwise(F.replace("c_name", F.lit("#"), F.lit("")))
    return sources.table(spark, d, "customer").select(s.alias("s")).groupBy(sources.is_spread("s").alias("spread")).agg(F.count(F.lit(1)).alias("n"))


def _broken(spark, d):
    """Bars with every 7th hour's high and low exchanged, so that there is something to find."""
    b = bars_1h(spark, d)
    odd = F.expr(f"(ts_open div {HOUR}) % 7") == 0
    return b.withColumns({"high": F.when(odd, F.col("low")).otherwise(F.col("high")), "low": F.when(odd, F.col("high")).otherwise(F.col("low"))})


@query("ohlc_violations", f"""WITH {B1H}, x AS (SELECT instrument, ts_open, open, close,
  CASE WHEN ts_open // {HOUR} % 7 = 0 THEN low ELSE high END AS high, CASE WHEN ts_open // {HOUR} % 7 = 0 THEN high ELSE low END AS low FROM b1h)
SELECT instrument, ts_open, 'high_below_low' AS rule FROM x WHERE high < low
UNION ALL SELECT instrument, ts_open, 'high_below_body' FROM x WHERE high < open OR high < close
UNION ALL SELECT instrument, ts_open, 'low_above_body' FROM x WHERE low > open OR low > close""")
def _(spark, d):
    return qa.ohlc_violations(_broken(spark, d))


@query("zero_volume_runs", f"""WITH {B1H}, f AS (SELECT instrument, ts_open, volume <= 2 AS hit, row_number() OVER {O} AS i FROM b1h),
g AS (SELECT *, i - row_number() OVER {O} AS island FROM f WHERE hit)
SELECT instrument, min(ts_open) AS start_ts, count(*) AS length FROM g GROUP BY instrument, island ORDER BY length DESC, start_ts, instrument LIMIT 20""")
def _(spark, d):
    quiet = bars_1h(spark, d).withColumn("volume", F.greatest(F.col("volume") - 2, F.lit(0)))
    return qa.zero_volume_runs(quiet).orderBy(F.desc("length"), "start_ts", "instrument").limit(20)


MOVES = f"""m AS (SELECT instrument, ts_open, close - lag(close) OVER {O} AS move, ts_open - lag(ts_open) OVER {O} AS dt FROM b1h),
mv AS (SELECT instrument, ts_open, move FROM m WHERE dt = {HOUR}),
rk AS (SELECT instrument, abs(move) AS a, row_number() OVER (PARTITION BY instrument ORDER BY abs(move)) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM mv),
sc AS (SELECT instrument, n, a * 1.4826 AS sigma FROM rk WHERE rn = n // 2 + 1)"""


@query("spike_mad", f"""WITH {B1H}, {MOVES} SELECT mv.instrument, ts_open, move, round(abs(move) / sigma, 6) AS sigmas FROM mv JOIN sc USING (instrument)
WHERE n >= 3 AND sigma > 0 AND abs(move) / sigma > 3""")
def _(spark, d):
    return qa.spikes(bars_1h(spark, d), HOUR, 3.0).withColumn("sigmas", F.round("sigmas", 6))


@query("spike_check_status", f"""WITH {B1H}, {MOVES} SELECT i.instrument, CASE WHEN coalesce(n, 0) < 3 OR sigma = 0 THEN 'skipped' ELSE 'ran' END AS spike_check,
CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_moves' WHEN sigma = 0 THEN 'zero_scale' END AS reason FROM (SELECT DISTINCT instrument FROM b1h) i LEFT JOIN sc USING (instrument)""")
def _(spark, d):
    return qa.status(bars_1h(spark, d), HOUR)


@query("gap_grid_antijoin", f"""WITH {B1H}, e AS (SELECT instrument, unnest(generate_series(min(ts_open), max(ts_open), {HOUR})) AS ts_open FROM b1h GROUP BY 1)
SELECT e.* FROM e ANTI JOIN b1h ON e.instrument = b1h.instrument AND e.ts_open = b1h.ts_open""")
def _(spark, d):
    b = bars_1h(spark, d)
    return qa.expected_slots(b, HOUR).join(b, ["instrument", "ts_open"], "left_anti")


@query("gap_report", f"""WITH {B1H}, p AS (SELECT instrument, ts_open, lag(ts_open) OVER {O} AS prev FROM b1h)
SELECT instrument, prev + {HOUR} AS gap_start, (ts_open - prev) // {HOUR} - 1 AS missing FROM p WHERE ts_open - prev > {HOUR} ORDER BY missing DESC, gap_start, instrument LIMIT 20""")
def _(spark, d):
    return qa.gaps(bars_1h(spark, d), HOUR).orderBy(F.desc("missing"), "gap_start", "instrument").limit(20)


@query("coverage_pct", f"""WITH {B1H}, c AS (SELECT instrument, (max(ts_open) - min(ts_open)) // {HOUR} + 1 AS expected, count(*) AS present FROM b1h GROUP BY 1)
SELECT *, expected - present AS missing, round(present * 100.0 / expected, 6) AS coverage_pct FROM c""")
def _(spark, d):
    return qa.coverage(bars_1h(spark, d), HOUR).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("unexpected_bars", f"""WITH {B1H}, u AS (SELECT instrument, ts_open FROM b1h WHERE ts_open // {HOUR} % 24 NOT BETWEEN 8 AND 19)
SELECT *, (SELECT count(*) FROM u) AS total FROM u ORDER BY ts_open, instrument LIMIT 10""")
def _(spark, d):
    hour = F.expr(f"(ts_open div {HOUR}) % 24")
    found = bars_1h(spark, d).where(~hour.between(8, 19)).select("instrument", "ts_open")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("ts_open", "instrument").limit(10).crossJoin(F.broadcast(total))


@query("resample_1h_to_1d", f"""WITH {B1H}, d AS (SELECT *, (ts_open + {HOUR} - 1) // {DAY_NS} AS day, ts_open // {DAY_NS} * {DAY_NS} AS bucket FROM b1h)
SELECT instrument, day, bucket, first(open ORDER BY ts_open) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts_open) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, min(ts_open) > bucket OR max(ts_open) + {HOUR} < bucket + {DAY_NS} AS partial FROM d GROUP BY 1, 2, 3""")
def _(spark, d):
    return resample.resample(bars_1h(spark, d), "1h", "1d")


@query("session_fold", f"""WITH {B1H} SELECT instrument, (ts_open + {HOUR} - 1) // {DAY_NS} AS day, CAST(sum(volume) AS BIGINT) AS volume, last(close ORDER BY ts_open) AS close,
max(ts_open) + {HOUR} AS avail_ts FROM b1h GROUP BY 1, 2""")
def _(spark, d):
    return resample.sessions(bars_1h(spark, d), prices.day_known(HOUR), HOUR)


C = "close / 1e9"


@query("sma", f"WITH {B1H} SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 20 THEN avg({C}) OVER {frame(20)} END, 6) AS sma_20 FROM b1h")
def _(spark, d):
    return bars_1h(spark, d).select("instrument", "ts_open", F.round(indicators.sma(prices.points(F.col("close")), 20), 6).alias("sma_20"))


@query("sma_exact_long", f"WITH {B1H} SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 200 THEN avg({C}) OVER {frame(200)} END, 6) AS sma_200 FROM b1h")
def _(spark, d):
    return indicators.sma_exact(bars_1h(spark, d), "close", 200).withColumn("sma_200", F.round("sma_200", 6))


@query("ema", f"""WITH RECURSIVE {B1H}, n AS (SELECT instrument, ts_open, {C} AS x, row_number() OVER {O} AS i FROM b1h),
s AS (SELECT instrument, avg(x) AS e FROM n WHERE i <= 10 GROUP BY 1 HAVING count(*) = 10),
r AS (SELECT instrument, 10 AS i, e FROM s UNION ALL SELECT r.instrument, r.i + 1, 2.0 / 11 * n.x + 9.0 / 11 * r.e FROM r JOIN n ON n.instrument = r.instrument AND n.i = r.i + 1)
SELECT n.instrument, n.ts_open, round(r.e, 6) AS ema FROM n LEFT JOIN r USING (instrument, i)""")
def _(spark, d):
    return indicators.ema(bars_1h(spark, d), "close", 10).withColumn("ema", F.round("ema", 6))


@query("bollinger", f"""WITH {B1H}, b AS (SELECT instrument, ts_open, row_number() OVER {O} AS i, avg({C}) OVER {frame(20)} AS m, stddev_pop({C}) OVER {frame(20)} AS s FROM b1h)
SELECT instrument, ts_open, round(CASE WHEN i >= 20 THEN m - 2 * s END, 6) AS lower, round(CASE WHEN i >= 20 THEN m END, 6) AS middle, round(CASE WHEN i >= 20 THEN m + 2 * s END, 6) AS upper FROM b""")
def _(spark, d):
    low, mid, high = indicators.bollinger(prices.points(F.col("close")), 20, 2.0)
    return bars_1h(spark, d).select("instrument", "ts_open", F.round(low, 6).alias("lower"), F.round(mid, 6).alias("middle"), F.round(high, 6).alias("upper"))


def _z_sql(x: str) -> str:
    return f"""WITH {B1H} SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 20 THEN ({x} - avg({x}) OVER {frame(20)}) / nullif(stddev_pop({x}) OVER {frame(20)}, 0) END, 5) AS z FROM b1h"""


@query("zscore_close", _z_sql(C))
def _(spark, d):
    return bars_1h(spark, d).select("instrument", "ts_open", F.round(indicators.zscore(prices.points(F.col("close")), 20), 5).alias("z"))


@query("zscore_volume", _z_sql("CAST(volume AS DOUBLE)"))
def _(spark, d):
    return bars_1h(spark, d).select("instrument", "ts_open", F.round(indicators.zscore(F.col("volume").cast("double"), 20), 5).alias("z"))


@query("stdev_return", f"""WITH {B1H}, r AS (SELECT instrument, ts_open, CASE WHEN lag(close) OVER {O} <> 0 THEN ({C}) / lag({C}) OVER {O} - 1 END AS ret FROM b1h),
k AS (SELECT * FROM r WHERE ret IS NOT NULL) SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 10 THEN stddev_pop(ret) OVER {frame(10)} END, 6) AS stdev_return FROM k""")
def _(spark, d):
    return indicators.stdev_of_returns(bars_1h(spark, d), 10).withColumn("stdev_return", F.round("stdev_return", 6))


@query("crosses", f"""WITH {B1H}, s AS (SELECT instrument, ts_open, {C} AS c, CASE WHEN row_number() OVER {O} >= 10 THEN avg({C}) OVER {frame(10)} END AS m FROM b1h)
SELECT instrument, ts_open, lag(c) OVER {O} <= lag(m) OVER {O} AND c > m AS above, lag(c) OVER {O} >= lag(m) OVER {O} AND c < m AS below FROM s""")
def _(spark, d):
    s = bars_1h(spark, d).select("instrument", "ts_open", prices.points(F.col("close")).alias("c"), indicators.sma(prices.points(F.col("close")), 10).alias("m"))
    over = indicators.series()
    return s.select("instrument", "ts_open", logic.crosses(F.col("c"), F.col("m"), over).alias("above"), logic.crosses(F.col("c"), F.col("m"), over, False).alias("below"))


@query("strict_and_or", """WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS a,
  CASE c_custkey // 3 % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS b FROM customer)
SELECT k, CASE WHEN a IS NULL THEN NULL WHEN NOT a THEN false ELSE b END AS both, CASE WHEN a IS NULL THEN NULL WHEN a THEN true ELSE b END AS either,
NOT CASE WHEN a IS NULL THEN NULL WHEN NOT a THEN false ELSE b END AS not_both FROM t""")
def _(spark, d):
    flag = lambda n: F.when(n == 1, F.lit(False)).when(n == 2, F.lit(True))
    k = F.col("c_custkey")
    t = sources.table(spark, d, "customer").select(k.alias("k"), flag(k % 3).alias("a"), flag(F.expr("c_custkey div 3") % 3).alias("b"))
    both = logic.strict_and(F.col("a"), F.col("b"))
    return t.select("k", both.alias("both"), logic.strict_or(F.col("a"), F.col("b")).alias("either"), (~both).alias("not_both"))


@query("round_to_tick", """SELECT o_orderkey, CAST(p - p % 250000000 AS BIGINT) AS rounded FROM (SELECT o_orderkey, v + sign(v) * 125000000 AS p FROM
 (SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) * 10000000 - 200000000000000) AS v FROM orders))""")
def _(spark, d):
    v = sources.cents_to_nanos("o_totalprice") - 200_000 * 10**9
    return sources.table(spark, d, "orders").select("o_orderkey", prices.round_to_tick(v, 250_000_000).alias("rounded"))


@query("price_parse", """SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) * 10000000 AS nanos FROM supplier""")
def _(spark, d):
    text = F.format_string("%.2f", F.col("s_acctbal"))
    shown = prices.show_decimal(prices.parse_decimal(text))
    return sources.table(spark, d, "supplier").select("s_suppkey", prices.parse_decimal(shown).alias("nanos"))


@query("symbol_parse", """WITH s AS (SELECT p_partkey, 'ES' || substr('FGHJKMNQUVXZ', 1 + CAST(p_partkey % 12 AS INT), 1) || (p_partkey % 10) AS s FROM part)
SELECT p_partkey, 'ES' AS root, CAST(1 + p_partkey % 12 AS INT) AS month,
CAST(2020 + p_partkey % 10 AS INT) AS year FROM s""")
def _(spark, d):
    code = F.substring(F.lit(symbols.MONTH_CODES), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1))
    s = F.concat(F.lit("ES"), code, (F.col("p_partkey") % 10).cast("string"))
    return sources.table(spark, d, "part").select("p_partkey", symbols.root(s).alias("root"), symbols.month(s).alias("month"), symbols.year(s).cast("int").alias("year"))


@query("normal_functions", """WITH g AS (SELECT CAST(k AS BIGINT) AS k, k / 100.0 AS x, k / 1000.0 AS p FROM range(1, 300) t(k))
SELECT k, round(CASE WHEN x >= 0 THEN 1 - 0.5 * (1 - (1 - y * exp(-z * z))) END, 6) AS cdf FROM (
 SELECT *, ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t AS y FROM (
 SELECT *, 1 / (1 + 0.3275911 * z) AS t FROM (SELECT *, x / sqrt(2) AS z FROM g)))""")
def _(spark, d):
    return spark.range(1, 300).select(F.col("id").alias("k"), F.round(prices.normal_cdf(F.col("id") / 100.0), 6).alias("cdf"))


@query("interval_merge", """WITH r AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 86400000000 * (1 + o_orderkey % 60) AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(s) AS "start", max(e) AS "end" FROM i GROUP BY k, island""")
def _(spark, d):
    return asof.merge_intervals(_ranges(spark, d), ["k"])


def _ranges(spark, d):
    at = sources.epoch_us("o_orderdate")
    return sources.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), at.alias("start"), (at + F.lit(86_400_000_000) * (F.col("o_orderkey") % 60 + 1)).alias("end"))


W0, W1 = 852_076_800_000_000, 946_684_800_000_000


@query("interval_difference", f"""WITH r AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 86400000000 * (1 + o_orderkey % 60) AS e FROM orders),
c AS (SELECT k, s, e FROM r WHERE e > {W0} AND s < {W1} UNION ALL SELECT DISTINCT k, {W1}, {W1} FROM r),
g AS (SELECT k, s, greatest(coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {W0}), {W0}) AS g0 FROM c)
SELECT k, g0 AS "start", s AS "end" FROM g WHERE g0 < s""")
def _(spark, d):
    r = _ranges(spark, d)
    wanted = r.select("k").distinct().select("k", F.lit(W0).alias("start"), F.lit(W1).alias("end"))
    return asof.subtract_intervals(wanted, r, ["k"])


@query("month_windows", """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 100 + 1 AS INT) AS e FROM orders),
m AS (SELECT *, unnest(generate_series(date_trunc('month', s), CAST(e - 1 AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM r)
SELECT k, greatest(s, CAST(m AS DATE)) AS "start", least(e, CAST(m + INTERVAL 1 MONTH AS DATE)) AS "end" FROM m""")
def _(spark, d):
    start = F.to_date("o_orderdate")
    r = sources.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 100 + 1).cast("int")).alias("end"))
    return asof.month_windows(r, ["k"])

