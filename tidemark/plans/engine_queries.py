"""Queries over replays: equity, trades, days, folds, statistics, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prices
from ..functions.prices import day_known, identity_hash, run_id
from ..operators import asof, controls, funnel, metrics, replay, rolls, stats, walkforward
from ..schema import DAY_NS
from .views import _targets_sql, B1H, CASH, CONTRACT_BARS, COSTS, CURVE, FAST, HOUR, SLOW, SPEC, TARGETS, TICK, bars_1h, contract_bars, contract_sessions, equity_sql, sma_cross

QUERIES, SQL = {}, {}
O = "(PARTITION BY instrument ORDER BY ts_open)"
RUN = "(PARTITION BY instrument ORDER BY ts_open ROWS UNBOUNDED PRECEDING)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CURVE_COLUMNS = ["instrument", "ts_open", "position", "fee", "equity"]
CURVE_LIST = ", ".join(CURVE_COLUMNS)


@query("sma_cross_equity_spread", f"WITH {CURVE} SELECT instrument, ts_open, CAST(position AS BIGINT) AS position, fee, equity FROM curve")
def _(spark, d):
    return sma_cross(spark, d).select(*CURVE_COLUMNS)


@query("sma_cross_equity_free", f"WITH {TARGETS},\n{equity_sql(replay.FREE)} SELECT instrument, ts_open, CAST(position AS BIGINT) AS position, fee, equity FROM curve")
def _(spark, d):
    return sma_cross(spark, d, replay.FREE).select(*CURVE_COLUMNS)


@query("buy_and_hold", f"WITH {B1H}, targets AS (SELECT *, CAST(row_number() OVER {O} > 20 AS INT) AS target FROM b1h),\n{equity_sql()} SELECT instrument, ts_open, equity FROM curve")
def _(spark, d):
    return replay.equity(replay.buy_and_hold_targets(bars_1h(spark, d), 20), SPEC, COSTS).select("instrument", "ts_open", "equity")


LEVELS = (0, 1, 2, 4)


@query("cost_sweep", f"WITH {TARGETS}, " + ",\n".join(
    f"p{h} AS (WITH {equity_sql(replay.Costs(h, COSTS.fee, TICK))} SELECT {h} AS half_ticks, instrument, last(equity ORDER BY ts_open) AS final_equity, CAST(sum(fee) AS BIGINT) AS fees FROM curve GROUP BY 2)" for h in LEVELS
) + " " + " UNION ALL ".join(f"SELECT * FROM p{h}" for h in LEVELS))
def _(spark, d):
    targets = replay.sma_cross_targets(bars_1h(spark, d), FAST, SLOW)
    return replay.cost_levels(targets, SPEC, LEVELS, COSTS.fee, TICK).select("half_ticks", "instrument", "final_equity", "fees")


FSM_RULES = f"""rules AS (SELECT *, row_number() OVER {O} AS i, coalesce(close > lag(close) OVER {O} AND volume >= 4, false) AS el, coalesce(close < lag(close) OVER {O}, false) AS xl,
  coalesce(close < lag(close) OVER {O} AND volume >= 4, false) AS es, coalesce(close > lag(close) OVER {O}, false) AS xs FROM b1h)"""


@query("target_fsm", f"""WITH RECURSIVE {B1H}, {FSM_RULES},
f AS (SELECT instrument, i, ts_open, CASE WHEN el AND es THEN 0 WHEN el THEN 1 WHEN es THEN -1 ELSE 0 END AS target FROM rules WHERE i = 1
UNION ALL SELECT r.instrument, r.i, r.ts_open, CASE WHEN s.flat <> 0 THEN s.flat WHEN r.el AND r.es THEN 0 WHEN r.el THEN 1 WHEN r.es THEN -1 ELSE 0 END
 FROM (SELECT f.instrument, f.i, CASE WHEN f.target = 1 AND x.xl THEN 0 WHEN f.target = -1 AND x.xs THEN 0 ELSE f.target END AS flat FROM f JOIN rules x ON x.instrument = f.instrument AND x.i = f.i + 1) s
 JOIN rules r ON r.instrument = s.instrument AND r.i = s.i + 1)
SELECT instrument, ts_open, target FROM f""")
def _(spark, d):
    over = Window.partitionBy("instrument").orderBy("ts_open")
    prev = F.lag("close").over(over)
    b = bars_1h(spark, d).withColumn("up", F.col("close") > prev).withColumn("down", F.col("close") < prev)
    busy = F.col("volume") >= 4
    out = replay.rule_targets(b, F.col("up") & busy, F.col("down"), F.col("down") & busy, F.col("up"))
    return out.select("instrument", "ts_open", "target")


TRADES = f"""held AS (SELECT *, CASE WHEN position <> coalesce(lag(position) OVER {O}, 0) AND position <> 0 THEN 1 ELSE 0 END AS starts,
  coalesce(lag(position) OVER {O}, 0) AS before,
  lead(open) OVER {O} AS next_open, lead(ts_open) OVER {O} AS next_ts, lead(position) OVER {O} AS next_position FROM curve),
ep AS (SELECT *, sum(starts) OVER {RUN} AS episode FROM held),
tr AS (SELECT instrument, episode, any_value(position) AS position, min(ts_open) AS first_ts, first(open ORDER BY ts_open) AS entry_open,
  arg_max(coalesce(next_open, -1), ts_open) AS exit_open, arg_max(coalesce(next_ts, -1), ts_open) AS exit_ts,
  arg_max(coalesce(next_position, 0), ts_open) AS exit_position, arg_min(before, ts_open) AS before,
  max(close) AS hi, min(close) AS lo FROM ep WHERE position <> 0 GROUP BY 1, 2),
tc AS (SELECT *, CASE WHEN before = 0 THEN {COSTS.fee} ELSE 0 END AS opening, CAST(abs(exit_position - position) AS BIGINT) * {COSTS.fee} AS closing, sign(position) AS side, entry_open + sign(position) * {COSTS.slip} AS entry, exit_open - sign(position) * {COSTS.slip} AS leave FROM tr WHERE exit_ts >= 0),
trades AS (SELECT instrument, exit_ts + {HOUR} AS closed_ts, CAST(position * (leave - entry) * {SPEC.point_value} - opening - closing AS BIGINT) AS net, CAST(side AS INT) AS direction, first_ts + {HOUR} AS opened_ts,
  CAST(least(0, position * (hi - entry) * {SPEC.point_value} - opening, position * (lo - entry) * {SPEC.point_value} - opening) AS BIGINT) AS mae,
  CAST(greatest(0, position * (hi - entry) * {SPEC.point_value} - opening, position * (lo - entry) * {SPEC.point_value} - opening) AS BIGINT) AS mfe FROM tc)"""


@query("trade_episodes", f"WITH {CURVE},\n{TRADES} SELECT * FROM trades")
def _(spark, d):
    return replay.closed_trades(sma_cross(spark, d), SPEC, COSTS, HOUR)


@query("mae_mfe", f"WITH {CURVE},\n{TRADES} SELECT instrument, count(*) AS round_trips, CAST(sum(CAST(net > 0 AS INT)) AS BIGINT) AS wins, min(mae) AS worst, max(mfe) AS best FROM trades GROUP BY 1")
def _(spark, d):
    t = replay.closed_trades(sma_cross(spark, d), SPEC, COSTS, HOUR)
    return t.groupBy("instrument").agg(F.count(F.lit(1)).alias("round_trips"), F.sum((F.col("net") > 0).cast("long")).alias("wins"), F.min("mae").alias("worst"), F.max("mfe").alias("best"))


@query("fees", f"WITH {CURVE} SELECT instrument, ts_open, fee FROM curve WHERE fee <> 0")
def _(spark, d):
    return sma_cross(spark, d).where("fee <> 0").select("instrument", "ts_open", "fee")


@query("trades_by_kernel", f"WITH {CURVE},\n{TRADES} SELECT instrument, closed_ts, net, direction, opened_ts FROM trades")
def _(spark, d):
    targets = replay.sma_cross_targets(bars_1h(spark, d), FAST, SLOW)
    return replay.bracket_replay(targets, HOUR, SPEC, COSTS, None, None, "trades").select("instrument", "closed_ts", "net", "direction", "opened_ts")


STOP, GAIN = 800, 1200


def _brackets_sql() -> str:
    """The bracket machine bar by bar: fill what is pending, leave by stop or target, decide."""
    slip, tick = COSTS.slip, COSTS.tick
    keep = "instrument, i, ts_open, open, high, low, close, target"
    return f"""nb AS (SELECT instrument, ts_open, open, high, low, close, CAST(target AS BIGINT) AS target, row_number() OVER {O} AS i FROM targets),
run AS (SELECT {keep}, CAST(0 AS BIGINT) AS pos, target AS pend, CAST(NULL AS BIGINT) AS stop, CAST(NULL AS BIGINT) AS gain, CAST(NULL AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS leg, CAST(0 AS BIGINT) AS change, false AS unsure FROM nb WHERE i = 1
UNION ALL SELECT {keep}, pos2, target - pos2, CASE WHEN leg IS NULL THEN stop2 END, CASE WHEN leg IS NULL THEN gain2 END,
  CASE leg WHEN 'stop' THEN hit - sign(pos1) * {slip} WHEN 'target' THEN hit END, leg, CASE WHEN leg IS NOT NULL THEN -pos1 ELSE 0 END, unsure
FROM (SELECT *, CASE WHEN leg IS NULL THEN pos1 ELSE 0 END AS pos2 FROM (
 SELECT *, CASE WHEN side * open <= side * stop2 THEN open WHEN side * open > side * gain2 THEN open WHEN lo <= side * stop2 THEN stop2 WHEN hi > side * gain2 THEN gain2 END AS hit,
  CASE WHEN pos1 = 0 OR stop2 IS NULL THEN NULL WHEN side * open <= side * stop2 THEN 'stop' WHEN side * open > side * gain2 THEN 'target' WHEN lo <= side * stop2 THEN 'stop' WHEN hi > side * gain2 THEN 'target' END AS leg,
  coalesce(pos1 <> 0 AND side * open > side * stop2 AND side * open <= side * gain2 AND lo <= side * stop2 AND hi > side * gain2, false) AS unsure FROM (
  SELECT *, sign(pos1) AS side, CASE WHEN pos1 > 0 THEN low ELSE -high END AS lo, CASE WHEN pos1 > 0 THEN high ELSE -low END AS hi,
   CASE WHEN pend = 0 THEN stop WHEN pos1 <> 0 THEN fill - sign(pos1) * {STOP * tick} END AS stop2, CASE WHEN pend = 0 THEN gain WHEN pos1 <> 0 THEN fill + sign(pos1) * {GAIN * tick} END AS gain2 FROM (
   SELECT nb.*, r.pend, r.stop, r.gain, r.pos + r.pend AS pos1, nb.open + sign(r.pend) * {slip} AS fill FROM run r JOIN nb ON nb.instrument = r.instrument AND nb.i = r.i + 1)))))"""


BRACKETS = f"WITH RECURSIVE {TARGETS}, {_brackets_sql()}"


def _bracket_exits(spark, d):
    targets = replay.sma_cross_targets(bars_1h(spark, d), FAST, SLOW)
    return replay.bracket_replay(targets, HOUR, SPEC, COSTS, STOP, GAIN, "fills").where("leg <> 'order'")


@query("bracket_exits", f"{BRACKETS} SELECT instrument, ts_open + {HOUR} AS ts, CAST(change AS BIGINT) AS change, CAST(price AS BIGINT) AS price, leg, unsure AS path_sensitive FROM run WHERE leg IS NOT NULL")
def _(spark, d):
    return _bracket_exits(spark, d)


@query("path_sensitivity", f"{BRACKETS} SELECT instrument, count(*) AS exits, CAST(sum(CAST(unsure AS INT)) AS BIGINT) AS unsure, sum(CAST(unsure AS INT)) / count(*) AS share FROM run WHERE leg IS NOT NULL GROUP BY 1")
def _(spark, d):
    exits = _bracket_exits(spark, d).groupBy("instrument")
    return exits.agg(F.count(F.lit(1)).alias("exits"), F.sum(F.col("path_sensitive").cast("long")).alias("unsure")).withColumn("share", F.col("unsure") / F.col("exits"))


@query("cancelled_orders", f"""WITH {TARGETS}, l AS (SELECT instrument, ts_open, target, lag(target) OVER {O} AS before, row_number() OVER (PARTITION BY instrument ORDER BY ts_open DESC) AS back FROM targets)
SELECT instrument, ts_open + {HOUR} AS ts, CAST(target - coalesce(before, 0) AS BIGINT) AS change FROM l WHERE back = 1 AND target <> coalesce(before, 0)""")
def _(spark, d):
    targets = replay.sma_cross_targets(bars_1h(spark, d), FAST, SLOW)
    return replay.bracket_replay(targets, HOUR, SPEC, COSTS, None, None, "cancelled")


RETS = f"""rets AS (SELECT *, CASE WHEN lag(equity) OVER {O} > 0 THEN CAST(equity AS DOUBLE) / lag(equity) OVER {O} - 1 END AS ret, max(equity) OVER {RUN} AS peak FROM curve)"""
PER_YEAR = 6048.0


@query("summary_metrics", f"""WITH {CURVE}, {RETS}, {TRADES} SELECT instrument, count(*) AS bars, first(equity ORDER BY ts_open) AS first_equity, last(equity ORDER BY ts_open) AS final_equity,
round((last(equity ORDER BY ts_open) - first(equity ORDER BY ts_open)) / CAST(first(equity ORDER BY ts_open) AS DOUBLE) * 100, 6) AS return_pct,
round(max(CASE WHEN peak > 0 THEN CAST(peak - equity AS DOUBLE) / peak END) * 100, 6) AS max_drawdown_pct,
round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt({PER_YEAR}) END, 6) AS sharpe,
round((avg(ret * ret * ret * 1e6) - 3 * avg(ret * 100) * avg(ret * ret * 1e4) + 2 * avg(ret * 100) ** 3) / nullif(var_pop(ret * 100), 0) ** 1.5, 4) AS skew, round(kurtosis_pop(ret) + 3, 4) AS kurtosis, CAST(sum(fee) AS BIGINT) AS fees,
coalesce(any_value(t.round_trips), 0) AS round_trips, round(any_value(t.win_rate), 6) AS win_rate
FROM rets LEFT JOIN (SELECT instrument, count(*) AS round_trips, avg(CAST(net > 0 AS INT)) AS win_rate FROM trades GROUP BY 1) t USING (instrument) GROUP BY 1""")
def _(spark, d):
    curve = sma_cross(spark, d)
    s = metrics.summary(curve, PER_YEAR, trades=replay.closed_trades(curve, SPEC, COSTS, HOUR))
    return s.withColumns({c: F.round(c, 6) for c in ("return_pct", "max_drawdown_pct", "sharpe", "win_rate")} | {c: F.round(c, 4) for c in ("skew", "kurtosis")})


@query("drawdown", f"WITH {CURVE}, {RETS} SELECT instrument, ts_open, peak, round(CASE WHEN peak > 0 THEN CAST(peak - equity AS DOUBLE) / peak END, 9) AS drawdown FROM rets")
def _(spark, d):
    return metrics.drawdowns(sma_cross(spark, d)).select("instrument", "ts_open", "peak", F.round("drawdown", 9).alias("drawdown"))


SUMS = "count(x) AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4"
CENTRAL = """c AS (SELECT *, s1 / n AS mean, s2 / n - (s1 / n) * (s1 / n) AS m2, s3 / n - 3 * (s1 / n) * s2 / n + 2 * (s1 / n) ** 3 AS m3,
 s4 / n - 4 * (s1 / n) * s3 / n + 6 * (s1 / n) ** 2 * s2 / n - 3 * (s1 / n) ** 4 AS m4 FROM s)"""
SHAPE = "round(CASE WHEN n >= 2 AND m2 > 0 THEN m3 / m2 ** 1.5 END, 5) AS skew, round(CASE WHEN n >= 2 AND m2 > 0 THEN m4 / (m2 * m2) END, 5) AS kurtosis"


@query("return_moments", f"WITH {CURVE}, {RETS}, s AS (SELECT instrument, {SUMS} FROM (SELECT instrument, ret * 100 AS x FROM rets) GROUP BY 1), {CENTRAL} SELECT instrument, n, {SHAPE} FROM c")
def _(spark, d):
    r = metrics.bar_returns(sma_cross(spark, d))
    skew, kurt = metrics.shape()
    return r.groupBy("instrument").agg(*metrics.moments(F.col("ret"))).select("instrument", "n", F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurtosis"))


@query("moment_combine", f"WITH {CURVE}, {RETS}, s AS (SELECT {SUMS} FROM (SELECT ret * 100 AS x FROM rets)), {CENTRAL} SELECT n, {SHAPE} FROM c")
def _(spark, d):
    r = metrics.bar_returns(sma_cross(spark, d))
    skew, kurt = metrics.shape()
    parts = r.groupBy("instrument").agg(*metrics.moments(F.col("ret")))
    return metrics.combine_moments(parts, "instrument").select("n", F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurtosis"))


DAYS = f"""bd AS (SELECT *, CAST((ts_open + {HOUR} - 1) // {DAY_NS} AS BIGINT) AS day, row_number() OVER {O} - 1 AS bar FROM curve),
dc AS (SELECT instrument, day, last(equity ORDER BY ts_open) AS c FROM bd GROUP BY 1, 2),
dopen AS (SELECT instrument, day, coalesce(lag(c) OVER (PARTITION BY instrument ORDER BY day), {CASH}) AS day_open FROM dc),
dp AS (SELECT bd.*, equity - day_open AS pnl FROM bd JOIN dopen USING (instrument, day)),
dd AS (SELECT *, greatest(0, max(pnl) OVER (PARTITION BY instrument, day ORDER BY ts_open ROWS UNBOUNDED PRECEDING)) - pnl AS dropped FROM dp),
days AS (SELECT instrument, day, min(bar) AS bar_lo, max(bar) + 1 AS bar_hi, last(pnl ORDER BY ts_open) AS close_pnl, greatest(0, max(pnl)) AS peak_from_open,
  least(0, min(pnl)) AS trough_from_open, max(dropped) AS max_drop FROM dd GROUP BY 1, 2)"""


def _days(spark, d):
    return metrics.account_days(sma_cross(spark, d), day_known(HOUR), CASH)


@query("account_days", f"WITH {CURVE}, {DAYS} SELECT * FROM days")
def _(spark, d):
    return _days(spark, d)


@query("worst_day_percentiles", f"""WITH {CURVE}, {DAYS} SELECT instrument, quantile_disc(close_pnl, 0.05) AS p5, quantile_disc(close_pnl, 0.25) AS p25, quantile_disc(close_pnl, 0.5) AS p50 FROM days GROUP BY 1""")
def _(spark, d):
    return metrics.nearest_rank(_days(spark, d), "close_pnl", [5, 25, 50])


@query("peak_crossing", f"WITH {CURVE} SELECT instrument, min(ts_open) AS crossed_ts FROM curve WHERE equity >= {CASH + 5_000 * 10**9} GROUP BY 1")
def _(spark, d):
    return metrics.first_crossing(sma_cross(spark, d), CASH + 5_000 * 10**9)


@query("run_high_water", f"""WITH {CURVE}, h AS (SELECT *, equity - {CASH} AS gain, greatest(0, max(equity - {CASH}) OVER {RUN}) AS water FROM curve)
SELECT instrument, max(water) AS peak_pnl, max(water - gain) AS max_drop FROM h GROUP BY 1""")
def _(spark, d):
    return metrics.run_high_water(sma_cross(spark, d), CASH)


@query("first_insolvent_bar", f"""WITH {CURVE}, b AS (SELECT *, row_number() OVER {O} - 1 AS bar FROM curve), g AS (SELECT instrument, count(*) AS bars, min(CASE WHEN equity <= 0 THEN bar END) AS first_bar FROM b GROUP BY 1)
SELECT *, round(first_bar / bars, 9) AS run_share FROM g""")
def _(spark, d):
    return metrics.first_insolvent(sma_cross(spark, d)).withColumn("run_share", F.round("run_share", 9))


# ---------------------------------------------------------------- rolls

ADJ = f"""{CONTRACT_BARS}, ct AS (SELECT root, contract, CAST(right(contract, 1) AS INT) AS seq, max(day) AS last_day FROM cs GROUP BY 1, 2),
nx AS (SELECT *, lead(contract) OVER (PARTITION BY root ORDER BY seq) AS nxt, row_number() OVER (PARTITION BY root ORDER BY seq) AS place FROM ct),
pr AS (SELECT a.root, a.contract AS front, n.nxt AS next, a.day, a.volume AS fv, coalesce(b.volume, 0) AS nv, a.close AS fc, b.close AS nc, a.avail_ts AS fa, b.avail_ts AS na
 FROM cs a JOIN nx n ON a.contract = n.contract LEFT JOIN cs b ON b.contract = n.nxt AND b.day = a.day WHERE n.nxt IS NOT NULL)"""


def _contract_sessions(spark, d):
    return contract_sessions(spark, d).withColumn("seq", F.substring("contract", -1, 1).cast("int"))


def _pairs(spark, d):
    s = _contract_sessions(spark, d)
    return rolls.adjacent(s, s.select("root", "contract", "seq").distinct())


@query("roll_crossover", f"""WITH {ADJ}, w AS (SELECT *, nv > fv AS win, sum(CAST(nv <= fv AS INT)) OVER (PARTITION BY front ORDER BY day ROWS UNBOUNDED PRECEDING) AS losses FROM pr),
st AS (SELECT *, sum(CAST(win AS INT)) OVER (PARTITION BY front, losses ORDER BY day ROWS UNBOUNDED PRECEDING) AS streak FROM w)
SELECT front, next, min(day) AS roll_day FROM st WHERE streak >= 2 GROUP BY 1, 2""")
def _(spark, d):
    return rolls.crossover_streaks(_pairs(spark, d), 2)


CONTRACTS = 4


def _chain_sql(rule: str) -> str:
    """The chain contract by contract: `rule` is true on a session that rolls, given the day `after` of the last roll."""
    steps = ["s0 AS (SELECT root, contract, CAST(-1000000 AS BIGINT) AS after FROM nx WHERE place = 1)"]
    for k in range(1, CONTRACTS):
        steps.append(
            f"""d{k} AS (SELECT p.root, p.front, p.next, coalesce(min(p.day) FILTER ({rule}), CASE WHEN any_value(f.last_day) < any_value(n.last_day) THEN max(p.day) FILTER (nc IS NOT NULL) END) AS day
 FROM pw p JOIN s{k - 1} s ON p.front = s.contract JOIN ct f ON f.contract = p.front JOIN ct n ON n.contract = p.next WHERE p.day > s.after GROUP BY 1, 2, 3),
s{k} AS (SELECT root, next AS contract, day AS after FROM d{k} WHERE day IS NOT NULL)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM d{k} WHERE day IS NOT NULL" for k in range(1, CONTRACTS))
    return ",\n".join(steps) + f""", ch AS ({every}),
rolls AS (SELECT c.root, c.front AS from_contract, c.next AS to_contract, c.day, greatest(fa, na) AS roll_ts, nc - fc AS adjustment FROM ch c JOIN pr p ON p.front = c.front AND p.day = c.day)"""


#: Rolls by volume, the next contract ahead in two sessions of the front one in a row.
ROLLS = f"""{ADJ}, pw AS (SELECT *, nv > fv AS win, lag(nv > fv) OVER w AS pwin, lag(day) OVER w AS pday FROM pr WINDOW w AS (PARTITION BY front ORDER BY day)),
{_chain_sql("win AND pwin AND pday > s.after")},
win AS (SELECT root, from_contract AS contract, coalesce(lag(roll_ts) OVER (PARTITION BY root ORDER BY roll_ts), -(1::BIGINT << 62)) AS after, roll_ts AS until,
  CAST(sum(adjustment) OVER (PARTITION BY root ORDER BY roll_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS "offset" FROM rolls
 UNION ALL SELECT root, arg_max(to_contract, roll_ts), max(roll_ts), 1::BIGINT << 62, 0 FROM rolls GROUP BY 1)"""


def _rolls(spark, d):
    return rolls.build_chain(_contract_sessions(spark, d), 2)


@query("roll_chain", f"WITH {ROLLS} SELECT * FROM rolls")
def _(spark, d):
    return _rolls(spark, d)


#: What is said of each contract's expiry, every session anew, and the rolls two days before what is known of it.
STATED = "st AS (SELECT root, contract, avail_ts, 19730 + 7 * CAST(right(contract, 1) AS BIGINT) + day % 5 AS expiry_day FROM cs)"
CALENDAR_ROLLS = f"""{ADJ}, {STATED}, kn AS (SELECT pr.*, st.expiry_day AS known FROM pr ASOF LEFT JOIN st ON st.contract = pr.front AND greatest(pr.fa, pr.na) >= st.avail_ts),
pw AS (SELECT * FROM kn), {_chain_sql("nc IS NOT NULL AND p.day >= known - 2")}"""


def _stated(spark, d):
    return _contract_sessions(spark, d).select("root", "contract", "avail_ts", (F.col("seq") * 7 + 19730 + F.col("day") % 5).alias("expiry_day"))


def _calendar_rolls(spark, d):
    return rolls.build_chain(_contract_sessions(spark, d), expiries=_stated(spark, d), days=2)


@query("roll_calendar_asof", f"WITH {CALENDAR_ROLLS} SELECT * FROM rolls")
def _(spark, d):
    return _calendar_rolls(spark, d)


@query("back_adjust", f"WITH {ROLLS} SELECT *, CAST(sum(adjustment) OVER (PARTITION BY root ORDER BY roll_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS \"offset\" FROM rolls")
def _(spark, d):
    return rolls.back_adjust(_rolls(spark, d), "root")


@query("front_windows", f"WITH {ROLLS} SELECT * FROM win")
def _(spark, d):
    return rolls.front_windows(_rolls(spark, d), "root")


STITCHED = f"""{ROLLS}, stitched AS (SELECT cb.*, "offset" AS signal_offset FROM cb JOIN win USING (root, contract) WHERE ts_open + {HOUR} > after AND ts_open + {HOUR} <= until)"""


@query("stitched_series", f"WITH {STITCHED} SELECT * FROM stitched")
def _(spark, d):
    return rolls.stitch(contract_bars(spark, d), rolls.front_windows(_rolls(spark, d), "root"), "root", HOUR)


@query("segment_report", f"WITH {STITCHED} SELECT root, contract, signal_offset, count(*) AS bars FROM stitched GROUP BY 1, 2, 3")
def _(spark, d):
    s = rolls.stitch(contract_bars(spark, d), rolls.front_windows(_rolls(spark, d), "root"), "root", HOUR)
    return s.groupBy("root", "contract", "signal_offset").agg(F.count(F.lit(1)).alias("bars"))


@query("roll_gap_bound", f"WITH {ROLLS} SELECT root, CAST(sum(abs(adjustment)) * {SPEC.point_value} AS BIGINT) AS bound FROM rolls GROUP BY 1")
def _(spark, d):
    return _rolls(spark, d).groupBy("root").agg((F.sum(F.abs("adjustment")) * SPEC.point_value).alias("bound"))


OBS = "ob AS (SELECT 'C' || (user_id % 20) AS contract, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS avail_ts, CAST(20000 + user_id % 20 + epoch_us(ts) // 86400000000 // 10 AS BIGINT) AS expiration FROM events)"
REVS = f"{OBS}, rv AS (SELECT contract, expiration, min(avail_ts) AS avail_ts, max(avail_ts) AS last_avail_ts, count(*) AS records FROM ob GROUP BY 1, 2)"


def _observed(spark, d):
    from ..sources.bars import epoch_us, table

    day = F.expr("us div 86400000000")
    return table(spark, d, "events").select(F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string")).alias("contract"), "user_id", epoch_us("ts").alias("us")).select(
        "contract", day.alias("avail_ts"), (F.col("user_id") % 20 + 20000 + F.expr("us div 86400000000 div 10")).alias("expiration")
    )


@query("expiry_revisions", f"WITH {REVS} SELECT *, coalesce(lead(avail_ts) OVER (PARTITION BY contract ORDER BY avail_ts, expiration) <= last_avail_ts, false) AS conflict FROM rv")
def _(spark, d):
    return rolls.revisions(_observed(spark, d))


@query("expiry_asof", f"""WITH {REVS}, q AS (SELECT 'C' || (c_custkey % 22) AS contract, 19720 + c_custkey % 40 AS decision_ts, c_custkey FROM customer)
SELECT q.contract, q.decision_ts, c_custkey, rv.expiration FROM q ASOF LEFT JOIN rv ON q.contract = rv.contract AND q.decision_ts >= rv.avail_ts""")
def _(spark, d):
    from ..sources.bars import table

    k = F.col("c_custkey")
    q = table(spark, d, "customer").select(F.concat(F.lit("C"), (k % 22).cast("string")).alias("contract"), (k % 40 + 19720).alias("decision_ts"), k)
    return rolls.expiry_as_of(q, rolls.revisions(_observed(spark, d)))


# ---------------------------------------------------------------- evidence

HORIZON = 6 * HOUR
SCORED = f"""sd AS (SELECT instrument, ts_open + {HOUR} AS ts, CASE WHEN row_number() OVER {O} >= 5 THEN round((close / 1e9) / (avg(close / 1e9) OVER (PARTITION BY instrument ORDER BY ts_open ROWS 4 PRECEDING)) - 1, 9) END AS score, close AS price, (ts_open + {HOUR} - 1) // {DAY_NS} AS session_key FROM b1h),
fw AS (SELECT *, max(ts) OVER (PARTITION BY instrument) AS end_ts, last_value(ts) OVER r AS exit_ts, last_value(price) OVER r AS exit FROM sd WINDOW r AS (PARTITION BY instrument ORDER BY ts RANGE BETWEEN CURRENT ROW AND {HORIZON} FOLLOWING)),
fr AS (SELECT *, CASE WHEN score IS NULL THEN 'no_score' WHEN ts + {HORIZON} > end_ts THEN 'beyond_end' WHEN exit_ts <= ts THEN 'no_partner' WHEN price = 0 OR exit = 0 THEN 'bad_price' ELSE 'ok' END AS status FROM fw),
pairs AS (SELECT instrument, ts, score, price, exit, session_key, CAST(exit AS DOUBLE) / price - 1 AS fwd_return FROM fr WHERE status = 'ok')"""


def _scored(spark, d):
    from ..operators.indicators import sma
    from ..functions.prices import points

    c = points(F.col("close"))
    return bars_1h(spark, d).select("instrument", (F.col("ts_open") + HOUR).alias("ts"), F.round(c / sma(c, 5) - 1, 9).alias("score"), F.col("close").alias("price"), day_known(HOUR).alias("session_key"))


def _pairs_scored(spark, d):
    return asof.forward_returns(_scored(spark, d), HORIZON).where("status = 'ok'")


@query("forward_return_asof", f"WITH {B1H}, {SCORED} SELECT instrument, ts, exit_ts, exit, status, round(CASE WHEN status = 'ok' THEN CAST(exit AS DOUBLE) / price - 1 END, 9) AS fwd_return FROM fr")
def _(spark, d):
    return asof.forward_returns(_scored(spark, d), HORIZON).select("instrument", "ts", "exit_ts", "exit", "status", F.round("fwd_return", 9).alias("fwd_return"))


@query("forward_return_drops", f"WITH {B1H}, {SCORED} SELECT instrument, status, count(*) AS n FROM fr GROUP BY 1, 2")
def _(spark, d):
    return asof.forward_returns(_scored(spark, d), HORIZON).groupBy("instrument", "status").agg(F.count(F.lit(1)).alias("n"))


@query("information_coefficient", f"""WITH {B1H}, {SCORED}, k AS (SELECT instrument, rank() OVER (PARTITION BY instrument ORDER BY score) + (count(*) OVER (PARTITION BY instrument, score) - 1) / 2 AS rs,
 rank() OVER (PARTITION BY instrument ORDER BY fwd_return) + (count(*) OVER (PARTITION BY instrument, fwd_return) - 1) / 2 AS rr FROM pairs)
SELECT instrument, count(*) AS n, round(corr(rs, rr), 6) AS ic, CAST(NULL AS VARCHAR) AS reason FROM k GROUP BY 1""")
def _(spark, d):
    return stats.information_coefficient(_pairs_scored(spark, d), ("instrument",)).withColumn("ic", F.round("ic", 6))


@query("score_buckets", f"""WITH {B1H}, {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY score, ts) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM pairs)
SELECT instrument, (rn * 5 - 1) // n AS bucket, min(score) AS lo, max(score) AS hi, count(*) AS n, round(avg(fwd_return), 6) AS mean_return, round(avg(CAST(exit - price AS DOUBLE) / {TICK}), 4) AS mean_ticks FROM k WHERE n >= 5 GROUP BY 1, 2""")
def _(spark, d):
    b = stats.score_buckets(_pairs_scored(spark, d), 5, TICK, ("instrument",), "ts")
    return b.withColumns({"mean_return": F.round("mean_return", 6), "mean_ticks": F.round("mean_ticks", 4)})


@query("session_bootstrap")
def _(spark, d):
    return stats.session_bootstrap(_pairs_scored(spark, d), 500, 42, ("instrument",))


PLAN = walkforward.fold_plan(30, 8, 4, 4)
PLAN_SQL = "folds(fold, part, day_lo, day_hi) AS (VALUES " + ", ".join(f"({f}, '{p}', {a}, {b})" for f, p, a, b in PLAN) + ")"


def _folds(spark):
    return spark.createDataFrame(PLAN, "fold int, part string, day_lo long, day_hi long")


@query("fold_plan", f"WITH {PLAN_SQL} SELECT CAST(fold AS INT) AS fold, part, CAST(day_lo AS BIGINT) AS day_lo, CAST(day_hi AS BIGINT) AS day_hi FROM folds")
def _(spark, d):
    return _folds(spark)


NUMBERED = f"""nd AS (SELECT *, row_number() OVER {O} - 1 AS bar, dense_rank() OVER (PARTITION BY instrument ORDER BY (ts_open + {HOUR} - 1) // {DAY_NS}) - 1 AS day_index,
 equity - coalesce(lag(equity) OVER {O}, {CASH}) AS delta FROM curve), {PLAN_SQL},
fi AS (SELECT * FROM nd JOIN folds ON day_index >= day_lo AND day_index < day_hi)"""


def _numbered(spark, d):
    return walkforward.number_days(sma_cross(spark, d), HOUR, DAY_NS)


@query("fold_window_metrics", f"WITH {CURVE}, {NUMBERED} SELECT instrument, fold, part, min(bar) AS bar_lo, max(bar) + 1 AS bar_hi, CAST(sum(delta) AS BIGINT) AS gain, round(CAST(sum(delta) AS DOUBLE) / {CASH} * 100, 6) AS return_pct FROM fi GROUP BY 1, 2, 3")
def _(spark, d):
    return walkforward.fold_returns(_numbered(spark, d), _folds(spark), CASH).withColumn("return_pct", F.round("return_pct", 6))


@query("oos_stitched", f"WITH {CURVE}, {NUMBERED} SELECT instrument, bar, fold, CAST({CASH} + sum(delta) OVER (PARTITION BY instrument ORDER BY bar ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM fi WHERE part = 'test'")
def _(spark, d):
    return walkforward.stitched(_numbered(spark, d), _folds(spark), CASH).select("instrument", "bar", "fold", "equity")


@query("union_of_windows", f"WITH {CURVE}, {NUMBERED}, w AS (SELECT instrument, min(bar) AS s, max(bar) + 1 AS e FROM fi WHERE part = 'train' GROUP BY instrument, fold) SELECT instrument, min(s) AS \"start\", max(e) AS \"end\" FROM w GROUP BY 1")
def _(spark, d):
    w = walkforward.fold_returns(_numbered(spark, d), _folds(spark), CASH).where("part = 'train'").select("instrument", F.col("bar_lo").alias("start"), F.col("bar_hi").alias("end"))
    return asof.merge_intervals(w, ["instrument"])


#: A performance matrix of eight folds from the monthly orders of 25 nations.
PERF = """perf AS (SELECT c_nationkey AS combo, CAST(o_orderkey % 8 AS INT) AS fold, round(avg(o_totalprice), 2) AS ret FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _perf(spark, d):
    from ..sources.bars import table

    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("combo"), (F.col("o_orderkey") % 8).cast("int").alias("fold")).agg(F.round(F.avg("o_totalprice"), 2).alias("ret"))


@query("pbo_cscv", f"""WITH {PERF}, m AS (SELECT k AS mask FROM range(256) t(k) WHERE bit_count(CAST(k AS INT)) = 4),
sc AS (SELECT mask, combo, avg(CASE WHEN (mask >> fold) & 1 = 1 THEN ret END) AS i, avg(CASE WHEN (mask >> fold) & 1 = 0 THEN ret END) AS o FROM perf, m GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY i DESC, combo) AS rn, count(*) OVER (PARTITION BY mask) AS combos FROM sc),
w AS (SELECT mask, combo AS wc, o AS wo, combos FROM b WHERE rn = 1),
r AS (SELECT w.mask, any_value(combos) AS combos, sum(CAST(o < wo OR (o = wo AND combo <= wc) AS INT)) AS rank FROM sc JOIN w USING (mask) GROUP BY 1)
SELECT count(*) AS splits, CAST(sum(CAST(2 * rank <= combos + 1 AS INT)) AS BIGINT) AS overfit, round(sum(CAST(2 * rank <= combos + 1 AS INT)) / count(*), 6) AS pbo FROM r""")
def _(spark, d):
    return stats.overfitting(_perf(spark, d), 8).withColumn("pbo", F.round("pbo", 6))


@query("sharpe_dispersion", f"WITH {CURVE}, {RETS}, s AS (SELECT instrument, avg(ret) / nullif(stddev_samp(ret), 0) AS sr FROM rets GROUP BY 1) SELECT count(sr) AS trials, round(stddev_samp(sr), 6) AS dispersion FROM s")
def _(spark, d):
    r = metrics.bar_returns(sma_cross(spark, d)).groupBy("instrument").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sr"))
    return r.agg(F.count("sr").alias("trials"), F.round(F.stddev_samp("sr"), 6).alias("dispersion"))


def _horner(cs, x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inverse_sql(p: str) -> str:
    """The inverse normal distribution spelled out."""
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    tail = lambda x: f"({_horner(prices._C, x)} / ({_horner(prices._D, x)} * {x} + 1.0))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    middle = f"({_horner(prices._A, r)} * {q} / ({_horner(prices._B, r)} * {r} + 1.0))"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -{tail(high)} ELSE {middle} END)"


def _deflated_sql() -> str:
    best = f"(CASE WHEN trials <= 1 THEN 0.0 ELSE (1 - {prices.EULER_GAMMA}) * {_inverse_sql('(1 - 1.0 / trials)')} + {prices.EULER_GAMMA} * {_inverse_sql('(1 - 1.0 / (trials * 2.718281828459045))')} END)"
    poly = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t"
    return f"""WITH {CURVE}, {RETS}, m AS (SELECT instrument, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, (avg(ret * ret * ret * 1e6) - 3 * avg(ret * 100) * avg(ret * ret * 1e4) + 2 * avg(ret * 100) ** 3) / nullif(var_pop(ret * 100), 0) ** 1.5 AS skew, kurtosis_pop(ret) + 3 AS kurt FROM rets GROUP BY 1),
d AS (SELECT stddev_samp(sr) AS dispersion, count(*) AS trials FROM m), v AS (SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS se FROM m, d),
z AS (SELECT *, (sr - dispersion * {best}) / se AS z FROM v), e AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z),
c AS (SELECT *, 1.0 - {poly} * exp(-abs(z) / sqrt(2.0) * abs(z) / sqrt(2.0)) AS erf FROM e)
SELECT instrument, n, round(sr, 6) AS sr, round(CASE WHEN z >= 0 THEN (1.0 + erf) / 2.0 ELSE (1.0 - erf) / 2.0 END, 6) AS dsr FROM c"""


@query("deflated_sharpe", _deflated_sql())
def _(spark, d):
    r = metrics.bar_returns(sma_cross(spark, d))
    skew, kurt = metrics.shape()
    per = r.groupBy("instrument").agg(*metrics.moments(F.col("ret"))).select("instrument", "n", metrics.sharpe().alias("sr"), skew.alias("skew"), kurt.alias("kurt"))
    spread = per.agg(F.stddev_samp("sr").alias("dispersion"), F.count(F.lit(1)).alias("trials"))
    out = per.crossJoin(F.broadcast(spread))  # one row
    dsr = stats.deflated_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), F.col("trials"), F.col("dispersion"))
    return out.select("instrument", "n", F.round("sr", 6).alias("sr"), F.round(dsr, 6).alias("dsr"))


def _path_gain(spark, paths):
    """What the strategy earns on series of closes, each bar opening at the close before it."""
    over = Window.partitionBy("instrument").orderBy("ts_open")
    bars = paths.withColumn("open", F.coalesce(F.lag("close").over(over), F.col("close")))
    curve = replay.equity(replay.sma_cross_targets(bars, FAST, SLOW), SPEC, COSTS)
    return curve.groupBy("instrument").agg((F.max_by("equity", "ts_open") - CASH).cast("double").alias("gain"))


@query("permutation_null")
def _(spark, d):
    b = bars_1h(spark, d)
    paths = stats.block_shuffled(b, 50, 24, 29)
    # Each draw is a series of its own, on which the whole strategy is run again.
    named = paths.select(F.concat_ws("|", "instrument", "draw").alias("instrument"), F.col("step").cast("long").alias("ts_open"), "close")
    null = _path_gain(spark, named).select(F.substring_index("instrument", "|", 1).alias("instrument"), F.col("gain").alias("null"))
    observed = _path_gain(spark, b.select("instrument", "ts_open", "close")).withColumnRenamed("gain", "observed")
    return stats.permutation_p(observed, null, ("instrument",))


def _truncation_sql() -> str:
    """Targets over all bars and over the first 300 of each instrument, compared."""
    whole = f"{B1H}, nb AS (SELECT *, row_number() OVER {O} AS i FROM b1h)"
    one = lambda name, where: f"{name} AS (WITH b1h AS (SELECT * FROM nb{where}), {_targets_sql(FAST, SLOW)} SELECT instrument, i, target FROM targets)"
    return f"""WITH {whole}, {one('al', '')}, {one('cu', ' WHERE i <= 300')}
SELECT b.instrument, count(*) FILTER (a.target IS DISTINCT FROM c.target) AS mismatches FROM nb b LEFT JOIN al a ON a.instrument = b.instrument AND a.i = b.i LEFT JOIN cu c ON c.instrument = b.instrument AND c.i = b.i WHERE b.i <= 300 GROUP BY 1"""


@query("truncation_invariance", _truncation_sql())
def _(spark, d):
    b = bars_1h(spark, d)
    number = lambda t: t.withColumn("i", F.row_number().over(Window.partitionBy("instrument").orderBy("ts_open")))
    whole = number(replay.sma_cross_targets(b, FAST, SLOW))
    cut = number(replay.sma_cross_targets(number(b).where("i <= 300").drop("i"), FAST, SLOW))
    bad = stats.truncation_mismatches(whole, cut, 300).groupBy("instrument").agg(F.count(F.lit(1)).alias("m"))
    return b.select("instrument").distinct().join(bad, "instrument", "left").select("instrument", F.coalesce("m", F.lit(0)).cast("long").alias("mismatches"))


@query("assess_verdicts", f"""WITH {CURVE}, {RETS}, {TRADES}, e AS (SELECT instrument, last(equity ORDER BY ts_open) - {CASH} AS gain, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) END AS sr FROM rets GROUP BY 1),
n AS (SELECT instrument, count(*) AS n_trades FROM trades GROUP BY 1), j AS (SELECT e.*, n_trades FROM e LEFT JOIN n USING (instrument)),
s AS (SELECT *, coalesce(n_trades >= 10, false) AS a, coalesce(gain > 0, false) AS b, coalesce(sr > 0.05, false) AS c FROM j)
SELECT instrument, CASE WHEN NOT a THEN 'admission:too_few_trades' WHEN NOT b OR NOT c THEN array_to_string(list_filter([CASE WHEN NOT b THEN 's1:no_gain' END, CASE WHEN b AND NOT c THEN 's2:weak' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS reasons,
CASE WHEN a AND b AND c THEN 'iterate' ELSE 'kill' END AS verdict FROM s""")
def _(spark, d):
    curve = sma_cross(spark, d)
    r = metrics.bar_returns(curve).groupBy("instrument").agg(
        (F.max_by("equity", "ts_open") - CASH).alias("gain"), F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret")).alias("sr")
    )
    n = replay.closed_trades(curve, SPEC, COSTS, HOUR).groupBy("instrument").agg(F.count(F.lit(1)).alias("n_trades"))
    stages = [("admission", [("too_few_trades", F.col("n_trades") >= 10)]), ("s1", [("no_gain", F.col("gain") > 0)]), ("s2", [("weak", F.col("sr") > 0.05)])]
    return funnel.assess(r.join(n, "instrument", "left"), stages).select("instrument", "reasons", "verdict")


@query("pool_sessions", f"""WITH {CONTRACT_BARS}, p AS (SELECT root, contract, count(DISTINCT day) AS d FROM cs GROUP BY 1, 2), u AS (SELECT root, count(DISTINCT day) AS sessions FROM cs GROUP BY 1)
SELECT root, CAST(sum(d) AS BIGINT) AS summed, count(*) AS contracts, any_value(sessions) AS sessions, CAST(sum(d) - any_value(sessions) AS BIGINT) AS overlap FROM p JOIN u USING (root) GROUP BY 1""")
def _(spark, d):
    return funnel.pool_sessions(contract_sessions(spark, d), "root")


@query("pool_gaps", """WITH s AS (SELECT o_orderpriority AS root, CAST(o_custkey AS VARCHAR) AS contract, CAST(min(epoch_us(o_orderdate) // 86400000000) AS BIGINT) AS f, CAST(min(epoch_us(o_orderdate) // 86400000000) + o_custkey % 3 AS BIGINT) AS l FROM orders GROUP BY 1, o_custkey),
n AS (SELECT *, lead(f) OVER w AS nf, lead(contract) OVER w AS follow FROM s WINDOW w AS (PARTITION BY root ORDER BY f, l, contract))
SELECT root, contract, follow, nf - l - 1 AS gap_days FROM n WHERE nf > l + 1""")
def _(spark, d):
    from ..sources.bars import epoch_us, table

    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("root"), "o_custkey").agg(F.min(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate) div 86400000000")).alias("first_day"))
    s = s.withColumn("last_day", F.col("first_day") + F.col("o_custkey") % 3).withColumn("contract", F.col("o_custkey").cast("string"))
    return funnel.pool_gaps(s, "root")


# ---------------------------------------------------------------- pooling and controls


@query("pooled_cost_sweep", f"WITH {TARGETS}, " + ",\n".join(
    f"p{h} AS (WITH {equity_sql(replay.Costs(h, COSTS.fee, TICK))} SELECT {h} AS half_ticks, count(*) AS bars, CAST(sum(fee) AS BIGINT) AS fees, CAST(sum(equity - prev) AS BIGINT) AS gain FROM (SELECT *, coalesce(lag(equity) OVER {O}, {CASH}) AS prev FROM curve))" for h in LEVELS
) + " " + " UNION ALL ".join(f"SELECT * FROM p{h}" for h in LEVELS))
def _(spark, d):
    targets = replay.sma_cross_targets(bars_1h(spark, d), FAST, SLOW)
    each = replay.cost_levels(targets, SPEC, LEVELS, COSTS.fee, TICK)
    return each.groupBy("half_ticks").agg(F.sum("bars").alias("bars"), F.sum("fees").alias("fees"), F.sum(F.col("final_equity") - CASH).alias("gain"))


@query("trial_composition", """SELECT o_orderpriority AS family, count(DISTINCT o_custkey % 50) * count(DISTINCT o_orderstatus) * 4 - count(*) FILTER (o_orderkey % 997 = 0) AS trials FROM orders GROUP BY 1""")
def _(spark, d):
    from ..sources.bars import table

    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("family")).agg(
        (F.countDistinct(F.col("o_custkey") % 50) * F.countDistinct("o_orderstatus") * 4 - F.sum((F.col("o_orderkey") % 997 == 0).cast("long"))).alias("trials")
    )


def _bar_trades(spark, d):
    curve = sma_cross(spark, d)
    at = curve.select("instrument", (F.col("ts_open") + HOUR).alias("ts"), (F.row_number().over(Window.partitionBy("instrument").orderBy("ts_open")) - 1).alias("bar"))
    t = replay.closed_trades(curve, SPEC, COSTS, HOUR)
    opened = at.select("instrument", F.col("ts").alias("opened_ts"), F.col("bar").alias("opened"))
    closed = at.select("instrument", F.col("ts").alias("closed_ts"), F.col("bar").alias("closed"))
    return t.join(opened, ["instrument", "opened_ts"]).join(closed, ["instrument", "closed_ts"]).select("instrument", "opened", "closed", "direction")


@query("random_entry")
def _(spark, d):
    b = bars_1h(spark, d)
    trades = _bar_trades(spark, d)
    final = F.max_by("equity", "ts_open").alias("final_equity")
    targets = controls.random_entry_draws(b, trades, list(range(controls.RANDOM_ENTRY_DRAWS)))
    draws = replay.equity(targets, SPEC, COSTS, ("instrument", "draw")).groupBy("instrument", "draw").agg(final)
    return controls.median_draw(draws, sma_cross(spark, d).groupBy("instrument").agg(final), ["instrument"], "final_equity", "draw")


@query("full_sample_leak", f"""WITH {B1H}, z AS (SELECT instrument, avg(close) AS m, stddev_pop(close) AS s FROM b1h GROUP BY 1)
SELECT instrument, ts_open, CASE WHEN (close - m) / nullif(s, 0) > 1 THEN -1 WHEN (close - m) / nullif(s, 0) < -1 THEN 1 ELSE 0 END AS target FROM b1h JOIN z USING (instrument)""")
def _(spark, d):
    return controls.full_sample_targets(bars_1h(spark, d)).select("instrument", "ts_open", "target")


@query("late_corrections", f"""WITH {CALENDAR_ROLLS}, u AS (SELECT r.root, from_contract, roll_ts, st.expiry_day AS used FROM rolls r ASOF JOIN st ON st.contract = r.from_contract AND r.roll_ts >= st.avail_ts),
l AS (SELECT contract, arg_max(expiry_day, (avail_ts, expiry_day)) AS latest FROM st GROUP BY 1), f AS (SELECT st.contract, latest, min(avail_ts) AS corrected_ts FROM st JOIN l ON st.contract = l.contract AND expiry_day = latest GROUP BY 1, 2)
SELECT root, from_contract, roll_ts, used, latest, corrected_ts FROM u JOIN f ON contract = from_contract WHERE used <> latest""")
def _(spark, d):
    return rolls.late_corrections(_calendar_rolls(spark, d), _stated(spark, d).drop("root"))


@query("contract_cycle_resolve", """WITH cy AS (SELECT 'ES' || (p_partkey % 7) AS symbol, 'ES' || (p_partkey % 7) || '-' || (p_partkey // 7) AS contract, 19000 + p_partkey AS expiry FROM part),
o AS (SELECT *, coalesce(lag(expiry) OVER (PARTITION BY symbol ORDER BY expiry), expiry - 3653) AS opens FROM cy), a AS (SELECT c_custkey, 'ES' || (c_custkey % 8) AS symbol, 18980 + c_custkey AS day FROM customer)
SELECT c_custkey, a.symbol, day, CASE WHEN day > opens THEN contract END AS contract, CASE WHEN day > opens THEN expiry END AS expiry FROM a ASOF LEFT JOIN o ON a.symbol = o.symbol AND day <= expiry""")
def _(spark, d):
    from ..sources.bars import table

    k, c = F.col("p_partkey"), F.col("c_custkey")
    symbol = F.concat(F.lit("ES"), (k % 7).cast("string"))
    cycles = table(spark, d, "part").select(symbol.alias("symbol"), F.concat(symbol, F.lit("-"), F.expr("p_partkey div 7").cast("string")).alias("contract"), (k + 19000).alias("expiry"))
    asked = table(spark, d, "customer").select(c, F.concat(F.lit("ES"), (c % 8).cast("string")).alias("symbol"), (c + 18980).alias("day"))
    return rolls.resolve_cycles(asked, cycles)


@query("contract_order", """WITH s AS (SELECT p_partkey, substr('FGHJKMNQUVXZ', 1 + CAST(p_partkey % 12 AS INT), 1) AS code, 2020 + p_partkey % 15 AS y FROM part)
SELECT p_partkey, 'CL' || code || y AS contract, row_number() OVER (ORDER BY y, instr('FGHJKMNQUVXZ', code), p_partkey) AS place FROM s""")
def _(spark, d):
    from ..functions import symbols
    from ..sources.bars import table

    k = F.col("p_partkey")
    code = F.substring(F.lit(symbols.MONTH_CODES), (k % 12 + 1).cast("int"), F.lit(1))
    s = table(spark, d, "part").select(k, F.concat(F.lit("CL"), code, (k % 15 + 2020).cast("string")).alias("contract"))
    return symbols.delivery_places(s, "contract", "p_partkey")


@query("run_ids", """SELECT o_orderkey, substr(sha256(o_orderpriority || '|' || o_custkey || '|' || o_orderstatus), 1, 16) AS run_id,
sha256(length(o_orderpriority) || ':' || o_orderpriority || length(o_orderstatus) || ':' || o_orderstatus) AS identity FROM orders""")
def _(spark, d):
    from ..sources.bars import table

    return table(spark, d, "orders").select("o_orderkey", run_id(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("run_id"), identity_hash(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("identity"))
