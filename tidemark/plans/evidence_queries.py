"""Queries over exchange sessions, the first funnel stage, verdicts, pools and purchase plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import symbols
from ..functions.prices import day_known
from ..operators import asof, funnel, qa, resample, rolls, s0
from ..operators.indicators import sma
from ..schema import DAY_NS
from ..sources import logs
from ..sources.bars import event_bars, table
from .data_queries import DIM, FIRST, LAST, MINUTE, _dim
from .engine_queries import ROLLS, _rolls
from .views import _BAR, _event_ticks, B1H, HOUR, bars_1h, contract_bars

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- sessions


def _stretches(spark):
    return cal.intervals(spark, cal.GLOBEX, FIRST, LAST)


#: Slots that an instrument could have had, and those without a bar.
SLOTS = f"""ends AS (SELECT instrument, min(ts_open) AS lo, max(ts_open) + {HOUR} AS hi FROM b1h GROUP BY 1),
bounds AS (SELECT instrument, trading_day, (greatest(open_ns, lo) + {HOUR - 1}) // {HOUR} AS f, (least(close_ns, hi) + {HOUR - 1}) // {HOUR} AS a FROM ends JOIN ses ON open_ns < hi AND close_ns > lo),
slots AS (SELECT instrument, trading_day, unnest(generate_series(f, a - 1)) AS slot FROM bounds WHERE a > f),
lost AS (SELECT s.* FROM slots s ANTI JOIN b1h ON b1h.instrument = s.instrument AND b1h.ts_open // {HOUR} = s.slot),
isl AS (SELECT *, slot - row_number() OVER (PARTITION BY instrument, trading_day ORDER BY slot) AS island FROM lost),
gaps AS (SELECT instrument, trading_day, min(slot) * {HOUR} AS from_ts, (max(slot) + 1) * {HOUR} AS to_ts, count(*) AS missing FROM isl GROUP BY instrument, trading_day, island)"""


@query("gap_sessions", f"WITH {B1H}, {DIM}, {SLOTS} SELECT * FROM gaps")
def _(spark, d):
    return qa.session_gaps(bars_1h(spark, d), _stretches(spark), HOUR)


@query("coverage_sessions", f"""WITH {B1H}, {DIM}, {SLOTS}, e AS (SELECT instrument, count(*) AS expected FROM slots GROUP BY 1), m AS (SELECT instrument, count(*) AS missing FROM lost GROUP BY 1)
SELECT instrument, expected, coalesce(missing, 0) AS missing, round((expected - coalesce(missing, 0)) * 100.0 / expected, 6) AS coverage_pct FROM e LEFT JOIN m USING (instrument)""")
def _(spark, d):
    return qa.session_coverage(bars_1h(spark, d), _stretches(spark), HOUR).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("session_phases", f"""WITH {B1H}, {DIM}, p AS (SELECT instrument, CASE WHEN open_ns IS NULL THEN 'closed' WHEN ts_open < rth_open_ns THEN 'overnight' WHEN ts_open < rth_close_ns THEN 'regular' ELSE 'post_regular' END AS phase
 FROM b1h LEFT JOIN ses ON ts_open >= open_ns AND ts_open < close_ns) SELECT instrument, phase, count(*) AS n FROM p GROUP BY 1, 2""")
def _(spark, d):
    phased = cal.with_phase(bars_1h(spark, d), _dim(spark), _stretches(spark))
    return phased.groupBy("instrument", "phase").agg(F.count(F.lit(1)).alias("n"))


QUARTER = 15 * MINUTE
B15M = "b15m AS (" + _BAR.format(order="us, event_id", ticks=_event_ticks(900_000_000)) + ")"


@query("resample_session", f"""WITH {B15M}, {DIM}, j AS (SELECT b15m.*, trading_day, open_ns + (ts_open - open_ns) // {HOUR} * {HOUR} AS bucket FROM b15m JOIN ses ON ts_open + {QUARTER} > open_ns AND ts_open + {QUARTER} <= close_ns)
SELECT instrument, trading_day AS day, bucket, first(open ORDER BY ts_open) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts_open) AS close, CAST(sum(volume) AS BIGINT) AS volume,
 min(ts_open) > bucket OR max(ts_open) + {QUARTER} < bucket + {HOUR} AS partial FROM j GROUP BY 1, 2, 3""")
def _(spark, d):
    return resample.resample_sessions(event_bars(spark, d, "15m"), _dim(spark), _stretches(spark), "15m", "1h")


@query("qa_report", f"""WITH {B1H}, {DIM}, {SLOTS}, names AS (SELECT DISTINCT instrument FROM b1h),
mv AS (SELECT instrument, abs(move) AS a FROM (SELECT instrument, close - lag(close) OVER w AS move, ts_open - lag(ts_open) OVER w AS dt FROM b1h WINDOW w AS (PARTITION BY instrument ORDER BY ts_open)) WHERE dt = {HOUR}),
rk AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY a) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM mv), sc AS (SELECT instrument, n, a * 1.4826 AS sigma FROM rk WHERE rn = n // 2 + 1),
spikes AS (SELECT instrument, count(*) AS c FROM mv JOIN sc USING (instrument) WHERE n >= 3 AND sigma > 0 AND a / sigma > 8 GROUP BY 1),
outside AS (SELECT b.instrument, count(*) AS c FROM b1h b ANTI JOIN ses ON b.ts_open >= open_ns AND b.ts_open < close_ns GROUP BY 1),
bad AS (SELECT instrument, sum(CAST(high < low AS INT) + CAST(high < open OR high < close AS INT) + CAST(low > open OR low > close AS INT)) AS c FROM b1h GROUP BY 1),
r AS (SELECT instrument, 'ohlc' AS "check", NULL AS reason, c FROM names LEFT JOIN bad USING (instrument) UNION ALL SELECT instrument, 'zero_volume', NULL, 0 FROM names
UNION ALL SELECT instrument, 'spikes', CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_moves' WHEN sigma = 0 THEN 'zero_scale' END, c FROM names LEFT JOIN sc USING (instrument) LEFT JOIN spikes USING (instrument)
UNION ALL SELECT instrument, 'coverage', NULL, c FROM names LEFT JOIN (SELECT instrument, count(*) AS c FROM gaps GROUP BY 1) USING (instrument) UNION ALL SELECT instrument, 'unexpected', NULL, c FROM names LEFT JOIN outside USING (instrument))
SELECT instrument, "check", CASE WHEN reason IS NULL THEN 'ran' ELSE 'skipped' END AS status, reason, CASE WHEN reason IS NULL THEN CAST(coalesce(c, 0) AS BIGINT) END AS findings FROM r""")
def _(spark, d):
    return qa.report(bars_1h(spark, d), _stretches(spark), HOUR)


def _options_sql() -> str:
    """Closed weekdays of the options exchange, each rule written out."""
    nth = lambda name, m, dow, lo: f"SELECT '{name}' AS holiday_name, d FROM days WHERE month(d) = {m} AND isodow(d) = {dow} AND day(d) BETWEEN {lo} AND {lo + 6}"
    shifted = lambda name, m, day: f"SELECT '{name}', CASE isodow(d) WHEN 6 THEN d - INTERVAL 1 DAY WHEN 7 THEN d + INTERVAL 1 DAY ELSE d END FROM days WHERE month(d) = {m} AND day(d) = {day}"
    return f"""WITH days AS (SELECT d FROM generate_series(TIMESTAMP '2019-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) t(d)),
y AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(2019, 2027) t(y)), h AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM y),
m AS (SELECT *, (a + 11 * h) // 319 AS m FROM h), r AS (SELECT *, (2 * (b % 4) + 2 * (c // 4) - c % 4 - h + m + 32) % 7 AS r FROM m),
e AS (SELECT make_date(CAST(y AS INT), CAST((h - m + r + 90) // 25 AS INT), CAST((h - m + r + (h - m + r + 90) // 25 + 19) % 32 AS INT)) AS easter FROM r),
shut AS ({nth('martin_luther_king_day', 1, 1, 15)} UNION ALL {nth('presidents_day', 2, 1, 15)} UNION ALL {nth('memorial_day', 5, 1, 25)} UNION ALL {nth('labor_day', 9, 1, 1)} UNION ALL {nth('thanksgiving', 11, 4, 22)}
UNION ALL {shifted('independence_day', 7, 4)} UNION ALL {shifted('christmas', 12, 25)} UNION ALL {shifted('juneteenth', 6, 19)} AND year(d) >= 2022
UNION ALL SELECT 'new_year', CASE isodow(d) WHEN 7 THEN d + INTERVAL 1 DAY ELSE d END FROM days WHERE month(d) = 1 AND day(d) = 1 UNION ALL SELECT 'good_friday', easter - INTERVAL 2 DAY FROM e UNION ALL SELECT 'day_of_mourning', TIMESTAMP '2025-01-09')
SELECT CAST(d AS DATE) AS trading_day, holiday_name FROM shut WHERE isodow(d) < 6"""


@query("exchange_closures", _options_sql())
def _(spark, d):
    days = cal.sessions(spark, cal.OPTIONS, dt.date(2019, 1, 1), dt.date(2026, 12, 31))
    return days.where("effect = 'closed'").select("trading_day", "holiday_name")


@query("session_stretches", """WITH days AS (SELECT d FROM generate_series(TIMESTAMP '2016-01-04', TIMESTAMP '2016-02-26', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
o AS (SELECT d, epoch_us(d) * 1000 AS m, d IN (DATE '2016-01-18', DATE '2016-02-15') AS early FROM days)
SELECT CAST(d AS DATE) AS trading_day, CAST(0 AS INT) AS part, CAST(m - 3600000000000 AS BIGINT) AS open_ns, CAST(m + CASE WHEN early THEN 18 * 3600000000000 ELSE 21 * 3600000000000 + 900000000000 END AS BIGINT) AS close_ns FROM o
UNION ALL SELECT CAST(d AS DATE), 1, m + 21 * 3600000000000 + 1800000000000, m + 22 * 3600000000000 FROM o WHERE NOT early""")
def _(spark, d):
    return cal.intervals(spark, cal.GLOBEX, dt.date(2016, 1, 4), dt.date(2016, 2, 26)).drop("calendar_id")


def _rules_sql() -> str:
    """The rules and one-off days of all calendars as tables, and what they give for each year, worked out in SQL."""
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rules, days = [], []
    for c in cal.CALENDARS:
        for place, h in enumerate(c.holidays):
            args = (*h.args, 0, 0, 0)[:3] if h.kind != "before" else (*h.args[:2], sum(1 << w for w in h.args[2:]))
            rules.append(f"('{c.name}', {place}, '{h.name}', '{h.kind}', {args[0]}, {args[1]}, {args[2]}, '{h.observance}', {text(h.close)}, {h.first}, {h.last})")
        days += [f"('{c.name}', DATE '{d}', '{name}', {text(close)})" for d, (name, close) in c.special.items()]
    return f"""WITH r(c, place, name, kind, a, b, n, obs, close, lo, hi) AS (VALUES {", ".join(rules)}), one(c, d, name, close) AS (VALUES {", ".join(days)}),
e0 AS (SELECT CAST(y AS INT) AS y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(2009, 2029) t(y)), e1 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM e0),
e2 AS (SELECT *, (a + 11 * h) // 319 AS m FROM e1), e3 AS (SELECT *, (2 * (b % 4) + 2 * (c // 4) - c % 4 - h + m + 32) % 7 AS w FROM e2),
years AS (SELECT y, make_date(y, CAST((h - m + w + 90) // 25 AS INT), CAST((h - m + w + (h - m + w + 90) // 25 + 19) % 32 AS INT)) AS easter FROM e3),
x AS (SELECT r.*, y, easter, CASE WHEN kind IN ('fixed', 'before') THEN make_date(y, a, b) WHEN kind IN ('weekday', 'after') THEN make_date(y, a, 1) END AS anchor FROM r, years WHERE y BETWEEN lo AND hi),
s AS (SELECT *, CASE WHEN kind IN ('fixed', 'before') THEN CASE WHEN obs = 'nearest' AND isodow(anchor) = 6 THEN anchor - 1 WHEN obs IN ('nearest', 'sunday') AND isodow(anchor) = 7 THEN anchor + 1 ELSE anchor END END AS seen,
 CASE WHEN kind IN ('weekday', 'after') THEN CASE WHEN n > 0 THEN anchor + CAST((b - isodow(anchor) + 8) % 7 + 7 * (n - 1) AS INT) ELSE last_day(anchor) - CAST((isodow(last_day(anchor)) - 1 - b + 7) % 7 AS INT) END END AS nth FROM x),
g AS (SELECT c, place, name, close, CASE kind WHEN 'fixed' THEN seen WHEN 'weekday' THEN CASE WHEN month(nth) = a THEN nth END WHEN 'after' THEN CASE WHEN month(nth) = a THEN nth + 1 END WHEN 'easter' THEN easter + a
 WHEN 'before' THEN CASE WHEN n = 0 OR (n >> (isodow(anchor) - 1)) & 1 = 1 THEN seen - CASE isodow(seen) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END END END AS d FROM s),
f AS (SELECT c, d, arg_min(name, place) AS name, arg_min(coalesce(CAST(close AS VARCHAR), ''), place) AS close FROM g WHERE d IS NOT NULL GROUP BY 1, 2),
u AS (SELECT coalesce(one.c, f.c) AS c, coalesce(one.d, f.d) AS d, coalesce(one.name, f.name) AS name, CASE WHEN one.c IS NOT NULL THEN coalesce(CAST(one.close AS VARCHAR), '') ELSE f.close END AS close FROM f FULL JOIN one ON one.c = f.c AND one.d = f.d)
SELECT c AS calendar_id, d AS trading_day, CASE WHEN close = '' THEN 'closed' ELSE 'early' END AS effect, name AS holiday_name FROM u WHERE isodow(d) < 6 AND d BETWEEN DATE '2012-12-01' AND DATE '2026-12-31'"""


@query("holiday_calendars", _rules_sql())
def _(spark, d):
    rows = [r for c in cal.CALENDARS for r in cal.session_rows(c, dt.date(2012, 12, 1), dt.date(2026, 12, 31))]
    return spark.createDataFrame(rows, cal.SESSION_SCHEMA).where("effect <> 'regular'").select("calendar_id", "trading_day", "effect", "holiday_name")


# ---------------------------------------------------------------- the funnel


MEASURED = """me AS (SELECT o_orderkey // 3 AS combo, CAST(o_orderkey % 3 AS INT) AS place, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_totalprice % 100) / 200 - 0.25 END AS ic,
 CASE WHEN o_orderkey % 11 = 0 THEN 'constant_score' END AS reason, o_totalprice % 7 - 3 AS lo, o_totalprice % 7 - 1 AS hi FROM orders),
f AS (SELECT *, ic IS NOT NULL AND abs(ic) >= 0.2 AND (lo > 0 OR hi < 0) AS clears FROM me)"""


@query("s0_criterion", f"""WITH {MEASURED} SELECT combo, CASE WHEN bool_or(clears) THEN 'passed' WHEN bool_or(ic IS NULL) THEN 'unavailable' ELSE 'failed' END AS outcome,
CAST(min(place) FILTER (clears) * 1000 AS INT) AS horizon, CASE WHEN NOT bool_or(clears) THEN any_value(reason) FILTER (ic IS NULL) END AS reason FROM f GROUP BY 1""")
def _(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    gone = k % 11 == 0
    m = table(spark, d, "orders").select(
        F.expr("o_orderkey div 3").alias("combo"), (k % 3).cast("int").alias("place"), ((k % 3) * 1000).cast("int").alias("horizon"),
        F.when(~gone, (price % 100) / 200 - 0.25).alias("ic"), F.when(gone, "constant_score").alias("reason"), (price % 7 - 3).alias("lo"), (price % 7 - 1).alias("hi"),
    )
    return s0.criterion(m, 0.2, ("combo",))


@query("s0_claims", """WITH w AS (SELECT DISTINCT c_custkey % 500 AS combo, CAST(c_nationkey AS BIGINT) AS seed FROM customer), g AS (SELECT o_custkey % 500 AS combo, o_orderkey % 25 AS seed, bool_or(o_orderstatus = 'P') AS v, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1, 2)
SELECT combo, seed, CASE WHEN v IS NULL OR v THEN 'claim' WHEN f THEN 'reuse' ELSE 'resume' END AS action FROM w LEFT JOIN g USING (combo, seed)""")
def _(spark, d):
    wanted = table(spark, d, "customer").select((F.col("c_custkey") % 500).alias("combo"), F.col("c_nationkey").cast("long").alias("seed"))
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "run_finished").when(status == "P", "void").otherwise("run")
    registry = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("combo"), (F.col("o_orderkey") % 25).alias("seed"), kind.alias("kind"))
    return s0.plan_runs(wanted, registry, ["combo", "seed"])


def scored_combos(spark, d):
    """Distance from the mean of three spans, a combo each."""
    b = bars_1h(spark, d)
    close = F.col("close") / F.lit(1e9)
    out = None
    for combo, span in enumerate((3, 8, 21)):
        one = b.select(F.lit(combo).alias("combo"), "instrument", (F.col("ts_open") + HOUR).alias("ts"), (close / sma(close, span) - 1).alias("score"), F.col("close").alias("price"), day_known(HOUR).alias("session_key"))
        out = one if out is None else out.unionByName(one)
    return out


S0_HORIZONS = [2 * HOUR, 8 * HOUR]


@query("s0_run")
def _(spark, d):
    nothing = spark.createDataFrame([], "combo int, instrument string, kind string")
    return s0.run(scored_combos(spark, d), nothing, S0_HORIZONS, 0.05, 200, 7)[1]


CRITERIA = funnel.Criteria.load(["s0", "s1", "s2"], [0, 0.5, 1, 2], 1, least_trades=20, least_sessions=15, least_ic=0.02, most_p=0.6, most_pbo=0.6, least_sharpe=0.1)
EVIDENCE = """ev AS (SELECT c_custkey AS combo, c_custkey % 60 AS oos_trades, c_custkey % 40 + 8 AS oos_sessions, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'passed' END AS s0_outcome, c_acctbal / 1000 AS free_return_pct,
 c_acctbal / 1000 - 0.5 AS return_pct, c_acctbal / 5000 AS sharpe, c_acctbal / 5000 - 0.2 AS kill_sharpe, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 9 - 6 AS DOUBLE) END AS random_return_pct,
 CAST(c_custkey % 11 - 8 AS DOUBLE) AS hold_return_pct, (c_custkey % 100) / 100.0 AS p_value, (c_custkey % 13) / 10.0 AS expected_max_sharpe, (c_custkey % 10) / 10.0 AS pbo FROM customer)"""


def _assess_sql() -> str:
    stages = [
        ("admission", {"trades": "oos_trades >= 20", "sessions": "oos_sessions >= 15"}), ("s0", {"criterion": "s0_outcome = 'passed'"}), ("s1", {"free_return": "free_return_pct >= 0"}),
        ("s2", {"sharpe": "sharpe >= 0.1", "kill_level": "kill_sharpe >= 0.1", "random_entry": "coalesce(return_pct > random_return_pct, false)", "buy_and_hold": "return_pct > hold_return_pct"}),
        ("s3", {"permutation": "p_value <= 0.6"}), ("s3", {"deflated": "sharpe > expected_max_sharpe", "pbo": "pbo <= 0.6"}),
    ]
    oks = [" AND ".join(f"({c})" for c in s.values()) for _, s in stages]
    before = [" AND ".join(oks[:k]) or "true" for k in range(len(stages))]
    reasons = ", ".join(f"CASE WHEN ({b}) AND NOT ({c}) THEN '{n}:{r}' END" for (n, s), b in zip(stages, before) for r, c in s.items())
    decided = "CASE " + " ".join(f"WHEN {b} THEN '{n}'" for (n, _), b in reversed(list(zip(stages, before)))) + " END"
    return f"WITH {EVIDENCE} SELECT combo, array_to_string(list_filter([{reasons}], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN {' AND '.join(oks)} THEN 'iterate' ELSE 'kill' END AS verdict, {decided} AS decided_at FROM ev"


@query("assess_full", _assess_sql())
def _(spark, d):
    k, money = F.col("c_custkey"), F.col("c_acctbal")
    e = table(spark, d, "customer").select(
        k.alias("combo"), (k % 60).alias("oos_trades"), (k % 40 + 8).alias("oos_sessions"), F.when(k % 5 == 0, "failed").otherwise("passed").alias("s0_outcome"),
        (money / 1000).alias("free_return_pct"), (money / 1000 - 0.5).alias("return_pct"), (money / 5000).alias("sharpe"), (money / 5000 - 0.2).alias("kill_sharpe"),
        F.when(k % 7 != 0, (k % 9 - 6).cast("double")).alias("random_return_pct"), (k % 11 - 8).cast("double").alias("hold_return_pct"),
        ((k % 100) / 100.0).alias("p_value"), ((k % 13) / 10.0).alias("expected_max_sharpe"), ((k % 10) / 10.0).alias("pbo"),
    )
    return funnel.assess(e, CRITERIA.ordered()).select("combo", "reasons", "verdict", "decided_at")


WARMUP = 20


@query("pool_plan", f"""WITH {ROLLS}, j AS (SELECT cb.root, cb.contract, cb.ts_open, CAST((cb.ts_open + {HOUR} - 1) // {DAY_NS} AS BIGINT) AS day, until, cb.ts_open + {HOUR} > after AS front FROM cb JOIN win USING (contract) WHERE cb.ts_open + {HOUR} <= until),
k AS (SELECT *, row_number() OVER (PARTITION BY contract, front ORDER BY ts_open DESC) AS back, count(*) FILTER (NOT front) OVER (PARTITION BY contract) AS lead_in, max(day) FILTER (front) OVER (PARTITION BY contract) AS last_day FROM j)
SELECT contract, ts_open, day, CASE WHEN front THEN 'test' ELSE 'warmup' END AS role, lead_in < {WARMUP} AS short FROM k WHERE (front OR back <= {WARMUP}) AND NOT coalesce(front AND day = last_day AND until < (last_day + 1) * {DAY_NS}, false)""")
def _(spark, d):
    bars = contract_bars(spark, d).select("contract", "ts_open", day_known(HOUR).alias("day"))
    windows = rolls.front_windows(_rolls(spark, d), "root").select("contract", "after", "until")
    closes = spark.range(19000, 21000).select(F.col("id").alias("trading_day"), ((F.col("id") + 1) * DAY_NS).alias("close_ns"))
    return s0.pool_plan(bars, windows, closes, HOUR, WARMUP)


# ---------------------------------------------------------------- plans and catalogues


RANGES = "w AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 + 1 AS INT) AS e FROM orders WHERE o_orderpriority LIKE '1%'), ow AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 + 1 AS INT) AS e FROM orders WHERE o_orderpriority NOT LIKE '1%')"
AV0, AV1 = dt.date(1996, 3, 10), dt.date(1998, 6, 20)


@query("purchase_plan", f"""WITH {RANGES}, av AS (SELECT DISTINCT k, greatest(s, DATE '{AV0}') AS s, least(e, DATE '{AV1}') AS e FROM w), cl AS (SELECT * FROM av WHERE s < e),
days AS (SELECT DISTINCT k, 0 AS w0, 0 AS w1, unnest(generate_series(s, e - 1, INTERVAL 1 DAY)) AS d FROM cl), have AS (SELECT DISTINCT k, unnest(generate_series(s, e - 1, INTERVAL 1 DAY)) AS d FROM ow),
miss AS (SELECT days.* FROM days ANTI JOIN have ON days.k = have.k AND days.d = have.d), isl AS (SELECT *, CAST(d AS DATE) - CAST(row_number() OVER (PARTITION BY k, w0, w1 ORDER BY d) AS INT) AS g FROM miss),
gp AS (SELECT k, w0, w1, CAST(min(d) AS DATE) AS gap_start, CAST(max(d) AS DATE) + 1 AS gap_end FROM isl GROUP BY k, w0, w1, g),
mo AS (SELECT DISTINCT k, gap_start, gap_end, unnest(generate_series(date_trunc('month', gap_start), CAST(gap_end - 1 AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM gp)
SELECT k, gap_start, gap_end, greatest(gap_start, CAST(m AS DATE)) AS "start", least(gap_end, CAST(m + INTERVAL 1 MONTH AS DATE)) AS "end", true AS tiled FROM mo""")
def _(spark, d):
    o = table(spark, d, "orders")
    start = F.to_date("o_orderdate")
    ranges = lambda t, most: t.select(F.col("o_custkey").alias("k"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % most + 1).cast("int")).alias("end"))
    wanted = ranges(o.where("o_orderpriority LIKE '1%'"), 200)
    offer = wanted.select("k").distinct().select("k", F.lit(AV0).alias("start"), F.lit(AV1).alias("end"))
    return asof.purchase_plan(wanted, offer, ranges(o.where("o_orderpriority NOT LIKE '1%'"), 90), ["k"])


@query("narrow_ranges", """WITH c AS (SELECT o_custkey AS k, min(o_orderkey) * 10 AS cs, max(o_orderkey) * 10 AS ce FROM orders GROUP BY 1), w AS (SELECT c_custkey AS k, c_custkey * 7 AS s, c_custkey * 7 + 90000 AS e FROM customer)
SELECT k, greatest(s, cs) AS "start", least(e, ce) AS "end", s < cs OR e > ce AS narrowed FROM w JOIN c USING (k) WHERE greatest(s, cs) < least(e, ce)""")
def _(spark, d):
    covered = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_orderkey") * 10).alias("start"), (F.max("o_orderkey") * 10).alias("end"))
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").select(k.alias("k"), (k * 7).alias("start"), (k * 7 + 90000).alias("end"))
    return rolls.narrow_ranges(wanted, covered, ["k"])


ALIAS = "CASE p_partkey % 6 WHEN 0 THEN 'ES.v.0' WHEN 1 THEN 'CL.c.0' WHEN 2 THEN 'ES.n.0' WHEN 3 THEN 'ES.v.1' WHEN 4 THEN 'ESH4' ELSE '6E.c.' || (p_partkey % 4) END"


@query("alias_parse", f"SELECT p_partkey, nullif(regexp_extract({ALIAS}, '^([A-Z0-9]+)\\.([vc])\\.0+$', 1), '') AS root, nullif(regexp_extract({ALIAS}, '^([A-Z0-9]+)\\.([vc])\\.0+$', 2), '') AS rule FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    alias = F.when(k % 6 == 5, F.concat(F.lit("6E.c."), (k % 4).cast("string"))).otherwise(F.element_at(F.array(*map(F.lit, ("ES.v.0", "CL.c.0", "ES.n.0", "ES.v.1", "ESH4", ""))), (k % 6 + 1).cast("int")))
    root, rule = symbols.alias_parts(alias)
    return table(spark, d, "part").select("p_partkey", root.alias("root"), rule.alias("rule"))


@query("merge_papers", """WITH p AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || (p_partkey % 500) END AS doi, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || '  ' END AS title,
 CASE WHEN p_partkey % 4 > 0 THEN 2000 + p_size % 3 END AS year, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS abstract, CASE WHEN p_partkey % 7 > 2 THEN p_brand END AS venue, 's' || (p_partkey % 4) AS source, CASE WHEN p_partkey % 6 > 0 THEN 't' || (p_partkey % 6) ELSE '' END AS topic FROM part),
k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'title:' || trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) || '|' || coalesce(CAST(year AS VARCHAR), '') END AS key FROM p)
SELECT key, arg_min(title, seq) AS title, arg_min(doi, seq) FILTER (doi IS NOT NULL) AS doi, CAST(arg_min(year, seq) FILTER (year IS NOT NULL) AS INT) AS year, arg_min(abstract, seq) FILTER (abstract IS NOT NULL) AS abstract,
 arg_min(venue, seq) FILTER (venue IS NOT NULL) AS venue, array_to_string(list_sort(list_distinct(list(source))), ',') AS seen_in, coalesce(array_to_string(list_sort(list_distinct(list(topic) FILTER (topic <> ''))), ','), '') AS topics FROM k GROUP BY 1""")
def _(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        k.alias("seq"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), (k % 500).cast("string"))).alias("doi"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit("  "))).alias("title"), F.when(k % 4 > 0, F.col("p_size") % 3 + 2000).alias("year"),
        F.when(k % 5 > 1, F.col("p_type")).alias("abstract"), F.when(k % 7 > 2, F.col("p_brand")).alias("venue"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"),
        F.when(k % 6 > 0, F.concat(F.lit("t"), (k % 6).cast("string"))).otherwise("").alias("topic"),
    )
    merged = logs.merge_papers(p, "seq")
    return merged.withColumns({c: F.array_join(c, ",") for c in ("seen_in", "topics")})
