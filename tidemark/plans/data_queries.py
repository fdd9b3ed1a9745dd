"""Queries over calendars, logs, profiles and configurations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import symbols
from ..operators import qa
from ..schema import NANO
from ..sources import logs
from ..sources.bars import epoch_us, synthetic_walk, table
from . import grid
from .views import B1H, COSTS, HOUR, SPEC, bars_1h, equity_sql

QUERIES, SQL = {}, {}
FIRST, LAST = dt.date(2023, 12, 25), dt.date(2024, 2, 10)
MINUTE = 60 * NANO


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The same calendar in SQL: Chicago is six hours behind over these winter days.
DIM = """dim AS (SELECT 'globex' AS calendar_id, CAST(d AS DATE) AS trading_day,
  CASE WHEN d IN (DATE '2023-12-25', DATE '2024-01-01') THEN 'closed' WHEN d IN (DATE '2024-01-15') THEN 'early' ELSE 'regular' END AS effect,
  CASE WHEN d = DATE '2023-12-25' THEN 'christmas' WHEN d = DATE '2024-01-01' THEN 'new_year' WHEN d = DATE '2024-01-15' THEN 'martin_luther_king_day' END AS holiday_name,
  epoch_us(d) * 1000 AS midnight FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
ses AS (SELECT calendar_id, trading_day, CASE WHEN effect <> 'closed' THEN midnight - 1 * 3600000000000 END AS open_ns,
  CASE effect WHEN 'regular' THEN midnight + 22 * 3600000000000 WHEN 'early' THEN midnight + 18 * 3600000000000 END AS close_ns,
  CASE WHEN effect <> 'closed' THEN midnight + 14 * 3600000000000 + 1800000000000 END AS rth_open_ns,
  CASE effect WHEN 'regular' THEN midnight + 21 * 3600000000000 WHEN 'early' THEN midnight + 18 * 3600000000000 END AS rth_close_ns, effect, holiday_name FROM dim)"""


def _dim(spark):
    return cal.sessions(spark, cal.GLOBEX, FIRST, LAST)


@query("calendar_sessions", f"WITH {DIM} SELECT * FROM ses")
def _(spark, d):
    return _dim(spark)


@query("holiday_rules", f"WITH {DIM} SELECT trading_day, effect, holiday_name FROM ses WHERE effect <> 'regular'")
def _(spark, d):
    return _dim(spark).where("effect <> 'regular'").select("trading_day", "effect", "holiday_name")


JOINED = f"j AS (SELECT b1h.*, ses.* FROM b1h JOIN ses ON ts_open + {HOUR} > open_ns AND ts_open + {HOUR} <= close_ns)"


@query("session_clock", f"""WITH {B1H}, {DIM}, {JOINED} SELECT instrument, ts_open, trading_day, (ts_open + {HOUR} - open_ns) / 6e10 AS minutes_since_open, (close_ns - ts_open - {HOUR}) / 6e10 AS minutes_to_close,
CAST(ts_open + {HOUR} - 1 >= rth_open_ns AND ts_open + {HOUR} - 1 < rth_close_ns AS DOUBLE) AS is_rth, CAST(ts_open + {HOUR} - 1 < rth_open_ns AS DOUBLE) AS is_overnight,
(ts_open + {HOUR} - rth_open_ns) / 6e10 AS minutes_since_rth_open, (rth_close_ns - ts_open - {HOUR}) / 6e10 AS minutes_to_rth_close, CAST(ts_open + {HOUR} - 1 >= rth_close_ns AS DOUBLE) AS is_post_rth FROM j""")
def _(spark, d):
    clock = cal.session_clock(HOUR)
    return cal.with_session(bars_1h(spark, d), _dim(spark), HOUR).select("instrument", "ts_open", "trading_day", *[c.alias(n) for n, c in clock.items()])


@query("session_unexpected", f"WITH {B1H}, {DIM}, {JOINED} SELECT instrument, count(*) AS n FROM (SELECT instrument, ts_open FROM b1h EXCEPT SELECT instrument, ts_open FROM j) GROUP BY 1")
def _(spark, d):
    b = bars_1h(spark, d)
    inside = cal.with_session(b, _dim(spark), HOUR).select("instrument", "ts_open")
    return b.join(inside, ["instrument", "ts_open"], "left_anti").groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


@query("bars_per_year", f"WITH {DIM} SELECT calendar_id, count(open_ns) AS days, round(sum(close_ns - open_ns) / 60e9 / ((max(trading_day) - min(trading_day) + 1) / 365.2425), 4) AS bars_per_year FROM ses GROUP BY 1")
def _(spark, d):
    return cal.bars_per_year(_dim(spark), MINUTE).withColumn("bars_per_year", F.round("bars_per_year", 4))


@query("dst_boundaries", """SELECT CAST(d + INTERVAL 1 DAY AS DATE) AS trading_day, CAST(CASE month(d) WHEN 3 THEN -1 ELSE 1 END AS BIGINT) AS shift_hours
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(d)
WHERE dayofweek(d) = 0 AND ((month(d) = 3 AND day(d) BETWEEN 8 AND 14) OR (month(d) = 11 AND day(d) BETWEEN 1 AND 7))""")
def _(spark, d):
    dim = cal.sessions(spark, cal.GLOBEX, dt.date(2024, 1, 2), dt.date(2024, 12, 24)).where("open_ns IS NOT NULL")
    hour = F.expr(f"(open_ns div {3600 * NANO}) % 24")
    rows = dim.withColumn("shift_hours", hour - F.lag(hour).over(Window.partitionBy("calendar_id").orderBy("trading_day")))
    return rows.where("shift_hours <> 0").select("trading_day", "shift_hours")


@query("third_fridays", """SELECT CAST(m AS INT) AS month, CAST(max(d) FILTER (isodow(d) = 5 AND day(d) BETWEEN 15 AND 21) AS DATE) AS expiry FROM (SELECT d, month(d) AS m FROM generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY) t(d)) GROUP BY 1""")
def _(spark, d):
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month")).withColumn("expiry", symbols.third_friday(F.lit(2025), F.col("month")))


# ---------------------------------------------------------------- logs

RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS combo, o_orderpriority AS family, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS voided, o_orderstatus FROM orders)"""


def _runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("combo"), F.col("o_orderpriority").alias("family"), "o_orderstatus")


@query("registry_trials", f"WITH {RUNS} SELECT family, count(DISTINCT combo) AS trials FROM runs WHERE voided = 0 GROUP BY 1")
def _(spark, d):
    r = _runs(spark, d)
    voids = r.where("run_id % 7 = 0").select("run_id")
    return logs.trials(r, voids, "family", ["combo"])


@query("registry_state", f"WITH {RUNS} SELECT run_id, CASE WHEN voided = 1 THEN 'void' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS state FROM runs")
def _(spark, d):
    r = _runs(spark, d)
    lines = r.select("run_id", F.lit("run").alias("kind")).unionByName(r.where("o_orderstatus = 'F'").select("run_id", F.lit("run_finished").alias("kind")))
    lines = lines.unionByName(r.where("run_id % 7 = 0").select("run_id", F.lit("void").alias("kind")))
    return logs.run_states(lines)


@query("journal_state", """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id AS intent, event_type AS state FROM s WHERE rn = 1""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("intent"), F.col("event_type").alias("state"), F.struct(epoch_us("ts"), "event_id").alias("at"))
    return logs.latest_state(e, "intent", "state", "at")


@query("manifest_verify", """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 13 = 0 THEN 'size' WHEN p_partkey % 17 = 0 THEN 'checksum' END AS finding
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").cast("long").alias("size"), F.sha2("p_name", 256).alias("digest"))
    found = p.where("id % 11 <> 0").select(
        "id", F.when(F.col("id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("id") % 17 == 0, F.lit("")).otherwise(F.col("digest")).alias("digest"),
    )
    return logs.verify(p, found)


@query("symbol_audit", """WITH dec AS (SELECT o_custkey AS record, l_partkey % 200 AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), own AS (SELECT DISTINCT o_custkey AS record, l_suppkey % 200 AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT d.record, count(*) AS missing FROM (SELECT DISTINCT * FROM dec) d ANTI JOIN own ON d.record = own.record AND d.s = own.s GROUP BY 1""")
def _(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    declared = j.select(F.col("o_custkey").alias("record"), (F.col("l_partkey") % 200).alias("symbol"))
    credited = j.select(F.col("o_custkey").alias("record"), (F.col("l_suppkey") % 200).alias("symbol"))
    return logs.missing_symbols(declared, credited).groupBy("record").agg(F.count(F.lit(1)).alias("missing"))


@query("job_reconciliation", """SELECT c_custkey AS intent, CASE WHEN s_suppkey IS NULL THEN 'buy' ELSE 'adopt' END AS action FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def _(spark, d):
    intents = table(spark, d, "customer").select(F.col("c_custkey").alias("intent"))
    jobs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("intent"), F.col("s_name").alias("job"))
    return logs.reconcile(intents, jobs)


@query("quote_gate", """SELECT o_custkey AS plan, CAST(sum(CAST(ceil(o_totalprice * 100) AS BIGINT) * 10000000) AS BIGINT) AS total, sum(CAST(ceil(o_totalprice * 100) AS BIGINT) * 10000000) <= 1000000000000000 AS allowed FROM orders GROUP BY 1""")
def _(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), (F.ceil(F.col("o_totalprice") * 100).cast("long") * 10_000_000).alias("cost"))
    return logs.price_gate(q, "plan", 1_000_000 * NANO)


@query("shingle_overlap", """WITH s AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM s WHERE len(w) >= 8))
SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2""")
def _(spark, d):
    return logs.shared_shingles(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 8)


# ---------------------------------------------------------------- profiles

#: Minutes of Chicago's clock, six hours behind in the months of the events.
LOCAL = "l AS (SELECT event_type AS root, epoch_us(ts) // 60000000 - 360 AS m FROM events), pg AS (SELECT DISTINCT root, CAST(m // 1440 AS BIGINT) AS date_key, CAST(m % 1440 AS BIGINT) AS minute FROM l)"


def _presence(spark, d):
    bars = table(spark, d, "events").select(F.col("event_type").alias("root"), epoch_us("ts").alias("us"), F.lit(1).alias("volume"))
    return qa.presence(bars, "America/Chicago")


@query("presence_grid", f"WITH {LOCAL} SELECT * FROM pg")
def _(spark, d):
    return _presence(spark, d)


@query("weekly_presence", f"""WITH {LOCAL}, w AS (SELECT root, (date_key + 3) % 7 AS weekday, minute // 60 AS hour, count(DISTINCT date_key) AS hit FROM pg GROUP BY 1, 2, 3),
n AS (SELECT root, (date_key + 3) % 7 AS weekday, count(DISTINCT date_key) AS dates FROM pg GROUP BY 1, 2) SELECT w.root, w.weekday, w.hour, hit, dates FROM w JOIN n USING (root, weekday)""")
def _(spark, d):
    p = _presence(spark, d).withColumn("weekday", (F.col("date_key") + 3) % 7).withColumn("hour", F.expr("minute div 60"))
    hit = p.groupBy("root", "weekday", "hour").agg(F.countDistinct("date_key").alias("hit"))
    return hit.join(p.groupBy("root", "weekday").agg(F.countDistinct("date_key").alias("dates")), ["root", "weekday"])


@query("window_runs", f"""WITH {LOCAL}, dd AS (SELECT root, date_key, count(*) FILTER (minute BETWEEN 540 AND 599) >= 1 AS flag FROM pg GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY date_key) - row_number() OVER (PARTITION BY root, flag ORDER BY date_key) AS island FROM dd)
SELECT root, flag, min(date_key) AS first_date, max(date_key) AS last_date, count(*) AS dates FROM i GROUP BY root, flag, island""")
def _(spark, d):
    p = _presence(spark, d).groupBy("root", "date_key").agg(F.max(F.col("minute").between(540, 599)).alias("flag"))
    a = F.row_number().over(Window.partitionBy("root").orderBy("date_key"))
    b = F.row_number().over(Window.partitionBy("root", "flag").orderBy("date_key"))
    return p.withColumn("island", a - b).groupBy("root", "flag", "island").agg(F.min("date_key").alias("first_date"), F.max("date_key").alias("last_date"), F.count(F.lit(1)).alias("dates")).drop("island")


@query("minute_presence", f"WITH {LOCAL} SELECT root, minute, round(count(*) * 100.0 / (SELECT count(DISTINCT date_key) FROM pg x WHERE x.root = pg.root), 6) AS pct FROM pg WHERE minute BETWEEN 540 AND 599 GROUP BY 1, 2")
def _(spark, d):
    p = _presence(spark, d)
    n = p.groupBy("root").agg(F.countDistinct("date_key").alias("dates"))
    return p.where(F.col("minute").between(540, 599)).groupBy("root", "minute").agg(F.count(F.lit(1)).alias("hit")).join(n, "root").select("root", "minute", F.round(F.col("hit") * 100.0 / F.col("dates"), 6).alias("pct"))


#: The days asked for begin and end outside of what was traded.
ASKED = ((FIRST - dt.date(1970, 1, 1)).days, (LAST - dt.date(1970, 1, 1)).days)


@query("holiday_detector", f"""WITH {LOCAL}, dates AS (SELECT root, unnest(generate_series({ASKED[0]}::BIGINT, {ASKED[1]}::BIGINT)) AS date_key FROM (SELECT DISTINCT root FROM pg))
SELECT root, d.date_key, max(minute) FILTER (minute < 1020) AS last_day_minute, min(minute) FILTER (minute >= 1020) AS first_evening FROM dates d LEFT JOIN pg k USING (root, date_key)
WHERE (d.date_key + 3) % 7 < 5 GROUP BY 1, 2 HAVING coalesce(max(minute) FILTER (minute < 1020), -1) < 900""")
def _(spark, d):
    return qa.short_days(_presence(spark, d), *ASKED, 1020, 900)


@query("daily_first_last_runs", f"""WITH {LOCAL}, dd AS (SELECT root, date_key, min(minute) // 60 AS f, max(minute) // 60 AS l FROM pg GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY date_key) - row_number() OVER (PARTITION BY root, f, l ORDER BY date_key) AS island FROM dd)
SELECT root, f AS first_hour, l AS last_hour, min(date_key) AS first_date, count(*) AS dates FROM i GROUP BY root, f, l, island""")
def _(spark, d):
    p = _presence(spark, d).groupBy("root", "date_key").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi")).select("root", "date_key", F.expr("lo div 60").alias("first_hour"), F.expr("hi div 60").alias("last_hour"))
    a = F.row_number().over(Window.partitionBy("root").orderBy("date_key"))
    b = F.row_number().over(Window.partitionBy("root", "first_hour", "last_hour").orderBy("date_key"))
    return p.withColumn("island", a - b).groupBy("root", "first_hour", "last_hour", "island").agg(F.min("date_key").alias("first_date"), F.count(F.lit(1)).alias("dates")).drop("island")


# ---------------------------------------------------------------- configurations

CONFIG = """
[indicators.fast]
kind = "sma"
period = [3, 5]
[indicators.slow]
kind = "sma"
period = { start = 10, end = 20, step = 10 }
[rules]
enter_long = "fast.value crosses_above slow.value"
exit_long = "fast.value crosses_below slow.value"
enter_short = "fast.value crosses_below slow.value and not volume < 1"
exit_short = "fast.value crosses_above slow.value"
"""


@query("grid_expand", "SELECT CAST(row_number() OVER (ORDER BY f, s) - 1 AS BIGINT) AS combo, CAST(f AS BIGINT) AS fast, CAST(s AS BIGINT) AS slow FROM (VALUES (3), (5)) a(f), (VALUES (10), (20)) b(s)")
def _(spark, d):
    rows = [(i, c["fast.period"], c["slow.period"]) for i, c in enumerate(grid.load(CONFIG).combos())]
    return spark.createDataFrame(rows, "combo long, fast long, slow long")


def _signals_sql() -> str:
    mean = lambda p: f"CASE WHEN row_number() OVER o >= {p} THEN avg(close / 1e9) OVER (PARTITION BY instrument ORDER BY ts_open ROWS {p - 1} PRECEDING) END"
    return f"""WITH {B1H}, v AS (SELECT *, {mean(3)} AS f, {mean(10)} AS s, row_number() OVER o AS n FROM b1h WINDOW o AS (PARTITION BY instrument ORDER BY ts_open)),
c AS (SELECT *, lag(f) OVER o <= lag(s) OVER o AND f > s AS up, lag(f) OVER o >= lag(s) OVER o AND f < s AS down FROM v WINDOW o AS (PARTITION BY instrument ORDER BY ts_open))
SELECT instrument, ts_open, n > 21 AND coalesce(up, false) AS enter_long, n > 21 AND coalesce(down AND volume >= 1, false) AS enter_short FROM c"""


@query("combo_signals", _signals_sql())
def _(spark, d):
    config = grid.load(CONFIG)
    s = grid.signals(bars_1h(spark, d), config, config.combos()[0])
    return s.select("instrument", "ts_open", F.col("rule_enter_long").alias("enter_long"), F.col("rule_enter_short").alias("enter_short"))


def _grid_sql() -> str:
    """Every combo's signals, enter/exit machine and equity, one after the other."""
    parts, ends = [f"WITH RECURSIVE {B1H}"], []
    mean = lambda p: f"CASE WHEN row_number() OVER o >= {p} THEN avg(close / 1e9) OVER (PARTITION BY instrument ORDER BY ts_open ROWS {p - 1} PRECEDING) END"
    o = "WINDOW o AS (PARTITION BY instrument ORDER BY ts_open)"
    for k, combo in enumerate(grid.load(CONFIG).combos()):
        parts.append(f"v{k} AS (SELECT *, {mean(combo['fast.period'])} AS f, {mean(combo['slow.period'])} AS s, row_number() OVER o AS i FROM b1h {o})")
        parts.append(f"c{k} AS (SELECT *, i > 21 AND coalesce(lag(f) OVER o <= lag(s) OVER o AND f > s, false) AS up, i > 21 AND coalesce(lag(f) OVER o >= lag(s) OVER o AND f < s, false) AS down FROM v{k} {o})")
        parts.append(f"""m{k} AS (SELECT instrument, i, CASE WHEN up AND down AND volume >= 1 THEN 0 WHEN up THEN 1 WHEN down AND volume >= 1 THEN -1 ELSE 0 END AS target FROM c{k} WHERE i = 1
UNION ALL SELECT instrument, i, CASE WHEN flat <> 0 THEN flat WHEN up AND down AND volume >= 1 THEN 0 WHEN up THEN 1 WHEN down AND volume >= 1 THEN -1 ELSE 0 END
 FROM (SELECT c.*, CASE WHEN m.target = 1 AND c.down THEN 0 WHEN m.target = -1 AND c.up THEN 0 ELSE m.target END AS flat FROM m{k} m JOIN c{k} c ON c.instrument = m.instrument AND c.i = m.i + 1))""")
        curve = equity_sql(source=f"(SELECT * FROM c{k} JOIN m{k} USING (instrument, i))")
        parts.append(f"e{k} AS (WITH {curve} SELECT CAST({k} AS BIGINT) AS combo, instrument, last(equity ORDER BY ts_open) AS final_equity, CAST(sum(traded) AS BIGINT) AS contracts FROM curve GROUP BY 2)")
        ends.append(f"SELECT * FROM e{k}")
    return ", ".join(parts) + " " + " UNION ALL ".join(ends)


@query("combo_grid_equity", _grid_sql())
def _(spark, d):
    return grid.run(bars_1h(spark, d), grid.load(CONFIG), SPEC, COSTS)


def _walk_sql(seed: int, n: int) -> str:
    """The walk of one seed, from its random stream in 128-bit numbers."""
    word = "18446744073709551616::UHUGEINT"
    mixed = lambda z, shift, factor: f"(xor({z}, {z} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {word}"
    return f"""dr AS (SELECT k, xor(z2, z2 // {1 << 31}::UHUGEINT) AS x FROM (SELECT k, {mixed("z1", 27, 0x94D049BB133111EB)} AS z2 FROM (SELECT k, {mixed("z", 30, 0xBF58476D1CE4E5B9)} AS z1
 FROM (SELECT k, ({seed}::UHUGEINT + (k + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {word} AS z FROM range({4 * n}) t(k))))),
st AS (SELECT k // 4 AS i, CAST(max(x) FILTER (k % 4 = 0) % 9 AS BIGINT) - 4 AS move, CAST(max(x) FILTER (k % 4 = 1) % 5 AS BIGINT) AS up, CAST(max(x) FILTER (k % 4 = 2) % 5 AS BIGINT) AS down,
 100 + CAST(max(x) FILTER (k % 4 = 3) % 901 AS BIGINT) AS volume FROM dr GROUP BY 1),
wk AS (SELECT i, 16000::BIGINT AS o, greatest(400, 16000 + move) AS c, up, down, volume FROM st WHERE i = 0 UNION ALL SELECT s.i, w.c, greatest(400, w.c + s.move), s.up, s.down, s.volume FROM wk w JOIN st s ON s.i = w.i + 1),
walk AS (SELECT 'SYN:{seed}' AS instrument, 1700000000000000000 + i * 60000000000 AS ts_open, o * 250000000 AS open, (greatest(o, c) + up) * 250000000 AS high,
 greatest(1, least(o, c) - down) * 250000000 AS low, c * 250000000 AS close, volume FROM wk)"""


@query("synthetic_walk", f"WITH RECURSIVE {_walk_sql(42, 2000)} SELECT * FROM walk")
def _(spark, d):
    return synthetic_walk(spark, [42], 2000)


@query("synthetic_walk_is_clean", f"WITH RECURSIVE {_walk_sql(43, 2000)} SELECT instrument, count(*) AS bars, count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close) AS broken FROM walk GROUP BY 1")
def _(spark, d):
    w = synthetic_walk(spark, [43], 2000)
    bad = qa.ohlc_violations(w).groupBy("instrument").agg(F.count(F.lit(1)).alias("b"))
    return w.groupBy("instrument").agg(F.count(F.lit(1)).alias("bars")).join(bad, "instrument", "left").select("instrument", "bars", F.coalesce("b", F.lit(0)).cast("long").alias("broken"))
