"""Queries over names, money, journals, orders of rows, folds, pools and session profiles."""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import prices, symbols
from ..operators import asof, controls, funnel, indicators, metrics, qa, walkforward
from ..schema import DAY_NS
from ..sources import logs
from ..sources.bars import epoch_us, table
from .bar_queries import MOVES
from .data_queries import LOCAL, _presence
from .engine_queries import NUMBERED, ROLLS, _folds, _numbered, _rolls
from .views import B1H, CASH, CONTRACT_BARS, CURVE, HOUR, bars_1h, contract_bars, contract_sessions, sma_cross

QUERIES, SQL = {}, {}
O = "(PARTITION BY instrument ORDER BY ts_open)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- names and money

NAMES = "st AS (SELECT DISTINCT 'R' || (p_partkey % 40) || substr('FGHJKMNQUVXZ', 1 + CAST(p_partkey % 12 AS INT), 1) || (2004 + p_partkey % 26) AS name FROM part), ask AS (SELECT c_custkey, 'R' || (c_custkey % 45) || substr('FGHJKMNQUVXZ', 1 + CAST(c_custkey % 12 AS INT), 1) || CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 10 AS VARCHAR) WHEN 1 THEN lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') ELSE CAST(2004 + c_custkey % 26 AS VARCHAR) END AS asked FROM customer)"


@query("instrument_resolve", f"""WITH {NAMES}, m AS (SELECT c_custkey, asked, list(DISTINCT name) FILTER (name IS NOT NULL AND length(asked) < length(name)) AS l, bool_or(name = asked) AS there
 FROM ask LEFT JOIN st ON name = asked OR (length(name) - length(asked) IN (2, 3) AND regexp_extract(asked, '^(R[0-9]+[A-Z])([0-9]+)$', 1) = regexp_extract(name, '^(R[0-9]+[A-Z])([0-9]+)$', 1) AND ends_with(name, regexp_extract(asked, '([0-9]+)$', 1)) AND length(regexp_extract(asked, '([0-9]+)$', 1)) < 3) GROUP BY 1, 2)
SELECT c_custkey, asked, CASE WHEN there THEN asked WHEN len(l) = 1 THEN l[1] END AS name, CASE WHEN there THEN 'exact' WHEN len(l) = 1 THEN 'alias' WHEN len(l) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM m""")
def _(spark, d):
    code = lambda k: F.substring(F.lit(symbols.MONTH_CODES), (k % 12 + 1).cast("int"), F.lit(1))
    p, c = F.col("p_partkey"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    stored = table(spark, d, "part").select(F.concat(F.lit("R"), text(p % 40), code(p), text(p % 26 + 2004)).alias("name")).distinct()
    year = F.when(c % 3 == 0, text(c % 10)).when(c % 3 == 1, F.lpad(text(c % 30), 2, "0")).otherwise(text(c % 26 + 2004))
    asked = table(spark, d, "customer").select(c, F.concat(F.lit("R"), text(c % 45), code(c), year).alias("asked"))
    return symbols.resolve_names(asked, stored)


@query("path_components", """WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' ' || c_mktsegment || '/%' WHEN 1 THEN 'ES.v.0' WHEN 2 THEN '..' ELSE 'é' || c_name END AS name FROM customer),
e AS (SELECT *, CASE WHEN regexp_full_match(name, '[\\x00-\\x7F]+') THEN array_to_string(list_transform(string_split(name, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._-]$') THEN c ELSE '%' || hex(encode(c)) END), '') END AS t FROM n)
SELECT c_custkey, CASE WHEN t = '..' THEN '%2E.' ELSE t END AS component, CASE WHEN t IS NOT NULL THEN name END AS back FROM e""")
def _(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("/%"))).when(k % 4 == 1, "ES.v.0").when(k % 4 == 2, "..").otherwise(F.concat(F.lit("é"), "c_name"))
    component = symbols.path_component(name)
    return table(spark, d, "customer").select(k, component.alias("component")).withColumn("back", symbols.path_name(F.col("component")))


@query("schema_frames", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1s' WHEN 1 THEN '1m' WHEN 2 THEN '1h' WHEN 3 THEN '1d' END AS tf FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, ("ohlcv-1s", "ohlcv-1m", "ohlcv-1h", "ohlcv-1d", "ohlcv-5m", "trades")))
    return table(spark, d, "part").select(k, symbols.frame_of_schema(F.element_at(names, (k % 6 + 1).cast("int"))).alias("tf"))


@query("usd_money", """WITH u AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 6 WHEN 0 THEN '$' || printf('%.2f', o_totalprice) WHEN 1 THEN '-1.5' WHEN 2 THEN '.' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') WHEN 3 THEN '1e3' WHEN 4 THEN '1_0' || o_orderkey || '.' ELSE '0.1234567890' END AS text FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) * 10000000 WHEN 2 THEN o_orderkey WHEN 4 THEN CAST('10' || o_orderkey AS BIGINT) * 1000000000 END AS nanos,
CAST(ceil(CAST(printf('%.12f', o_totalprice / 7) AS DECIMAL(24, 12)) * 1000000000) AS BIGINT) AS rounded_up, '$' || printf('%.2f', o_totalprice) AS shown FROM u""")
def _(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = (
        F.when(k % 6 == 0, F.format_string("$%.2f", price)).when(k % 6 == 1, "-1.5").when(k % 6 == 2, F.concat(F.lit("."), F.lpad(k.cast("string"), 9, "0")))
        .when(k % 6 == 3, "1e3").when(k % 6 == 4, F.concat(F.lit("1_0"), k.cast("string"), F.lit("."))).otherwise("0.1234567890")
    )
    cents = F.round(price * 100).cast("long") * 10_000_000
    return table(spark, d, "orders").select(k, prices.parse_usd(text).alias("nanos"), prices.ceil_nanos(price / 7).alias("rounded_up"), prices.show_usd(cents).alias("shown"))


@query("half_ticks", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 * (p_partkey % 9) WHEN 1 THEN 2 * (p_partkey % 9) + 1 END AS half_ticks FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    whole = (k % 9).cast("string")
    text = F.when(k % 4 == 0, whole).when(k % 4 == 1, F.concat(whole, F.lit(".5"))).when(k % 4 == 2, F.concat(whole, F.lit(".3"))).otherwise(F.concat(F.lit("-"), whole))
    return table(spark, d, "part").select(k, prices.half_ticks(text).alias("half_ticks"))


def _tail_sql(x: str) -> str:
    a, b = (" + ".join(f"{c!r} * {x} ** {len(cs) - 1 - i}" for i, c in enumerate(cs)) for cs in (prices._C, (*prices._D, 1.0)))
    return f"({a}) / ({b})"


def _middle_sql() -> str:
    a, b = (" + ".join(f"{c!r} * q ** {2 * (len(cs) - 1 - i)}" for i, c in enumerate(cs)) for cs in (prices._A, (*prices._B, 1.0)))
    return f"({a}) * q / ({b})"


@query("inverse_normal", f"""SELECT k, round(CASE WHEN p <= 0 OR p >= 1 THEN NULL WHEN p < 0.02425 THEN {_tail_sql('lo')} WHEN p > 0.97575 THEN -({_tail_sql('hi')}) ELSE {_middle_sql()} END, 6) AS z
FROM (SELECT k, p, p - 0.5 AS q, sqrt(-2 * ln(p)) AS lo, sqrt(-2 * ln(1 - p)) AS hi FROM (SELECT p_partkey AS k, p_partkey / (1.0 + (SELECT max(p_partkey) FROM part)) AS p FROM part))""")
def _(spark, d):
    part = table(spark, d, "part")
    most = part.agg(F.max("p_partkey").alias("most"))  # one row
    return part.crossJoin(F.broadcast(most)).select(F.col("p_partkey").alias("k"), F.round(prices.inverse_normal_cdf(F.col("p_partkey") / (F.col("most") + 1.0)), 6).alias("z"))


# ---------------------------------------------------------------- logs and times


@query("intent_states", """WITH e AS (SELECT user_id AS intent, CASE event_type WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'intended' WHEN 'purchase' THEN 'downloaded' WHEN 'error' THEN 'abandoned' ELSE CASE WHEN user_id % 3 = 0 THEN 'appended' ELSE 'intended' END END AS event, epoch_us(ts) AS t FROM events),
l AS (SELECT intent, max(t) FILTER (event = 'intended') AS i, max(t) FILTER (event = 'submitted') AS s, max(t) FILTER (event = 'downloaded') AS w, max(t) FILTER (event = 'appended') AS a, max(t) FILTER (event = 'abandoned') AS g FROM e GROUP BY 1)
SELECT intent, i IS NOT NULL AS intended, s IS NOT NULL AND (g IS NULL OR s > g) AS submitted, w IS NOT NULL AND (g IS NULL OR w > g) AS staged, a IS NOT NULL AS appended, g IS NOT NULL AND (s IS NULL OR g > s) AS abandoned,
 s IS NOT NULL AND (g IS NULL OR s > g) AND a IS NULL AND NOT (g IS NOT NULL AND (s IS NULL OR g > s)) AS in_flight FROM l""")
def _(spark, d):
    kind = F.col("event_type")
    event = F.when(kind == "click", "submitted").when(kind == "view", "intended").when(kind == "purchase", "downloaded").when(kind == "error", "abandoned").when(F.col("user_id") % 3 == 0, "appended").otherwise("intended")
    return logs.intent_states(table(spark, d, "events").select(F.col("user_id").alias("intent"), event.alias("event"), epoch_us("ts").alias("t")), "t")


ERAS = [("globex", e.start, i) for i, e in enumerate(cal.GLOBEX.eras)] + [("us_equity_options", e.start, i) for i, e in enumerate(cal.OPTIONS.eras)]


@query("era_asof", "WITH er(calendar_id, start, era) AS (VALUES " + ", ".join(f"('{c}', DATE '{s}', {i})" for c, s, i in ERAS) + """),
q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'us_equity_options' ELSE 'globex' END AS calendar_id, DATE '2010-01-01' + CAST(c_custkey * 37 % 5500 AS INT) AS day FROM customer)
SELECT q.c_custkey, q.calendar_id, q.day, CAST(coalesce(er.era, 0) AS INT) AS era FROM q ASOF LEFT JOIN er ON q.calendar_id = er.calendar_id AND q.day >= er.start""")
def _(spark, d):
    k = F.col("c_custkey")
    days = table(spark, d, "customer").select(k, F.when(k % 3 == 0, "us_equity_options").otherwise("globex").alias("calendar_id"), F.date_add(F.lit(dt.date(2010, 1, 1)), (k * 37 % 5500).cast("int")).alias("day"))
    return cal.era_of(days, spark.createDataFrame(ERAS, "calendar_id string, start date, era int"))


@query("trading_days", """SELECT event_id, CAST(ts - INTERVAL 6 HOUR AS DATE) + CAST(hour(ts - INTERVAL 6 HOUR) >= 17 AS INT) AS trading_day FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.trading_day(epoch_us("ts") * 1000, cal.GLOBEX).alias("trading_day"))


@query("bar_of_record", f"""WITH {B1H}, b AS (SELECT instrument, ts_open + {HOUR} AS ts, row_number() OVER {O} - 1 AS bar FROM b1h), r AS (SELECT event_id, event_type AS instrument, epoch_us(ts) * 1000 + 7200000000000 AS at FROM events)
SELECT r.event_id, r.instrument, r.at, b.bar FROM r ASOF LEFT JOIN b ON r.instrument = b.instrument AND r.at <= b.ts""")
def _(spark, d):
    over = Window.partitionBy("instrument").orderBy("ts_open")
    bars = bars_1h(spark, d).select("instrument", (F.col("ts_open") + HOUR).alias("ts"), (F.row_number().over(over) - 1).cast("long").alias("bar"))
    records = table(spark, d, "events").select("event_id", F.col("event_type").alias("instrument"), (epoch_us("ts") * 1000 + 2 * HOUR).alias("at"))
    return asof.next_as_of(records, bars, ["instrument"], "at", "ts", ["bar"])


@query("order_faults", f"""WITH {ROLLS}, e AS (SELECT root, 'rolls' AS what, roll_ts AS v, row_number() OVER (PARTITION BY root ORDER BY day) AS place FROM rolls
 UNION ALL SELECT event_type, 'events', epoch_us(ts), event_id FROM events)
SELECT root, what, count(*) AS "rows", count(*) FILTER (v <= before) AS faults FROM (SELECT *, lag(v) OVER (PARTITION BY root, what ORDER BY place) AS before FROM e) GROUP BY 1, 2""")
def _(spark, d):
    chain = _rolls(spark, d).select("root", F.lit("rolls").alias("what"), F.col("roll_ts").alias("v"), F.col("day").alias("place"))
    events = table(spark, d, "events").select(F.col("event_type").alias("root"), F.lit("events").alias("what"), epoch_us("ts").alias("v"), F.col("event_id").alias("place"))
    return asof.order_faults(chain.unionByName(events), ["root", "what"], "v")


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return asof.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- indicators and checks

RET = f"r AS (SELECT instrument, ts_open, CASE WHEN lag(close) OVER {O} <> 0 THEN (close / 1e9) / lag(close / 1e9) OVER {O} - 1 END AS x FROM b1h), k AS (SELECT * FROM r WHERE x IS NOT NULL)"


@query("zscore_return", f"""WITH {B1H}, {RET} SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 10 THEN (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) END, 5) AS z
FROM k WINDOW w AS (PARTITION BY instrument ORDER BY ts_open ROWS 9 PRECEDING)""")
def _(spark, d):
    rows = bars_1h(spark, d).withColumn("x", indicators.returns(prices.points(F.col("close")))).where(F.col("x").isNotNull())
    return rows.select("instrument", "ts_open", F.round(indicators.zscore(F.col("x"), 10), 5).alias("z"))


@query("stdev_close_volume", f"""WITH {B1H} SELECT instrument, ts_open, round(CASE WHEN row_number() OVER {O} >= 12 THEN stddev_pop(close / 1e9) OVER w END, 5) AS sd_close, round(CASE WHEN row_number() OVER {O} >= 12 THEN stddev_pop(volume) OVER w END, 5) AS sd_volume
FROM b1h WINDOW w AS (PARTITION BY instrument ORDER BY ts_open ROWS 11 PRECEDING)""")
def _(spark, d):
    sd = lambda c: F.round(indicators.stdev(c, 12), 5)
    return bars_1h(spark, d).select("instrument", "ts_open", sd(prices.points(F.col("close"))).alias("sd_close"), sd(F.col("volume").cast("double")).alias("sd_volume"))


@query("worst_spikes", f"""WITH {B1H}, {MOVES}, s AS (SELECT mv.instrument, ts_open, move, abs(move) / sigma AS sigmas FROM mv JOIN sc USING (instrument) WHERE n >= 3 AND sigma > 0 AND abs(move) / sigma > 2)
SELECT instrument, ts_open, move, round(sigmas, 6) AS sigmas, (SELECT count(*) FROM s) AS total FROM s ORDER BY s.sigmas DESC, ts_open, instrument LIMIT 20""")
def _(spark, d):
    return qa.worst_spikes(qa.spikes(bars_1h(spark, d), HOUR, 2.0), 20).withColumn("sigmas", F.round("sigmas", 6))


@query("weekly_sessions", f"""WITH {LOCAL}, r AS (SELECT root, CAST(year(DATE '1970-01-01' + CAST(date_key AS INT)) AS INT) AS year, CAST((date_key + 3) % 7 AS INT) AS weekday, date_key, minute FROM pg),
n AS (SELECT root, year, weekday, count(DISTINCT date_key) AS dates FROM r GROUP BY 1, 2, 3), h AS (SELECT root, year, weekday, minute, count(*) AS hit FROM r GROUP BY 1, 2, 3, 4),
m AS (SELECT n.*, t.minute, coalesce(hit, 0) / dates AS share FROM n CROSS JOIN (SELECT unnest(range(1440)) AS minute) t LEFT JOIN h ON h.root = n.root AND h.year = n.year AND h.weekday = n.weekday AND h.minute = t.minute),
w AS (SELECT *, min(minute) FILTER (share >= 0.25) OVER p AS f, max(minute) FILTER (share >= 0.25) OVER p AS l FROM m WINDOW p AS (PARTITION BY root, year, weekday)), i AS (SELECT * FROM w WHERE minute BETWEEN f AND l),
s AS (SELECT *, minute - row_number() OVER (PARTITION BY root, year, weekday ORDER BY minute) AS island FROM i WHERE share <= 0.05), c AS (SELECT root, year, weekday, count(*) AS length FROM s GROUP BY root, year, weekday, island HAVING count(*) >= 5),
cc AS (SELECT root, year, weekday, count(*) AS closed_runs, CAST(sum(length) AS BIGINT) AS closed_minutes FROM c GROUP BY 1, 2, 3), g AS (SELECT root, year, weekday, any_value(dates) AS dates, CAST(any_value(f) AS INT) AS first_minute, CAST(any_value(l) AS INT) AS last_minute, count(*) FILTER (share > 0.05 AND share < 0.25) AS ambiguous FROM i GROUP BY 1, 2, 3)
SELECT g.*, coalesce(closed_runs, 0) AS closed_runs, coalesce(closed_minutes, 0) AS closed_minutes FROM g LEFT JOIN cc USING (root, year, weekday)""")
def _(spark, d):
    # The events are thin, so a quarter of the dates counts as open here.
    return qa.weekly_sessions(_presence(spark, d), open_share=0.25)


# ---------------------------------------------------------------- grids, folds, pools, hashes


@query("grid_product", """SELECT CAST(combo AS INT) AS combo, CAST(half_ticks AS INT) AS half_ticks, control, CAST(draw AS INT) AS draw, row_number() OVER (ORDER BY combo, half_ticks, control, draw) - 1 AS run
FROM range(5) a(combo), (VALUES (0), (1), (2), (4)) b(half_ticks), (VALUES ('hold'), ('none'), ('random')) c(control), range(16) e(draw) WHERE control = 'random' OR draw = 0""")
def _(spark, d):
    rows = [(c, h, name, draw) for c, h, name, draw in product(range(5), funnel.SWEPT, ("hold", "none", "random"), range(controls.RANDOM_ENTRY_DRAWS)) if name == "random" or draw == 0]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(sorted(rows))], "combo int, half_ticks int, control string, draw int, run long")


def _fnv_sql(data: str) -> str:
    """FNV-1a over a list of byte values."""
    return f"list_reduce(list_prepend({0xCBF29CE484222325}::UHUGEINT, list_transform({data}, lambda b: b::UHUGEINT)), lambda h, b: (xor(h, b) * {0x100000001B3}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query("result_hash", f"""WITH {CURVE}, v AS (SELECT instrument, ts_open, CASE WHEN equity < 0 THEN 18446744073709551616::HUGEINT + equity ELSE equity::HUGEINT END AS e FROM curve),
b AS (SELECT instrument, list(CAST(e // (256::HUGEINT ** k)::HUGEINT % 256 AS INT) ORDER BY ts_open, k) AS bytes, count(*) // 8 AS n FROM v, range(8) t(k) GROUP BY 1)
SELECT instrument, n, lower(lpad(hex({_fnv_sql('bytes')}::UBIGINT), 16, '0')) AS hash FROM b""")
def _(spark, d):
    return controls.result_hash(sma_cross(spark, d), "equity")


@query("seeds", f"""WITH k AS (SELECT combo, fold, control, list_concat(list_transform(range(32), lambda i: 171), [42, 0, 0, 0, 0, 0, 0, 0], [combo, 0, 0, 0, 0, 0, 0, 0], CASE WHEN control IS NULL THEN [fold, 0, 0, 0, 0, 0, 0, 0] ELSE list_concat([255], list_transform(string_split(control, ''), lambda c: ascii(c))) END) AS bytes
 FROM (SELECT combo, fold, NULL AS control FROM range(4) a(combo), range(3) b(fold) UNION ALL SELECT combo, NULL, control FROM range(4) a(combo), (VALUES ('hold'), ('random')) c(control))),
h AS (SELECT *, ({_fnv_sql('bytes')} + {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM k),
a AS (SELECT *, (xor(z, z // {1 << 30}::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT) % 18446744073709551616::UHUGEINT AS y FROM h), b AS (SELECT *, (xor(y, y // {1 << 27}::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM a)
SELECT CAST(combo AS INT) AS combo, CAST(fold AS INT) AS fold, control, lower(lpad(hex(xor(x, x // {1 << 31}::UHUGEINT)::UBIGINT), 16, '0')) AS seed FROM b""")
def _(spark, d):
    config = bytes([0xAB] * 32)
    rows = [(c, f, None, f"{controls.derive_seed(config, 42, c, f):016x}") for c in range(4) for f in range(3)]
    rows += [(c, None, n, f"{controls.derive_seed(config, 42, c, control=n):016x}") for c in range(4) for n in ("hold", "random")]
    return spark.createDataFrame(rows, "combo int, fold int, control string, seed string")


@query("first_whole_day", f"""WITH {B1H}, d AS (SELECT instrument, ts_open, row_number() OVER {O} - 1 AS bar, dense_rank() OVER (PARTITION BY instrument ORDER BY (ts_open + {HOUR} - 1) // {DAY_NS}) - 1 AS day_index FROM b1h),
o AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_index ORDER BY bar) = 1 AS opens FROM d), s AS (SELECT instrument, min(bar) FILTER (opens) AS first_bar, count(*) AS n FROM o WHERE bar >= 30 GROUP BY 1)
SELECT s.instrument, first_bar, CAST(day_index AS INT) AS first_day, coalesce(first_bar - 30, n) AS partial_day_bars FROM s LEFT JOIN o ON o.instrument = s.instrument AND o.bar = first_bar""")
def _(spark, d):
    found = walkforward.first_whole_day(walkforward.number_days(bars_1h(spark, d), HOUR, DAY_NS), 30)
    return found.withColumns({"first_bar": F.col("first_bar").cast("long"), "first_day": F.col("first_day").cast("int"), "partial_day_bars": F.col("partial_day_bars").cast("long")})


@query("fold_summaries", f"""WITH {CURVE}, {NUMBERED}, w AS (SELECT instrument, bar, day_index, delta, part, CAST(fold AS INT) AS fold, CAST(fold AS INT) AS of FROM fi UNION ALL SELECT instrument, bar, day_index, delta, part, -1, CAST(fold AS INT) FROM fi),
e AS (SELECT *, {CASH} + sum(delta) OVER (PARTITION BY instrument, fold, part ORDER BY of, bar ROWS UNBOUNDED PRECEDING) AS e FROM w),
g AS (SELECT *, coalesce(lag(e) OVER k, {CASH}) AS p, greatest({CASH}, max(e) OVER (PARTITION BY instrument, fold, part ORDER BY of, bar ROWS UNBOUNDED PRECEDING)) AS peak FROM e WINDOW k AS (PARTITION BY instrument, fold, part ORDER BY of, bar)),
s AS (SELECT *, CASE WHEN p > 0 THEN CAST(e AS DOUBLE) / p - 1 END AS ret FROM g)
SELECT instrument, fold, part, count(*) AS bars, count(DISTINCT day_index) AS sessions, round(CAST(sum(delta) AS DOUBLE) / {CASH} * 100, 6) AS return_pct, round(max(CASE WHEN peak > 0 THEN CAST(peak - e AS DOUBLE) / peak END) * 100, 6) AS max_drawdown_pct,
round(avg(ret) / nullif(stddev_samp(ret), 0), 6) AS sharpe FROM s GROUP BY 1, 2, 3""")
def _(spark, d):
    found = walkforward.fold_summaries(_numbered(spark, d), _folds(spark), CASH)
    return found.withColumns({c: F.round(c, 6) for c in ("return_pct", "max_drawdown_pct", "sharpe")})


POOL = f"""{CONTRACT_BARS}, n AS (SELECT root, contract, count(*) AS bars, count(DISTINCT day) AS days FROM (SELECT *, CAST((ts_open + {HOUR} - 1) // {DAY_NS} AS BIGINT) AS day FROM cb) GROUP BY 1, 2),
ev AS (SELECT *, bars AS warmup_bars, 40 * CAST(right(contract, 1) AS BIGINT) + 60 AS warmup_needed, days // 9 - CAST(right(contract, 1) AS BIGINT) AS folds, bars % 17 AS trades FROM n)"""


@query("pool_evaluations", f"""WITH {POOL}, j AS (SELECT *, CASE WHEN warmup_bars < warmup_needed THEN 'warmup' WHEN folds = 0 THEN 'no_fold' END AS reason FROM ev),
b AS (SELECT contract, min(day) AS b FROM cs GROUP BY 1), u AS (SELECT cs.root, count(DISTINCT day) AS s FROM cs JOIN j ON j.contract = cs.contract AND j.reason IS NULL JOIN b ON b.contract = cs.contract WHERE day >= b + 6 GROUP BY 1)
SELECT root, count(*) FILTER (reason IS NULL) AS evaluated, count(*) FILTER (reason = 'warmup') AS short_of_warmup, count(*) FILTER (reason = 'no_fold') AS without_fold, CAST(coalesce(sum(trades) FILTER (reason IS NULL), 0) AS BIGINT) AS oos_trades, coalesce(any_value(s), 0) AS oos_sessions FROM j LEFT JOIN u USING (root) GROUP BY 1""")
def _(spark, d):
    seq = F.substring("contract", -1, 1).cast("long")
    bars = contract_bars(spark, d).groupBy("root", "contract").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct(prices.day_known(HOUR)).alias("days"))
    contracts = bars.select("root", "contract", F.col("bars").alias("warmup_bars"), (seq * 40 + 60).alias("warmup_needed"), (F.expr("days div 9") - seq).alias("folds"), (F.col("bars") % 17).alias("trades"))
    # The days after a contract's first six are out of sample.
    days = contract_sessions(spark, d).withColumn("begin", F.min("day").over(Window.partitionBy("contract")))
    return funnel.pool_evaluations(contracts, days.where("day >= begin + 6").select("root", "contract", "day"), "root")


@query("pool_evidence", f"""WITH {CONTRACT_BARS}, r AS (SELECT root, contract, CASE WHEN lag(close) OVER w > 0 THEN CAST(close AS DOUBLE) / lag(close) OVER w - 1 END AS ret, close - lag(close) OVER w AS delta FROM cb WINDOW w AS (PARTITION BY contract ORDER BY ts_open)),
f AS (SELECT root, contract, CASE WHEN root <> 'error' OR right(contract, 1) <> '2' THEN ret END AS ret, delta FROM r), a AS (SELECT root, count(DISTINCT contract) AS asked FROM cb GROUP BY 1), t AS (SELECT root, count(DISTINCT contract) FILTER (ret IS NOT NULL) AS there, CAST(sum(delta) AS DOUBLE) AS net, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM f GROUP BY 1)
SELECT root, asked, there, round(CASE WHEN asked = there THEN net / {CASH} * 100 END, 6) AS return_pct, round(CASE WHEN asked = there THEN sharpe END, 6) AS sharpe, CASE WHEN asked = there THEN n END AS n FROM a JOIN t USING (root)""")
def _(spark, d):
    over = Window.partitionBy("contract").orderBy("ts_open")
    prev = F.lag("close").over(over)
    rows = contract_bars(spark, d).select("root", "contract", F.when(prev > 0, F.col("close").cast("double") / prev - 1).alias("ret"), (F.col("close") - prev).alias("delta"))
    members = contract_bars(spark, d).select("root", "contract").distinct()
    # One contract has no returns, so its pool has no evidence.
    there = F.expr("root <> 'error' OR right(contract, 1) <> '2'")
    parts = rows.groupBy("root", "contract").agg(F.sum("delta").alias("net"), *metrics.moments(F.when(there, F.col("ret"))))
    return funnel.pool_evidence(parts, members, "root", CASH).withColumns({c: F.round(c, 6) for c in ("return_pct", "sharpe")})
