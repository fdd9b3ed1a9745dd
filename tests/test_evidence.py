"""Evidence without SQL by brute force, kernels over batches, calendars, roll tables, criteria."""

import datetime as dt
import json
import math
import os
import time
from collections import defaultdict
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import funnel, indicators, metrics, qa, replay, resample, rolls, s0, stats
from tidemark.plans import evidence_queries, grid
from tidemark.plans.queries import QUERIES
from tidemark.sources import logs
from tidemark.sources.bars import synthetic_walk

SF = "/root/testdata/sf0.001"
H = 3_600_000_000_000


def plain_bootstrap(pairs, draws, seed):
    """(sessions, n, mean, lo, hi) of (session, return) pairs, session by session."""
    sums, counts = defaultdict(float), defaultdict(int)
    for key, x in pairs:
        sums[key] += x
        counts[key] += 1
    keys = sorted(sums)
    total, widest = len(pairs), max(counts.values())
    rng = np.random.default_rng([seed, len(keys)])
    means = []
    for _ in range(draws):
        s = n = 0
        while n < total:
            for i in rng.integers(0, len(keys), max(1, (total - n) // max(1, widest) + 1)):
                if n < total:
                    s, n = s + sums[keys[i]], n + counts[keys[i]]
        means.append(s / n)
    means.sort()
    return len(keys), total, sum(x for _, x in pairs) / total, means[math.floor(0.025 * draws)], means[math.ceil(0.975 * draws) - 1]


def plain_ic(scores, returns):
    """Correlation of average ranks."""
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    a, b = rank(scores), rank(returns)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def plain_pairs(rows, horizon):
    """(score, return, session) of bars (ts, score, price, session) with the last bar at most `horizon` later."""
    rows, out = sorted(rows), []
    for ts, score, price, session in rows:
        inside = [r for r in rows if ts <= r[0] <= ts + horizon]
        if score is not None and ts + horizon <= rows[-1][0] and inside[-1][0] > ts and price and inside[-1][2]:
            out.append((score, inside[-1][2] / price - 1, session))
    return out


def test_session_bootstrap_equals_plain_loops(spark):
    from tidemark.plans.engine_queries import _pairs_scored

    by = defaultdict(list)
    for r in _pairs_scored(spark, SF).collect():
        by[r.instrument].append((r.session_key, r.fwd_return))
    got = QUERIES["session_bootstrap"](spark, SF).collect()
    assert len(got) == len(by) > 0
    for r in got:
        assert np.allclose((r.sessions, r.n, r["mean"], r.lo, r.hi), plain_bootstrap(by[r.instrument], 500, 42), atol=1e-12)


def test_permutation_null_equals_plain_paths(spark):
    """Blocks of the moves in the order of their keys; the observed gain among those of the paths."""
    from tidemark.plans.views import bars_1h

    keys = defaultdict(dict)
    blocks = bars_1h(spark, SF).groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).select("instrument", F.explode(F.sequence(F.lit(0), F.expr("(n - 2) div 24"))).alias("block"))
    keyed = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49))))
    for r in keyed.select("instrument", "draw", "block", F.xxhash64("instrument", "draw", "block", F.lit(29)).alias("k")).collect():
        keys[r.instrument, r.draw][r.block] = r.k
    closes = defaultdict(list)
    for r in bars_1h(spark, SF).orderBy("ts_open").collect():
        closes[r.instrument].append(r.close)

    from tidemark.plans.views import COSTS, FAST, SLOW, SPEC

    def gain(path):
        """The moving-average cross bar by bar; every bar opens at the close before it."""
        mean = lambda i, p: sum(path[i - p + 1 : i + 1]) / p if i >= p - 1 else None
        position = target = earned = 0
        before = None
        for i, close in enumerate(path):
            last = path[i - 1] if i else close
            earned -= abs(target - position) * (COSTS.slip * SPEC.point_value + COSTS.fee)
            position = target
            earned += position * (close - last) * SPEC.point_value
            diff = mean(i, FAST) - mean(i, SLOW) if i >= SLOW - 1 else None
            if before is not None and diff is not None:
                target = 1 if before <= 0 < diff else -1 if before >= 0 > diff else target
            before = diff
        return float(earned)

    got = {r.instrument: r for r in QUERIES["permutation_null"](spark, SF).collect()}
    assert set(got) == set(closes)
    for name, series in closes.items():
        moves = [b - a for a, b in zip(series, series[1:])]
        nulls = []
        for draw in range(50):
            order = sorted(keys[name, draw], key=keys[name, draw].get)
            path, level = [], series[0]  # the first close itself is not a step
            for block in order:
                for m in moves[24 * block : 24 * block + 24]:
                    level += m
                    path.append(level)
            nulls.append(gain(path))
        above = sum(x >= gain(series) for x in nulls)
        assert (got[name].draws, got[name].unevaluable, got[name].not_below) == (50, 0, above)
        assert abs(got[name].p - (above + 1) / 51) < 1e-12


def test_the_first_stage_equals_plain_loops(spark):
    rows = defaultdict(list)
    for r in evidence_queries.scored_combos(spark, SF).collect():
        rows[r.combo, r.instrument].append((r.ts, r.score, r.price, r.session_key))
    got = {(r.combo, r.instrument): (r.outcome, r.horizon, r.reason) for r in QUERIES["s0_run"](spark, SF).collect()}
    assert set(got) == set(rows)
    for key, series in rows.items():
        want = ("failed", None, None)
        for horizon in reversed(evidence_queries.S0_HORIZONS):
            pairs = plain_pairs(series, horizon)
            ic = plain_ic([p[0] for p in pairs], [p[1] for p in pairs])
            *_, lo, hi = plain_bootstrap([(p[2], p[1]) for p in pairs], 200, 7)
            if abs(ic) >= 0.05 and (lo > 0 or hi < 0):
                want = ("passed", horizon, None)
        assert got[key] == want, key


def test_recorded_runs_are_not_measured_again(spark):
    scored = evidence_queries.scored_combos(spark, SF)
    name = scored.first().instrument
    registry = spark.createDataFrame([(0, name, "run"), (0, name, "run_finished"), (1, name, "run")], "combo int, instrument string, kind string")
    claims, outcomes = s0.run(scored, registry, [2 * H], 0.05, 20, 1)
    asked, measured = ({(r.combo, r.instrument) for r in t.select("combo", "instrument").collect()} for t in (claims, outcomes))
    assert (0, name) not in asked | measured and (1, name) in measured - asked and asked < measured


@pytest.mark.parametrize("batch", [10_000, 7])
def test_kernels_do_not_depend_on_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        walk = synthetic_walk(spark, [3, 4, 5], 120)
        bars = {}
        for r in walk.orderBy("ts_open").collect():
            bars.setdefault(r.instrument, []).append(r)
        ema = {(r.instrument, r.ts_open): r.ema for r in indicators.ema(walk, "close", 6).collect()}
        for name, series in bars.items():
            level = sum(r.close / 1e9 for r in series[:6]) / 6
            for i, r in enumerate(series):
                level = level if i < 6 else 2 / 7 * r.close / 1e9 + 5 / 7 * level
                assert (ema[name, r.ts_open] is None) if i < 5 else abs(ema[name, r.ts_open] - level) < 1e-9
        targets = replay.sma_cross_targets(walk, 3, 9)
        wanted = {}
        for r in targets.orderBy("ts_open").collect():
            wanted.setdefault(r.instrument, []).append(r.target)
        spec, costs = replay.Spec(), replay.Costs(2, 1_250_000_000, 250_000_000)
        found = {k: [tuple(r) for r in replay.bracket_replay(targets, 60_000_000_000, spec, costs, 8, 12, k).collect()] for k in ("fills", "trades", "equity", "cancelled")}
        for name, series in bars.items():
            points, fills, trades, cancelled = replay.run_bars(series, wanted[name], 60_000_000_000, spec, costs, 8, 12)
            for kind, rows in (("fills", fills), ("trades", trades), ("equity", points)):
                assert sorted(r[1:] for r in found[kind] if r[0] == name) == sorted(rows)
            assert sum(r[0] == name for r in found["cancelled"]) == cancelled
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


CONFIG = """
[contract]
tick = 0.25
point_value = 20
[execution]
half_spread_ticks = 0.5
fee = 1.5
[indicators.e]
kind = "ema"
period = [4, 9]
[indicators.b]
kind = "bollinger"
period = 12
k = [1.0, 1.5]
[rules]
enter_long = "close crosses_above e.value and minutes_since_open > 30"
exit_long = "close crosses_below b.middle or is_rth < 1 and not low > b.lower"
enter_short = "close crosses_below b.lower or (e.value < b.lower and volume > 500)"
exit_short = "e.value >= b.middle"
"""


@pytest.mark.parametrize("batch,chunk", [(10_000, 64), (50, 3)])
def test_a_grid_equals_its_combos_one_by_one(spark, monkeypatch, batch, chunk):
    monkeypatch.setattr(grid, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        walk = synthetic_walk(spark, [7, 8], 1500)
        dim, step = cal.sessions(spark, cal.GLOBEX, dt.date(2023, 11, 13), dt.date(2023, 11, 20)), 60_000_000_000
        config = grid.load(CONFIG)
        spec, costs = config.spec(), config.costs()
        assert (spec.point_value, costs.half_ticks, costs.slip) == (20, 1, 125_000_000)
        got = {(r.combo, r.instrument): (r.final_equity, r.contracts) for r in grid.run(walk, config, spec, costs, dim, step).collect()}
        want = {}
        for k, combo in enumerate(config.combos()):
            s = grid.signals(walk, config, combo, dim, step)
            t = replay.rule_targets(s, *(F.col(f"rule_{n}") for n in grid.RULES))
            curve = replay.equity(t, spec, costs).groupBy("instrument").agg(F.max_by("equity", "ts_open").alias("e"), F.sum("traded").alias("c"))
            want |= {(k, r.instrument): (r.e, r.c) for r in curve.collect()}
        assert got == want and len(got) == 8 and min(c for _, c in got.values()) > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("text", ["stop_ticks = 9\ntarget_ticks = 14", "stop_ticks = 6", "target_ticks = 5"])
def test_a_grid_with_brackets_equals_the_general_kernel(spark, monkeypatch, text):
    monkeypatch.setattr(grid, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        walk = synthetic_walk(spark, [7, 8], 900)
        dim, step = cal.sessions(spark, cal.GLOBEX, dt.date(2023, 11, 13), dt.date(2023, 11, 20)), 60_000_000_000
        config = grid.load(f"{CONFIG}[brackets]\n{text}")
        spec, costs = config.spec(), config.costs()
        got = {(r.combo, r.instrument): (r.final_equity, r.contracts) for r in grid.run(walk, config, spec, costs, dim, step).collect()}
        want = {}
        for k, combo in enumerate(config.combos()):
            t = replay.rule_targets(grid.signals(walk, config, combo, dim, step), *(F.col(f"rule_{n}") for n in grid.RULES))
            last = replay.bracket_replay(t, step, spec, costs, *config.brackets(), "equity").groupBy("instrument").agg(F.max_by("equity", "ts").alias("e"))
            traded = replay.bracket_replay(t, step, spec, costs, *config.brackets(), "fills").groupBy("instrument").agg(F.sum(F.abs("change")).alias("c"))
            want |= {(k, r.instrument): (r.e, r.c) for r in last.join(traded, "instrument").collect()}
        assert got == want and len(got) == 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_configurations_are_checked():
    for text in ("[x]\na = 1", "[run]\nsed = 1", CONFIG.replace("0.5", "0.3")):
        with pytest.raises(ValueError):
            grid.load(text).costs()
    with pytest.warns(UserWarning):
        grid.load(CONFIG.replace("[4, 9]", "{ start = 1, end = 6000, step = 1 }"))


def test_moments_of_parts_are_those_of_the_whole(spark):
    rng = np.random.default_rng(3)
    parts = [1e6 + rng.normal(size=n) * s for n, s in ((50, 1.0), (3, 10.0), (1, 1.0), (200, 0.1))]
    rows = [(i, float(x)) for i, part in enumerate(parts) for x in part] + [(4, None)]
    frame = spark.createDataFrame(rows, "part int, x double")
    each = frame.groupBy("part").agg(*metrics.moments(F.col("x")))
    got = metrics.combine_moments(each, "part").first()
    x = np.concatenate(parts)
    d = x - x.mean()
    assert got.n == len(x) and np.allclose((got["mean"], got.m2, got.m3, got.m4), (x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()), rtol=1e-6)


def test_rules_of_days():
    assert cal.nth_weekday(2024, 2, 0, 5) is None and cal.nth_weekday(2024, 2, 3, 5) == dt.date(2024, 2, 29)
    before = cal.Holiday("x", "before", (7, 4, 1, 2, 3, 4))
    assert before.on(2023) == dt.date(2023, 7, 3) and before.on(2022) is None and before.on(2027) is None
    after = cal.Holiday("x", "after", (11, 3, 4))
    assert after.on(2024) == dt.date(2024, 11, 29)
    early = {d: cal.GLOBEX.holiday(d) for d in (dt.date(2024, 6, 19), dt.date(2021, 6, 18), dt.date(2023, 4, 7), dt.date(2024, 3, 29), dt.date(2013, 1, 21), dt.date(2025, 1, 9))}
    assert [e and (e[0], e[1]) for e in early.values()] == [
        ("early", "juneteenth"), None, ("early", "payroll_good_friday"), ("closed", "good_friday"), ("closed", "martin_luther_king_day"), ("early", "day_of_mourning"),
    ]
    assert cal.governing("CLZ2024") is cal.ENERGY and cal.governing("SPY") is cal.OPTIONS and cal.governing("6EM5") is cal.FX
    with pytest.raises(LookupError):
        cal.governing("XYZ")


def test_an_evening_belongs_to_the_next_day():
    at = lambda h, m=0: dt.datetime(2024, 7, 8, h, m, tzinfo=ZoneInfo("America/Chicago"))
    assert cal.GLOBEX.trading_day(at(16, 59)) == dt.date(2024, 7, 8) and cal.GLOBEX.trading_day(at(17)) == dt.date(2024, 7, 9)
    assert cal.OPTIONS.trading_day(at(22)) == dt.date(2024, 7, 8)


def test_halts_split_sessions_and_count_as_closed(spark):
    day = dt.date(2016, 3, 1)
    rows = cal.interval_rows(cal.GLOBEX, day, day)
    hours = [(b - a) / H for *_, a, b in rows]
    assert hours == [22.25, 0.5] and (rows[1][3] - rows[0][4]) / H == 0.25
    stretches, dim = cal.intervals(spark, cal.GLOBEX, day, day), cal.sessions(spark, cal.GLOBEX, day, day)
    m = 60_000_000_000
    times = [t for t in range(rows[0][3], rows[1][4], m) if not rows[0][4] <= t < rows[1][3] and (t // m) % 97]
    bars = spark.createDataFrame([("X", t, 1, 1, 1, 1, 1) for t in times], "instrument string, ts_open long, open long, high long, low long, close long, volume long")
    lost = [t for t in range(times[0], times[-1] + m, m) if t not in set(times) and not rows[0][4] <= t < rows[1][3]]
    assert sorted(r.from_ts for r in qa.session_gaps(bars, stretches, m).collect()) == lost
    got = qa.session_coverage(bars, stretches, m).first()
    assert (got.expected, got.missing) == (len(times) + len(lost), len(lost))
    odd = spark.createDataFrame([("X", rows[0][4] + m), ("X", rows[0][3]), ("X", rows[1][4]), ("X", rows[1][3])], "instrument string, ts_open long")
    phases = {r.ts_open: r.phase for r in cal.with_phase(odd, dim, stretches).collect()}
    assert [phases[t] for t in (rows[0][4] + m, rows[0][3], rows[1][4], rows[1][3])] == ["closed", "overnight", "closed", "post_regular"]


def test_a_chain_by_expiry_uses_what_was_known():
    day = lambda c, d, px: {"contract": c, "seq": ord(c), "day": d, "volume": 1, "close": px, "avail_ts": d * 10}
    sessions = [day(c, d, 100 + ord(c)) for c in "AB" for d in range(1, 12)]
    stated = {"A": [(5, 9), (60, 7)], "B": [(5, 30)]}  # from day 6 on the expiry is day 7
    assert [r["day"] for r in rolls.chain_of(sessions, expiries=stated, days=1)] == [6]
    assert [r["day"] for r in rolls.chain_of(sessions, expiries={"A": [(5, 9)]}, days=1)] == [8]
    with pytest.raises(ValueError):
        rolls.chain_of(sessions, expiries={"B": [(5, 30)]}, days=1)


def test_roll_tables_come_back_and_damaged_ones_are_refused(spark, tmp_path):
    chain = QUERIES["roll_chain"](spark, SF)
    path = str(tmp_path / "rolls")
    rolls.write_roll_tables(chain, path, "v2")
    names = ["root", "from_contract", "to_contract", "day", "roll_ts", "adjustment"]
    back = rolls.read_roll_tables(spark, path, "v2")
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, chain.select(names).collect())) and back.count() > 3
    row = {"from_contract": "A", "to_contract": "B", "day": 1, "roll_ts": 5, "adjustment": 0}
    for i, table in enumerate(({"schema_version": 2, "root": "X", "rule": "v2", "rows": [row]}, {"schema_version": 1, "root": "X", "rule": "v2", "rows": [row, row]}, {"schema_version": 1, "rule": "v2", "rows": [row]})):
        folder = tmp_path / f"bad{i}" / "rule_name=v2"
        os.makedirs(folder)
        (folder / "a.json").write_text(json.dumps(table))
        with pytest.raises(Exception, match="the roll table of"):
            rolls.read_roll_tables(spark, str(tmp_path / f"bad{i}"), "v2").collect()


def test_one_answer_for_a_cycle_or_none(spark):
    cycles = spark.createDataFrame([("ESH4", "ESH2014", 100), ("ESH4", "ESH2024", 3700)], "symbol string, contract string, expiry int")
    asked = spark.createDataFrame([("ESH4", d) for d in (-4000, 50, 100, 101, 3700, 3701)], "symbol string, day int")
    got = {r.day: r.contract for r in rolls.resolve_cycles(asked, cycles).collect()}
    assert got == {-4000: None, 50: "ESH2014", 100: "ESH2014", 101: "ESH2024", 3700: "ESH2024", 3701: None}
    with pytest.raises(Exception, match="expire at once"):
        rolls.resolve_cycles(asked, cycles.union(spark.createDataFrame([("ESH4", "ESH2034", 3700)], cycles.schema))).collect()


def test_cycles_of_one_symbol_are_read_once(spark):
    """40,000 cycles and as many days of one symbol: minutes with a frame that reads the rest of them for every row."""
    n = 40_000
    cycles = spark.range(1, n + 1).selectExpr("'ES' AS symbol", "concat('ES', id) AS contract", "10 * id AS expiry")
    asked = spark.range(n).selectExpr("'ES' AS symbol", "nullif(11 * id, 5005) AS day")
    start = time.monotonic()
    got = rolls.resolve_cycles(asked, cycles, first_days=4).collect()
    assert time.monotonic() - start < 30
    numbers = {day: -(-day // 10) if 6 < day <= 10 * n else None for day in range(0, 11 * n, 11)} | {None: None}
    del numbers[5005]
    want = {day: (None, None) if k is None else (f"ES{k}", 10 * k) for day, k in numbers.items()}
    assert len(got) == n and {r.day: (r.contract, r.expiry) for r in got} == want
    assert want[0] == want[11 * n - 11] == (None, None) and want[110] == ("ES11", 110) and want[121] == ("ES13", 130)


def test_criteria_are_refused_before_any_bar_is_read():
    good = {"stages": ["s1", "s2"], "sweep_ticks": [0, 0.5, 1, 2], "kill_ticks": 1}
    assert funnel.Criteria.load(**good).sweep == (0, 1, 2, 4)
    for change in ({"stages": []}, {"stages": ["s3"]}, {"stages": ["admission"]}, {"sweep_ticks": [0, 1, 2]}, {"kill_ticks": 1.5}, {"kill_ticks": 0.3}, {"stages": ["s0"]}, {"least_ic": 0.1}):
        with pytest.raises(funnel.CriteriaError):
            funnel.Criteria.load(**good | change)


def test_vendor_conditions(spark, tmp_path):
    files = {"j1": [{"date": "2024-01-01", "condition": "degraded", "x": 1}, {"date": "2024-01-02", "condition": "available"}], "j2": {"no": "list"}}
    for job, content in files.items():
        os.makedirs(tmp_path / job)
        (tmp_path / job / "condition.json").write_text(json.dumps(content, indent=1))
    got = {tuple(r) for r in logs.vendor_conditions(spark, str(tmp_path)).collect()}
    assert got == {("j1", "2024-01-01", "degraded"), ("j2", None, "unreadable")}


def test_overfitting_with_few_folds_and_missing_cells(spark):
    perf = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)], "combo int, fold int, ret double")
    assert stats.overfitting(perf, 2).first().pbo == 1.0
    whole = [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)]
    for rows, why in ((whole[:3], "lacks a fold"), (whole[:3] + [(1, 0, 2.0)], "has a fold twice"), (whole[:3] + [(1, 1, float("nan"))], "no number"), (whole[:2], "single combo")):
        with pytest.raises(Exception, match=why):
            stats.overfitting(spark.createDataFrame(rows, perf.schema), 2).collect()
    for folds in (3, 0, 30):
        with pytest.raises(ValueError):
            stats.overfitting(perf, folds)


def test_sessions_that_can_not_be_resampled_are_refused(spark):
    quarter, row = 900 * 10**9, lambda t: ("X", t, 1, 1, 1, 1, 1)
    schema = "instrument string, ts_open long, open long, high long, low long, close long, volume long"

    def run(calendar, day, at, source="15m"):
        dim, stretches = cal.sessions(spark, calendar, day, day), cal.intervals(spark, calendar, day, day)
        return resample.resample_sessions(spark.createDataFrame([row(at(dim.first()))], schema), dim, stretches, source, "1h").collect()

    assert run(cal.GLOBEX, dt.date(2024, 3, 5), lambda s: s.open_ns + 4 * quarter)[0].bucket % H == 0
    with pytest.raises(Exception, match="has a halt"):
        run(cal.GLOBEX, dt.date(2016, 3, 1), lambda s: s.open_ns)
    with pytest.raises(Exception, match="before the session"):
        run(cal.GLOBEX, dt.date(2024, 3, 5), lambda s: s.open_ns - 1)
    odd = cal.Calendar("odd", "UTC", (cal.Era(dt.date(2020, 1, 1), dt.time(9, 7), dt.time(16), dt.time(9, 7), dt.time(16)),), ())
    with pytest.raises(Exception, match="off the grid"):
        run(odd, dt.date(2024, 3, 5), lambda s: s.open_ns)

