"""Hand-derived results of the replay kernels, rules, calendars and statistics."""

import datetime as dt
import os
from collections import namedtuple

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import logic, prices
from tidemark.operators import asof, metrics, qa, replay, resample, rolls, stats, walkforward
from tidemark.plans import grid, rules
from tidemark.schema import NANO, tf_ns
from tidemark.sources import bars as sources
from tidemark.sources import logs

Bar = namedtuple("Bar", "ts_open open high low close")
M = 60 * NANO


def nano(*xs):
    return [round(x * NANO) for x in xs]


FOUR = [Bar(i * M, *nano(*x)) for i, x in enumerate([(99.5, 100.5, 99, 100), (101, 102.5, 100.5, 102), (102.5, 103.5, 102, 103), (102, 102.5, 101, 101.5)])]
ES = replay.Costs(half_ticks=2, fee=1_250_000_000, tick=250_000_000)


def test_four_bars_to_the_nano_dollar(spark):
    equity, fills, trades, cancelled = replay.run_bars(FOUR, [1, 1, 0, 0], M, replay.Spec(), ES)
    assert [e for _, e in equity] == [100000000000000, 100036250000000, 100086250000000, 100022500000000]
    assert len(fills) == 2 and len(trades) == 1 and trades[0][1] == 22500000000 and cancelled == 0
    rows = [("X", b.ts_open, b.open, b.high, b.low, b.close, t) for b, t in zip(FOUR, [1, 1, 0, 0])]
    frame = spark.createDataFrame(rows, "instrument string, ts_open long, open long, high long, low long, close long, target int")
    curve = replay.equity(frame, replay.Spec(), ES)
    assert [r.equity for r in curve.orderBy("ts_open").collect()] == [e for _, e in equity]
    assert replay.bracket_replay(frame, M, replay.Spec(), ES, None, None, "equity").orderBy("ts").toPandas()["equity"].tolist() == [e for _, e in equity]


def test_bars_out_of_order_are_an_error_and_pending_orders_are_cancelled():
    with pytest.raises(ValueError):
        replay.run_bars([FOUR[1], FOUR[0]], [0, 0], M, replay.Spec(), ES)
    assert replay.run_bars(FOUR, [None, None, None, 1], M, replay.Spec(), ES)[3] == 1


@pytest.mark.parametrize(
    "side,bar,want",
    [
        (1, (100, 104, 97, 101), (98, "stop", False, True)),
        (1, (97, 99, 96, 98), (97, "stop", True, False)),
        (1, (104, 105, 103, 104), (104, "target", True, False)),
        (1, (100, 104, 99, 101), (103, "target", False, False)),
        (1, (100, 103, 99, 101), None),
        (1, (100, 101, 98, 101), (98, "stop", False, False)),
        (-1, (100, 103, 96, 101), (102, "stop", False, True)),
        (-1, (100, 101, 96, 99), (97, "target", False, False)),
        (-1, (103, 104, 100, 101), (103, "stop", True, False)),
    ],
)
def test_brackets(side, bar, want):
    stop, target = replay.bracket_levels(100 * NANO, side, 250_000_000, 8, 12)
    got = replay.resolve_bracket(side, Bar(0, *nano(*bar)), stop, target)
    assert got == (None if want is None else (want[0] * NANO, *want[1:]))


def test_partial_closes_flips_and_average_entry():
    book = replay.Portfolio(replay.Spec(point_value=1, cash=0))
    book.fill(1, 2, 10, 0)
    book.fill(2, 1, 12, 0)
    assert book.entry == 10  # 32 / 3 towards zero
    book.fill(3, -1, 13, 0)
    assert (book.cash, book.position, book.trades) == (3, 2, [])
    assert book.mark(8) == 3 - 4 and book.worst == -1
    book.fill(4, -5, 9, 1)
    assert book.trades == [(4, 3 - 2 - 5, 1, 1, -1, 0)] and (book.position, book.entry, book.side) == (-3, 9, -1)


def test_rules_follow_left_nulls(spark):
    values = [None, False, True]
    frame = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    got = {(r.a, r.b): (r.x, r.y) for r in frame.select("a", "b", logic.strict_and(F.col("a"), F.col("b")).alias("x"), logic.strict_or(F.col("a"), F.col("b")).alias("y")).collect()}
    assert got[None, False] == (None, None) and got[None, True] == (None, None)
    assert got[False, None] == (False, None) and got[True, None] == (None, True)


def test_rule_texts():
    e = rules.parse("close > 5 or not volume <= 3 and f.value crosses_above open", {"f.value"})
    assert rules.canonical(e) == "((close > 5.0) or ((not (volume <= 3.0)) and (f.value crosses_above open)))"
    assert rules.has_cross(e) and rules.canonical(rules.parse("(close > 5.0)")) == "(close > 5.0)"
    for bad in ("close", "close = 5", "close > ", "(close > 1", "close > other", "close > 1 1", "close + 1 > 2"):
        with pytest.raises(rules.RuleError):
            rules.parse(bad)


def test_grids():
    text = '[indicators.b]\nkind="sma"\nperiod=[2,3]\n[indicators.a]\nkind="bollinger"\nperiod={start=4,end=6,step=2}\nk=[1.5]\n[rules]\nenter_long="a.upper < close and b.value crosses_above close"\n'
    config = grid.load(text)
    assert [tuple(c.values()) for c in config.combos()] == [(4, 1.5, 2), (4, 1.5, 3), (6, 1.5, 2), (6, 1.5, 3)]
    assert config.warmup() == 7 and config.identity() == grid.load(text.replace("close and", "close  and")).identity()
    assert config.identity() != grid.load(text.replace("1.5", "1.6")).identity()
    for bad in (text.replace("[2,3]", "[2,2]"), text.replace("bollinger", "x"), text + "other=1\n"):
        with pytest.raises(ValueError):
            grid.load(bad)


def test_calendar_rules():
    assert [cal.easter(y) for y in (2000, 2019, 2024, 2025, 2038)] == [dt.date(2000, 4, 23), dt.date(2019, 4, 21), dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2038, 4, 25)]
    assert cal.nth_weekday(2024, 5, 0, -1) == dt.date(2024, 5, 27) and cal.nth_weekday(2024, 11, 3, 4) == dt.date(2024, 11, 28)
    assert cal.nth_weekday(2024, 12, 1, -1) == dt.date(2024, 12, 31)
    assert cal.observed(dt.date(2021, 12, 25), "nearest") == dt.date(2021, 12, 24) and cal.observed(dt.date(2023, 1, 1), "sunday") == dt.date(2023, 1, 2)
    assert cal.GLOBEX.era(dt.date(1999, 1, 1)) is cal.GLOBEX.eras[0] and cal.GLOBEX.era(dt.date(2020, 1, 1)) is cal.GLOBEX.eras[1]
    for day, at in ((dt.date(2024, 3, 10), dt.time(2, 30)), (dt.date(2024, 11, 3), dt.time(1, 30))):
        with pytest.raises(ValueError):
            cal.wall_to_utc(day, at, "America/New_York")


def test_exact_prices(spark):
    texts = ["1.5", "-0.000000001", "1_000.25", "1e5", "1.0000000001", "", "7", "+2.50"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(prices.parse_decimal(F.col("t"))).collect()]
    assert got == [1500000000, -1, 1000250000000, None, None, None, 7 * NANO, 2500000000]
    ticks = spark.createDataFrame([(x,) for x in (130, 125, 124, -125, -124, -130, 0)], "x long")
    assert [r[0] for r in ticks.select(prices.round_to_tick(F.col("x"), 250)).collect()] == [250, 250, 0, -250, 0, -250, 0]
    one = spark.range(1)
    cdf, inv, z, none = one.select(prices.normal_cdf(F.lit(1.959963985)), prices.inverse_normal_cdf(F.lit(0.975)), prices.expected_max_z(F.lit(24)), prices.inverse_normal_cdf(F.lit(1.0))).first()
    assert abs(cdf - 0.975) < 1e-6 and abs(inv - 1.959963985) < 1e-6 and abs(z - 1.95) < 0.06 and none is None


def test_moments(spark):
    frame = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double").repartition(3)
    parts = frame.groupBy(F.spark_partition_id().alias("p")).agg(*metrics.moments(F.col("x")))
    skew, kurt = metrics.shape()
    s, k = metrics.combine_moments(parts, "p").select(skew, kurt).first()
    assert abs(s - 1.0182337649) < 1e-8 and abs(k - 2.2304) < 1e-4


def test_overfitting_of_a_perfect_inversion(spark):
    perf = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)], "combo long, fold int, ret double")
    assert stats.overfitting(perf, 2).first().pbo == 1.0
    with pytest.raises(ValueError):
        stats.overfitting(perf, 3)


def test_equal_count_buckets(spark):
    pairs = spark.createDataFrame([("a", float(i), i, 1, 1, 0.0) for i in range(7)], "instrument string, score double, ts long, price long, exit long, fwd_return double")
    got = {r.bucket: r.n for r in stats.score_buckets(pairs, 3, 1, ("instrument",), "ts").collect()}
    assert got == {0: 2, 1: 2, 2: 3}


def test_intervals(spark):
    owned = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 8, 9), ("a", 8, 8), ("a", 20, 30)], "k string, start long, end long")
    assert sorted(tuple(r) for r in asof.merge_intervals(owned, ["k"]).collect()) == [("a", 1, 5), ("a", 8, 9), ("a", 20, 30)]
    wanted = spark.createDataFrame([("a", 0, 22), ("b", 4, 6)], "k string, start long, end long")
    assert sorted(tuple(r) for r in asof.subtract_intervals(wanted, owned, ["k"]).collect()) == [("a", 0, 1), ("a", 5, 8), ("a", 9, 20), ("b", 4, 6)]


def test_roll_chain():
    day = lambda c, d, v, px: {"contract": c, "seq": ord(c), "day": d, "volume": v, "close": px, "avail_ts": d * 10}
    s = [day("A", d, v, 100) for d, v in ((1, 9), (2, 5), (3, 1))] + [day("B", d, v, 103) for d, v in ((1, 1), (2, 6), (3, 9), (4, 9), (5, 2))]
    s += [day("C", d, 1, 99) for d in (4, 5, 6)]
    got = rolls.chain_of(s, confirm=2)
    assert [(r["from_contract"], r["day"], r["adjustment"], r["roll_ts"]) for r in got] == [("A", 3, 3, 30), ("B", 5, -4, 50)]


def test_quality_checks_skip_rather_than_pass(spark):
    flat = spark.createDataFrame([("f", i * M, 5, 5, 5, 5, 0) for i in range(6)] + [("s", 0, 5, 5, 5, 5, 1)], "instrument string, ts_open long, open long, high long, low long, close long, volume long")
    assert {r.instrument: (r.spike_check, r.reason) for r in qa.status(flat, M).collect()} == {"f": ("skipped", "zero_scale"), "s": ("skipped", "too_few_moves")}
    assert qa.spikes(flat, M).count() == 0 and [r.length for r in qa.zero_volume_runs(flat).collect()] == [6]
    jump = [("j", t * M, p, p, p, p, 1) for t, p in ((0, 10), (1, 11), (2, 10), (3, 11), (4, 100), (9, 500), (10, 501))]
    b = spark.createDataFrame(jump, flat.schema)
    assert [r.ts_open for r in qa.spikes(b, M).collect()] == [4 * M]
    assert [(r.gap_start, r.missing) for r in qa.gaps(b, M).collect()] == [(5 * M, 4)]


def test_resampling_refuses_what_does_not_divide(spark):
    with pytest.raises(ValueError):
        resample.resample(spark.range(1), "1h", "5m")
    five = spark.createDataFrame([("a", i * M, 10 + i, 20 + i, 5 - i, 11 + i, 2) for i in range(5)], "instrument string, ts_open long, open long, high long, low long, close long, volume long")
    r = resample.resample(five, "1m", "5m").first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.partial) == (10, 24, 1, 15, 10, False)


def test_folds():
    assert walkforward.fold_plan(10, 4, 2, 2) == [(0, "train", 0, 4), (0, "test", 4, 6), (1, "train", 2, 6), (1, "test", 6, 8), (2, "train", 4, 8), (2, "test", 8, 10)]
    assert walkforward.fold_plan(9, 4, 2, 3, anchored=True)[2] == (1, "train", 0, 7)
    with pytest.raises(ValueError):
        walkforward.fold_plan(10, 4, 3, 2)


def test_store_round_trip_and_pruning(spark, tmp_path):
    walk = sources.synthetic_walk(spark, [1, 2], 300)
    path = str(tmp_path / "bars")
    sources.write_bars(walk, path, "1m")
    back = sources.scan_bars(spark, path, "1m")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, walk.collect()))
    t0 = sources.WALK_START
    part = sources.scan_bars(spark, path, "1m", "SYN:1", t0 + 10 * M, t0 + 20 * M)
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts_open), GreaterThanOrEqual(ts_open" in plan and "PartitionFilters: [isnotnull" in plan
    report = sources.integrity(back).collect()
    assert all((r.row_count, r.negative_volume, r.not_increasing) == (300, 0, 0) for r in report)
    with pytest.raises(ValueError):
        tf_ns("2m")
    assert sources.footer(spark, path, "1m") == {"schema_version": sources.STORE_VERSION, "tf": "1m"}
    os.rename(f"{path}/tf=1m", f"{path}/tf=5m")
    with pytest.raises(ValueError):
        sources.scan_bars(spark, path, "5m")
    with pytest.raises(Exception, match="already exists"):
        sources.write_bars(walk, path, "1m")
    with pytest.raises(Exception, match="a bar twice"):
        sources.write_bars(walk.union(walk.limit(1)), str(tmp_path / "twice"), "1m")


def test_instrument_names():
    assert sources.resolve_instrument(["ESH2024", "ESH2034"], "ESH2024") == "ESH2024"
    assert sources.resolve_instrument(["ESH2024", "ESH2035"], "ESH4") == "ESH2024"
    for stored, name in ((["ESH2024", "ESH2034"], "ESH4"), (["ESH2024"], "ESM4")):
        with pytest.raises(LookupError):
            sources.resolve_instrument(stored, name)


def test_logs(spark, tmp_path):
    path = str(tmp_path / "manifest.jsonl")
    logs.append_line(path, {"file_digest": "d1", "symbols": ["A", "B"], "size_bytes": 3})
    logs.append_line(path, {"supplements": "d1", "added_symbols": ["C", "A"]})
    with open(path, "a") as out:
        out.write("not json\n")
    lines = logs.read_lines(spark, path, logs.MANIFEST).cache()
    assert lines.where("corrupt IS NOT NULL").count() == 1
    good = lines.where("corrupt IS NULL")
    assert [r.kind for r in logs.manifest_kinds(good).collect()] == ["record", "supplement"]
    assert sorted(r.symbol for r in logs.credited_symbols(good).collect()) == ["A", "B", "C"]


def test_information_coefficient_reasons(spark):
    rows = [Row(g="flat", score=1.0, fwd_return=0.1), Row(g="flat", score=1.0, fwd_return=0.2), Row(g="one", score=1.0, fwd_return=0.1)]
    rows += [Row(g="ok", score=float(i), fwd_return=float(i * i)) for i in range(5)] + [Row(g="nan", score=float("nan"), fwd_return=0.0), Row(g="nan", score=1.0, fwd_return=1.0)]
    got = {r.g: (r.ic if r.ic is None else round(r.ic, 9), r.reason) for r in stats.information_coefficient(spark.createDataFrame(rows), ("g",)).collect()}
    assert got == {"flat": (None, "constant_score"), "one": (None, "too_few"), "ok": (1.0, None), "nan": (None, "non_finite")}
