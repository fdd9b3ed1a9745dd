import itertools

import pytest

from tidemark.operators import controls, replay, stats
from tidemark.sources import bars, logs, scorecard


def test_schedules_keep_holdings_and_do_not_overlap():
    for seed in range(50):
        placed = controls.random_schedule([3, 1, 5], 10, 20, seed)
        assert [b - a for a, b in placed] == [3, 1, 5] and placed[0][0] >= 10 and placed[-1][1] <= 30
        assert all(x[1] <= y[0] for x, y in zip(placed, placed[1:]))
    with pytest.raises(ValueError):
        controls.random_schedule([5, 6], 0, 10, 1)
    assert controls.fnv1a("") == 0xCBF29CE484222325 and controls.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert controls.split_mix(0)[1] == 0xE220A8397B1DCDAF == int(bars.split_mix(0, 1)[0])


def test_an_entry_on_the_bar_of_an_exit_never_happens():
    seven = lambda schedule: list(itertools.islice(controls.walk_schedule(schedule), 7))
    assert seven([(1, 3, 1), (3, 5, -1)]) == [0, 1, 1, 0, 0, 0, 0]
    assert seven([(1, 3, 1), (4, 6, -1)]) == [0, 1, 1, 0, -1, -1, 0]


def test_the_random_entry_control_takes_sixteen_draws_and_counts_those_beaten(spark, monkeypatch):
    from tidemark.plans import engine_queries, queries

    walk = bars.synthetic_walk(spark, [29, 31], 300)
    trades = spark.createDataFrame([(r.instrument, 10, 60, 1) for r in walk.select("instrument").distinct().collect()], "instrument string, opened int, closed int, direction int")
    curve = replay.equity(controls.random_entry_targets(walk, trades, 99), engine_queries.SPEC, engine_queries.COSTS)
    for name, value in (("bars_1h", walk), ("_bar_trades", trades), ("sma_cross", curve)):
        monkeypatch.setattr(engine_queries, name, lambda *_, value=value: value)
    got = {r.instrument: r for r in queries.QUERIES["random_entry"](spark, "").collect()}

    def final(targets):
        rows = replay.equity(targets, engine_queries.SPEC, engine_queries.COSTS).orderBy("ts_open").collect()
        return {r.instrument: r.equity for r in rows}

    drawn, own = [final(controls.random_entry_targets(walk, trades, i)) for i in range(16)], final(controls.random_entry_targets(walk, trades, 99))
    assert len(got) == 2
    for name, r in got.items():
        values = sorted(d[name] for d in drawn)
        assert (r.final_equity, r.draws, r.draws_beaten) == (values[7], 16, sum(own[name] > v for v in values))


def test_a_planted_leak_is_caught(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    walk = bars.synthetic_walk(spark, [29], 400)
    number = lambda t: t.withColumn("i", F.row_number().over(Window.partitionBy("instrument").orderBy("ts_open")))
    head = number(walk).where("i <= 200").drop("i")
    leak = stats.truncation_mismatches(number(controls.full_sample_targets(walk)), number(controls.full_sample_targets(head)), 200)
    fair = stats.truncation_mismatches(number(replay.sma_cross_targets(walk, 3, 9)), number(replay.sma_cross_targets(head, 3, 9)), 200)
    assert leak.count() > 0 and fair.count() == 0


def test_cards_state_their_limits(spark, tmp_path):
    facts = dict.fromkeys(scorecard.HONESTY, "x")
    page = scorecard.render("T <1>", facts, {"rows": spark.createDataFrame([("<a>", None)], "k string, v int")})
    assert "&lt;a&gt;" in page and "T &lt;1&gt;" in page
    scorecard.write(f"{tmp_path}/card.html", page)
    with pytest.raises(ValueError):
        scorecard.render("T", facts | {"costs": ""}, {})
    with pytest.raises(ValueError):
        scorecard.render("T", facts, {"rows": spark.range(11)}, most_rows=10)


def test_layout(spark):
    paths = ["raw/a/b/x.zst", "raw/x.zst", "other/a/b/x.zst", "raw/a/b/c/x.zst", "raw/a/b/x.txt"]
    got = {r.path: r.finding for r in logs.layout_findings(spark.createDataFrame([(p,) for p in paths], "path string"), ["raw"]).collect()}
    assert got == {paths[1]: "too_shallow", paths[2]: "unknown_root", paths[3]: "too_deep", paths[4]: "unknown_kind"}
