"""Quality checks of bars. Each reports what it found or that it could not run, never a silent pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPIKE_SIGMAS = 8.0
#: Median absolute deviation to standard deviation of a normal (fixed value).
MAD_SCALE = 1.4826


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """A row per bar and broken rule."""
    rules = F.array(
        F.when(F.col("high") < F.col("low"), F.lit("high_below_low")),
        F.when((F.col("high") < F.col("open")) | (F.col("high") < F.col("close")), F.lit("high_below_body")),
        F.when((F.col("low") > F.col("open")) | (F.col("low") > F.col("close")), F.lit("low_above_body")),
    )
    return bars.select("instrument", "ts_open", F.explode(F.array_compact(rules)).alias("rule"))


def runs_of(bars: DataFrame, condition) -> DataFrame:
    """Start and length of each longest run of bars that meet a condition."""
    over = Window.partitionBy("instrument").orderBy("ts_open")
    rows = bars.withColumn("hit", F.coalesce(condition, F.lit(False))).withColumn("i", F.row_number().over(over))
    rows = rows.where("hit").withColumn("island", F.col("i") - F.row_number().over(over))
    return rows.groupBy("instrument", "island").agg(F.min("ts_open").alias("start_ts"), F.count(F.lit(1)).alias("length")).drop("island")


def zero_volume_runs(bars: DataFrame) -> DataFrame:
    return runs_of(bars, F.col("volume") == 0)


def moves(bars: DataFrame, step: int) -> DataFrame:
    """Differences of closes over exactly one time step; none across a gap."""
    over = Window.partitionBy("instrument").orderBy("ts_open")
    rows = bars.withColumn("move", F.col("close") - F.lag("close").over(over)).withColumn("dt", F.col("ts_open") - F.lag("ts_open").over(over))
    return rows.where(F.col("dt") == step).select("instrument", "ts_open", "move")


def robust_scale(moved: DataFrame) -> DataFrame:
    """sigma from the upper median of the absolute moves, by rank rather than by collecting them."""
    rn = F.row_number().over(Window.partitionBy("instrument").orderBy(F.abs("move")))
    n = F.count(F.lit(1)).over(Window.partitionBy("instrument"))
    rows = moved.withColumn("rn", rn).withColumn("n", n)
    return rows.where(F.col("rn") == F.expr("n div 2") + 1).select("instrument", "n", (F.abs("move") * F.lit(MAD_SCALE)).alias("sigma"))


def spikes(bars: DataFrame, step: int, sigmas: float = SPIKE_SIGMAS) -> DataFrame:
    """Moves beyond `sigmas` robust deviations; instruments with under three moves or no scale are skipped."""
    moved = moves(bars, step)
    scale = robust_scale(moved).where((F.col("n") >= 3) & (F.col("sigma") > 0))
    rows = moved.join(scale, "instrument").withColumn("sigmas", F.abs("move") / F.col("sigma"))
    return rows.where(F.col("sigmas") > sigmas).select("instrument", "ts_open", "move", "sigmas")


def status(bars: DataFrame, step: int) -> DataFrame:
    """Per instrument whether the spike check ran, and why not."""
    scale = robust_scale(moves(bars, step))
    all_ = bars.select("instrument").distinct().join(scale, "instrument", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < 3, "too_few_moves").when(F.col("sigma") == 0, "zero_scale")
    return all_.select("instrument", F.when(reason.isNull(), "ran").otherwise("skipped").alias("spike_check"), reason.alias("reason"))


def expected_slots(bars: DataFrame, step: int) -> DataFrame:
    """Every slot between an instrument's first and last bar."""
    ends = bars.groupBy("instrument").agg(F.min("ts_open").alias("lo"), F.max("ts_open").alias("hi"))
    return ends.select("instrument", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("ts_open"))


def gaps(bars: DataFrame, step: int) -> DataFrame:
    """Runs of missing slots. Lags give them without building the grid of expected slots."""
    over = Window.partitionBy("instrument").orderBy("ts_open")
    rows = bars.select("instrument", "ts_open", F.lag("ts_open").over(over).alias("prev"))
    return rows.where(F.col("ts_open") - F.col("prev") > step).select(
        "instrument", (F.col("prev") + step).alias("gap_start"), F.expr(f"(ts_open - prev) div {step} - 1").alias("missing")
    )


def coverage(bars: DataFrame, step: int) -> DataFrame:
    got = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("present"), F.min("ts_open").alias("lo"), F.max("ts_open").alias("hi"))
    rows = got.select("instrument", F.expr(f"(hi - lo) div {step} + 1").alias("expected"), "present")
    return rows.withColumn("missing", F.col("expected") - F.col("present")).withColumn("coverage_pct", F.col("present") * 100.0 / F.col("expected"))


def _bounded(bars: DataFrame, stretches: DataFrame, step: int) -> DataFrame:
    """For each instrument the slots [first, after) of each open stretch that lie within the bars it holds.

    A stretch belongs to the span from an instrument's first bar to the end of
    its last one; what overlaps only in part counts only there. `stretches` has
    a few rows a day, so it is broadcast.
    """
    ends = bars.groupBy("instrument").agg(F.min("ts_open").alias("lo"), (F.max("ts_open") + step).alias("hi"))
    both = ends.join(F.broadcast(stretches), (F.col("open_ns") < F.col("hi")) & (F.col("close_ns") > F.col("lo")))
    start, end = F.greatest("open_ns", "lo"), F.least("close_ns", "hi")
    up = lambda x: F.expr(f"({x} + {step - 1}) div {step}")
    cut = both.withColumns({"s": start, "e": end})
    return cut.select("instrument", "trading_day", "part", up("s").alias("first"), up("e").alias("after"), "s", "e").where("after > first")


def _in_stretches(bars: DataFrame, stretches: DataFrame, step: int) -> DataFrame:
    """Bars with the day and part of the open stretch that they open in; others are left out."""
    day_ns = 86_400_000_000_000
    keyed = stretches.withColumn("utc_day", F.explode(F.sequence(F.expr(f"open_ns div {day_ns}"), F.expr(f"close_ns div {day_ns}"))))
    staged = bars.select("instrument", "ts_open", F.expr(f"ts_open div {day_ns}").alias("utc_day"))
    inside = staged.join(F.broadcast(keyed), "utc_day").where((F.col("ts_open") >= F.col("open_ns")) & (F.col("ts_open") < F.col("close_ns")))
    return inside.select("instrument", "trading_day", "part", F.expr(f"ts_open div {step}").alias("slot"))


def session_gaps(bars: DataFrame, stretches: DataFrame, step: int) -> DataFrame:
    """Runs of slots that lack a bar while the exchange trades: day, first slot's time, end and how many.

    Slots before the first, between two and after the last bar of each stretch
    are found by lags, without a grid of all slots.
    """
    key = ["instrument", "trading_day", "part"]
    marks = _in_stretches(bars, stretches, step).select(*key, "slot")
    expected = _bounded(bars, stretches, step)
    # A mark before the first slot and one after the last close each stretch in.
    fence = expected.select(*key, (F.col("first") - 1).alias("slot")).unionByName(expected.select(*key, F.col("after").alias("slot")))
    order = Window.partitionBy(*key).orderBy("slot")
    rows = marks.unionByName(fence).withColumn("before", F.lag("slot").over(order))
    found = rows.where(F.col("slot") > F.col("before") + 1)
    return found.select(
        "instrument", "trading_day", ((F.col("before") + 1) * step).alias("from_ts"), (F.col("slot") * step).alias("to_ts"),
        (F.col("slot") - F.col("before") - 1).alias("missing"),
    )


def session_coverage(bars: DataFrame, stretches: DataFrame, step: int) -> DataFrame:
    """Per instrument the slots that the exchange traded while it was held, how many lack a bar, and the percentage present."""
    expected = _bounded(bars, stretches, step).groupBy("instrument").agg(F.sum(F.col("after") - F.col("first")).alias("expected"))
    missing = session_gaps(bars, stretches, step).groupBy("instrument").agg(F.sum("missing").alias("missing"))
    rows = expected.join(missing, "instrument", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return rows.withColumn("coverage_pct", (F.col("expected") - F.col("missing")) * 100.0 / F.col("expected"))


def report(bars: DataFrame, stretches: DataFrame, step: int) -> DataFrame:
    """One row per instrument and check: ran with how many findings, or skipped with the reason."""
    names = bars.select("instrument").distinct()
    count = lambda found, check: found.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).select("instrument", F.lit(check).alias("check"), "n")
    outside = bars.select("instrument", "ts_open").join(
        _in_stretches(bars, stretches, step).select("instrument", (F.col("slot") * step).alias("ts_open")), ["instrument", "ts_open"], "left_anti"
    )
    found = count(ohlc_violations(bars), "ohlc").unionByName(count(zero_volume_runs(bars), "zero_volume"))
    found = found.unionByName(count(spikes(bars, step), "spikes")).unionByName(count(session_gaps(bars, stretches, step), "coverage"))
    found = found.unionByName(count(outside, "unexpected"))
    checks = names.withColumn("check", F.explode(F.array(*map(F.lit, ("ohlc", "zero_volume", "spikes", "coverage", "unexpected")))))
    ran = status(bars, step).select("instrument", F.lit("spikes").alias("check"), "reason")
    rows = checks.join(found, ["instrument", "check"], "left").join(ran, ["instrument", "check"], "left")
    skipped = F.col("reason").isNotNull()
    return rows.select(
        "instrument", "check", F.when(skipped, "skipped").otherwise("ran").alias("status"), "reason",
        F.when(~skipped, F.coalesce("n", F.lit(0))).alias("findings"),
    )


def presence(bars: DataFrame, zone: str) -> DataFrame:
    """`root`, `date_key` and `minute` of the exchange's own clock with at least one traded bar (`us`, `volume`); by civil date, not trading day."""
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("us"), zone))
    minutes = bars.where(F.col("volume") > 0).withColumn("m", F.floor(local / 60_000_000).cast("long"))
    return minutes.select("root", F.floor(F.col("m") / 1440).cast("long").alias("date_key"), F.pmod("m", F.lit(1440)).alias("minute")).distinct()


def short_days(grid: DataFrame, first: int, last: int, evening: int, cutoff: int) -> DataFrame:
    """Weekdays from `first` to `last` (date keys) whose day session is absent or ends before `cutoff`, with the first evening minute.

    Every date is asked of every root, so one without any trade is found as well.
    """
    dates = grid.select("root").distinct().withColumn("date_key", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    dates = dates.where((F.col("date_key") + 3) % 7 < 5)
    day, night = F.when(F.col("minute") < evening, F.col("minute")), F.when(F.col("minute") >= evening, F.col("minute"))
    got = dates.join(grid, ["root", "date_key"], "left").groupBy("root", "date_key").agg(F.max(day).alias("last_day_minute"), F.min(night).alias("first_evening"))
    return got.where(F.coalesce("last_day_minute", F.lit(-1)) < cutoff)


def weekly_sessions(grid: DataFrame, open_share: float = 0.5, closed_share: float = 0.05, least_run: int = 5) -> DataFrame:
    """Per root, year and weekday (Monday 0): the usual first and last minute, stretches inside that are usually closed, and minutes that are neither.

    `grid` has root, date_key and minute. Shares are of the weekday's dates that traded at all.
    """
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("date_key").cast("int"))
    rows = grid.select("root", F.year(date).alias("year"), ((F.col("date_key") + 3) % 7).cast("int").alias("weekday"), "date_key", "minute")
    by = ["root", "year", "weekday"]
    dates = rows.groupBy(*by).agg(F.countDistinct("date_key").alias("dates"))
    # A row for each minute of the day, whether it traded or not.
    minutes = dates.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1439)))).join(
        rows.groupBy(*by, F.col("minute").cast("int").alias("minute")).agg(F.count(F.lit(1)).alias("hit")), [*by, "minute"], "left"
    )
    minutes = minutes.withColumn("share", F.coalesce("hit", F.lit(0)) / F.col("dates"))
    whole = Window.partitionBy(*by)
    opened = F.when(F.col("share") >= open_share, F.col("minute"))
    inside = minutes.withColumns({"first": F.min(opened).over(whole), "last": F.max(opened).over(whole)}).where((F.col("minute") >= F.col("first")) & (F.col("minute") <= F.col("last")))
    shut = (F.col("share") <= closed_share).cast("int")
    island = F.col("minute") - F.sum(shut).over(whole.orderBy("minute"))
    runs = inside.withColumn("shut", shut).withColumn("island", island).where("shut = 1").groupBy(*by, "island").agg(F.count(F.lit(1)).alias("length"))
    closed = runs.where(F.col("length") >= least_run).groupBy(*by).agg(F.count(F.lit(1)).alias("closed_runs"), F.sum("length").alias("closed_minutes"))
    unsure = F.count_if((F.col("share") > closed_share) & (F.col("share") < open_share))
    got = inside.groupBy(*by).agg(F.first("dates").alias("dates"), F.first("first").alias("first_minute"), F.first("last").alias("last_minute"), unsure.alias("ambiguous"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("closed_runs", "closed_minutes")}
    return got.join(closed, by, "left").withColumns(zero)


def worst_spikes(found: DataFrame, most: int) -> DataFrame:
    """The `most` spikes of the most sigmas, ties by time and instrument, and how many there are in all."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("sigmas"), "ts_open", "instrument").limit(most).crossJoin(F.broadcast(total))  # one row
