"""Walk-forward folds and windowed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import day_known


def fold_plan(days: int, train: int, test: int, step: int, anchored: bool = False, first_day: int = 0) -> list[tuple[int, str, int, int]]:
    """(fold, part, day_lo, day_hi) in whole days; a tail too short for a test window makes no fold."""
    if min(train, test, step) <= 0 or step < test:
        raise ValueError("windows need positive sizes and a step of at least the test window")
    out, k = [], 0
    while train + k * step + test <= days - first_day:
        start = first_day + k * step
        out.append((k, "train", first_day if anchored else start, start + train))
        out.append((k, "test", start + train, start + train + test))
        k += 1
    return out


def number_days(bars: DataFrame, step: int, day_ns: int) -> DataFrame:
    """`bar` and `day_index`, both from 0, of each bar in its instrument; days by the time a bar is known."""
    over = Window.partitionBy("instrument").orderBy("ts_open")
    day = day_known(step, day_ns)
    return bars.withColumn("day", day).withColumn("bar", F.row_number().over(over) - 1).withColumn(
        "day_index", F.dense_rank().over(Window.partitionBy("instrument").orderBy("day")) - 1
    )


def fold_returns(equity: DataFrame, folds: DataFrame, cash: int) -> DataFrame:
    """Return of each fold's windows, re-based to the initial cash: one replay, sliced.

    The folds, a few rows, are broadcast; a bar may be in several train windows.
    """
    over = Window.partitionBy("instrument").orderBy("bar")
    rows = equity.withColumn("delta", F.col("equity") - F.coalesce(F.lag("equity").over(over), F.lit(cash)))
    inside = rows.join(F.broadcast(folds), (F.col("day_index") >= F.col("day_lo")) & (F.col("day_index") < F.col("day_hi")))
    return inside.groupBy("instrument", "fold", "part").agg(
        F.min("bar").alias("bar_lo"), (F.max("bar") + 1).alias("bar_hi"), F.sum("delta").cast("long").alias("gain")
    ).withColumn("return_pct", F.col("gain").cast("double") / cash * 100)


def stitched(equity: DataFrame, folds: DataFrame, cash: int) -> DataFrame:
    """The curve over all test windows in order, from the initial cash on."""
    over = Window.partitionBy("instrument").orderBy("bar")
    rows = equity.withColumn("delta", F.col("equity") - F.coalesce(F.lag("equity").over(over), F.lit(cash)))
    tests = F.broadcast(folds.where(F.col("part") == "test"))
    inside = rows.join(tests, (F.col("day_index") >= F.col("day_lo")) & (F.col("day_index") < F.col("day_hi")))
    run = over.rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("equity", F.lit(cash) + F.sum("delta").over(run)).drop("delta")


def first_whole_day(numbered: DataFrame, warmup: int) -> DataFrame:
    """Per instrument the first bar after the warm-up that opens a day, that day's index, and the bars of a cut day before it."""
    opens = F.row_number().over(Window.partitionBy("instrument", "day_index").orderBy("bar")) == 1
    rows = numbered.withColumn("opens", opens).where(F.col("bar") >= warmup)
    got = rows.groupBy("instrument").agg(F.min(F.when(F.col("opens"), F.struct("bar", "day_index"))).alias("s"), F.count(F.lit(1)).alias("left"))
    return got.select("instrument", F.col("s.bar").alias("first_bar"), F.col("s.day_index").alias("first_day"), F.coalesce(F.col("s.bar") - warmup, F.col("left")).alias("partial_day_bars"))


def fold_summaries(equity: DataFrame, folds: DataFrame, cash: int, per_year: float = 1.0) -> DataFrame:
    """Each window's own summary from one replay: its curve re-based to the initial cash, with return, Sharpe ratio, drawdown and days.

    `fold` -1 with part test is the curve stitched over all test windows, and
    with part train the windows of the pooled training parts one after the other.
    """
    from .metrics import moments, sharpe

    over = Window.partitionBy("instrument").orderBy("bar")
    rows = equity.withColumn("delta", F.col("equity") - F.coalesce(F.lag("equity").over(over), F.lit(cash)))
    inside = rows.join(F.broadcast(folds), (F.col("day_index") >= F.col("day_lo")) & (F.col("day_index") < F.col("day_hi")))
    inside = inside.select("instrument", "bar", "day_index", "delta", "part", F.explode(F.array(F.col("fold").cast("int"), F.lit(-1))).alias("window"), F.col("fold").alias("of"))
    key = Window.partitionBy("instrument", "window", "part").orderBy("of", "bar")
    based = inside.withColumn("e", F.lit(cash) + F.sum("delta").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    prev = F.coalesce(F.lag("e").over(key), F.lit(cash))
    based = based.withColumn("ret", F.when(prev > 0, F.col("e").cast("double") / prev - 1))
    based = based.withColumn("peak", F.greatest(F.lit(cash), F.max("e").over(key.rowsBetween(Window.unboundedPreceding, 0))))
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("e")).cast("double") / F.col("peak"))
    got = based.groupBy("instrument", F.col("window").alias("fold"), "part").agg(
        F.count(F.lit(1)).alias("bars"), F.countDistinct("day_index").alias("sessions"), (F.sum("delta").cast("double") / cash * 100).alias("return_pct"),
        (F.max(fall) * 100).alias("max_drawdown_pct"), *moments(F.col("ret")),
    )
    return got.select("instrument", "fold", "part", "bars", "sessions", "return_pct", "max_drawdown_pct", sharpe(per_year).alias("sharpe"))
