"""Trailing indicators. Each includes the current bar and is null until its window is full."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.prices import points
from .kernel import beside


def series() -> WindowSpec:
    """One instrument in time order; never a window over everything."""
    return Window.partitionBy("instrument").orderBy("ts_open")


def trailing(period: int) -> WindowSpec:
    return series().rowsBetween(-(period - 1), 0)


def full(value: Column, period: int, over: WindowSpec | None = None) -> Column:
    over = over or trailing(period)
    return F.when(F.count(F.lit(1)).over(over) == period, value)


def sma(x: Column, period: int) -> Column:
    return full(F.avg(x).over(trailing(period)), period)


def bollinger(x: Column, period: int, k: float) -> tuple[Column, Column, Column]:
    """(low, middle, high): mean and population deviations around it."""
    over = trailing(period)
    mid, sd = F.avg(x).over(over), F.stddev_pop(x).over(over)
    return tuple(full(c, period) for c in (mid - k * sd, mid, mid + k * sd))


def returns(x: Column) -> Column:
    """x / previous - 1; null without a previous value or where it is zero."""
    prev = F.lag(x).over(series())
    return F.when(prev != 0, x / prev - 1)


def zscore(x: Column, period: int) -> Column:
    over = trailing(period)
    return full((x - F.avg(x).over(over)) / F.nullif(F.stddev_pop(x).over(over), F.lit(0.0)), period)


def stdev(x: Column, period: int) -> Column:
    return full(F.stddev_pop(x).over(trailing(period)), period)


def stdev_of_returns(bars: DataFrame, period: int) -> DataFrame:
    """`stdev` of close returns; bars without a return do not enter the window."""
    with_return = bars.withColumn("ret", returns(points(F.col("close")))).where(F.col("ret").isNotNull())
    return with_return.select("instrument", "ts_open", stdev(F.col("ret"), period).alias("stdev_return"))


def sma_exact(bars: DataFrame, column: str, period: int) -> DataFrame:
    """SMA of whole nanos by differences of running sums: the cost does not grow with the period."""
    over = series()
    run = bars.withColumn("__cum", F.sum(column).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__n", F.row_number().over(over)).withColumn("__old", F.coalesce(F.lag("__cum", period).over(over), F.lit(0)))
    value = F.when(F.col("__n") >= period, (F.col("__cum") - F.col("__old")).cast("double") / period / 1e9)
    return run.select("instrument", "ts_open", value.alias(f"sma_{period}"))


class _Emas:
    def __init__(self, column: int, periods: tuple[int, ...]):
        self.column, self.periods = column, periods
        self.seen, self.levels = 0, [0.0] * len(periods)

    def feed(self, rows: pa.RecordBatch) -> list:
        x = rows.column(self.column).to_numpy(zero_copy_only=False).tolist()
        found = []
        for k, period in enumerate(self.periods):
            alpha, level, out = 2.0 / (period + 1), self.levels[k], np.full(len(x), np.nan)
            for i, value in enumerate(x):
                n = self.seen + i + 1
                if n <= period:
                    level += value
                    if n == period:
                        level /= period
                else:
                    level = alpha * value + (1 - alpha) * level
                if n >= period:
                    out[i] = level
            self.levels[k] = level
            found.append(pa.array(out, pa.float64(), mask=np.isnan(out)))
        self.seen += len(x)
        return found


def with_emas(bars: DataFrame, column: str, named: dict[str, int], keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """`bars` with EMAs (name: period) of a column of doubles, factor 2 / (period + 1), seeded with the mean of the first `period` bars.

    The recurrence is sequential in one series; batches are passed through a kernel that keeps the levels.
    """
    at = [*keys, *[c for c in bars.columns if c not in keys]].index(column)
    return beside(bars, list(keys), ["ts_open"], lambda _: _Emas(at, tuple(named.values())), ", ".join(f"`{n}` double" for n in named))


def ema(bars: DataFrame, column: str, period: int) -> DataFrame:
    """EMA of a price column in points."""
    source = bars.select("instrument", "ts_open", points(F.col(column)).alias("x"))
    return with_emas(source, "x", {"ema": period}).select("instrument", "ts_open", "ema")
