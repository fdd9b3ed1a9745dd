"""Summaries of equity curves: returns, drawdowns, moments, trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bar_returns(equity: DataFrame, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """`ret` of each bar; skipped while the equity before was not positive."""
    prev = F.lag("equity").over(Window.partitionBy(*keys).orderBy("ts_open"))
    return equity.withColumn("ret", F.when(prev > 0, F.col("equity").cast("double") / prev - 1))


def drawdowns(equity: DataFrame, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Running peak and the fraction below it, while the peak is positive."""
    run = Window.partitionBy(*keys).orderBy("ts_open").rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("peak", F.max("equity").over(run))
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")).cast("double") / F.col("peak")))


def moments(x: Column) -> list[Column]:
    """n, mean and the undivided central moments m2, m3, m4, merged across tasks by the engine's own stable aggregates."""
    x = x.cast("double")
    n, var = F.count(x).cast("double"), F.coalesce(F.var_pop(x), F.lit(0.0))
    skew, excess = (F.when(var > 0, c).otherwise(F.lit(0.0)) for c in (F.skewness(x), F.kurtosis(x)))
    return [
        F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), (var * n).alias("m2"),
        (skew * F.pow(var, F.lit(1.5)) * n).alias("m3"), F.when(var > 0, (excess + 3) * var * var * n).otherwise(F.lit(0.0)).alias("m4"),
    ]


def _merged(a, b):
    """Moments of two samples put together (pairwise update of central moments by Chan and others, and by Pebay)."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n, d = na + nb, b["mean"] - a["mean"]
    m3 = a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n) + 3.0 * d * (na * b["m2"] - nb * a["m2"]) / n
    m4 = (
        a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
        + 6.0 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4.0 * d * (na * b["m3"] - nb * a["m3"]) / n
    )
    both = F.struct(
        (a["n"] + b["n"]).alias("n"), (a["mean"] + d * nb / n).alias("mean"), (a["m2"] + b["m2"] + d * d * na * nb / n).alias("m2"),
        m3.alias("m3"), m4.alias("m4"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def combine_moments(parts: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """`moments` of all parts of a key together, folded in the order given: a few contracts each, in one row."""
    names = ("n", "mean", "m2", "m3", "m4")
    rows = F.sort_array(F.collect_list(F.struct(order, F.struct(*names).alias("v"))))
    empty = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in names[1:]])
    total = F.aggregate(F.transform(rows, lambda x: x["v"]), empty, _merged)
    return parts.groupBy(*keys).agg(total.alias("v")).select(*keys, "v.*")


def sharpe(per_year: float = 1.0) -> Column:
    """mean over sample deviation, times the root of bars a year; null for fewer than two or no spread."""
    n = F.col("n").cast("double")
    return F.when((n >= 2) & (F.col("m2") > 0), F.col("mean") / F.sqrt(F.col("m2") / (n - 1)) * F.sqrt(F.lit(per_year)))


def shape() -> tuple[Column, Column]:
    """Population skew and raw kurtosis; null for fewer than two or no spread."""
    n, var = F.col("n").cast("double"), F.col("m2") / F.col("n")
    ok = (n >= 2) & (F.col("m2") > 0)
    return F.when(ok, F.col("m3") / n / F.pow(var, F.lit(1.5))), F.when(ok, F.col("m4") / n / (var * var))


def summary(equity: DataFrame, per_year: float, keys: tuple[str, ...] = ("instrument",), trades: DataFrame | None = None) -> DataFrame:
    """One row per curve: ends, return and drawdown in percent, Sharpe ratio, shape of the returns, fees, and of `trades` round trips and win rate."""
    rows = drawdowns(bar_returns(equity, keys), keys)
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("equity", "ts_open").alias("first_equity"),
        F.max_by("equity", "ts_open").alias("final_equity"),
        F.max("drawdown").alias("__dd"),
        F.sum("fee").cast("long").alias("fees"),
        *moments(F.col("ret")),
    )
    skew, kurtosis = shape()
    first = F.col("first_equity")
    change = F.when(first != 0, (F.col("final_equity").cast("double") / first - 1) * 100).otherwise(F.lit(0.0))
    out = got.select(
        *keys, "bars", "first_equity", "final_equity", change.alias("return_pct"), (F.coalesce("__dd", F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        sharpe(per_year).alias("sharpe"), skew.alias("skew"), kurtosis.alias("kurtosis"), "fees",
    )
    if trades is None:
        return out
    closed = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("round_trips"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))
    return out.join(closed, list(keys), "left").withColumn("round_trips", F.coalesce("round_trips", F.lit(0)))


def account_days(equity: DataFrame, day: Column, cash: int, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Per trading day: close, peak and trough from the open, and the largest drop from the running peak.

    A day opens at the close of the day before; the first at the initial cash.
    """
    order = Window.partitionBy(*keys).orderBy("ts_open")
    rows = equity.withColumn("day", day).withColumn("bar", F.row_number().over(order) - 1)
    last = rows.groupBy(*keys, "day").agg(F.max_by("equity", "ts_open").alias("close_equity"))
    before = F.coalesce(F.lag("close_equity").over(Window.partitionBy(*keys).orderBy("day")), F.lit(cash))
    opened = last.select(*keys, "day", before.alias("day_open"))
    rows = rows.join(opened, [*keys, "day"]).withColumn("pnl", F.col("equity") - F.col("day_open"))
    run = Window.partitionBy(*keys, "day").orderBy("ts_open").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("drop", F.greatest(F.lit(0), F.max("pnl").over(run)) - F.col("pnl"))
    return rows.groupBy(*keys, "day").agg(
        F.min("bar").alias("bar_lo"),
        (F.max("bar") + 1).alias("bar_hi"),
        F.max_by("pnl", "ts_open").alias("close_pnl"),
        F.greatest(F.lit(0), F.max("pnl")).alias("peak_from_open"),
        F.least(F.lit(0), F.min("pnl")).alias("trough_from_open"),
        F.max("drop").alias("max_drop"),
    )


def run_high_water(equity: DataFrame, cash: int, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Highest cumulative gain of the run, from 0 on, and the largest drop from it."""
    run = Window.partitionBy(*keys).orderBy("ts_open").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("equity") - F.lit(cash)
    rows = equity.withColumn("gain", gain).withColumn("water", F.greatest(F.lit(0), F.max(gain).over(run)))
    return rows.groupBy(*keys).agg(F.max("water").alias("peak_pnl"), F.max(F.col("water") - F.col("gain")).alias("max_drop"))


def first_crossing(equity: DataFrame, level: int, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """The first bar at which equity reaches `level`."""
    return equity.where(F.col("equity") >= level).groupBy(*keys).agg(F.min("ts_open").alias("crossed_ts"))


def first_insolvent(equity: DataFrame, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Index of the first bar with equity of zero or below and the share of the run before it."""
    order = Window.partitionBy(*keys).orderBy("ts_open")
    rows = equity.withColumn("bar", F.row_number().over(order) - 1)
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.min(F.when(F.col("equity") <= 0, F.col("bar"))).alias("first_bar"))
    return got.withColumn("run_share", F.col("first_bar") / F.col("bars"))


def nearest_rank(days: DataFrame, column: str, percents: list[int], keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p n / 100)."""
    kind = days.schema[column].dataType
    at = lambda p: F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast(kind)
    return days.groupBy(*keys).agg(*[at(p).alias(f"p{p}") for p in percents])
