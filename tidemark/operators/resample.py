"""Resampling to coarser bars and session folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import with_session
from ..functions.prices import whole
from ..schema import tf_ns


def resample(bars: DataFrame, source: str, to: str, day: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """Coarser bars inside of sessions: buckets count from `anchor`, and no bar spans two days.

    Days belong to the time at which a bar is known, buckets to its opening.
    `partial` tells that a bucket lacks its first or last source bar.
    """
    step, wide = tf_ns(source), tf_ns(to)
    if wide <= step or wide % step:
        raise ValueError(f"{source} bars make no {to} bars")
    day_ns = tf_ns("1d")
    avail = F.col("ts_open") + step
    day = day if day is not None else whole(avail - 1, day_ns)
    staged = bars.withColumn("day", day)
    anchor = anchor if anchor is not None else whole(F.col("ts_open"), day_ns) * day_ns
    staged = staged.withColumn("bucket", anchor + whole(F.col("ts_open") - anchor, wide) * wide)
    return staged.groupBy("instrument", "day", "bucket").agg(
        F.min_by("open", "ts_open").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_open").alias("close"),
        F.sum("volume").cast("long").alias("volume"),
        ((F.min("ts_open") > F.first("bucket")) | (F.max("ts_open") + step < F.first("bucket") + wide)).alias("partial"),
    )


def resample_sessions(bars: DataFrame, dim: DataFrame, stretches: DataFrame, source: str, to: str) -> DataFrame:
    """`resample` anchored at the openings of an exchange's sessions, refusing what it can not do honestly.

    An error are sessions with a halt, sessions that open off the source bars'
    grid, and bars that open before the session they are known in. Bars that no
    session holds are left out.
    """
    step = tf_ns(source)
    halted = stretches.where(F.col("part") > 0).select("trading_day").distinct().withColumn("halted", F.lit(True))
    days = dim.where(F.col("open_ns").isNotNull()).join(halted, "trading_day", "left")
    fault = F.when(F.col("halted"), "has a halt").when(F.col("open_ns") % step != 0, "opens off the grid of its bars")
    text = F.concat(F.lit("the session of "), F.col("trading_day").cast("string"), F.lit(" "), fault)
    checked = days.withColumn("__fault", text).drop("halted")
    inside = with_session(bars, checked, step)
    early = F.when(F.col("ts_open") < F.col("open_ns"), F.concat(F.lit("a bar opens before the session of "), F.col("trading_day").cast("string")))
    message = F.coalesce("__fault", early)
    guarded = inside.withColumn("open_ns", F.when(message.isNotNull(), F.raise_error(message).cast("long")).otherwise(F.col("open_ns")))
    return resample(guarded, source, to, F.col("trading_day"), F.col("open_ns"))


def sessions(bars: DataFrame, day: Column, step: int) -> DataFrame:
    """Volume, last close and the time it is known, per contract and day."""
    return bars.withColumn("day", day).groupBy("instrument", "day").agg(
        F.sum("volume").cast("long").alias("volume"),
        F.max_by("close", "ts_open").alias("close"),
        (F.max("ts_open") + step).alias("avail_ts"),
    )
