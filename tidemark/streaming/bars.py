"""Streaming twins: bars from ticks, session folds, ordered feeds and the running position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "0 seconds") -> DataFrame:
    """Bars of a stream of (instrument, ts, seq, price), each emitted when the watermark has passed it."""
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", width))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("instrument", F.col("window.start").alias("ts_open"), "open", "high", "low", "close", "volume")
    )


def stream_sessions(bars: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Volume and last close of each UTC day of a stream of bars with a timestamp `ts`."""
    return (
        bars.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", "1 day"))
        .agg(F.sum("volume").alias("volume"), F.max_by("close", "ts").alias("close"), F.max("ts").alias("last_ts"))
        .select("instrument", F.col("window.start").alias("day"), "volume", "close", "last_ts")
    )


def stream_account(equity: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Last, highest and lowest equity of each UTC day of a stream of (instrument, ts, equity), emitted when the day is over."""
    return (
        equity.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", "1 day"))
        .agg(F.max_by("equity", "ts").alias("close_equity"), F.max("equity").alias("high"), F.min("equity").alias("low"), F.count(F.lit(1)).alias("bars"))
        .select("instrument", F.col("window.start").alias("day"), "close_equity", "high", "low", "bars")
    )


ORDERED = "instrument string, ts_open long, close long, accepted boolean, reason string"


def ordered_feed(bars: DataFrame) -> DataFrame:
    """Each bar marked accepted or, if its time is before the last accepted one, rejected with the reason.

    Late bars are routed to the caller, never dropped in silence.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        # A trigger's rows of one instrument come in frames of no certain order.
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            ok = last is None or r.ts_open >= last
            last = r.ts_open if ok else last
            rows.append((key[0], r.ts_open, r.close, ok, None if ok else "out_of_order"))
        yield pd.DataFrame(rows, columns=["instrument", "ts_open", "close", "accepted", "reason"])
        if last is not None:
            state.update((int(last),))

    return bars.groupBy("instrument").applyInPandasWithState(run, ORDERED, "last long", "append", GroupStateTimeout.NoTimeout)


STEPPED = "instrument string, ts_open long, target int, position int, equity long"


def stream_replay(targets: DataFrame, point_value: int, cash: int, cost: int) -> DataFrame:
    """Equity after each bar of a stream with targets: fills on the bar after the decision.

    The state of an instrument is five whole numbers, whatever the length of the stream.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, wanted, close, equity, seen = state.get if state.exists else (0, 0, 0, cash, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts_open").itertuples(index=False):
            before = position
            gap = (int(r.open) - close) if seen else 0
            position = wanted
            equity += before * gap * point_value + position * (int(r.close) - int(r.open)) * point_value - abs(position - before) * cost
            close, wanted, seen = int(r.close), int(r.target), 1
            rows.append((key[0], int(r.ts_open), wanted, position, equity))
        yield pd.DataFrame(rows, columns=["instrument", "ts_open", "target", "position", "equity"])
        state.update((position, wanted, close, equity, seen))

    return targets.groupBy("instrument").applyInPandasWithState(
        run, STEPPED, "position int, wanted int, close long, equity long, seen int", "append", GroupStateTimeout.NoTimeout
    )
