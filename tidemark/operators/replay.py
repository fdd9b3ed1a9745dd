"""Replays: targets to fills, equity, trades and protective exits.

An order decided on one bar fills on the next bar's open. Three kernels, from
the weakest that is exact: targets without state are a few windows; the
enter/exit machine and, over whole numbers, brackets and partial closes are
kernels that take an instrument's bars in order, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NANO
from .kernel import beside, rows_of

# ---------------------------------------------------------------- costs


@dataclass(frozen=True)
class Costs:
    """Half-spread per fill in half ticks, and fee per contract. There is no default model."""

    half_ticks: int
    fee: int
    tick: int

    @property
    def slip(self) -> int:
        return self.half_ticks * self.tick // 2


FREE = Costs(0, 0, 1)


@dataclass(frozen=True)
class Spec:
    """Contract and account: dollars a point, contracts, starting cash in nano-dollars."""

    point_value: int = 50
    quantity: int = 1
    cash: int = 100_000 * NANO


# ---------------------------------------------------------------- K1: targets without state


def sma_cross_targets(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Adds `target`: long after the fast mean goes above the slow one, short after it goes below."""
    from .indicators import series, sma

    diff = sma(F.col("close").cast("double"), fast) - sma(F.col("close").cast("double"), slow)
    out = bars.withColumn("diff", diff)
    prev = F.lag("diff").over(series())
    out = out.withColumn("signal", F.when((prev <= 0) & (F.col("diff") > 0), 1).when((prev >= 0) & (F.col("diff") < 0), -1))
    held = F.last("signal", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("target", F.coalesce(held, F.lit(0))).drop("diff", "signal")


def buy_and_hold_targets(bars: DataFrame, start: int = 0) -> DataFrame:
    from .indicators import series

    return bars.withColumn("target", (F.row_number().over(series()) > start).cast("int"))


def marked(targets: DataFrame, spec: Spec, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Targets of -q, 0 or q with `position`, contracts `traded` and `gross`, the change of equity before any cost."""
    over = Window.partitionBy(*keys).orderBy("ts_open")
    pos = F.coalesce(F.lag("target").over(over), F.lit(0)).cast("long") * spec.quantity
    out = targets.withColumn("position", pos)
    before = F.coalesce(F.lag("position").over(over), F.lit(0))
    last_close = F.coalesce(F.lag("close").over(over), F.col("open"))
    gross = before * (F.col("open") - last_close) * spec.point_value + F.col("position") * (F.col("close") - F.col("open")) * spec.point_value
    return out.withColumns({"traded": F.abs(F.col("position") - before), "gross": gross})


def equity(targets: DataFrame, spec: Spec, costs: Costs, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Equity after each bar, for targets of -q, 0 or q; exact in whole nanos."""
    over = Window.partitionBy(*keys).orderBy("ts_open").rowsBetween(Window.unboundedPreceding, 0)
    out = marked(targets, spec, keys).withColumn("fee", F.col("traded") * F.lit(costs.fee))
    change = F.col("gross") - F.col("traded") * F.lit(costs.slip * spec.point_value + costs.fee)
    return out.withColumn("equity", F.lit(spec.cash) + F.sum(change).over(over)).drop("gross")


def cost_levels(targets: DataFrame, spec: Spec, levels: tuple[int, ...], fee: int, tick: int, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Per key and half-spread level in half ticks: bars, contracts, fees and final equity.

    Costs are linear in the contracts traded, so the bars are replayed once,
    whatever the number of levels.
    """
    done = marked(targets, spec, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.sum("traded").alias("traded"), F.sum("gross").alias("gross"))
    rows = done.withColumn("half_ticks", F.explode(F.array(*map(F.lit, levels))))
    slip = F.expr(f"half_ticks * {tick}L div 2")
    cost = F.col("traded") * (slip * spec.point_value + fee)
    return rows.select(
        *keys, "half_ticks", "bars", "traded", (F.col("traded") * F.lit(fee)).alias("fees"), (F.lit(spec.cash) + F.col("gross") - cost).alias("final_equity")
    )


# ---------------------------------------------------------------- K2: enter and exit rules


def machine(state: int, enter_long: bool, exit_long: bool, enter_short: bool, exit_short: bool) -> tuple[int, bool]:
    """The next state and whether both entries fired at once: exits first, then entries when flat."""
    if (state == 1 and exit_long) or (state == -1 and exit_short):
        state = 0
    if state:
        return state, False
    if enter_long and enter_short:
        return 0, True
    return (1 if enter_long else -1 if enter_short else 0), False


class _Machine:
    def __init__(self, flags: list[int]):
        self.flags, self.state = flags, 0

    def feed(self, rows: pa.RecordBatch) -> list:
        flags = [rows.column(i).to_numpy(zero_copy_only=False) for i in self.flags]
        acts = np.flatnonzero(flags[0] | flags[1] | flags[2] | flags[3])
        target, conflict = np.full(rows.num_rows, self.state, np.int32), np.zeros(rows.num_rows, bool)
        # A bar that acts on no state keeps the last one.
        for at, *now in zip(acts.tolist(), *(f[acts].tolist() for f in flags)):
            self.state, conflict[at] = machine(self.state, *now)
            target[at:] = self.state
        return [pa.array(target, pa.int32()), pa.array(conflict, pa.bool_())]


def rule_targets(
    bars: DataFrame, enter_long: Column, exit_long: Column, enter_short: Column | None = None, exit_short: Column | None = None,
    keys: tuple[str, ...] = ("instrument",),
) -> DataFrame:
    """Adds `target` and `conflict`: exits first, then entries when flat; both entries at once stay flat."""
    no = F.lit(False)
    names = ("__el", "__xl", "__es", "__xs")
    flags = [F.coalesce(c, no) if c is not None else no for c in (enter_long, exit_long, enter_short, exit_short)]
    staged = bars.withColumns(dict(zip(names, flags)))
    columns = [*keys, *[c for c in staged.columns if c not in keys]]
    at = [columns.index(n) for n in names]
    return beside(staged, list(keys), ["ts_open"], lambda _: _Machine(at), "target int, conflict boolean").drop(*names)


# ---------------------------------------------------------------- K3: the general kernel


def bracket_levels(fill: int, side: int, tick: int, stop: int | None, target: int | None) -> tuple[int | None, int | None]:
    return (None if stop is None else fill - side * stop * tick, None if target is None else fill + side * target * tick)


def resolve_bracket(side: int, bar, stop: int | None, target: int | None):
    """(price, leg, gapped, path_sensitive) or None; the stop is reached at its level, the target only beyond."""
    o, h, lo = (bar.open, bar.high, bar.low) if side > 0 else (-bar.open, -bar.low, -bar.high)
    s, t = (None if x is None else side * x for x in (stop, target))
    if s is not None and o <= s:
        return side * o, "stop", True, False
    if t is not None and o > t:
        return side * o, "target", True, False
    if s is not None and lo <= s:
        return side * s, "stop", False, t is not None and h > t
    if t is not None and h > t:
        return side * t, "target", False, False
    return None


def _truncated(a: int, b: int) -> int:
    """Whole division towards zero."""
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


class Portfolio:
    """Average-entry accounting in whole numbers, with the excursions of the open trade."""

    def __init__(self, spec: Spec):
        self.spec, self.cash, self.position, self.entry, self.fees = spec, spec.cash, 0, 0, 0
        self.net = self.best = self.worst = 0
        self.opened = None
        self.trades: list[tuple] = []

    def fill(self, ts: int, change: int, price: int, fee: int) -> None:
        pv, before = self.spec.point_value, self.position
        total_fee = fee * abs(change)
        self.cash -= total_fee
        self.fees += total_fee
        self.net -= total_fee
        if before == 0:
            self.opened, self.side = ts, 1 if change > 0 else -1
        if before * change < 0:
            closed = min(abs(change), abs(before)) * (1 if before > 0 else -1)
            gain = (price - self.entry) * pv * closed
            self.cash += gain
            self.net += gain
            self.position += -closed
            if self.position == 0:
                self.trades.append((ts, self.net, self.side, self.opened, self.worst, self.best))
                self.net = self.best = self.worst = 0
            left = change + closed
            if left:
                self.opened, self.side, self.entry, self.position = ts, (1 if left > 0 else -1), price, left
        elif before:
            self.entry = _truncated(self.entry * abs(before) + price * abs(change), abs(before) + abs(change))
            self.position += change
        else:
            self.entry, self.position = price, change

    def mark(self, close: int) -> int:
        open_gain = (close - self.entry) * self.spec.point_value * self.position
        if self.position:
            self.best, self.worst = max(self.best, self.net + open_gain), min(self.worst, self.net + open_gain)
        return self.cash + open_gain


class BracketRun:
    """One instrument's bars in order: pending fill, bracket exit, mark, decision. Bars out of order are an error."""

    def __init__(self, step: int, spec: Spec, costs: Costs, stop: int | None = None, target: int | None = None):
        self.step, self.costs, self.stop, self.target = step, costs, stop, target
        self.book, self.fills = Portfolio(spec), []
        self.pending = self.live = self.last = None

    def _fill(self, ts: int, change: int, price: int, leg: str, unsure: bool) -> None:
        self.book.fill(ts, change, price, self.costs.fee)
        self.fills.append((ts, change, price, leg, unsure))

    def take(self, bar, wanted: int | None) -> tuple[int, int]:
        """(time, equity) after the bar; `wanted` is the position decided on it, None to leave it."""
        book, ts = self.book, bar.ts_open + self.step
        if self.last is not None and ts < self.last:
            raise ValueError(f"bar at {ts} comes after {self.last}")
        self.last = ts
        if self.pending:
            side = 1 if self.pending > 0 else -1
            price = bar.open + side * self.costs.slip
            self._fill(ts, self.pending, price, "order", False)
            self.pending, self.live = None, None
            if book.position and (self.stop is not None or self.target is not None):
                self.live = bracket_levels(price, 1 if book.position > 0 else -1, self.costs.tick, self.stop, self.target)
        if self.live and book.position:
            side = 1 if book.position > 0 else -1
            hit = resolve_bracket(side, bar, *self.live)
            if hit:
                price, leg, _, unsure = hit
                if leg == "stop":
                    price -= side * self.costs.slip
                self._fill(ts, -book.position, price, leg, unsure)
                self.live = None
        mark = (ts, book.mark(bar.close))
        if wanted is not None and wanted != book.position:
            self.pending = wanted - book.position
        return mark


def run_bars(bars, targets, step: int, spec: Spec, costs: Costs, stop: int | None = None, target: int | None = None):
    """(equity, fills, trades, cancelled) of one series; `targets` gives the wanted position after each bar."""
    run = BracketRun(step, spec, costs, stop, target)
    points = [run.take(bar, wanted) for bar, wanted in zip(bars, targets)]
    return points, run.fills, run.book.trades, int(run.pending is not None)


@dataclass
class _Bar:
    ts_open: int
    open: int
    high: int
    low: int
    close: int


class _Brackets:
    """Feeds a `BracketRun` and hands out what is new of its result."""

    TYPES = {
        "fills": (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()),
        "trades": (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
        "equity": (pa.int64(), pa.int64()),
        "cancelled": (pa.int64(), pa.int64()),
    }

    def __init__(self, run: BracketRun, result: str, quantity: int):
        self.run, self.result, self.quantity = run, result, quantity

    def feed(self, rows: pa.RecordBatch) -> list:
        columns = [rows.column(c).to_pylist() for c in ("ts_open", "open", "high", "low", "close", "target")]
        points, opened = [], []
        for *bar, wanted in zip(*columns):
            points.append(self.run.take(_Bar(*bar), wanted * self.quantity))
            opened.append((points[-1][0], self.run.pending or 0))
        found = {"fills": self.run.fills, "trades": self.run.book.trades, "equity": points, "cancelled": opened}[self.result]
        out = [pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * len(self.TYPES[self.result]), self.TYPES[self.result])]
        self.run.fills.clear()
        self.run.book.trades.clear()
        return out


def bracket_replay(targets: DataFrame, step: int, spec: Spec, costs: Costs, stop: int | None, target: int | None, result: str = "fills") -> DataFrame:
    """Runs the general kernel for each instrument; `result` is fills, trades, equity or cancelled (orders that never filled).

    A target decided while the same side was just protected out is entered again.
    """
    schemas = {
        "fills": "instrument string, ts long, change long, price long, leg string, path_sensitive boolean",
        "trades": "instrument string, closed_ts long, net long, direction int, opened_ts long, mae long, mfe long",
        "equity": "instrument string, ts long, equity long",
        "cancelled": "instrument string, ts long, change long",
    }
    need = targets.select("instrument", "ts_open", "open", "high", "low", "close", "target")
    make = lambda _: _Brackets(BracketRun(step, spec, costs, stop, target), result, spec.quantity)
    found = rows_of(need, ["instrument"], ["ts_open"], make, schemas[result])
    if result != "cancelled":
        return found
    last = found.groupBy("instrument").agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts"))
    return last.where("change <> 0").select("instrument", "ts", "change")


# ---------------------------------------------------------------- trades without state


def trades_of(equity_rows: DataFrame, spec: Spec, step: int) -> DataFrame:
    """Round trips of positions in {-q, 0, q}: an episode is a run of bars of one non-zero position.

    The last bar of an episode carries the mark; the closing fill comes on the
    next bar's open, so the trade's net is the change of equity between the
    bar before it opened and its closing fill.
    """
    over = Window.partitionBy("instrument").orderBy("ts_open")
    pos = F.col("position")
    rows = equity_rows.withColumn("before", F.coalesce(F.lag("position").over(over), F.lit(0)))
    rows = rows.withColumn("starts", ((pos != F.col("before")) & (pos != 0)).cast("int"))
    rows = rows.withColumn("episode", F.sum("starts").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next_open", F.lead("open").over(over)).withColumn("next_ts", F.lead("ts_open").over(over))
    rows = rows.withColumn("next_position", F.lead("position").over(over))
    held = rows.where(pos != 0)
    return held.groupBy("instrument", "episode").agg(
        F.min("ts_open").alias("first_ts"),
        F.max("ts_open").alias("last_ts"),
        F.first("position").alias("position"),
        F.min_by("open", "ts_open").alias("entry_open"),
        F.max_by("next_open", "ts_open").alias("exit_open"),
        F.max_by("next_ts", "ts_open").alias("exit_ts"),
        F.max_by("next_position", "ts_open").alias("exit_position"),
        F.min_by("before", "ts_open").alias("before"),
        F.max("close").alias("top_close"),
        F.min("close").alias("bottom_close"),
    )


def closed_trades(equity_rows: DataFrame, spec: Spec, costs: Costs, step: int) -> DataFrame:
    """closed_ts, net, direction, opened_ts, mae, mfe of each closed episode.

    The whole fee of a fill that reverses a position belongs to the trade it closes.
    """
    e = trades_of(equity_rows, spec, step).where(F.col("exit_ts").isNotNull())
    side = F.signum("position").cast("long")
    size = F.abs("position")
    entry = F.col("entry_open") + side * costs.slip
    leave = F.col("exit_open") - side * costs.slip
    opening = F.when(F.col("before") == 0, size).otherwise(0) * F.lit(costs.fee)
    closing = F.abs(F.col("exit_position") - F.col("position")) * F.lit(costs.fee)
    net = F.col("position") * (leave - entry) * spec.point_value - opening - closing
    mark = lambda px: F.col("position") * (px - entry) * spec.point_value - opening
    high, low = mark(F.col("top_close")), mark(F.col("bottom_close"))
    return e.select(
        "instrument",
        (F.col("exit_ts") + step).alias("closed_ts"),
        net.alias("net"),
        side.cast("int").alias("direction"),
        (F.col("first_ts") + step).alias("opened_ts"),
        F.least(F.lit(0), high, low).alias("mae"),
        F.greatest(F.lit(0), high, low).alias("mfe"),
    )
