"""Strategy configurations: indicator slots with axes, expanded to combos, run over one scan."""

from __future__ import annotations

import hashlib
import tomllib
import warnings
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import session_clock, with_session
from ..functions.prices import points
from ..operators import indicators, replay
from ..operators.kernel import rows_of
from ..schema import NANO
from .rules import PRICES, SESSION, Expr, RuleError, canonical, compile_rule, evaluate, has_cross, operands, parse

WARN_COMBOS, MOST_COMBOS = 10_000, 50_000
#: Combos whose states one kernel carries side by side.
CHUNK = 64
RULES = ("enter_long", "exit_long", "enter_short", "exit_short")
#: Keys of the other tables of a configuration.
TABLES = {
    "meta": ("name", "hypothesis", "family"),
    "contract": ("tick", "point_value", "quantity"),
    "execution": ("half_spread_ticks", "fee", "cash"),
    "brackets": ("stop_ticks", "target_ticks"),
    "walk_forward": ("train_days", "test_days", "step_days", "anchored"),
    "run": ("seed",),
}
FIELDS = {"sma": ("value",), "ema": ("value",), "bollinger": ("lower", "middle", "upper"), "zscore": ("value",), "stdev": ("value",)}


@dataclass(frozen=True)
class Config:
    """Slots sorted by name, each with its axes in declared order; the four rules; the other tables as they were written."""

    slots: tuple[tuple[str, str, tuple[tuple[str, tuple], ...]], ...]
    rules: tuple[tuple[str, Expr], ...]
    tables: dict[str, dict] = field(default_factory=dict)

    def costs(self) -> replay.Costs:
        """Half-spread in whole or half ticks and fee in dollars a contract; there is no default."""
        execution, tick = self.tables["execution"], self.tables["contract"]["tick"]
        doubled = float(execution["half_spread_ticks"]) * 2
        if doubled < 0 or abs(doubled - round(doubled)) > 1e-9:
            raise ValueError("half_spread_ticks is not in half ticks")
        return replay.Costs(round(doubled), round(float(execution["fee"]) * NANO), round(float(tick) * NANO))

    def brackets(self) -> tuple[int | None, int | None]:
        """Protective stop and target in ticks from the fill, each may be absent."""
        given = self.tables.get("brackets", {})
        return given.get("stop_ticks"), given.get("target_ticks")

    def spec(self) -> replay.Spec:
        contract, execution = self.tables.get("contract", {}), self.tables.get("execution", {})
        return replay.Spec(contract.get("point_value", 50), contract.get("quantity", 1), execution.get("cash", 100_000) * NANO)

    def axes(self) -> list[tuple[str, str, tuple]]:
        return [(slot, axis, values) for slot, _, axes in self.slots for axis, values in axes]

    def size(self) -> int:
        n = 1
        for _, _, values in self.axes():
            n *= len(values)
        return n

    def identity(self) -> str:
        """A hash that does not depend on spelling or slot order."""
        text = [f"{s}:{k}:{axes!r}" for s, k, axes in self.slots] + [f"{n}={canonical(e)}" for n, e in self.rules]
        text += [f"{t}.{k}={v!r}" for t in sorted(self.tables) for k, v in sorted(self.tables[t].items()) if t != "meta"]
        return hashlib.sha256("\n".join(f"{len(t)}:{t}" for t in text).encode()).hexdigest()

    def combos(self) -> list[dict[str, object]]:
        """All combos; the last axis changes fastest."""
        axes = self.axes()
        return [{f"{s}.{a}": v for (s, a, _), v in zip(axes, values)} for values in product(*(v for _, _, v in axes))]

    def warmup(self) -> int:
        """Bars before any combo may act: the longest window, and one for crossovers."""
        longest = max((max(v) for _, a, v in self.axes() if a == "period"), default=0)
        return int(longest) + any(has_cross(e) for _, e in self.rules)


def _axis(name: str, value) -> tuple:
    if isinstance(value, dict):
        if set(value) != {"start", "end", "step"} or value["step"] <= 0:
            raise ValueError(f"axis {name} needs start, end and a positive step")
        values = tuple(range(value["start"], value["end"] + 1, value["step"]))
    else:
        values = tuple(value) if isinstance(value, list) else (value,)
    if not values or len(set(values)) != len(values):
        raise ValueError(f"axis {name} is empty or has a value twice")
    return values


def load(text: str) -> Config:
    """Reads TOML; unknown keys are refused."""
    raw = tomllib.loads(text)
    if unknown := sorted(set(raw) - {*TABLES, "indicators", "rules"}):
        raise ValueError(f"unknown tables: {unknown}")
    for name in TABLES:
        if unknown := sorted(set(raw.get(name, {})) - set(TABLES[name])):
            raise ValueError(f"unknown keys of {name}: {unknown}")
    slots, known = [], set()
    for slot in sorted(raw.get("indicators", {})):
        body = dict(raw["indicators"][slot])
        kind = body.pop("kind")
        if kind not in FIELDS:
            raise ValueError(f"unknown indicator {kind!r}")
        slots.append((slot, kind, tuple((a, _axis(a, v)) for a, v in body.items())))
        known |= {f"{slot}.{f}" for f in FIELDS[kind]}
    rules = raw.get("rules", {})
    if set(rules) - set(RULES) or not rules:
        raise RuleError("rules are enter_long, exit_long, enter_short and exit_short")
    config = Config(tuple(slots), tuple((n, parse(rules[n], known)) for n in sorted(rules)), {t: raw[t] for t in TABLES if t in raw})
    if config.size() > WARN_COMBOS:
        warnings.warn(f"{config.size()} combos are many trials", stacklevel=2)
    if config.size() > MOST_COMBOS:
        raise ValueError(f"{config.size()} combos; at most {MOST_COMBOS} are run")
    return config


def _fields(kind: str, given: dict[str, object], ema: Column | None) -> dict[str, Column]:
    """The indicator's columns, by field, with one choice of its axes."""
    close, period = points(F.col("close")), int(given["period"])
    if kind == "bollinger":
        return dict(zip(("lower", "middle", "upper"), indicators.bollinger(close, period, float(given.get("k", 2.0)))))
    return {"value": {"sma": indicators.sma, "zscore": indicators.zscore, "stdev": indicators.stdev}[kind](close, period) if ema is None else ema}


def _settings(config: Config) -> list[tuple[str, str, tuple[tuple[str, object], ...]]]:
    """(slot, kind, choice of axes) of everything that any combo asks for: sums over slots, not products."""
    return [(slot, kind, tuple(zip([a for a, _ in axes], values))) for slot, kind, axes in config.slots for values in product(*(v for _, v in axes))]


def _staged(bars: DataFrame, config: Config, settings: list, dim: DataFrame | None, step: int | None) -> tuple[DataFrame, dict[tuple, str]]:
    """Bars with a column for each setting's field and session word, and the columns' names."""
    emas = {f"__e{given['period']}": int(given["period"]) for _, kind, choice in settings if kind == "ema" for given in [dict(choice)]}
    if emas:
        bars = indicators.with_emas(bars.withColumn("__x", points(F.col("close"))), "__x", emas).drop("__x")
    names: dict[tuple, str] = {}
    columns: dict[str, Column] = {}
    for slot, kind, choice in settings:
        ema = F.col(f"__e{dict(choice)['period']}") if kind == "ema" else None
        for name, column in _fields(kind, dict(choice), ema).items():
            names[slot, choice, name] = f"__v{len(names)}"
            columns[names[slot, choice, name]] = column
    used = set().union(*(operands(e) for _, e in config.rules)) & set(SESSION)
    if used:
        if dim is None or step is None:
            raise RuleError("the rules ask for session words, so a session table is needed")
        clock = session_clock(step)
        inside = with_session(bars, dim, step).select("instrument", "ts_open", *[clock[w].alias(f"__{w}") for w in sorted(used)])
        bars = bars.join(inside, ["instrument", "ts_open"], "left")
        names |= {("session", w): f"__{w}" for w in used}
    return bars.withColumns(columns).drop(*emas), names


def signals(bars: DataFrame, config: Config, combo: dict[str, object], dim: DataFrame | None = None, step: int | None = None) -> DataFrame:
    """Bars with the rules of one combo as columns; the first bars are held back."""
    over = indicators.series()
    choice = lambda slot: tuple((k.split(".")[1], v) for k, v in combo.items() if k.startswith(f"{slot}."))
    # Indicator columns first, so that crossovers look at columns, not at windows of windows.
    staged, names = _staged(bars, config, [(slot, kind, choice(slot)) for slot, kind, _ in config.slots], dim, step)
    columns = {p: points(F.col(p)) for p in PRICES[:4]} | {"volume": F.col("volume").cast("double")}
    columns |= {k[1] if k[0] == "session" else f"{k[0]}.{k[2]}": F.col(c) for k, c in names.items()}
    ready = F.row_number().over(over) > config.warmup()
    rules = {f"rule_{n}": ready & F.coalesce(compile_rule(e, columns, over), F.lit(False)) for n, e in config.rules}
    return staged.withColumns(rules).drop(*names.values())


class _Combos:
    """The states and equity of some combos over one instrument's bars."""

    def __init__(self, config: Config, places: dict[str, np.ndarray], combos: np.ndarray, spec: replay.Spec, costs: replay.Costs):
        self.rules, self.warmup, self.combos, self.places = dict(config.rules), config.warmup(), combos, places
        self.spec, self.costs, self.cost = spec, costs, costs.slip * spec.point_value + costs.fee
        self.stop, self.gain = config.brackets()
        n = len(combos)
        zero = lambda: np.zeros(n, np.int64)
        self.cash, self.entry, self.pending, self.levels, self.live = np.full(n, spec.cash, np.int64), zero(), zero(), (zero(), zero()), np.zeros(n, bool)
        self.seen, self.close = 0, None
        self.state, self.position = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.equity, self.contracts = np.full(n, spec.cash, np.int64), np.zeros(n, np.int64)
        self.before: dict[str, float] = {}

    def _values(self, rows: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Operands as rows x combos (or x 1), the last row of the batch before first."""
        plain = {}
        for name in rows.schema.names:
            if name in PRICES or name.startswith("__"):
                x = rows.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = x / NANO if name in PRICES[:4] else x
                plain[name] = np.concatenate([[self.before.get(name, np.nan)], np.where(np.isfinite(x), x, np.nan)])
        self.before = {name: float(x[-1]) for name, x in plain.items()}
        out = {name: plain[name][:, None] for name in PRICES} | {w: plain[f"__{w}"][:, None] for w in SESSION if f"__{w}" in plain}
        return out | {name: np.stack([plain[c] for c in columns], axis=1) for name, columns in self.places.items()}

    def feed(self, rows: pa.RecordBatch) -> list:
        n, c = rows.num_rows, len(self.combos)
        values = self._values(rows)
        ready = np.arange(self.seen + 1, self.seen + n + 1) > self.warmup
        flags = []
        for name in RULES:
            if name not in self.rules:
                flags.append(np.zeros((n, c), bool))
                continue
            known, value = evaluate(self.rules[name], values)
            flags.append(np.broadcast_to((known & value)[1:], (n, c)) & ready[:, None])
        enter_long, exit_long, enter_short, exit_short = flags
        target = np.empty((n, c), np.int64)
        acts = (enter_long | exit_long | enter_short | exit_short).any(axis=1)
        state, last = self.state, 0
        for i in np.flatnonzero(acts).tolist():
            target[last:i] = state
            state = np.where(((state == 1) & exit_long[i]) | ((state == -1) & exit_short[i]), 0, state)
            opening = np.where(enter_long[i] & ~enter_short[i], 1, np.where(enter_short[i] & ~enter_long[i], -1, 0))
            state = np.where(state == 0, opening, state)
            last = i
        target[last:] = state
        if self.stop is not None or self.gain is not None:
            self._protected(rows, target)
        else:
            self._marked(rows, target)
        self.state, self.seen = state, self.seen + n
        numbers = (self.combos, np.full(c, self.seen), self.equity, self.contracts)
        return [pa.array(x, pa.int64()) for x in numbers]

    def _marked(self, rows: pa.RecordBatch, target: np.ndarray) -> None:
        """Orders on the next open, for all bars at once."""
        opened, closed = (rows.column(x).to_numpy() for x in ("open", "close"))
        held = np.vstack([self.state[None], target[:-1]]) * self.spec.quantity
        before = np.vstack([self.position[None], held[:-1]])
        gap = opened - np.concatenate([[opened[0] if self.close is None else self.close], closed[:-1]])
        traded = np.abs(held - before)
        gain = (before * gap[:, None] + held * (closed - opened)[:, None]) * self.spec.point_value - traded * self.cost
        self.equity, self.contracts = self.equity + gain.sum(axis=0), self.contracts + traded.sum(axis=0)
        self.position, self.close = held[-1], int(closed[-1])

    def _protected(self, rows: pa.RecordBatch, target: np.ndarray) -> None:
        """Bar by bar, all combos side by side: pending fill, bracket exit, mark, decision, as `replay.BracketRun` does for one."""
        pv, fee, slip, tick = self.spec.point_value, self.costs.fee, self.costs.slip, self.costs.tick
        prices = zip(*(rows.column(x).to_pylist() for x in ("open", "high", "low", "close")), target * self.spec.quantity)
        never = np.iinfo(np.int64).max // 4
        for opened, high, low, close, wanted in prices:
            filled = self.pending != 0
            price = opened + np.sign(self.pending) * slip
            self.cash += np.where(filled, (price - self.entry) * pv * self.position - np.abs(self.pending) * fee, 0)
            self.contracts = self.contracts + np.abs(self.pending)
            self.position = self.position + self.pending
            self.entry = np.where(filled, price, self.entry)
            side = np.sign(self.position)
            stop = price - side * (self.stop or 0) * tick
            gain = price + side * (self.gain or 0) * tick
            self.levels = tuple(np.where(filled, new, old) for new, old in zip((stop, gain), self.levels))
            self.live = np.where(filled, self.position != 0, self.live & (self.position != 0))
            top, bottom = np.where(side > 0, high, -low), np.where(side > 0, low, -high)
            s = side * self.levels[0] if self.stop is not None else np.full(len(side), -never)
            t = side * self.levels[1] if self.gain is not None else np.full(len(side), never)
            gap_stop = self.live & (side * opened <= s)
            gap_gain = self.live & ~gap_stop & (side * opened > t)
            inside = self.live & ~gap_stop & ~gap_gain
            hit_stop = inside & (bottom <= s)
            hit_gain = inside & ~hit_stop & (top > t)
            left = gap_stop | gap_gain | hit_stop | hit_gain
            out = np.where(gap_stop | gap_gain, opened, np.where(hit_stop, self.levels[0], self.levels[1])) - np.where(gap_stop | hit_stop, side * slip, 0)
            self.cash += np.where(left, (out - self.entry) * pv * self.position - np.abs(self.position) * fee, 0)
            self.contracts = self.contracts + np.where(left, np.abs(self.position), 0)
            self.position = np.where(left, 0, self.position)
            self.live = self.live & ~left
            self.equity = self.cash + (close - self.entry) * pv * self.position
            self.pending = wanted - self.position


def run(bars: DataFrame, config: Config, spec: replay.Spec, costs: replay.Costs, dim: DataFrame | None = None, step: int | None = None) -> DataFrame:
    """Final equity and contracts traded of each combo and instrument.

    Every indicator setting is one window column over one scan of the bars.
    Combos are rows: chunks of them are a key beside the instrument, and a
    kernel carries the states of a chunk, so neither the plan nor a task grows
    with the number of combos.
    """
    settings = _settings(config)
    staged, names = _staged(bars, config, settings, dim, step)
    combos = config.combos()
    wanted = sorted(set().union(*(operands(e) for _, e in config.rules)) - set(PRICES) - set(SESSION))
    choices = [{slot: tuple((k.split(".")[1], v) for k, v in combo.items() if k.startswith(f"{slot}.")) for slot, _, _ in config.slots} for combo in combos]
    places = {w: np.array([names[w.split(".")[0], choice[w.split(".")[0]], w.split(".")[1]] for choice in choices]) for w in wanted}
    used = {*(c for columns in places.values() for c in columns), *(c for k, c in names.items() if k[0] == "session")}
    chunks = -(-len(combos) // CHUNK)
    rows = staged.select("instrument", "ts_open", *PRICES, *sorted(used)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def make(key: tuple) -> _Combos:
        part = np.arange(key[1] * CHUNK, min(len(combos), (key[1] + 1) * CHUNK))
        return _Combos(config, {w: columns[part] for w, columns in places.items()}, part, spec, costs)

    schema = "instrument string, chunk int, combo long, n long, final_equity long, contracts long"
    found = rows_of(rows, ["instrument", "chunk"], ["ts_open"], make, schema)
    return found.groupBy("combo", "instrument").agg(F.max_by("final_equity", "n").alias("final_equity"), F.max("contracts").alias("contracts"))
