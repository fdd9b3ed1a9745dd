"""Controls that a strategy has to beat, and a strategy that cheats on purpose."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import beside, rows_of

MASK = (1 << 64) - 1
#: Draws of the random-entry control.
RANDOM_ENTRY_DRAWS = 16


def fnv1a(text: str) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in text.encode("utf-8"):
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


#: Absorbed on the streams of controls only, so that none of them is a fold's (fixed value).
CONTROL = 0xFF


def fnv1a_bytes(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


def derive_seed(config: bytes, root_seed: int, combo: int, fold: int | None = None, control: str | None = None, account: str | None = None) -> int:
    """The seed of a fold's or a control's stream: FNV-1a over the run's identity, then the SplitMix64 finalizer."""
    data = config + root_seed.to_bytes(8, "little") + (account or "").encode() + combo.to_bytes(8, "little")
    data += bytes([CONTROL]) + control.encode() if control is not None else int(fold or 0).to_bytes(8, "little")
    return split_mix(fnv1a_bytes(data))[1]


class _Hash:
    def __init__(self, column: int):
        self.column, self.h, self.n = column, 0xCBF29CE484222325, 0

    def feed(self, rows: pa.RecordBatch) -> list:
        values = rows.column(self.column).to_pylist()
        self.h = fnv1a_bytes(b"".join(v.to_bytes(8, "little", signed=True) for v in values), self.h)
        self.n += len(values)
        return [pa.array([self.n], pa.int64()), pa.array([f"{self.h:016x}"], pa.string())]


def result_hash(rows: DataFrame, column: str, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """FNV-1a over a column's values in time order, eight bytes each: two runs agree on every bit, or their hashes differ."""
    need = rows.select(*keys, "ts_open", column)
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = rows_of(need, list(keys), ["ts_open"], lambda _: _Hash(len(keys) + 1), f"{fields}, n long, hash string")
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.max_by("hash", "n").alias("hash"))


def split_mix(state: int) -> tuple[int, int]:
    """The next state and draw of a SplitMix64 stream."""
    state = (state + 0x9E3779B97F4A7C15) & MASK
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return state, z ^ (z >> 31)


def random_schedule(holdings: list[int], start: int, window: int, seed: int) -> list[tuple[int, int]]:
    """(entry, exit) bars of episodes placed anew in a window: same order and holding times, no overlap."""
    slack = window - sum(holdings) + 1
    if slack <= 0:
        raise ValueError("the episodes do not fit into the window")
    state, cuts = seed & MASK, []
    for _ in holdings:
        state, x = split_mix(state)
        cuts.append(x % slack)
    out, used = [], 0
    for cut, hold in zip(sorted(cuts), holdings):
        entry = start + cut + used
        out.append((entry, entry + hold))
        used += hold
    return out


def walk_schedule(schedule: list[tuple[int, int, int]]) -> Iterator[int]:
    """The target after each bar, without end. An entry on the bar of the last exit is consumed by that exit and never happens."""
    held, k, bar = 0, 0, 0
    while True:
        if held and bar >= schedule[k][1]:
            held, k = 0, k + 1
            if k < len(schedule) and schedule[k][0] <= bar:
                k += 1
        elif not held and k < len(schedule) and bar >= schedule[k][0]:
            held = schedule[k][2]
        yield held
        bar += 1


def random_entry_targets(bars: DataFrame, trades: DataFrame, seed: int, start: int = 0) -> DataFrame:
    """Targets that hold as often, as long and in the same directions as `trades`, at random bars.

    `trades` has instrument, opened and closed as bar numbers, and direction.
    """
    return random_entry_draws(bars, trades, [seed], start).drop("draw")


class _Entries:
    """Targets of one draw; its first row says how many bars there are and which episodes are to be placed."""

    def __init__(self, key: tuple, start: int):
        self.key, self.start, self.bar, self.targets = key, start, 0, None

    def feed(self, rows: pa.RecordBatch) -> list:
        out = []
        for bars, episodes in zip(rows.column("__bars").to_pylist(), rows.column("__episodes").to_pylist()):
            if bars is not None:
                found = [(x["opened"], x["closed"], x["direction"]) for x in episodes or ()]
                holds = [max(1, closed - max(opened, self.start)) for opened, closed, _ in found]
                seed = fnv1a(f"{self.key[0]}|{self.key[1]}")
                placed = random_schedule(holds, self.start, bars - self.start, seed) if found else []
                self.targets = walk_schedule([(a, b, d) for (a, b), (_, _, d) in zip(placed, found)])
                out.append(None)
            else:
                out.append(next(self.targets))
        return [pa.array(out, pa.int32())]


def random_entry_draws(bars: DataFrame, trades: DataFrame, seeds: list[int], start: int = 0) -> DataFrame:
    """`random_entry_targets` of each of some seeds, which stand in `draw`.

    The episodes of a draw travel once, ahead of its bars, which pass in batches.
    """
    prices = bars.select("instrument", "ts_open", "open", "high", "low", "close")
    episodes = trades.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("opened", "closed", "direction"))).alias("__episodes"))
    counted = prices.groupBy("instrument").agg(F.count(F.lit(1)).alias("__bars")).join(episodes, "instrument", "left")
    both = counted.withColumn("ts_open", F.lit(-(1 << 62)).cast("long")).unionByName(prices, allowMissingColumns=True)
    both = both.withColumn("draw", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    run = beside(both, ["instrument", "draw"], ["ts_open"], lambda key: _Entries(key, start), "target int")
    return run.where("__bars IS NULL").select(*prices.columns, "draw", "target")


def full_sample_targets(bars: DataFrame, entry: float = 1.0) -> DataFrame:
    """Trades the z-score over all bars, future ones too: what a truncation test must catch."""
    stats = bars.groupBy("instrument").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"))
    z = (F.col("close") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return bars.join(stats, "instrument").withColumn("target", F.when(z > entry, -1).when(z < -entry, 1).otherwise(0)).drop("m", "s")


def lower_median(draws: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    """Of the draws sorted by value and seed the one at place (n - 1) div 2."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(value, seed))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = draws.withColumn("rn", rn).withColumn("n", n)
    return rows.where(F.col("rn") == F.expr("(n - 1) div 2") + 1).drop("rn", "n")


def median_draw(draws: DataFrame, own: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    """The lower median draw, how many draws there are and how many of them the value in `own` is above."""
    beaten = draws.join(own.select(*keys, F.col(value).alias("__own")), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), F.count_if(F.col("__own") > F.col(value)).alias("draws_beaten")
    )
    return lower_median(draws, keys, value, seed).join(beaten, keys)
