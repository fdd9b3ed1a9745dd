"""The first stage of the funnel: does a score predict forward returns at all?

Each score is joined with the forward return at every horizon and measured there
by its rank correlation and by the interval of the mean return over resampled
sessions. The criterion asks for both at one and the same horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import forward_returns
from .stats import information_coefficient, session_bootstrap


def measure(scored: DataFrame, horizons: list[int], draws: int, seed: int, keys: tuple[str, ...] = ("combo", "instrument")) -> DataFrame:
    """A row per key and horizon: `ic`, `lo` and `hi` of the mean return, or the reason why one is missing.

    `scored` has the keys, ts, score, price and session_key. A horizon is the
    width of a range frame, so each has a frame of its own.
    """
    out = None
    for place, horizon in enumerate(horizons):
        pairs = forward_returns(scored, horizon, keys).where("status = 'ok'")
        ic = information_coefficient(pairs, keys)
        spread = session_bootstrap(pairs, draws, seed, keys).select(*keys, "lo", "hi")
        every = scored.select(*keys).distinct().join(ic, list(keys), "left").join(spread, list(keys), "left")
        one = every.select(*keys, F.lit(place).alias("place"), F.lit(horizon).alias("horizon"), "ic", F.when(F.col("n").isNull(), "too_few").otherwise(F.col("reason")).alias("reason"), "lo", "hi")
        out = one if out is None else out.unionByName(one)
    return out


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def criterion(measured: DataFrame, least_ic: float, keys: tuple[str, ...] = ("combo", "instrument")) -> DataFrame:
    """`outcome` of each key: passed at `horizon`, the first that clears both halves; unavailable with the first reason
    if any measurement is missing and none passed; else failed.
    """
    there = F.col("ic").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    clears = there & (F.abs("ic") >= least_ic) & excludes_zero(F.col("lo"), F.col("hi"))
    lacking = F.when(~there, F.struct("place", F.coalesce("reason", F.lit("no_interval")).alias("reason")))
    got = measured.groupBy(*keys).agg(F.min(F.when(clears, F.struct("place", "horizon"))).alias("p"), F.min(lacking).alias("l"))
    outcome = F.when(F.col("p").isNotNull(), "passed").when(F.col("l").isNotNull(), "unavailable").otherwise("failed")
    return got.select(*keys, outcome.alias("outcome"), F.col("p.horizon").alias("horizon"), F.when(F.col("p").isNull(), F.col("l.reason")).alias("reason"))


def plan_runs(wanted: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """What to do with each run that a grid asks for: `claim` it before it is measured, `resume` a claim that never finished,
    or `reuse` the recorded result; a run that was voided is claimed anew. `registry` has keys and kind (run, run_finished, void).
    """
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    states = registry.groupBy(*keys).agg(F.when(has("void"), "claim").when(has("run_finished"), "reuse").otherwise("resume").alias("action"))
    return wanted.select(*keys).distinct().join(states, keys, "left").withColumn("action", F.coalesce("action", F.lit("claim")))


def run(scored: DataFrame, registry: DataFrame, horizons: list[int], least_ic: float, draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(claims to record before anything is measured, outcomes) over all combos of a grid that are not recorded yet.

    One batch measures all combos that have to be: they are rows, not a loop.
    """
    keys = ["combo", "instrument"]
    actions = plan_runs(scored, registry, keys)
    claims = actions.where("action = 'claim'").select(*keys, F.lit("run").alias("kind"))
    todo = scored.join(actions.where("action <> 'reuse'").select(*keys), keys, "left_semi")
    return claims, criterion(measure(todo, horizons, draws, seed), least_ic)


def pool_plan(bars: DataFrame, windows: DataFrame, closes: DataFrame, step: int, warmup: int) -> DataFrame:
    """Bars of each contract that a pooled run replays: its front window with `warmup` bars before it and without a cut last day.

    `windows` has contract, after, until (instants; a bar belongs if it is known
    after the one and not after the other), `closes` trading_day and close_ns,
    and `bars` contract, ts_open, day. `role` is warmup or test. The last day is
    dropped where the window ends before that day's close; a contract that has
    fewer bars before its window than the warm-up needs is `short`.
    """
    avail = F.col("ts_open") + step
    rows = bars.join(windows, "contract").where(avail <= F.col("until")).withColumn("front", avail > F.col("after"))
    before = Window.partitionBy("contract", "front").orderBy(F.desc("ts_open"))
    rows = rows.withColumn("back", F.when(~F.col("front"), F.row_number().over(before)))
    each = Window.partitionBy("contract")
    rows = rows.withColumns({"lead_in": F.count("back").over(each), "last_day": F.max(F.when(F.col("front"), F.col("day"))).over(each)})
    rows = rows.join(F.broadcast(closes.select(F.col("trading_day").alias("last_day"), "close_ns")), "last_day", "left")
    cut = F.col("front") & (F.col("day") == F.col("last_day")) & (F.col("until") < F.col("close_ns"))
    kept = rows.where((F.col("front") | (F.col("back") <= warmup)) & ~F.coalesce(cut, F.lit(False)))
    role = F.when(F.col("front"), "test").otherwise("warmup")
    return kept.select(*bars.columns, role.alias("role"), (F.col("lead_in") < warmup).alias("short"))
