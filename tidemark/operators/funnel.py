"""Verdicts: ordered stages, pooling of contracts, cost sweeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("s0", "s1", "s2")
#: Known but not built as a stage of its own, so a configuration that asks for it is refused.
LATER = ("s3",)
#: Half-spread levels, in half ticks, that every sweep has to hold (fixed values: free, half a tick, one and two).
SWEPT = (0, 1, 2, 4)


class CriteriaError(ValueError):
    """Criteria that cannot be judged by, refused before any bar is read."""


def half_ticks(ticks: float) -> int:
    """Twice a number of ticks in whole or half ticks."""
    doubled = float(ticks) * 2
    if not 0 <= doubled <= 1000 or abs(doubled - round(doubled)) >= 1e-9:
        raise CriteriaError(f"{ticks} ticks are not in half ticks")
    return round(doubled)


@dataclass(frozen=True)
class Criteria:
    """What a verdict is pre-registered to ask for."""

    stages: tuple[str, ...]
    sweep: tuple[int, ...]
    kill_level: int
    least_trades: int = 30
    least_sessions: int = 20
    least_free_return: float = 0.0
    least_sharpe: float = 0.0
    controls: bool = True
    least_ic: float | None = None
    most_p: float | None = None
    most_pbo: float = 0.5

    @staticmethod
    def load(stages: list[str], sweep_ticks: list[float], kill_ticks: float, **given) -> "Criteria":
        """Refuses unknown and unbuilt stages, an incomplete sweep, a kill level outside of it, and an S0 block without S0 or the reverse."""
        for name in stages:
            if name in LATER:
                raise CriteriaError(f"stage {name} is not built")
            if name not in STAGES:
                raise CriteriaError(f"no stage {name}")
        if not stages:
            raise CriteriaError("no stages")
        sweep = tuple(sorted({half_ticks(t) for t in sweep_ticks}))
        missing = [s / 2 for s in SWEPT if s not in sweep]
        if missing:
            raise CriteriaError(f"the sweep lacks {missing} ticks")
        kill = half_ticks(kill_ticks)
        if kill not in sweep:
            raise CriteriaError(f"the kill level of {kill_ticks} ticks is not swept")
        if ("s0" in stages) != (given.get("least_ic") is not None):
            raise CriteriaError("stage s0 and its least_ic go together")
        return Criteria(tuple(sorted(set(stages))), sweep, kill, **given)

    def ordered(self) -> list[tuple[str, list[tuple[str, Column]]]]:
        """The stages of `assess` over the columns of an evidence table, in order: sample, S0, S1, S2, S3.

        Evidence that is null does not pass: a control or a null that was not
        built is no cleared bar.
        """
        c = F.col
        out = [("admission", [("trades", c("oos_trades") >= self.least_trades), ("sessions", c("oos_sessions") >= self.least_sessions)])]
        if "s0" in self.stages:
            out.append(("s0", [("criterion", c("s0_outcome") == "passed")]))
        if "s1" in self.stages:
            out.append(("s1", [("free_return", c("free_return_pct") >= self.least_free_return)]))
        if "s2" in self.stages:
            s2 = [("sharpe", c("sharpe") >= self.least_sharpe), ("kill_level", c("kill_sharpe") >= self.least_sharpe)]
            if self.controls:
                s2 += [("random_entry", c("return_pct") > c("random_return_pct")), ("buy_and_hold", c("return_pct") > c("hold_return_pct"))]
            out.append(("s2", s2))
        if self.most_p is not None:
            out.append(("s3", [("permutation", c("p_value") <= self.most_p)]))
        out.append(("s3", [("deflated", c("sharpe") > c("expected_max_sharpe")), ("pbo", c("pbo") <= self.most_pbo)]))
        return out


def assess(evidence: DataFrame, stages: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """Verdict of each row: stages in order, each evaluated only if nothing has failed before; all criteria of one stage are.

    A criterion is (reason, column); null, missing evidence, fails it. `decided_at`
    is the last stage that was looked at. There is no verdict above iterate.
    """
    failed: list[Column] = []
    open_ = F.lit(True)
    reached = F.lit(None).cast("string")
    for name, criteria in stages:
        reached = F.when(open_, F.lit(name)).otherwise(reached)
        here = [F.when(open_ & ~F.coalesce(ok, F.lit(False)), F.lit(f"{name}:{reason}")) for reason, ok in criteria]
        failed += here
        for _, ok in criteria:
            open_ = open_ & F.coalesce(ok, F.lit(False))
    reasons = F.array_compact(F.array(*failed))
    out = evidence.withColumns({"reasons": F.array_join(reasons, ","), "decided_at": reached})
    return out.withColumn("verdict", F.when(F.col("reasons") == "", "iterate").otherwise("kill"))


def pool_sessions(rows: DataFrame, group: str) -> DataFrame:
    """Distinct days over contracts, never their sum; the difference is the overlap."""
    per = rows.groupBy(group, "contract").agg(F.countDistinct("day").alias("d"))
    summed = per.groupBy(group).agg(F.sum("d").alias("summed"), F.count(F.lit(1)).alias("contracts"))
    union = rows.groupBy(group).agg(F.countDistinct("day").alias("sessions"))
    return summed.join(union, group).withColumn("overlap", F.col("summed") - F.col("sessions"))


def pool_gaps(spans: DataFrame, group: str) -> DataFrame:
    """Days between one contract's last and the next one's first; contracts by first, last, name."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy("first_day", "last_day", "contract")
    rows = spans.withColumn("next_first", F.lead("first_day").over(order)).withColumn("follow", F.lead("contract").over(order))
    return rows.where(F.col("next_first") > F.col("last_day") + 1).select(
        group, "contract", "follow", (F.col("next_first") - F.col("last_day") - 1).alias("gap_days")
    )


def pool_evaluations(contracts: DataFrame, oos_days: DataFrame, group: str) -> DataFrame:
    """One row per pool: contracts evaluated, out-of-sample days (the union, never a sum), trades (summed), and why others were skipped.

    `contracts` has the group, contract, warmup_bars, warmup_needed, folds and
    trades; `oos_days` group, contract and day. A lack of warm-up is judged
    before a lack of folds.
    """
    reason = F.when(F.col("warmup_bars") < F.col("warmup_needed"), "warmup").when(F.col("folds") == 0, "no_fold")
    judged = contracts.withColumn("reason", reason)
    used = judged.where("reason IS NULL")
    days = oos_days.join(used.select(group, "contract"), [group, "contract"], "left_semi").groupBy(group).agg(F.countDistinct("day").alias("oos_sessions"))
    skipped = lambda r: F.count_if(F.col("reason") == r)
    got = judged.groupBy(group).agg(
        F.count_if(F.col("reason").isNull()).alias("evaluated"), skipped("warmup").alias("short_of_warmup"), skipped("no_fold").alias("without_fold"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("trades"))), F.lit(0)).alias("oos_trades"),
    )
    return got.join(days, group, "left").withColumn("oos_sessions", F.coalesce("oos_sessions", F.lit(0)))


def pool_evidence(parts: DataFrame, members: DataFrame, group: str, cash: int, per_year: float = 1.0) -> DataFrame:
    """Pooled return and Sharpe ratio of each group from its contracts' moments, absent if any member has none.

    `parts` has group, contract, net (change of equity) and `metrics.moments`; `members` group and contract.
    """
    from .metrics import combine_moments, sharpe

    asked = members.groupBy(group).agg(F.countDistinct("contract").alias("asked"))
    there = parts.where(F.col("n") > 0).groupBy(group).agg(F.countDistinct("contract").alias("there"), F.sum("net").alias("net"))
    pooled = combine_moments(parts.where(F.col("n") > 0), "contract", (group,)).withColumn("sharpe", sharpe(per_year)).select(group, "n", "sharpe")
    rows = asked.join(there, group, "left").join(pooled, group, "left")
    whole = F.coalesce(F.col("asked") == F.col("there"), F.lit(False))
    given = {"return_pct": F.col("net").cast("double") / cash * 100, "sharpe": F.col("sharpe"), "n": F.col("n")}
    return rows.select(group, "asked", F.coalesce("there", F.lit(0)).alias("there"), *[F.when(whole, c).alias(n) for n, c in given.items()])
