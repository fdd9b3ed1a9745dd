"""Evidence: rank correlation, score buckets, overfitting, deflated Sharpe, permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import expected_max_z, normal_cdf


def average_rank(column: str, keys: tuple[str, ...]) -> Column:
    """1-based rank; equal values share the mean of theirs."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (tied - 1) / 2


def information_coefficient(pairs: DataFrame, keys: tuple[str, ...], least: int = 2) -> DataFrame:
    """Correlation of average ranks, or the reason why there is none."""
    rows = pairs.withColumn("rs", average_rank("score", keys)).withColumn("rr", average_rank("fwd_return", keys))
    infinite = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.covar_pop("rs", "rr") / F.nullif(F.stddev_pop("rs") * F.stddev_pop("rr"), F.lit(0.0))).alias("__ic"),
        F.max((infinite("score") | infinite("fwd_return")).cast("int")).alias("__odd"),
        (F.min("score") == F.max("score")).alias("__flat_score"),
        (F.min("fwd_return") == F.max("fwd_return")).alias("__flat_return"),
    )
    reason = (
        F.when(F.col("n") < least, "too_few")
        .when(F.col("__odd") == 1, "non_finite")
        .when(F.col("__flat_score"), "constant_score")
        .when(F.col("__flat_return"), "constant_return")
        .when(F.col("__ic").isNull() | F.isnan("__ic"), "degenerate")
    )
    return got.withColumn("reason", reason).select(*keys, "n", F.when(F.col("reason").isNull(), F.col("__ic")).alias("ic"), "reason")


def score_buckets(pairs: DataFrame, k: int, tick: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """Buckets of equal count: bucket b holds the sorted places [b n / k, (b + 1) n / k)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("score", order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = pairs.withColumn("rn", rn).withColumn("n", n).where(F.col("n") >= k)
    rows = rows.withColumn("bucket", F.expr(f"(cast(rn as bigint) * {k} - 1) div n"))
    return rows.groupBy(*keys, "bucket").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.avg("fwd_return").alias("mean_return"), F.avg((F.col("exit") - F.col("price")).cast("double") / tick).alias("mean_ticks"),
    )


def session_bootstrap(pairs: DataFrame, draws: int, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """95 percent index interval of the mean forward return, resampling whole sessions.

    Only a sum and a count of each session reach the kernel.
    """
    per_session = pairs.groupBy(*keys, "session_key").agg(F.sum("fwd_return").alias("s"), F.count(F.lit(1)).alias("n"))
    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_key")
        s, n = pdf["s"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, len(pdf)])
        total, means = int(n.sum()), np.empty(draws)
        for d in range(draws):
            got_s = got_n = 0
            while got_n < total:
                pick = rng.integers(0, len(s), max(1, (total - got_n) // max(1, int(n.max())) + 1))
                ends = np.cumsum(n[pick])
                last = min(int(np.searchsorted(ends, total - got_n)) + 1, len(pick))
                got_s, got_n = got_s + s[pick[:last]].sum(), got_n + int(ends[last - 1])
            means[d] = got_s / got_n
        means.sort()
        row = {k: [pdf[k].iloc[0]] for k in keys}
        lo, hi = int(np.floor(0.025 * draws)), int(np.ceil(0.975 * draws)) - 1
        return pd.DataFrame(row | {"sessions": [len(pdf)], "n": [total], "mean": [s.sum() / total], "lo": [means[lo]], "hi": [means[hi]]})

    return per_session.groupBy(*keys).applyInPandas(run, f"{fields}, sessions long, n long, mean double, lo double, hi double")


def block_splits(perf: DataFrame, folds: int, most: int = 200_000) -> DataFrame:
    """All choices of half the folds as bit masks, a row each: in-sample set of a split."""
    from math import comb

    if folds % 2 or folds < 2:
        raise ValueError("an even number of folds is needed")
    if comb(folds, folds // 2) > most:
        raise ValueError("too many splits")
    spark = perf.sparkSession
    return spark.range(1 << folds).where(F.bit_count("id") == folds // 2).select(F.col("id").alias("mask"))


def overfitting(perf: DataFrame, folds: int) -> DataFrame:
    """Probability of backtest overfitting over all symmetric splits of (combo, fold, ret).

    In each split the combo with the best mean in sample, the lowest index
    among equals, is ranked out of sample, where equals of lower index count
    below; it overfits if twice its rank is at most the combos and one.
    """
    # One row for each combo, with its folds side by side, before it meets the
    # splits, which `block_splits` bounds.
    splits = F.broadcast(block_splits(perf, folds))
    combos = perf.groupBy("combo").agg(F.sort_array(F.collect_list(F.struct("fold", "ret"))).alias("r"))
    cells = F.size("r") == F.size(F.array_distinct(F.transform("r", lambda x: x["fold"])))
    sound = F.forall("r", lambda x: x["ret"].isNotNull() & ~F.isnan(x["ret"]) & (F.abs(x["ret"]) < float("inf")) & x["fold"].between(0, folds - 1))
    fault = F.when(F.size("r") != folds, "lacks a fold").when(~cells, "has a fold twice").when(~sound, "has a return that is no number or a fold that is none")
    message = F.concat(F.lit("combo "), F.col("combo").cast("string"), F.lit(" "), fault)
    combos = combos.withColumn("r", F.when(fault.isNotNull(), F.raise_error(message).cast(combos.schema["r"].dataType)).otherwise(F.col("r")))
    inside = lambda x: F.get(F.split(F.lpad(F.bin("mask"), folds, "0"), ""), F.lit(folds - 1) - x["fold"]) == "1"
    mean = lambda rows: F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["ret"]) / F.size(rows))
    scored = combos.join(splits).select(
        "mask", "combo", mean(F.filter("r", inside)).alias("is_score"), mean(F.filter("r", lambda x: ~inside(x))).alias("oos_score")
    )
    best = scored.groupBy("mask").agg(F.max(F.struct("is_score", (-F.col("combo")).alias("neg"), "oos_score")).alias("w"), F.count(F.lit(1)).alias("combos"))
    ranked = scored.join(best, "mask").groupBy("mask").agg(
        F.first("combos").alias("combos"),
        F.sum(
            ((F.col("oos_score") < F.col("w.oos_score")) | ((F.col("oos_score") == F.col("w.oos_score")) & (F.col("combo") <= -F.col("w.neg")))).cast("long")
        ).alias("rank"),
    )
    alone = F.raise_error(F.lit("a single combo can not be ranked")).cast("boolean")
    over = F.when(F.col("combos") < 2, alone).otherwise(F.col("rank") * 2 <= F.col("combos") + 1).cast("long")
    return ranked.agg(F.count(F.lit(1)).alias("splits"), F.sum(over).alias("overfit")).withColumn("pbo", F.col("overfit") / F.col("splits"))


def deflated_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, trials: Column, dispersion: Column) -> Column:
    """Probability that a Sharpe ratio per bar exceeds what the best of `trials` shows by luck."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    se = F.when((n > 1) & (var > 0), F.sqrt(var / (n - 1)))
    bench = F.coalesce(dispersion, se) * expected_max_z(trials)
    return normal_cdf((sr - bench) / se)


def permutation_p(observed: DataFrame, nulls: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(1 + draws not below the observed) / (1 + draws); draws without a finite value are counted apart."""
    bad = F.col("null").isNull() | F.isnan("null")
    return nulls.join(observed, list(keys)).groupBy(*keys).agg(
        F.sum((~bad).cast("long")).alias("draws"),
        F.sum(bad.cast("long")).alias("unevaluable"),
        F.sum((~bad & (F.col("null") >= F.col("observed"))).cast("long")).alias("not_below"),
    ).withColumn("p", (F.col("not_below") + 1) / (F.col("draws") + 1))


def block_shuffled(bars: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """Paths whose differences are those of the closes with blocks in another order, rebuilt additively.

    Blocks are ordered by a seeded hash, so every engine node gives the same paths.
    """
    over = Window.partitionBy("instrument").orderBy("ts_open")
    rows = bars.withColumn("i", F.row_number().over(over) - 1).withColumn("first_close", F.first("close").over(over))
    rows = rows.withColumn("diff", F.col("close") - F.lag("close").over(over))
    moves = rows.where(F.col("i") > 0).withColumn("block", F.expr(f"(i - 1) div {block}"))
    drawn = moves.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("key", F.xxhash64("instrument", "draw", "block", F.lit(seed)))
    path = Window.partitionBy("instrument", "draw").orderBy("key", "i").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.select("instrument", "draw", F.row_number().over(Window.partitionBy("instrument", "draw").orderBy("key", "i")).alias("step"), (F.col("first_close") + F.sum("diff").over(path)).alias("close"))


def truncation_mismatches(full: DataFrame, cut: DataFrame, last: int) -> DataFrame:
    """Places up to `last` where decisions on a prefix differ from the full run's."""
    a = full.where(F.col("i") <= last).select("instrument", "i", F.col("target").alias("full_target"))
    b = cut.select("instrument", "i", F.col("target").alias("cut_target"))
    return a.join(b, ["instrument", "i"], "full_outer").where(~F.col("full_target").eqNullSafe(F.col("cut_target")))
