"""As-of joins and interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(scored: DataFrame, horizon: int, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Each scored bar with the last bar at or before `ts + horizon`, as one range frame.

    `status` is ok, beyond_end (the series ends too early), no_partner (no later
    bar) or bad_price (zero at either side); what is dropped stays countable.
    """
    order = Window.partitionBy(*keys).orderBy("ts")
    ahead = order.rangeBetween(0, horizon)
    rows = scored.withColumn("exit_ts", F.last("ts").over(ahead)).withColumn("exit", F.last("price").over(ahead))
    rows = rows.withColumn("end_ts", F.max("ts").over(Window.partitionBy(*keys)))
    status = (
        F.when(F.col("score").isNull(), "no_score")
        .when(F.col("ts") + horizon > F.col("end_ts"), "beyond_end")
        .when(F.col("exit_ts") <= F.col("ts"), "no_partner")
        .when((F.col("price") == 0) | (F.col("exit") == 0), "bad_price")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).withColumn(
        "fwd_return", F.when(F.col("status") == "ok", F.col("exit").cast("double") / F.col("price") - 1)
    ).drop("end_ts")


def latest_as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """The last row of `right` at or before `left_ts`, null where there is none.

    Both sides are put into one order by key and time and the last value is
    carried on: one shuffle, no pairs, whatever the number of revisions.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    extra = [c for c in left.columns if c not in keys]
    packed = F.struct(*values)
    a = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("__v"), *extra)
    b = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), packed.alias("__v"), *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    over = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(over))
    return both.where(F.col("__side") == 1).select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def next_as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """The first row of `right` at or after `left_ts`, null where there is none: `latest_as_of` looking ahead."""
    back = lambda t, c: t.withColumn("__back", -F.col(c))
    return latest_as_of(back(left, left_ts), back(right, right_ts), keys, "__back", "__back", values).drop("__back")


def order_faults(rows: DataFrame, keys: list[str], column: str, strict: bool = True) -> DataFrame:
    """Per key how many rows do not come after the one before them, in the order of `place`."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy("place"))
    fault = (F.col(column) <= before) if strict else (F.col(column) < before)
    return rows.withColumn("__fault", F.coalesce(fault, F.lit(False)).cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("__fault").alias("faults"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open ranges [start, end) of each key, with touching and overlapping ones merged."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach)).cast("int")
    islands = rows.where(F.col("start") < F.col("end")).withColumn("new", new)
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def subtract_intervals(wanted: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """What of each wanted range the owned ranges of its key do not cover; a key may want several ranges."""
    have = merge_intervals(owned, keys)
    frame = wanted.select(*keys, F.col("start").alias("w0"), F.col("end").alias("w1")).where("w0 < w1").distinct()
    inside = frame.join(have, keys).where((F.col("end") > F.col("w0")) & (F.col("start") < F.col("w1")))
    marks = inside.select(*keys, "w0", "w1", "start", "end").unionByName(
        frame.select(*keys, "w0", "w1", F.col("w1").alias("start"), F.col("w1").alias("end"))
    )
    before = F.max("end").over(Window.partitionBy(*keys, "w0", "w1").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.withColumn("gap_start", F.greatest(F.coalesce(before, F.col("w0")), F.col("w0")))
    return gaps.where(F.col("gap_start") < F.col("start")).select(*keys, F.col("gap_start").alias("start"), F.col("start").alias("end"))


def purchase_plan(wanted: DataFrame, available: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be bought, by month: wanted date ranges clipped to what is on offer, less what is owned.

    Ranges are of dates, [start, end). Windows of a gap tile it by construction
    of `month_windows`; `tiled` says whether they do, from their lengths.
    """
    clipped = wanted.join(available.select(*keys, F.col("start").alias("a0"), F.col("end").alias("a1")), keys).select(
        *keys, F.greatest("start", "a0").alias("start"), F.least("end", "a1").alias("end")
    )
    # Wanted ranges that overlap share their gaps.
    whole = merge_intervals(clipped, keys)
    gaps = subtract_intervals(whole, owned, keys).withColumnsRenamed({"start": "gap_start", "end": "gap_end"})
    months = month_windows(gaps.withColumns({"start": F.col("gap_start"), "end": F.col("gap_end")}), [*keys, "gap_start", "gap_end"])
    gap = Window.partitionBy(*keys, "gap_start", "gap_end")
    length = F.sum(F.datediff("end", "start")).over(gap) == F.datediff("gap_end", "gap_start")
    return months.withColumn("tiled", length & (F.min("start").over(gap) == F.col("gap_start")) & (F.max("end").over(gap) == F.col("gap_end")))


def month_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Date ranges [start, end) cut at the first of each month."""
    months = F.sequence(F.trunc("start", "month"), F.date_sub("end", 1), F.expr("interval 1 month"))
    cut = rows.where(F.col("start") < F.col("end")).withColumn("m", F.explode(months))
    return cut.select(*keys, F.greatest("start", "m").alias("start"), F.least("end", F.add_months("m", 1)).alias("end"))
