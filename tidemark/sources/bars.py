"""Bar sources: driver tables turned into bars, the curated bar store, a synthetic walk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BAR_SCHEMA, tf_ns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(col: str) -> Column:
    """Microseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def cents_to_nanos(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long") * 10_000_000


def to_bars(ticks: DataFrame, tf: str, order: list[str]) -> DataFrame:
    """Bars of (instrument, us, price): first, highest, lowest and last price and the count.

    One aggregation with partial sums on the map side; `order` breaks ties of time.
    """
    step = tf_ns(tf) // 1000
    at = F.struct(*order)
    return (
        ticks.withColumn("ts_open", F.expr(f"us div {step} * {step} * 1000"))
        .groupBy("instrument", "ts_open")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), epoch_us("ts").alias("us"), "event_id", cents_to_nanos("value").alias("price")
    )
    return to_bars(ticks, tf, ["us", "event_id"])


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("instrument"),
        epoch_us("l_shipdate").alias("us"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        cents_to_nanos("l_extendedprice").alias("price"),
    )
    return to_bars(ticks, "1d", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price"])


# ---------------------------------------------------------------- the bar store


STORE_VERSION = 1


def write_bars(bars: DataFrame, path: str, tf: str, mode: str = "errorifexists") -> None:
    """Partitions by time frame and instrument, each sorted by time, so that scans prune files and row groups.

    The schema version and time frame stand in every file's footer, as metadata
    of `ts_open`. An instrument whose times repeat or a negative volume is an
    error; by default so is a store that exists.
    """
    tf_ns(tf)
    again = F.lag("ts_open").over(Window.partitionBy("instrument").orderBy("ts_open")) == F.col("ts_open")
    fault = F.when(again, "a bar twice").when(F.col("volume") < 0, "a negative volume")
    text = F.concat(F.col("instrument"), F.lit(" has "), fault)
    checked = bars.withColumn("ts_open", F.when(fault.isNotNull(), F.raise_error(text).cast("long")).otherwise(F.col("ts_open")))
    noted = F.col("ts_open").alias("ts_open", metadata={"schema_version": STORE_VERSION, "tf": tf})
    (
        checked.select(*[noted if c == "ts_open" else F.col(c) for c in bars.columns])
        .withColumn("tf", F.lit(tf))
        .repartitionByRange("instrument", "ts_open")
        .sortWithinPartitions("instrument", "ts_open")
        .write.partitionBy("tf", "instrument")
        .option("compression", "zstd")
        .mode(mode)
        .parquet(path)
    )


def footer(spark: SparkSession, path: str, tf: str) -> dict:
    """What a store's files say about themselves, without reading a row; a frame that its folder does not name is an error."""
    found = spark.read.parquet(f"{path}/tf={tf}").schema["ts_open"].metadata
    if found.get("schema_version") != STORE_VERSION:
        raise ValueError(f"{path} is of store version {found.get('schema_version')}")
    if found.get("tf") != tf:
        raise ValueError(f"{path} says {found.get('tf')} in a folder of {tf}")
    return found


def scan_bars(spark: SparkSession, path: str, tf: str, instrument: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of [start, end); instrument and frame prune partitions, the range prunes row groups. The footer has to agree."""
    tf_ns(tf)
    footer(spark, path, tf)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR_SCHEMA.fields)
    found = spark.read.schema(f"{fields}, tf string").parquet(path).where(F.col("tf") == tf)
    if instrument is not None:
        found = found.where(F.col("instrument") == instrument)
    if start is not None and end is not None and start >= end:
        raise ValueError("an empty range")
    if start is not None:
        found = found.where(F.col("ts_open") >= start)
    if end is not None:
        found = found.where(F.col("ts_open") < end)
    return found.select(*[f.name for f in BAR_SCHEMA.fields])


def integrity(bars: DataFrame) -> DataFrame:
    """Per instrument: rows, ends, and counts of what the store refuses."""
    before = F.lag("ts_open").over(Window.partitionBy("instrument").orderBy("ts_open"))
    return (
        bars.withColumn("prev", before)
        .groupBy("instrument")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("ts_open").alias("first_ts"),
            F.max("ts_open").alias("last_ts"),
            F.sum((F.col("volume") < 0).cast("long")).alias("negative_volume"),
            F.sum(F.coalesce((F.col("ts_open") <= F.col("prev")).cast("long"), F.lit(0))).alias("not_increasing"),
        )
    )


def instruments(bars: DataFrame) -> DataFrame:
    return bars.select("instrument").distinct()


def resolve_instrument(stored: list[str], wanted: str) -> str:
    """An exact name, or the one stored four-digit name that a one- or two-digit year stands for."""
    import re

    if wanted in stored:
        return wanted
    m = re.fullmatch(r"([A-Z0-9]+?)([FGHJKMNQUVXZ])(\d{1,2})", wanted)
    found = []
    if m:
        base = 10 ** len(m[3])
        found = [s for s in stored if (n := re.fullmatch(rf"{m[1]}{m[2]}(\d{{4}})", s)) and int(n[1]) % base == int(m[3])]
    if not found:
        raise LookupError(f"no instrument {wanted!r}")
    if len(found) > 1:
        raise LookupError(f"{wanted!r} is ambiguous: {', '.join(sorted(found))}")
    return found[0]


# ---------------------------------------------------------------- vendor records


#: Marks a price that the vendor left undefined (fixed value).
UNDEFINED_PRICE = (1 << 63) - 1


def validate_raw(raw: DataFrame, tf: str) -> DataFrame:
    """`reject_reason` of each raw bar, null where it is accepted. Prices of zero and below are valid."""
    step = tf_ns(tf)
    again = F.count(F.lit(1)).over(Window.partitionBy("instrument", "ts_open"))
    broken = F.lit(False)
    for c in ("open", "high", "low", "close"):
        broken = broken | (F.col(c) == F.lit(UNDEFINED_PRICE))
    return raw.withColumn(
        "reject_reason",
        F.when(F.col("instrument").isNull(), "unknown_id")
        .when(broken, "undefined_price")
        .when(F.col("ts_open") % step != 0, "unaligned_ts")
        .when(again > 1, "duplicate"),
    )


def is_spread(symbol: str) -> Column:
    """Spread symbols hold a hyphen, a colon or a space."""
    return F.col(symbol).rlike("[-: ]")


# ---------------------------------------------------------------- synthetic bars

#: When walks begin, 2023-11-14T22:13:20Z (fixed value).
WALK_START = 1_700_000_000_000_000_000
_M1, _M2, _GAMMA = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def split_mix(seed: int, n: int) -> np.ndarray:
    """The first n draws of a SplitMix64 stream."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * _GAMMA
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def synthetic_walk(spark: SparkSession, seeds: list[int], n: int, tf: str = "1m", tick: int = 250_000_000, start_ticks: int = 16_000, vol: int = 4) -> DataFrame:
    """Random walks on the tick grid, an instrument `SYN:<seed>` each; no close falls below 400 ticks.

    Each bar takes four draws: the step, between -`vol` and `vol`, the wicks, up to `vol` both, and the volume.
    """
    step = tf_ns(tf)
    wide = np.uint64(vol + 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["seed"]:
                r = split_mix(int(seed), 4 * n).reshape(n, 4)
                move = (r[:, 0] % np.uint64(2 * vol + 1)).astype(np.int64) - vol
                close = np.empty(n, np.int64)
                level = start_ticks
                for i in range(n):
                    level = max(400, level + int(move[i]))
                    close[i] = level
                open_ = np.concatenate([[start_ticks], close[:-1]])
                up, down = (r[:, 1] % wide).astype(np.int64), (r[:, 2] % wide).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "instrument": f"SYN:{seed}",
                        "ts_open": WALK_START + np.arange(n, dtype=np.int64) * step,
                        "open": open_ * tick,
                        "high": (np.maximum(open_, close) + up) * tick,
                        "low": np.maximum(1, np.minimum(open_, close) - down) * tick,
                        "close": close * tick,
                        "volume": 100 + (r[:, 3] % np.uint64(901)).astype(np.int64),
                    }
                )

    frame = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(max(1, len(seeds)), "seed")
    return frame.mapInPandas(walk, BAR_SCHEMA)
