"""Streams give what the batch operators give on the same rows."""

import shutil

from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.schema import NANO
from tidemark.sources.bars import event_bars, table
from tidemark.streaming import bars as streams

SF = "/root/testdata/sf0.001"


def drain(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name)
    finally:
        q.stop()


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    ticks = table(spark, SF, "events").select(
        F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        (F.round(F.col("value") * 100).cast("long") * 10_000_000).alias("price"),
    )
    end = ticks.select("instrument").distinct().select("instrument", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("price"))
    ticks.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    end.coalesce(1).write.parquet(f"{tmp_path}/late")
    source = spark.readStream.schema(ticks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.stream_bars(source).writeStream.outputMode("append").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
        shutil.copytree(f"{tmp_path}/late", f"{tmp_path}/in/b")
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("streamed").select("instrument", (F.unix_micros("ts_open") * 1000).alias("ts_open"), "open", "high", "low", "close", "volume")
    want = event_bars(spark, SF, "1h").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_bars_are_marked(spark, tmp_path):
    rows = [("a", i, t, 1) for i, t in enumerate((1, 2, 5, 3, 5, 6))] + [("b", 0, 9, 1)]
    frame = spark.createDataFrame(rows, "instrument string, seq long, ts_open long, close long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    got = drain(spark, streams.ordered_feed(source), "ordered").collect()
    assert [(r.ts_open, r.reason) for r in got if not r.accepted] == [(3, "out_of_order")] and len(got) == 7


def test_stream_replay_equals_batch_replay(spark, tmp_path):
    targets = replay.sma_cross_targets(event_bars(spark, SF, "1h"), 3, 8).select("instrument", "ts_open", "open", "close", "target")
    targets.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(targets.schema).parquet(f"{tmp_path}/in")
    cost = 10_000_000 * 50 + NANO
    got = drain(spark, streams.stream_replay(source, 50, 1000 * NANO, cost), "replayed")
    costs = replay.Costs(half_ticks=2, fee=NANO, tick=10_000_000)
    want = replay.equity(targets.withColumn("high", F.col("open")).withColumn("low", F.col("open")), replay.Spec(cash=1000 * NANO), costs)
    pick = lambda df: sorted((r.instrument, r.ts_open, r.equity) for r in df.select("instrument", "ts_open", "equity").collect())
    assert pick(got) == pick(want)


def test_days_of_streams_equal_days_of_tables(spark, tmp_path):
    """Sessions and account days, each emitted once its day is over."""
    bars = event_bars(spark, SF, "1h").select("instrument", F.timestamp_micros(F.expr("ts_open div 1000")).alias("ts"), "volume", "close", F.col("close").alias("equity"))
    after = bars.groupBy("instrument").agg(F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("volume"), F.lit(0).cast("long").alias("close"), F.lit(0).cast("long").alias("equity"))
    bars.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    after.coalesce(1).write.parquet(f"{tmp_path}/late")
    for name, run, columns in (("sess", streams.stream_sessions, ["volume", "close"]), ("acct", streams.stream_account, ["close_equity", "high", "low", "bars"])):
        shutil.copytree(f"{tmp_path}/in/a", f"{tmp_path}/{name}/a")
        source = spark.readStream.schema(bars.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        q = run(source).writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
            shutil.copytree(f"{tmp_path}/late", f"{tmp_path}/{name}/b")
            q.processAllAvailable()
        finally:
            q.stop()
        day = bars.groupBy("instrument", F.date_trunc("day", "ts").alias("day")).agg(
            F.sum("volume").alias("volume"), F.max_by("close", "ts").alias("close"), F.max_by("equity", "ts").alias("close_equity"),
            F.max("equity").alias("high"), F.min("equity").alias("low"), F.count(F.lit(1)).alias("bars"),
        )
        pick = lambda df: sorted(map(tuple, df.select("instrument", "day", *columns).collect()))  # noqa: B023, E731
        assert pick(spark.table(name)) == pick(day) and pick(day)
