"""Rolls between futures contracts, continuous series, expiry histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import latest_as_of


def crossover_streaks(pairs: DataFrame, confirm: int) -> DataFrame:
    """The first day on which the next contract has traded more for `confirm` days in a row.

    `pairs` has front, next, day, front_volume, next_volume; a missing next
    contract traded nothing.
    """
    order = Window.partitionBy("front", "next").orderBy("day")
    rows = pairs.withColumn("wins", F.coalesce("next_volume", F.lit(0)) > F.col("front_volume"))
    rows = rows.withColumn("losses", F.sum((~F.col("wins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("front", "next", "losses").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum(F.col("wins").cast("int")).over(inside))
    return rows.where(F.col("streak") >= confirm).groupBy("front", "next").agg(F.min("day").alias("roll_day"))


def adjacent(sessions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sessions of each contract beside the next one's of its root on the same day (`contracts`: root, contract, seq)."""
    follow = F.lead("contract").over(Window.partitionBy("root").orderBy("seq"))
    named = contracts.select(F.col("contract").alias("front"), follow.alias("next"))
    front = sessions.select(F.col("contract").alias("front"), "day", F.col("volume").alias("front_volume"), F.col("close").alias("front_close"), F.col("avail_ts").alias("front_avail"))
    follow = sessions.select(F.col("contract").alias("next"), "day", F.col("volume").alias("next_volume"), F.col("close").alias("next_close"), F.col("avail_ts").alias("next_avail"))
    return front.join(F.broadcast(named.where(F.col("next").isNotNull())), "front").join(follow, ["next", "day"], "left")


SESSIONS = "root string, contract string, seq int, day long, volume long, close long, avail_ts long"
CHAIN = "root string, from_contract string, to_contract string, day long, roll_ts long, adjustment long"


def _day_of_roll(a: dict, b: dict, after: int | None, confirm: int, expiry_days: dict | None, days: int) -> int | None:
    """The first session of `a` after `after` on which the rule says to roll into `b`."""
    streak = 0
    for day in sorted(a):
        if after is not None and day <= after:
            continue
        if expiry_days is None:
            streak = streak + 1 if (b[day]["volume"] if day in b else 0) > a[day]["volume"] else 0
            if streak >= confirm:
                return day
        elif day in b:
            decided = max(a[day]["avail_ts"], b[day]["avail_ts"])
            known = [e for at, e in expiry_days if at <= decided]
            if known and day >= known[-1] - days:
                return day
    return None


def chain_of(sessions: list[dict], confirm: int = 1, expiries: dict[str, list[tuple[int, int]]] | None = None, days: int = 0) -> list[dict]:
    """Rolls of one root in order, each strictly after the last.

    By volume, the next contract has to out-trade the front one for `confirm` of
    its sessions in a row; a day on which it did not trade breaks the run. With
    `expiries`, (time known, expiry day) by contract in the order they were
    stated, the roll is the first session of both at most `days` before the
    expiry known when it closes; a contract without any is an error. When the
    rule never fires, the last day that both traded is the roll, unless the
    front outlives the next contract, where the chain ends.
    """
    by: dict[str, dict] = {}
    for s in sorted(sessions, key=lambda s: s["seq"]):
        by.setdefault(s["contract"], {})[s["day"]] = s
    rolls, after = [], None
    for front, follow in zip(by, list(by)[1:]):
        a, b = by[front], by[follow]
        if expiries is not None and not expiries.get(front):
            raise ValueError(f"no expiry of {front} is known")
        found = _day_of_roll(a, b, after, confirm, None if expiries is None else expiries[front], days)
        if found is None:
            if max(a) >= max(b):
                break
            shared = [d for d in a if d in b and (after is None or d > after)]
            if not shared:
                raise ValueError(f"{front} and {follow} never traded on one day")
            found = max(shared)
        if found not in b:
            raise ValueError(f"{follow} has no session on {found}")
        x, y = a[found], b[found]
        rolls.append({"from_contract": front, "to_contract": follow, "day": found, "roll_ts": max(x["avail_ts"], y["avail_ts"]), "adjustment": y["close"] - x["close"]})
        after = found
    return rolls


def build_chain(sessions: DataFrame, confirm: int = 1, expiries: DataFrame | None = None, days: int = 0) -> DataFrame:
    """The roll chain of every root, from `sessions` (root, contract, seq, day, volume, close, avail_ts).

    A chain is sequential, since each roll has to come after the last; a root's
    sessions, a row per contract and day, are one group. `expiries` has root,
    contract, avail_ts and expiry_day, as they were stated.
    """
    import pandas as pd

    fields = [x.split()[0] for x in SESSIONS.split(", ")]
    columns = [x.split()[0] for x in CHAIN.split(", ")]

    def run(root: str, rows: pd.DataFrame, known: dict | None) -> pd.DataFrame:
        found = chain_of(rows[fields].to_dict("records"), confirm, known, days)
        return pd.DataFrame([{"root": root, **r} for r in found], columns=columns)

    if expiries is None:
        return sessions.select(*fields).groupBy("root").applyInPandas(lambda key, rows: run(key[0], rows, None), CHAIN)

    def with_expiries(key, rows: pd.DataFrame, stated: pd.DataFrame) -> pd.DataFrame:
        stated = stated.sort_values(["avail_ts", "expiry_day"])
        known = {c: list(zip(g["avail_ts"], g["expiry_day"])) for c, g in stated.groupby("contract")}
        return run(key[0], rows, known) if len(rows) else pd.DataFrame([], columns=columns)

    said = expiries.select("root", "contract", "avail_ts", "expiry_day")
    return sessions.select(*fields).groupBy("root").cogroup(said.groupBy("root")).applyInPandas(with_expiries, CHAIN)


def late_corrections(rolls: DataFrame, stated: DataFrame) -> DataFrame:
    """Rolls that a later statement of the expiry would have moved.

    `stated` has contract, avail_ts, expiry_day. `used` is the expiry known at
    the roll, `latest` the last one stated, `corrected_ts` when that was first said.
    """
    used = latest_as_of(rolls, stated.withColumnRenamed("contract", "from_contract"), ["from_contract"], "roll_ts", "avail_ts", ["expiry_day"])
    last = stated.groupBy("contract").agg(F.max_by("expiry_day", F.struct("avail_ts", "expiry_day")).alias("latest"))
    first = stated.groupBy("contract", F.col("expiry_day").alias("latest")).agg(F.min("avail_ts").alias("corrected_ts"))
    final = last.join(first, ["contract", "latest"]).withColumnRenamed("contract", "from_contract")
    moved = used.withColumnRenamed("expiry_day", "used").join(final, "from_contract").where(F.col("used") != F.col("latest"))
    return moved.select("root", "from_contract", "roll_ts", "used", "latest", "corrected_ts")


ROLL_TABLE_VERSION = 1
ROLL_TABLE = "schema_version int, root string, rule string, rows array<struct<from_contract: string, to_contract: string, day: long, roll_ts: long, adjustment: long>>"


def _checked(tables: DataFrame) -> DataFrame:
    """`tables` of which each has rolls in rising order that hand over from each contract to the next; else an error."""
    pairs = F.zip_with(F.slice("rows", F.lit(1), F.size("rows") - 1), F.slice("rows", F.lit(2), F.size("rows")), lambda a, b: (a["roll_ts"] < b["roll_ts"]) & (a["to_contract"] == b["from_contract"]))
    fault = (
        F.when(F.col("schema_version") != ROLL_TABLE_VERSION, "of an unknown version")
        .when(F.col("root").isNull() | F.col("rule").isNull() | F.col("rows").isNull(), "incomplete")
        .when(~F.forall(F.when(F.size("rows") > 1, pairs).otherwise(F.array().cast("array<boolean>")), lambda ok: F.coalesce(ok, F.lit(False))), "out of order")
    )
    text = F.concat(F.lit("the roll table of "), F.coalesce("root", F.lit("no root")), F.lit(" is "), fault)
    return tables.withColumn("root", F.when(fault.isNotNull(), F.raise_error(text).cast("string")).otherwise(F.col("root")))


def write_roll_tables(rolls: DataFrame, path: str, rule: str) -> None:
    """A JSON line per root below `path`, in a folder of the rule."""
    row = F.struct("from_contract", "to_contract", "day", "roll_ts", "adjustment")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("roll_ts", row.alias("row")))), lambda x: x["row"])
    tables = rolls.groupBy("root").agg(ordered.alias("rows"))
    tables = tables.select(F.lit(ROLL_TABLE_VERSION).alias("schema_version"), "root", F.lit(rule).alias("rule"), "rows")
    _checked(tables).withColumn("rule_name", F.lit(rule)).write.mode("overwrite").partitionBy("rule_name").json(path)


def read_roll_tables(spark, path: str, rule: str) -> DataFrame:
    """The rolls of a rule's tables, a row each; tables that contradict themselves are refused."""
    tables = spark.read.schema(ROLL_TABLE).option("mode", "FAILFAST").json(f"{path}/rule_name={rule}")
    return _checked(tables).select("root", F.inline("rows"))


def narrow_ranges(wanted: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """The overlap [start, end) of each wanted with its key's covered range, and whether it is narrower; none where they do not meet."""
    have = covered.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    start, end = F.greatest("start", "__s"), F.least("end", "__e")
    narrowed = (F.col("start") < F.col("__s")) | (F.col("end") > F.col("__e"))
    both = wanted.join(have, keys).withColumns({"start": start, "end": end, "narrowed": narrowed})
    return both.where(F.col("start") < F.col("end")).drop("__s", "__e")


def back_adjust(rolls: DataFrame, key: str) -> DataFrame:
    """For each segment the sum of the gaps after it; the last segment is not in the table and has 0."""
    ahead = Window.partitionBy(key).orderBy("roll_ts").rowsBetween(0, Window.unboundedFollowing)
    return rolls.withColumn("offset", F.sum("adjustment").over(ahead))


def front_windows(rolls: DataFrame, key: str) -> DataFrame:
    """(after, until] of each contract in front; open ends are the ends of time."""
    order = Window.partitionBy(key).orderBy("roll_ts")
    start = F.coalesce(F.lag("roll_ts").over(order), F.lit(-(1 << 62)))
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    known = rolls.select(key, F.col("from_contract").alias("contract"), start.alias("after"), F.col("roll_ts").alias("until"), F.sum("adjustment").over(ahead).alias("offset"))
    last = rolls.groupBy(key).agg(F.max_by("to_contract", "roll_ts").alias("contract"), F.max("roll_ts").alias("after"))
    return known.unionByName(last.select(key, "contract", "after", F.lit(1 << 62).alias("until"), F.lit(0).cast("long").alias("offset")))


def stitch(bars: DataFrame, windows: DataFrame, key: str, step: int) -> DataFrame:
    """Bars of the contract in front; a roll counts strictly after its time.

    The windows are the rows of roll tables, which a check of their number
    allows to broadcast; else the join on key and contract is shuffled.
    """
    avail = F.col("ts_open") + step
    joined = bars.join(windows, [key, "contract"]).where((avail > F.col("after")) & (avail <= F.col("until")))
    return joined.drop("after", "until").withColumnRenamed("offset", "signal_offset")


def revisions(observed: DataFrame) -> DataFrame:
    """Per contract and expiration: first and last time it was seen and how often; `conflict` if two overlap."""
    rows = observed.groupBy("contract", "expiration").agg(
        F.min("avail_ts").alias("avail_ts"), F.max("avail_ts").alias("last_avail_ts"), F.count(F.lit(1)).alias("records")
    )
    ahead = F.lead("avail_ts").over(Window.partitionBy("contract").orderBy("avail_ts", "expiration"))
    return rows.withColumn("conflict", F.coalesce(ahead <= F.col("last_avail_ts"), F.lit(False)))


def expiry_as_of(decisions: DataFrame, revised: DataFrame) -> DataFrame:
    """The latest expiration known at each decision."""
    return latest_as_of(decisions, revised, ["contract"], "decision_ts", "avail_ts", ["expiration"])


def resolve_cycles(asked: DataFrame, cycles: DataFrame, first_days: int = 3653) -> DataFrame:
    """The contract that a short symbol means at a time: the cycle whose expiry is the first not before it.

    `asked` has symbol and day, `cycles` symbol, contract and expiry. The first
    cycle opens `first_days` before its expiry; outside of all cycles the
    contract is null. Two cycles of a symbol with one expiry are an error, as
    the answer has to be exactly one. Both sides are put into one order, last
    day first, and the next expiry is carried on: each row is seen once, as a
    frame that looks ahead would read the rest of its symbol for every row.
    """
    order = Window.partitionBy("symbol").orderBy("expiry")
    clash = F.raise_error(F.concat(F.lit("two cycles of "), F.col("symbol"), F.lit(" expire at once"))).cast("long")
    before = F.lag("expiry").over(order)
    opens = F.when(before == F.col("expiry"), clash).otherwise(F.coalesce(before, F.col("expiry") - first_days))
    cycle = F.struct("contract", "expiry", opens.alias("opens"))
    known = cycles.withColumn("__cycle", cycle).select("symbol", F.col("expiry").alias("__at"), F.lit(1).alias("__side"), "__cycle")
    wanted = asked.withColumn("__at", F.col("day")).withColumn("__side", F.lit(0))
    both = wanted.unionByName(known, allowMissingColumns=True)
    back = Window.partitionBy("symbol").orderBy(F.desc("__at"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__next", F.last("__cycle", ignorenulls=True).over(back)).where(F.col("__side") == 0)
    inside = F.col("day") > F.col("__next.opens")
    return found.select(*asked.columns, *[F.when(inside, F.col(f"__next.{c}")).alias(c) for c in ("contract", "expiry")])
