"""Exchange calendars: holiday rules, trading days, session bounds, as a small dimension table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NANO = 1_000_000_000


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday by the anonymous computus."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * i - k - h + m + 32) % 7
    n = (h - m + r + 90) // 25
    return dt.date(year, n, (h - m + r + n + 19) % 32)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date | None:
    """The n-th weekday (Monday 0) of a month; -1 is the last. None where the month has no such day."""
    if n == -1:
        last = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
        return last - dt.timedelta((last.weekday() - weekday) % 7)
    first = dt.date(year, month, 1)
    found = first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    return found if n >= 1 and found.month == month else None


def observed(day: dt.date, rule: str) -> dt.date:
    """actual; nearest (Saturday back, Sunday on); sunday (Sunday on)."""
    if rule == "nearest" and day.weekday() == 5:
        return day - dt.timedelta(1)
    if rule in ("nearest", "sunday") and day.weekday() == 6:
        return day + dt.timedelta(1)
    return day


@dataclass(frozen=True)
class Holiday:
    """A day of each year from `first` to `last`, closed or closing early at `close`.

    kind: fixed (month, day); weekday (month, weekday, n); easter (days after
    Easter); after (the day after month, weekday, n); before (month, day, then
    the weekdays the date may fall on, any if none): the last weekday before a date.
    """

    name: str
    kind: str
    args: tuple[int, ...]
    observance: str = "actual"
    close: dt.time | None = None
    first: int = 0
    last: int = 9999

    def on(self, year: int) -> dt.date | None:
        if not self.first <= year <= self.last:
            return None
        if self.kind == "fixed":
            return observed(dt.date(year, *self.args), self.observance)
        if self.kind in ("weekday", "after"):
            day = nth_weekday(year, *self.args)
            return day + dt.timedelta(1) if day and self.kind == "after" else day
        if self.kind == "before":
            anchor = dt.date(year, *self.args[:2])
            if self.args[2:] and anchor.weekday() not in self.args[2:]:
                return None
            day = observed(anchor, self.observance) - dt.timedelta(1)
            while day.weekday() >= 5:
                day -= dt.timedelta(1)
            return day
        return easter(year) + dt.timedelta(self.args[0])


@dataclass(frozen=True)
class Era:
    """Session times from a date on; an opening after the close belongs to the evening before. Halts are (from, to)."""

    start: dt.date
    open: dt.time
    close: dt.time
    rth_open: dt.time
    rth_close: dt.time
    halts: tuple[tuple[dt.time, dt.time], ...] = ()

    @property
    def overnight(self) -> bool:
        return self.open >= self.close


@dataclass(frozen=True)
class Calendar:
    """`special` are one-off days, (name, close or None where closed); they come before all rules."""

    name: str
    zone: str
    eras: tuple[Era, ...]
    holidays: tuple[Holiday, ...]
    special: dict[dt.date, tuple[str, dt.time | None]] = field(default_factory=dict)
    roots: tuple[str, ...] = ()

    def era(self, day: dt.date) -> Era:
        """The latest era that has begun, or the first."""
        found = [e for e in self.eras if e.start <= day]
        return found[-1] if found else self.eras[0]

    def holiday(self, day: dt.date) -> tuple[str, str, dt.time | None] | None:
        """(effect, name, close) of the one-off, or else of the first rule that names the day."""
        if day in self.special:
            name, close = self.special[day]
            return ("early" if close else "closed"), name, close
        for h in self.holidays:
            if day in (h.on(day.year - 1), h.on(day.year), h.on(day.year + 1)):
                return ("early" if h.close else "closed"), h.name, h.close
        return None

    def trading_day(self, at: dt.datetime) -> dt.date:
        """The day that the exchange books an instant to, whether or not it trades then."""
        local = at.astimezone(ZoneInfo(self.zone))
        era = self.era(local.date())
        return local.date() + dt.timedelta(era.overnight and local.time() >= era.open)


def wall_to_utc(day: dt.date, at: dt.time, zone: str) -> dt.datetime:
    """The instant of a wall clock reading; one that does not exist or exists twice is refused."""
    tz = ZoneInfo(zone)
    a = dt.datetime.combine(day, at, tz)
    b = a.replace(fold=1)
    if a.utcoffset() != b.utcoffset():
        raise ValueError(f"{day} {at} does not exist once in {zone}")
    return a.astimezone(dt.timezone.utc)


def _ns(t: dt.datetime) -> int:
    return int(t.timestamp()) * NANO


SESSION_SCHEMA = (
    "calendar_id string, trading_day date, open_ns long, close_ns long, rth_open_ns long, rth_close_ns long, effect string, holiday_name string"
)


def session_rows(cal: Calendar, first: dt.date, last: dt.date) -> list[tuple]:
    """One row per weekday; closed days have no bounds."""
    out = []
    for i in range((last - first).days + 1):
        day = first + dt.timedelta(i)
        if day.weekday() >= 5:
            continue
        era, found = cal.era(day), cal.holiday(day)
        if found and found[0] == "closed":
            out.append((cal.name, day, None, None, None, None, "closed", found[1]))
            continue
        opened = wall_to_utc(day - dt.timedelta(1) if era.overnight else day, era.open, cal.zone)
        end = found[2] if found else era.close
        closed = wall_to_utc(day, end, cal.zone)
        rth = wall_to_utc(day, era.rth_open, cal.zone), min(wall_to_utc(day, era.rth_close, cal.zone), closed)
        out.append((cal.name, day, _ns(opened), _ns(closed), _ns(rth[0]), _ns(rth[1]), "early" if found else "regular", found[1] if found else None))
    return out


def interval_rows(cal: Calendar, first: dt.date, last: dt.date) -> list[tuple]:
    """(calendar_id, trading_day, part, open_ns, close_ns) of the stretches in which each session trades, halts left out."""
    out = []
    for name, day, open_ns, close_ns, *_ in session_rows(cal, first, last):
        if open_ns is None or close_ns <= open_ns:
            continue
        parts, at = [], open_ns
        for lo, hi in ((_ns(wall_to_utc(day, a, cal.zone)), _ns(wall_to_utc(day, b, cal.zone))) for a, b in cal.era(day).halts):
            if hi <= at or lo >= close_ns:
                continue
            if lo > at:
                parts.append((at, lo))
            at = max(at, hi)
        if at < close_ns:
            parts.append((at, close_ns))
        out += [(name, day, i, a, b) for i, (a, b) in enumerate(parts)]
    return out


def intervals(spark: SparkSession, cal: Calendar, first: dt.date, last: dt.date) -> DataFrame:
    """The dimension table of open stretches, a few rows for each day of the span."""
    return spark.createDataFrame(interval_rows(cal, first, last), "calendar_id string, trading_day date, part int, open_ns long, close_ns long")


def sessions(spark: SparkSession, cal: Calendar, first: dt.date, last: dt.date) -> DataFrame:
    """The dimension table: a row per weekday, so its size is bounded by the span of days."""
    return spark.createDataFrame(session_rows(cal, first, last), SESSION_SCHEMA)


def with_session(bars: DataFrame, dim: DataFrame, step: int) -> DataFrame:
    """Each bar with its session: the first whose close is not before the bar is known.

    Bars are put on UTC days for an equi-join with the days a session touches.
    """
    day_ns = 86_400 * NANO
    avail = F.col("ts_open") + step
    keyed = dim.where(F.col("open_ns").isNotNull()).withColumn(
        "utc_day", F.explode(F.sequence(F.expr(f"open_ns div {day_ns}"), F.expr(f"close_ns div {day_ns}")))
    )
    staged = bars.withColumn("utc_day", F.expr(f"(ts_open + {step - 1}) div {day_ns}"))
    joined = staged.join(F.broadcast(keyed), "utc_day", "left")
    inside = (avail > F.col("open_ns")) & (avail <= F.col("close_ns"))
    return joined.where(inside).drop("utc_day")


def era_of(days: DataFrame, eras: DataFrame) -> DataFrame:
    """Each row of `days` (`day`) with its calendar's latest era (`start`, `era`) that has begun, or else the first."""
    from ..operators.asof import latest_as_of

    found = latest_as_of(days, eras, ["calendar_id"], "day", "start", ["era"])
    first = eras.groupBy("calendar_id").agg(F.min_by("era", "start").alias("__first"))
    return found.join(F.broadcast(first), "calendar_id", "left").withColumn("era", F.coalesce("era", "__first")).drop("__first")


def trading_day(ts: Column, cal: Calendar) -> Column:
    """The date that an exchange books an instant (whole UTC nanoseconds) to: the next one from the evening's opening on.

    The era is that of the civil date, as in `Calendar.trading_day`.
    """
    local = F.from_utc_timestamp(F.timestamp_micros(((ts - F.pmod(ts, F.lit(1000))) / F.lit(1000)).cast("long")), cal.zone)
    date = F.to_date(local)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    late = F.lit(False)
    for era in cal.eras:  # a few; the last that has begun decides
        opened = era.open.hour * 3600 + era.open.minute * 60
        here = (second >= opened) if era.overnight else F.lit(False)
        late = here if era is cal.eras[0] else F.when(date >= F.lit(era.start), here).otherwise(late)
    return F.date_add(date, late.cast("int"))


def with_phase(bars: DataFrame, dim: DataFrame, stretches: DataFrame) -> DataFrame:
    """`phase` of each bar's opening: closed, overnight, regular or post_regular."""
    day_ns = 86_400 * NANO
    days = stretches.join(dim.select("trading_day", "rth_open_ns", "rth_close_ns"), "trading_day")
    keyed = days.withColumn("utc_day", F.explode(F.sequence(F.expr(f"open_ns div {day_ns}"), F.expr(f"close_ns div {day_ns}"))))
    at = F.col("ts_open")
    keyed = keyed.select("utc_day", *[F.col(c).alias(f"__{c}") for c in ("open_ns", "close_ns", "rth_open_ns", "rth_close_ns")])
    staged = bars.withColumn("utc_day", F.expr(f"ts_open div {day_ns}"))
    # The stretches of a calendar, a few rows a day.
    on = (staged["utc_day"] == keyed["utc_day"]) & (at >= F.col("__open_ns")) & (at < F.col("__close_ns"))
    joined = staged.join(F.broadcast(keyed), on, "left").drop("utc_day")
    phase = (
        F.when(F.col("__open_ns").isNull(), "closed")
        .when(at < F.col("__rth_open_ns"), "overnight")
        .when(at < F.col("__rth_close_ns"), "regular")
        .otherwise("post_regular")
    )
    return joined.withColumn("phase", phase).drop("__open_ns", "__close_ns", "__rth_open_ns", "__rth_close_ns")


def session_clock(step: int) -> dict[str, Column]:
    """Minutes since and to the session's bounds, and one-hot phases, of a bar with its session.

    The phase is that of the nanosecond before the bar is known.
    """
    avail = F.col("ts_open") + step
    at = avail - 1
    minutes = lambda x: x.cast("double") / (60.0 * NANO)
    rth = (at >= F.col("rth_open_ns")) & (at < F.col("rth_close_ns"))
    return {
        "minutes_since_open": minutes(avail - F.col("open_ns")),
        "minutes_to_close": minutes(F.col("close_ns") - avail),
        "minutes_since_rth_open": minutes(avail - F.col("rth_open_ns")),
        "minutes_to_rth_close": minutes(F.col("rth_close_ns") - avail),
        "is_rth": rth.cast("double"),
        "is_overnight": (at < F.col("rth_open_ns")).cast("double"),
        "is_post_rth": (at >= F.col("rth_close_ns")).cast("double"),
    }


def bars_per_year(dim: DataFrame, step: int) -> DataFrame:
    """Trading days or open time over the step, scaled to a year of 365.2425 days, per calendar."""
    traded = dim.groupBy("calendar_id").agg(
        F.count("open_ns").alias("days"),
        F.sum(F.col("close_ns") - F.col("open_ns")).alias("open_ns"),
        (F.datediff(F.max("trading_day"), F.min("trading_day")) + 1).alias("span"),
    )
    years = F.col("span") / 365.2425
    bars = F.col("days") if step >= 86_400 * NANO else F.col("open_ns") / F.lit(step)
    return traded.select("calendar_id", "days", (bars / years).alias("bars_per_year"))


# ---------------------------------------------------------------- exchanges (rules, dates and times are fixed values)

_T = dt.time
_D = dt.date
_ALWAYS = (
    Holiday("new_year", "fixed", (1, 1), "sunday"),
    Holiday("good_friday", "easter", (-2,)),
    Holiday("christmas", "fixed", (12, 25), "nearest"),
)
#: Name, kind, day and observance of the holidays that futures were closed on for a while, and the years of that.
_FLOATING = (
    ("martin_luther_king_day", "weekday", (1, 0, 3), "actual", 2013, 2014),
    ("presidents_day", "weekday", (2, 0, 3), "actual", 2013, 2014),
    ("memorial_day", "weekday", (5, 0, -1), "actual", 2013, 2013),
    ("independence_day", "fixed", (7, 4), "nearest", 2013, 2013),
    ("labor_day", "weekday", (9, 0, 1), "actual", 2013, 2013),
    ("thanksgiving", "weekday", (11, 3, 4), "actual", 2012, 2013),
)
_JUNETEENTH = ("juneteenth", "fixed", (6, 19), "sunday")


def _floating(before: dt.time | None, closes: tuple[tuple[dt.time, int], ...], juneteenth: dt.time | None) -> tuple[Holiday, ...]:
    """The floating holidays: early closes before the years of closure, then `closes`, (time, last year), one after the other."""
    out = []
    for name, kind, args, observance, shut, reopened in _FLOATING:
        out.append(Holiday(name, kind, args, observance, None, shut, reopened))
        if before:
            out.append(Holiday(name, kind, args, observance, before, 0, shut - 1))
        first = reopened + 1
        for close, last in closes:
            out.append(Holiday(name, kind, args, observance, close, first, last))
            first = last + 1
    if juneteenth:
        out.append(Holiday(*_JUNETEENTH, juneteenth, 2022))
    return tuple(out)


def _year_end(friday: tuple[tuple[dt.time, int], ...], eve: tuple[tuple[dt.time, int], ...]) -> tuple[Holiday, ...]:
    """Early closes after Thanksgiving and on Christmas Eve, (time, last year) one after the other."""
    out, first = [], 0
    for close, last in friday:
        out.append(Holiday("day_after_thanksgiving", "after", (11, 3, 4), "actual", close, first, last))
        first = last + 1
    first = 0
    for close, last in eve:
        out.append(Holiday("christmas_eve", "fixed", (12, 24), "actual", close, first, last))
        first = last + 1
    return tuple(out)


_BEFORE_FOURTH = Holiday("day_before_independence_day", "before", (7, 4, 1, 2, 3, 4), "actual", _T(12, 15), 2013)
_PAYROLL_FRIDAYS = (_D(2012, 4, 6), _D(2015, 4, 3), _D(2021, 4, 2), _D(2023, 4, 7), _D(2026, 4, 3))

GLOBEX = Calendar(
    "globex",
    "America/Chicago",
    (
        Era(_D(2012, 11, 19), _T(17), _T(16, 15), _T(8, 30), _T(15), ((_T(15, 15), _T(15, 30)),)),
        Era(_D(2015, 9, 21), _T(17), _T(16), _T(8, 30), _T(15), ((_T(15, 15), _T(15, 30)),)),
        Era(_D(2021, 6, 28), _T(17), _T(16), _T(8, 30), _T(15)),
    ),
    (*_ALWAYS, *_floating(None, ((_T(12), 9999),), _T(12)), *_year_end(((_T(12, 15), 9999),), ((_T(12, 15), 9999),)), _BEFORE_FOURTH),
    {
        **{d: ("payroll_good_friday", _T(8, 15)) for d in (_D(2010, 4, 2), *_PAYROLL_FRIDAYS)},
        _D(2012, 10, 29): ("hurricane", _T(8, 15)),
        _D(2012, 10, 30): ("hurricane", _T(8, 15)),
        _D(2018, 12, 5): ("day_of_mourning", _T(8, 30)),
        _D(2025, 1, 9): ("day_of_mourning", _T(8, 30)),
    },
    ("ES", "MES", "NQ", "MNQ", "RTY", "M2K"),
)

_COMMODITY_DAYS = (
    *_ALWAYS,
    *_floating(_T(12, 15), ((_T(12), 2021), (_T(13, 30), 9999)), _T(13, 30)),
    *_year_end(((_T(12, 45), 2023), (_T(13, 45), 9999)), ((_T(12, 45), 9999),)),
)
ENERGY = Calendar(
    "globex_energy", "America/Chicago",
    (Era(_D(2010, 6, 6), _T(17), _T(16, 15), _T(8), _T(13, 30)), Era(_D(2015, 9, 21), _T(17), _T(16), _T(8), _T(13, 30))),
    _COMMODITY_DAYS, {}, ("CL", "MCL"),
)
METALS = Calendar(
    "globex_metals", "America/Chicago",
    (Era(_D(2010, 6, 6), _T(17), _T(16, 15), _T(7, 20), _T(12, 30)), Era(_D(2015, 9, 21), _T(17), _T(16), _T(7, 20), _T(12, 30))),
    _COMMODITY_DAYS, {}, ("GC", "MGC"),
)
FX = Calendar(
    "globex_fx", "America/Chicago", (Era(_D(2010, 6, 6), _T(17), _T(16), _T(7, 20), _T(14)),),
    (
        *_ALWAYS, *_floating(_T(12), ((_T(12), 2021),), None),
        *_year_end(((_T(12, 15), 2023), (_T(13, 45), 9999)), ((_T(12, 15), 2023), (_T(12, 45), 9999))),
    ),
    {_D(2010, 12, 31): ("new_year_eve", _T(12, 15)), **{d: ("payroll_good_friday", _T(10, 15)) for d in _PAYROLL_FRIDAYS}},
    ("6E", "M6E"),
)
RATES = Calendar(
    "globex_rates", "America/Chicago",
    (Era(_D(2010, 6, 6), _T(17, 30), _T(16), _T(7, 20), _T(14)), Era(_D(2011, 10, 3), _T(17), _T(16), _T(7, 20), _T(14))),
    (*_ALWAYS, *_floating(_T(12), ((_T(12), 9999),), _T(12)), *_year_end(((_T(12, 15), 9999),), ((_T(12, 15), 9999),))),
    {
        _D(2010, 12, 31): ("new_year_eve", _T(12, 15)),
        _D(2012, 10, 29): ("hurricane", _T(11)),
        _D(2018, 12, 5): ("day_of_mourning", None),
        _D(2025, 1, 9): ("day_of_mourning", _T(12, 15)),
        **{d: ("payroll_good_friday", _T(10, 15)) for d in _PAYROLL_FRIDAYS},
    },
    ("ZN",),
)
OPTIONS = Calendar(
    "us_equity_options", "America/New_York", (Era(_D(2012, 6, 1), _T(9, 30), _T(16), _T(9, 30), _T(16)),),
    (
        *_ALWAYS,
        Holiday("martin_luther_king_day", "weekday", (1, 0, 3)),
        Holiday("presidents_day", "weekday", (2, 0, 3)),
        Holiday("memorial_day", "weekday", (5, 0, -1)),
        Holiday("juneteenth", "fixed", (6, 19), "nearest", None, 2022),
        Holiday("independence_day", "fixed", (7, 4), "nearest"),
        Holiday("labor_day", "weekday", (9, 0, 1)),
        Holiday("thanksgiving", "weekday", (11, 3, 4)),
        Holiday("day_before_independence_day", "before", (7, 4, 1, 2, 3, 4), "nearest", _T(13)),
        Holiday("day_after_thanksgiving", "after", (11, 3, 4), "actual", _T(13)),
        Holiday("christmas_eve", "before", (12, 25), "nearest", _T(13)),
    ),
    {
        _D(2012, 10, 29): ("hurricane", None),
        _D(2012, 10, 30): ("hurricane", None),
        _D(2018, 12, 5): ("day_of_mourning", None),
        _D(2025, 1, 9): ("day_of_mourning", None),
    },
    ("SPY", "QQQ", "IWM", "DIA"),
)
CALENDARS = (GLOBEX, ENERGY, METALS, FX, RATES, OPTIONS)


def governing(instrument: str) -> Calendar:
    """The calendar that claims an instrument's root: the part before a month code and year, or the whole name."""
    import re

    m = re.fullmatch(r"([A-Z0-9]+?)[FGHJKMNQUVXZ](\d{4}|\d{1,2})", instrument)
    for cal in CALENDARS:
        if instrument in cal.roots or (m and m[1] in cal.roots):
            return cal
    raise LookupError(f"no calendar claims {instrument}")
