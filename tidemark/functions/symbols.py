"""Futures symbols: root, month code, year of one, two or four digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH_CODES = "FGHJKMNQUVXZ"
ANCHOR_YEAR = 2025
_PATTERN = r"^([A-Z0-9]+?)([FGHJKMNQUVXZ])([0-9]{4}|[0-9]{2}|[0-9])$"


def root(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, _PATTERN, 1), F.lit(""))


def month(symbol: Column) -> Column:
    code = F.regexp_extract(symbol, _PATTERN, 2)
    return F.when(code != "", F.position(code, F.lit(MONTH_CODES)))


def year(symbol: Column, anchor: int = ANCHOR_YEAR) -> Column:
    """Four digits as they are, two in this century, one the year nearest to the anchor (the earlier of two)."""
    digits = F.regexp_extract(symbol, _PATTERN, 3)
    given = F.nullif(digits, F.lit("")).cast("int")
    decade = given + F.lit(anchor - anchor % 10)
    nearest = F.when(decade - anchor >= 5, decade - 10).when(anchor - decade > 5, decade + 10).otherwise(decade)
    return F.when(F.length(digits) == 4, given).when(F.length(digits) == 2, given + 2000).otherwise(nearest)


def canonical(symbol: Column) -> Column:
    return F.concat(root(symbol), F.regexp_extract(symbol, _PATTERN, 2), F.lpad(year(symbol).cast("string"), 4, "0"))


def third_friday(y: Column, m: Column) -> Column:
    """Nominal expiry."""
    first = F.make_date(y, m, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)


def recordable(symbol: Column) -> Column:
    """A symbol that a log line may hold: not empty, no white space or control characters."""
    return symbol.isNotNull() & symbol.rlike(r"^[^\x00-\x20\x7F]+$")


def delivery_places(rows: DataFrame, contract: str, tie: str) -> DataFrame:
    """`rows` with `place`, from 1 in each root: by year and month of delivery, not by letters, ties by `tie`.

    No task sorts a whole root: places inside one delivery month are numbered
    alone, and the months before, one row each, are added up.
    """
    month_key = ["__root", "__year", "__month"]
    keyed = rows.withColumns({"__root": root(F.col(contract)), "__year": year(F.col(contract)), "__month": month(F.col(contract))})
    before = Window.partitionBy("__root").orderBy("__year", "__month").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*month_key).agg(F.count(F.lit(1)).alias("__n"))
    ahead = sizes.select(*month_key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy(*month_key).orderBy(tie))
    placed = keyed.withColumn("__in", inside).join(ahead, month_key)
    return placed.withColumn("place", (F.col("__ahead") + F.col("__in")).cast("long")).select(*rows.columns, "place")


def alias_parts(alias: Column) -> tuple[Column, Column]:
    """(root, rule) of `ROOT.rule.0`, rule v by volume or c by calendar; null for any other text or a deferred month."""
    pattern = r"^([A-Z0-9]+)\.([vc])\.0+$"
    part = lambda i: F.nullif(F.regexp_extract(alias, pattern, i), F.lit(""))
    return part(1), part(2)


_UNRESERVED = "A-Za-z0-9._-"


def path_component(name: Column) -> Column:
    """One path component for a name: bytes other than letters, digits, dot, underscore and hyphen as %XX. Null if empty or not ASCII."""
    letters = F.transform(F.split(name, ""), lambda c: F.when(c.rlike(f"^[{_UNRESERVED}]$"), c).otherwise(F.concat(F.lit("%"), F.hex(F.encode(c, "UTF-8")))))
    text = F.array_join(letters, "")
    # A component of nothing but dots is a way up, not a name.
    text = F.when(text.isin(".", ".."), F.concat(F.lit("%2E"), F.substring(text, 2, 1))).otherwise(text)
    return F.when(name.rlike(r"^[\x00-\x7F]+$"), text)


def path_name(component: Column) -> Column:
    """The name of a path component; null for anything that `path_component` does not write."""
    parts = F.regexp_extract_all(component, F.lit(r"(%[0-9A-F]{2}|[^%])"), F.lit(1))
    text = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 3, F.decode(F.unhex(F.substring(p, 2, 2)), "US-ASCII")).otherwise(p)), "")
    return F.when(path_component(text) == component, text)


#: Vendor schemas of bars and their time frames (fixed values).
SCHEMA_FRAMES = {"ohlcv-1s": "1s", "ohlcv-1m": "1m", "ohlcv-1h": "1h", "ohlcv-1d": "1d"}


def frame_of_schema(schema: Column) -> Column:
    """The time frame of a vendor schema, null for any other."""
    found = F.lit(None).cast("string")
    for name, tf in SCHEMA_FRAMES.items():
        found = F.when(schema == name, F.lit(tf)).otherwise(found)
    return found


def resolve_names(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """`name` of each wanted instrument (`asked`): itself if stored, or the one stored name of four-digit year that its
    short year stands for; `status` is exact, alias, ambiguous or missing. `stored` has `name`, each once.
    """
    digits = F.regexp_extract("asked", _PATTERN, 3)
    short = F.length(digits).isin(1, 2)
    stem = lambda c, n: F.concat(root(F.col(c)), F.regexp_extract(c, _PATTERN, 2), F.substring(F.regexp_extract(c, _PATTERN, 3), -n, n))
    long_names = stored.where(F.length(F.regexp_extract("name", _PATTERN, 3)) == 4)
    forms = long_names.select("name", F.explode(F.array(stem("name", 1), stem("name", 2))).alias("form"))
    counted = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("one"))
    exact = stored.select(F.col("name").alias("asked"), F.lit(True).alias("there"))
    rows = wanted.join(exact, "asked", "left").withColumn("form", F.when(short, F.col("asked"))).join(counted, "form", "left")
    status = F.when(F.col("there"), "exact").when(F.col("n") == 1, "alias").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    name = F.when(F.col("there"), F.col("asked")).when(F.col("n") == 1, F.col("one"))
    return rows.withColumns({"status": status, "name": name}).select(*wanted.columns, "name", "status")
