"""Exact price and money functions, and the normal distribution without user functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def avail_ts(step: int) -> Column:
    return F.col("ts_open") + F.lit(step)


def whole(x: Column, n: int) -> Column:
    """Whole division towards minus infinity.

    The dividend is made a multiple of `n` first, so that the quotient of
    doubles is exact for nanosecond times and steps of whole seconds.
    """
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def day_known(step: int, day_ns: int = 86_400_000_000_000) -> Column:
    """The UTC day, from the epoch, on which a bar is known; midnight ends the day before."""
    return whole(F.col("ts_open") + F.lit(step) - 1, day_ns)


def points(nanos: Column) -> Column:
    return nanos.cast("double") / F.lit(1e9)


def round_to_tick(price: Column, tick: int) -> Column:
    """The nearest tick, halves away from zero; whole division truncates."""
    moved = price + F.signum(price).cast("long") * F.lit(tick // 2)
    return (moved - moved % F.lit(tick)).cast("long")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_decimal(text: Column, digits: int = 9) -> Column:
    """Exact nanos of a decimal text; null for exponents, too many digits or anything else."""
    return let(F.regexp_replace(text, "_", ""), lambda plain: _parsed(plain, digits))


def _parsed(plain: Column, digits: int) -> Column:
    ok = plain.rlike(rf"^[+-]?[0-9]+(\.[0-9]{{1,{digits}}})?$")
    sign = F.when(plain.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    whole = F.regexp_extract(plain, r"^[+-]?([0-9]+)", 1)
    part = F.rpad(F.regexp_extract(plain, r"\.([0-9]+)$", 1), digits, "0")
    return F.when(ok, sign * (whole.cast("long") * F.lit(10**digits) + part.cast("long")))


def show_decimal(nanos: Column) -> Column:
    """Decimal text without trailing zeros."""
    return let(nanos, _shown)


def _shown(nanos: Column) -> Column:
    size = F.abs(nanos)
    part = F.rtrim(F.lpad((size % F.lit(10**9)).cast("string"), 9, "0"), F.lit("0"))
    whole = ((size - size % F.lit(10**9)) / F.lit(10**9)).cast("long").cast("string")
    text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(nanos < 0, F.concat(F.lit("-"), text)).otherwise(text)


def half_ticks(text: Column) -> Column:
    """Twice a number of ticks given in whole or half ticks; null for other fractions."""
    return F.when(text.rlike(r"^[0-9]+(\.[05])?$"), (text.cast("decimal(18,1)") * 2).cast("long"))


def normal_cdf(x: Column) -> Column:
    """By the rational error function of Abramowitz and Stegun, 7.1.26."""
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    # Fixed values of the approximation.
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    erf = F.lit(1.0) - poly * t * F.exp(-z * z)
    return F.when(x >= 0, (1.0 + erf) / 2.0).otherwise((1.0 - erf) / 2.0)


# Acklam's coefficients for the inverse normal distribution (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(cs, x):
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal_cdf(p: Column) -> Column:
    """Null outside of (0, 1)."""
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    tail = lambda x: _poly(_C, x) / (_poly(_D, x) * x + 1.0)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < 0.02425, tail(low))
        .when(p > 1 - 0.02425, -tail(high))
        .otherwise(_poly(_A, r) * q / (_poly(_B, r) * r + 1.0))
    )


EULER_GAMMA = 0.5772156649015329


def expected_max_z(n: Column) -> Column:
    """Expected largest of n standard normal draws; 0 for one draw or none."""
    n = n.cast("double")
    return F.when(n <= 1, F.lit(0.0)).otherwise(
        (1 - EULER_GAMMA) * inverse_normal_cdf(1 - 1 / n) + EULER_GAMMA * inverse_normal_cdf(1 - 1 / (n * math.e))
    )


def identity_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each with its length before it, so that no two lists of parts collide."""
    return F.sha2(F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]), 256)


def run_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def parse_usd(text: Column) -> Column:
    """Exact nano-dollars of an amount, which may start with a dollar sign; null for signs, exponents, finer parts or anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\$", ""), "_", "")
    full = F.when(plain.startswith("."), F.concat(F.lit("0"), plain)).otherwise(F.regexp_replace(plain, r"\.$", ""))
    return F.when(plain.rlike(r"^([0-9]+\.?[0-9]{0,9}|\.[0-9]{1,9})$"), parse_decimal(full))


def ceil_nanos(dollars: Column) -> Column:
    """Nano-dollars of a double, never less than it says; null for a negative, infinite or larger one.

    The double's own binary value counts, to twelve decimals: its fraction is a
    whole number of 2**-52, which decimals hold exactly.
    """
    fits = F.when((dollars >= 0) & (dollars < 9.0e9), dollars)
    whole = F.floor(fits)
    units = F.floor((fits - whole) * F.lit(float(1 << 52))).cast("decimal(16,0)")
    pico = F.bround(units * F.lit(10**12).cast("decimal(13,0)") / F.lit(1 << 52).cast("decimal(16,0)"), 0)
    return whole.cast("long") * F.lit(10**9) + F.ceil(pico.cast("long") / 1000)


def show_usd(nanos: Column) -> Column:
    """`$1234.56`: at least two decimals, no further zeros."""
    text = show_decimal(nanos)
    places = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    padded = F.when(places == 0, F.concat(text, F.lit(".00"))).when(places == 1, F.concat(text, F.lit("0"))).otherwise(text)
    return F.concat(F.lit("$"), padded)
