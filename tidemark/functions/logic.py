"""The three-valued logic of rules: a null on the left decides, unlike in SQL."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def strict_and(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), F.lit(None).cast("boolean")).when(~a, F.lit(False)).otherwise(b)


def strict_or(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), F.lit(None).cast("boolean")).when(a, F.lit(True)).otherwise(b)


def finite(x: Column) -> Column:
    """Null where a double is not a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def compare(a: Column, op: str, b: Column) -> Column:
    a, b = finite(a), finite(b)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def crosses(a: Column, b: Column, over: WindowSpec, above: bool = True) -> Column:
    """Whether a goes from not above to above b at this row; null while a side or its last value is."""
    a, b = finite(a), finite(b)
    prev_a, prev_b = F.lag(a).over(over), F.lag(b).over(over)
    return ((prev_a <= prev_b) & (a > b)) if above else ((prev_a >= prev_b) & (a < b))


def fires(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))
