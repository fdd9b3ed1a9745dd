"""The bar schema and the units that everything else is built on.

Prices are whole nano-points, money whole nano-dollars, time whole UTC
nanoseconds. Doubles appear in indicator and statistics columns only. Spark's
ANSI mode, on by default, turns an overflow into an error.
"""

from __future__ import annotations

from pyspark.sql import types as T

NANO = 1_000_000_000
TF_NS = {"1s": NANO, "1m": 60 * NANO, "5m": 300 * NANO, "15m": 900 * NANO, "1h": 3600 * NANO, "1d": 86_400 * NANO}
DAY_NS = TF_NS["1d"]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("ts_open", T.LongType(), False),
        T.StructField("open", T.LongType(), False),
        T.StructField("high", T.LongType(), False),
        T.StructField("low", T.LongType(), False),
        T.StructField("close", T.LongType(), False),
        T.StructField("volume", T.LongType(), False),
    ]
)


def tf_ns(tf: str) -> int:
    """Length of a time frame; other spellings than the known ones are refused."""
    if tf not in TF_NS:
        raise ValueError(f"unknown time frame {tf!r}; one of {', '.join(TF_NS)}")
    return TF_NS[tf]
