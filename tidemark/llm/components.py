"""Connected components by repeated joins; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(links: DataFrame) -> DataFrame:
    """`key`, `label` for each end of the links `a`, `b`; the label is the least key reached.

    Each round takes the least label among the neighbours and then the label of
    that label, so that chains shrink by a power at a time. Labels are summed
    up by partial minima, which keeps keys with very many neighbours cheap.
    """
    both = materialise(
        links.select(F.col("a").alias("key"), F.col("b").alias("other"))
        .union(links.select("b", "a"))
        .where(F.col("key") != F.col("other"))
        .distinct(),
        "links",
    )
    labels = materialise(both.groupBy("key").agg(F.min("other").alias("m")).select("key", F.least("key", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.min("label").alias("m"))
        nearer = labels.join(near, "key").select("key", "label", F.least("label", "m").alias("m"))
        ahead = labels.select(F.col("key").alias("m"), F.col("label").alias("jump"))
        moved = nearer.join(ahead, "m").select("key", "label", F.least("m", "jump").alias("next"))
        moved = materialise(moved, "labels")
        changed = moved.where(F.col("label") != F.col("next")).limit(1).count()
        labels = moved.select("key", F.col("next").alias("label"))
        if not changed:
            return labels
