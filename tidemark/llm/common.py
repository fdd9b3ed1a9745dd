"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2/Python class of the characters that separate words.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table through Spark, whatever store `sf_dir` is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by `spark.checkpoint.dir`. Only where that is unset and
    driver and executors are one process, as in local tests, a temporary folder
    is made and set as checkpoint folder; on a cluster RuntimeError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes `df` as Parquet below the shared folder and reads it again.

    This cuts the lineage at files that outlive any executor. Rows keep the
    file they were written to, so a later scan sees the same groups of rows.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties each memo that a Python worker keeps from task to task, by the name of the memo.
MEMOS: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Empties all memos of this process except one."""
    for name, empty in MEMOS.items():
        if name != but:
            empty()


def give_back() -> None:
    """Returns memory that this process has freed, but holds for later, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable:
    """`kernel` for mapInArrow, after which its worker holds no memo but `keep` and no freed memory.

    Workers live on from task to task and from operator to operator, beside the
    JVM that then sorts and joins, so what one of them left would count against all that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        try:
            yield from kernel(batches)
        finally:
            forget(keep)
            give_back()

    return run


def row_key(*cols: str) -> Column:
    """A 64-bit key of columns of any type; nulls count as values."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])


def text_of(col: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def slices(n_rows: int, per_slice: int, least: int = 1) -> int:
    """How many slices of about `per_slice` rows `n_rows` make."""
    return max(least, math.ceil(n_rows / per_slice))


def crc_remainder(col: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


#: A key with less than one in so many of all rows needs no split: tasks hold more than that anyway.
HOT_SHARE = 10_000


def hot_keys(sizes: DataFrame, key: str, per_part: int) -> DataFrame:
    """`key` and `__parts`, two or more, of the keys that have many of the rows, from `key` and `n`.

    Each has more than one in `HOT_SHARE` of all rows, so there are fewer than
    `HOT_SHARE` of them and the result may be broadcast, whatever the size of the data.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(per_part, total // HOT_SHARE)
    return sizes.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("__parts"))


def _parted(rows: DataFrame, hot: DataFrame, key: str, salt: Column) -> DataFrame:
    """`rows` with `__part`, by `salt` for hot keys, else 0."""
    part = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.col("__parts")).cast("int"))
    return rows.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")


def _in_each_part(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """`rows`, unique by `key`, once for each `__part` of their key."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), key, "left").withColumn("__part", every).drop("__parts")


def spread_join(left: DataFrame, right: DataFrame, key: str, per_part: int) -> DataFrame:
    """Left join of `left`, a scan of files, with the rows of `right`, unique by `key`, without hot keys.

    `right` has the column `n`, how many rows of `left` have the key.
    """
    hot = hot_keys(right, key, per_part)
    salted = _parted(left, hot, key, F.monotonically_increasing_id())
    return salted.join(_in_each_part(right.drop("n"), hot, key), [key, "__part"], "left").drop("__part")


def behind_leaders(rows: DataFrame, leaders: DataFrame, sizes: DataFrame, key: str, per_part: int, salt: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """`rows` and `leaders` in one stream: in each task, a key's leader (`__side` 0) comes right before its rows (1).

    Leaders are unique by key, rows follow in the given order. A leader is sent once to each part of its key,
    not once for each row, and no task has to hold a group. `sizes` has `key`
    and `n`, the rows by key; columns that one side lacks are null there.
    """
    hot = hot_keys(sizes, key, per_part)
    first = _in_each_part(leaders, hot, key).withColumn("__side", F.lit(0))
    after = _parted(rows, hot, key, salt).withColumn("__side", F.lit(1))
    both = first.unionByName(after, allowMissingColumns=True)
    return both.repartition(key, "__part").sortWithinPartitions(key, "__part", "__side", *order)


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it as long as a column of that name is taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
