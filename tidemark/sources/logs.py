"""Append-only logs as DataFrames: manifests, run registries, purchase journals."""

from __future__ import annotations

import fcntl
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "schema_version int, dataset string, schema string, symbols array<string>, start_ts long, end_ts long, file_path string, file_digest string, size_bytes long, supplements string, added_symbols array<string>"


def append_line(path: str, row: dict) -> None:
    """Adds one JSON line under an exclusive lock and waits until it is on disk."""
    with open(path, "ab") as out:
        fcntl.flock(out, fcntl.LOCK_EX)
        out.write(json.dumps(row, sort_keys=True).encode("utf-8") + b"\n")
        out.flush()
        os.fsync(out.fileno())


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with `corrupt`, the text of a line that is not of the schema."""
    return spark.read.schema(f"{schema}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


def manifest_kinds(lines: DataFrame) -> DataFrame:
    """`kind` of each line: a record, or a supplement to one."""
    return lines.withColumn("kind", F.when(F.col("supplements").isNotNull(), "supplement").otherwise("record"))


def credited_symbols(lines: DataFrame) -> DataFrame:
    """(file_digest, symbol): a record's own symbols and those added later."""
    own = lines.where("supplements IS NULL").select("file_digest", F.explode("symbols").alias("symbol"))
    added = lines.where("supplements IS NOT NULL").select(F.col("supplements").alias("file_digest"), F.explode("added_symbols").alias("symbol"))
    return own.unionByName(added).distinct()


def missing_symbols(declared: DataFrame, credited: DataFrame) -> DataFrame:
    return declared.distinct().join(credited.distinct(), ["record", "symbol"], "left_anti")


def verify(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file is missing or differs in size or digest."""
    j = records.join(files.select("id", F.col("size").alias("got_size"), F.col("digest").alias("got_digest")), "id", "left")
    finding = (
        F.when(F.col("got_size").isNull(), "missing").when(F.col("got_size") != F.col("size"), "size").when(F.col("got_digest") != F.col("digest"), "checksum")
    )
    return j.withColumn("finding", finding).where("finding IS NOT NULL").select("id", "finding")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """id (path), size and digest of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("id"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def run_states(lines: DataFrame) -> DataFrame:
    """void, done or running of each run, from its lines in any order."""
    has = lambda k: F.max((F.col("kind") == k).cast("int")) == 1
    return lines.groupBy("run_id").agg(F.when(has("void"), "void").when(has("run_finished"), "done").otherwise("running").alias("state"))


def trials(runs: DataFrame, voids: DataFrame, family: str, identity: list[str]) -> DataFrame:
    """Distinct trials of each family with at least one run that is not void."""
    return runs.join(voids, "run_id", "left_anti").groupBy(family).agg(F.countDistinct(F.struct(*identity)).alias("trials"))


def intent_states(events: DataFrame, at: str) -> DataFrame:
    """What a purchase journal leaves of each intent, its events folded in the order `at`.

    `events` has intent and event: intended, submitted, downloaded, appended or
    abandoned. Giving up takes back the submission and the download before it;
    submitting again takes back the giving up.
    """
    last = lambda e: F.max(F.when(F.col("event") == e, F.col(at)))
    names = ("intended", "submitted", "downloaded", "appended", "abandoned")
    got = events.groupBy("intent").agg(*[last(e).alias(e) for e in names])
    since = lambda e: F.col(e).isNotNull() & (F.col("abandoned").isNull() | (F.col(e) > F.col("abandoned")))
    gone = F.col("abandoned").isNotNull() & (F.col("submitted").isNull() | (F.col("abandoned") > F.col("submitted")))
    states = {"intended": F.col("intended").isNotNull(), "submitted": since("submitted"), "staged": since("downloaded"), "appended": F.col("appended").isNotNull(), "abandoned": gone}
    return got.select("intent", *[c.alias(n) for n, c in states.items()], (states["submitted"] & ~states["appended"] & ~gone).alias("in_flight"))


def latest_state(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, at).alias(state))


def reconcile(intents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Intents that a remote job already serves are adopted, never bought again."""
    served = jobs.select("intent").distinct().withColumn("served", F.lit(True))
    return intents.join(served, "intent", "left").select("intent", F.when(F.col("served"), "adopt").otherwise("buy").alias("action"))


def price_gate(quotes: DataFrame, key: str, cap: int) -> DataFrame:
    total = quotes.groupBy(key).agg(F.sum("cost").alias("total"))
    return total.withColumn("allowed", F.col("total") <= cap)


def shared_shingles(texts: DataFrame, n: int) -> DataFrame:
    """Pairs of texts and how many distinct runs of n words they share."""
    words = texts.select("id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w")).where(F.size("w") >= n)
    grams = words.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("g")).distinct()
    a, b = grams.select(F.col("id").alias("a"), "g"), grams.select(F.col("id").alias("b"), "g")
    return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def layout_findings(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files of an archive (column `path`) that do not lie where their kind belongs."""
    parts = F.split("path", "/")
    finding = (
        F.when(~F.get(parts, F.lit(0)).isin(roots), "unknown_root")
        .when(F.size(parts) < 4, "too_shallow")
        .when(F.size(parts) > 4, "too_deep")
        .when(~F.col("path").rlike(r"\.(parquet|jsonl|zst)$"), "unknown_kind")
    )
    return files.select("path", finding.alias("finding")).where("finding IS NOT NULL")


CONDITION = "date string, condition string"


def vendor_conditions(spark: SparkSession, path: str) -> DataFrame:
    """(job, date, condition) of all delivery days that the vendor calls other than available, from `<path>/<job>/condition.json`.

    Other fields are ignored; a file that is no such list gives one row with a null date and the condition unreadable.
    """
    files = spark.read.text(f"{path}/*/condition.json", wholetext=True)
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/condition\.json$", 1)
    rows = files.select(job.alias("job"), F.from_json("value", f"array<struct<{CONDITION.replace(' string', ': string')}>>").alias("c"))
    good = F.col("c").isNotNull() & F.forall("c", lambda x: x["condition"].isNotNull())
    days = rows.where(good).select("job", F.inline("c")).where("condition <> 'available'")
    return days.unionByName(rows.where(~F.coalesce(good, F.lit(False))).select("job", F.lit(None).cast("string").alias("date"), F.lit("unreadable").alias("condition")))


def merge_papers(papers: DataFrame, order: str) -> DataFrame:
    """One row per paper: by DOI, or without one by title, white space and case aside, and year.

    Each field is the first that is given in `order`; `seen_in` and `topics` are all
    sources and topics, sorted. Groups are merged by partial aggregates.
    """
    title = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    by_title = F.concat(F.lit("title:"), title, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    key = F.when(F.length("doi") > 0, F.concat(F.lit("doi:"), F.col("doi"))).otherwise(by_title)
    given = lambda c: F.min(F.when(F.length(F.col(c).cast("string")) > 0, F.struct(order, c)))[c].alias(c)
    first = [F.min(F.struct(order, "title"))["title"].alias("title"), *[given(c) for c in ("doi", "year", "abstract", "venue")]]
    sets = [F.sort_array(F.collect_set(F.when(F.length(c) > 0, F.col(c)))).alias(n) for c, n in (("source", "seen_in"), ("topic", "topics"))]
    return papers.withColumn("key", key).groupBy("key").agg(*first, *sets)
