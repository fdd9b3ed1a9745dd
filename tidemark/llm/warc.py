"""Web archives with a two-level capture index.

Pages are ordered by the reversed-host key of their URL. Each task writes one
archive of gzip members, a record each, and beside it an index shard: the
record lines in key order, in compressed blocks. The block directory, the
second level, has one row for each block: its first and last key, its shard and
where its bytes are. A lookup searches the directory by halves, reads one block
by its range, searches it by halves, and reads from the archive only the ranges
of the records found. The table is read back by looking its keys up: they are
dealt to the archives whose keys enclose them, and each archive's directory is
sent ahead of the keys asked of it. As requests, blocks and records follow the
same order, neighbouring records are read in one range.

Of captures with equal payload the one of the least page id is stored as
response, the others as revisit records that name it.

Defined cases: a null page is the empty page. Rows that repeat a page id with
the same payload: one is the response, the others revisit it. A null id comes
after all others; a null URL has the empty key. Whole-number ids are kept as
such, ids of any other type as their text, and both get their type back.
Columns beside id, url and html are not read. Archives are written under a
temporary name and then renamed, so a task that is run again leaves no half file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import behind_leaders, materialise, spread_join, text_of, work_folder

#: Records of one compressed index block.
BLOCK = 128
#: The date that all records carry, as the pages have none (fixed value).
DATE = "2024-01-01T00:00:00Z"
#: Copies of one payload that share a join key.
COPIES = 1000
#: Payload of an archive, about, and what a record takes beside its payload.
ARCHIVE_BYTES, RECORD_BYTES = 256 << 20, 512
#: Records that lie side by side are read in ranges of about this size.
RANGE_BYTES = 8 << 20
#: Keys asked of one archive that go to one task.
REQUESTS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def surt(url: str | None) -> str:
    """The key of a URL: reversed host labels, then path and query, without scheme and fragment."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, query, tail = host.partition("?")
    host = host.rpartition("@")[2].translate(_LOWER)
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "")
    return key + ")" + (slash + path if slash else "/" + query + tail)


def surt_column(url: str) -> Column:
    """`surt` of a URL column, in the JVM."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.\\-]*://|(?s)#.*$", "")
    before = F.substring_index(rest, "/", 1)
    bare = F.substring_index(before, "?", 1)
    after = lambda text, start: text.substr(F.length(start) + 1, F.length(text))
    host = F.translate(F.substring_index(bare, "@", -1), _UPPER, _UPPER.lower())
    name = F.substring_index(host, ":", 1)
    port = after(host, name)
    shown = F.when(port.isin("", ":", ":80", ":443"), F.lit("")).otherwise(port)
    path = F.when(F.length(rest) > F.length(before), after(rest, before)).otherwise(F.concat(F.lit("/"), after(before, bare)))
    key = F.concat(F.array_join(F.reverse(F.split(name, "\\.", -1)), ","), shown, F.lit(")"), path)
    return F.when(F.coalesce(F.col(url), F.lit("")) == "", F.lit("")).otherwise(key)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member; with `refers_to` a revisit, whose body is not stored."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {_safe(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"WARC-Payload-Length: {len(payload)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    plain = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record in a run of gzip members; ValueError if damaged."""
    while data:
        unpacker = zlib.decompressobj(31)
        plain = unpacker.decompress(data)
        if not unpacker.eof:
            raise ValueError("the archive ends inside a record")
        data = unpacker.unused_data
        head, _, rest = plain.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record length differs from its header")
        payload = rest[:size].partition(b"\r\n\r\n")[2]
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
            raise ValueError("payload digest differs")
        yield headers, payload


# ---------------------------------------------------------------- files


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's URI names, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^(file:)?/+", "file:///", uri))


def _get(store: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
    with store.open_input_file(path) as source:
        return source.read_at(size, offset)


@dataclass
class Block:
    """A row of the directory."""

    first_key: str
    last_key: str
    shard: str
    offset: int
    size: int


class CaptureIndex:
    """Searches a directory, whose blocks follow the order of their keys, and the blocks it names."""

    def __init__(self, store: fs.FileSystem, root: str, directory: list[Block]):
        self.store, self.root, self.directory = store, root, directory
        self.last_keys = [b.last_key for b in directory]
        self.held: tuple[Block | None, list[dict], list[str]] = (None, [], [])

    def _block(self, block: Block) -> tuple[list[dict], list[str]]:
        if self.held[0] is not block:
            lines = read_block(self.store, self.root, block.shard, block.offset, block.size)
            self.held = (block, lines, [line["key"] for line in lines])
        return self.held[1], self.held[2]

    def search(self, key: str) -> list[dict]:
        """The index lines of a key, from as many blocks as it fills."""
        found = []
        at = bisect.bisect_left(self.last_keys, key)
        while at < len(self.directory) and self.directory[at].first_key <= key:
            lines, keys = self._block(self.directory[at])
            found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            at += 1
        return found

    def records(self, lines: list[dict]) -> Iterator[tuple[dict, dict[str, str], bytes]]:
        """Line, headers and payload of each record; neighbours are read together."""
        at = 0
        while at < len(lines):
            end = at + 1
            while (
                end < len(lines) and lines[end]["archive"] == lines[at]["archive"]
                and lines[end]["offset"] == lines[end - 1]["offset"] + lines[end - 1]["size"]
                and lines[end]["offset"] - lines[at]["offset"] < RANGE_BYTES
            ):
                end += 1
            begin = lines[at]["offset"]
            data = _get(self.store, f"{self.root}/{lines[at]['archive']}", begin, lines[end - 1]["offset"] + lines[end - 1]["size"] - begin)
            for line, (headers, payload) in zip(lines[at:end], parse_records(data), strict=True):
                if headers["WARC-Payload-Digest"] != f"sha1:{line['digest']}":
                    raise ValueError("index and archive differ")
                yield line, headers, payload
            at = end


def lookup(folder: str, directory: list[Block], url: str) -> list[tuple[dict[str, str], bytes]]:
    """All captures of a URL: directory by halves, block by range, records by range."""
    index = CaptureIndex(*open_store(folder), directory)
    return [(headers, payload) for _, headers, payload in index.records(index.search(surt(url)))]


def read_block(store: fs.FileSystem, root: str, shard: str, offset: int, size: int) -> list[dict]:
    plain = zlib.decompress(_get(store, f"{root}/{shard}", offset, size), 31)
    return [json.loads(line) for line in plain.decode("utf-8").splitlines()]


# ---------------------------------------------------------------- stages


def _captures(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """`id`, `url`, `html` and the key of each page; ids as whole numbers or as text."""
    whole = pages.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return pages.select(
        F.col(id_col).cast("long" if whole else "string").alias("id"), F.col(url_col).alias("url"),
        text_of(html_col).alias("html"), surt_column(url_col).alias("key"),
    )


def _typed(captures: DataFrame) -> DataFrame:
    """Each page with the page that holds its payload, where several do; `first` tells whether the page may be that one.

    Payload digests that many pages share are spread over several join keys.
    """
    base = captures.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    firsts = base.groupBy("sha").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialise(firsts, "payloads")
    joined = spread_join(base, firsts, "sha", COPIES)
    own = F.col("id").eqNullSafe(F.col("least.id")) & F.col("url").eqNullSafe(F.col("least.url"))
    return joined.select("id", "url", "key", "html", "sha", F.col("least.id").alias("first_id"), (F.col("least").isNull() | own).alias("first"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and index shards into `folder`; returns the block directory."""
    captures = _captures(pages, id_col, url_col, html_col)
    typed = _typed(captures)
    total = captures.agg(F.sum(F.octet_length("html") + RECORD_BYTES)).first()[0] or 0
    n = max(1, pages.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    # Equal rows are in one archive, side by side.
    ordered = typed.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id", "url", "sha")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        part = TaskContext.get().partitionId()
        archive, shard = f"archive-{part:06d}.warc.gz", f"index-{part:06d}.cdx.gz"
        at = block_at = 0
        lines: list[str] = []
        blocks: list[tuple] = []
        first_key = ""
        before = None
        attempt = TaskContext.get().taskAttemptId()
        drafts = [f"{root}/{name}.{attempt}.draft" for name in (archive, shard)]
        with store.open_output_stream(drafts[0]) as out, store.open_output_stream(drafts[1]) as index:

            def close_block():
                nonlocal block_at, lines
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress("\n".join(lines).encode("utf-8")) + packer.flush()
                index.write(data)
                blocks.append((first_key, json.loads(lines[-1])["key"], shard, block_at, len(data), len(lines)))
                block_at += len(data)
                lines = []

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("id", "url", "html", "sha", "first_id", "first", "key")]
                for page_id, url, html, sha, first_id, first, key in zip(*columns):
                    # Of equal rows only the first is the response.
                    copy = not first or before == (page_id, url, sha)
                    before = (page_id, url, sha)
                    digest = base64.b32encode(sha).decode("ascii")
                    target = ("null" if first_id is None else first_id) if copy else None
                    data = record(page_id, url, html.encode("utf-8"), digest, target)
                    out.write(data)
                    if not lines:
                        first_key = key
                    line = {"key": key, "id": page_id, "archive": archive, "offset": at, "size": len(data), "digest": digest}
                    lines.append(json.dumps(line | ({"of": first_id} if copy else {})))
                    at += len(data)
                    if len(lines) == BLOCK:
                        close_block()
            if lines:
                close_block()
        for draft, name in zip(drafts, (archive, shard)):
            if blocks:
                store.move(draft, f"{root}/{name}")
            else:
                store.delete_file(draft)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        rows = list(zip(*blocks)) if blocks else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(r, k) for r, k in zip(rows, kinds)], ["first_key", "last_key", "shard", "offset", "size", "records"]
        )

    directory = ordered.mapInArrow(write, "first_key string, last_key string, shard string, offset long, size long, records long")
    return materialise(directory, "directory")


def look_up_keys(keys: DataFrame, directory: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the given keys (`key`, each once), found through the index, with its payload's size and digest."""
    spark = keys.sparkSession
    entry = F.struct("first_key", "offset", "last_key", "size")
    shards = directory.groupBy("shard").agg(
        F.min("first_key").alias("lo"), F.max("last_key").alias("hi"), F.sum("records").alias("n"), F.sort_array(F.collect_list(entry)).alias("blocks")
    )
    shards = materialise(shards, "shards")
    # A row for each archive, that is for each ARCHIVE_BYTES of payload or for each core.
    ends = spark.sparkContext.broadcast(sorted((r["lo"], r["hi"], r["shard"]) for r in shards.select("lo", "hi", "shard").collect()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [hi for _, hi, _ in ends.value]
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_left(tops, key)
                while at < len(tops) and ends.value[at][0] <= key:
                    found.append((ends.value[at][2], key))
                    at += 1
            names, wanted = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(wanted, pa.string())], ["shard", "key"])

    asked = keys.select("key").mapInArrow(deal, "shard string, key string")
    leaders = shards.select("shard", "blocks")
    stream = behind_leaders(asked, leaders, shards.select("shard", "n"), "shard", REQUESTS, F.col("key"), ("key",))
    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    kind = pa.int64() if whole else pa.string()
    kinds = (kind, pa.int64(), pa.string(), pa.string(), kind)
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        index = CaptureIndex(store, root, [])
        pending: list[dict] = []

        def flush() -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for line, headers, payload in index.records(pending):
                revisit = headers["WARC-Type"] == "revisit"
                size = int(headers["WARC-Payload-Length"]) if revisit else len(payload)
                row = (line["id"], size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], line.get("of"))
                for column, value in zip(out, row):
                    column.append(value)
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        for batch in batches:
            for shard, blocks, key in zip(*(batch.column(c).to_pylist() for c in ("shard", "blocks", "key"))):
                if key is None:
                    index = CaptureIndex(store, root, [Block(b["first_key"], b["last_key"], shard, b["offset"], b["size"]) for b in blocks])
                    continue
                pending += index.search(key)
                if len(pending) >= 1024:
                    yield flush()
        if pending:
            yield flush()

    sent = "bigint" if whole else "string"
    found = stream.select("shard", "blocks", "key").mapInArrow(
        read, f"id {sent}, payload_bytes long, payload_digest string, record_type string, refers_to {sent}"
    )
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, from archives below the shared folder that are written and then asked for every key."""
    folder = work_folder(pages.sparkSession, "archives")
    directory = write_archives(pages, folder, id_col, url_col, html_col)
    keys = pages.select(surt_column(url_col).alias("key")).distinct()
    return look_up_keys(keys, directory, folder, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
