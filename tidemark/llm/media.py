"""Media columns: payloads stored as PNG files in a binary column.

A payload becomes the samples of an 8-bit grey image, 64 samples a row. The
writer makes the chunks itself with zlib and picks one row filter per image by
the entropy of the filtered bytes; the reader tests signature and checksums and
undoes any of the five PNG filters with numpy. A 64-bit perceptual feature comes
from the low frequencies of a cosine transform of the image read back.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes;
equal texts give equal values; repeated rows are stored one by one; columns
beside id and text are not read. A file whose chunks do not match their
checksums raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WIDTH = 64
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the image that the cosine transform sees, and of its kept corner.
SIDE, CORNER = 32, 8


def pad_payload(data: bytes) -> bytes:
    """`data` with zero bytes up to a positive multiple of the row width."""
    return data + b"\0" * ((-len(data)) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _entropy(samples: np.ndarray) -> float:
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    return float(-(share * np.log2(share)).sum())


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are `payload`, a multiple of `width` long."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above = rows.copy()
    above[1:] -= rows[:-1]
    kind, best = min(enumerate((rows, left, above)), key=lambda x: (round(_entropy(x[1]), 9), x[0]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = best
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(kinds)]):
        if lo == hi:
            continue
        kind, part = kinds[lo], out[lo:hi]
        if kind == 1:
            out[lo:hi] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            if lo:
                part[0] += out[lo - 1]
            out[lo:hi] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind >= 3:
            for r in range(lo, hi):
                _unfilter_row(out, r, kind)
    return out


def _unfilter_row(out: np.ndarray, r: int, kind: int) -> None:
    """Filters 3 (mean) and 4 (Paeth), in which each sample needs the one before."""
    row = out[r].tolist()
    up = out[r - 1].tolist() if r else [0] * len(row)
    a = c = 0
    for i, b in enumerate(up):
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        a, c = (row[i] + guess) & 255, b
        row[i] = a
    out[r] = row


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG as rows x width; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off inside a chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r} differs")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a plain grey 8-bit PNG")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("sample count differs from the header")
    return _unfilter(lines.reshape(height, width + 1))


def _basis() -> np.ndarray:
    k, n = np.arange(CORNER)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (n + 0.5) * k / SIDE)


_BASIS = _basis()


def _shrink(image: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid of near equal cells; few rows are repeated."""
    height, width = image.shape
    rows = image.astype(np.float64).reshape(height, SIDE, width // SIDE).mean(axis=2)
    if height < SIDE:
        return rows[np.arange(SIDE) * height // SIDE]
    edges = np.arange(SIDE + 1) * height // SIDE
    return np.add.reduceat(rows, edges[:-1], axis=0) / np.diff(edges)[:, None]


def feature_bits(image: np.ndarray) -> str:
    """16 hex digits: which low cosine frequencies exceed their median."""
    low = (_BASIS @ _shrink(image) @ _BASIS.T).ravel()
    bits = np.round(low, 6) > np.round(np.median(low[1:]), 6)
    return np.packbits(bits).tobytes().hex()


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `n_bytes` and the stored file as the binary column `media`."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
            files = [encode_png(pad_payload(r)) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())],
                [id_col, "n_bytes", "media"],
            )

    return source.mapInArrow(write, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored files back: payload digest, checksum of its end, and the feature."""
    kind = stored.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                image = decode_png(data)
                payload = image.tobytes()
                row = (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-64:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    feature_bits(image),
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds))], [id_col, *names]
            )

    return stored.select(id_col, "n_bytes", "media").mapInArrow(read, f"`{id_col}` {kind}, {SCHEMA}")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text stored as a PNG, read back and described."""
    return media_features(store_media(docs, id_col, text_col), id_col)
