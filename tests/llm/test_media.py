import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import media


@pytest.mark.parametrize("text", ["", "a", "é" * 63, "x" * 64, "line\n" * 5000, "漢" * 1000])
def test_round_trip(text):
    payload = media.pad_payload(text.encode())
    assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0") and payload
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_every_row_filter_is_undone():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 64)).astype(np.int64)
    kinds = rng.integers(0, 5, 40)
    lines = np.zeros((40, 65), np.uint8)
    for r in range(40):
        for i in range(64):
            a = image[r, i - 1] if i else 0
            b = image[r - 1, i] if r else 0
            c = image[r - 1, i - 1] if r and i else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[r, i + 1] = (image[r, i] - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) & 255
        lines[r, 0] = kinds[r]
    assert (media._unfilter(lines) == image).all()


def test_smooth_images_are_filtered():
    ramp = (np.arange(64)[:, None] * 3 + np.arange(64)[None, :]).astype(np.uint8)
    assert media.decode_png(media.encode_png(ramp.tobytes())).tobytes() == ramp.tobytes()


def test_damage_is_found():
    data = bytearray(media.encode_png(bytes(range(64))))
    data[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(bytes(64))[:-6])
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def test_near_images_have_near_features():
    y, x = np.mgrid[0:96, 0:64]
    image = (100 + 60 * np.sin(y / 17) + 50 * np.cos(x / 11)).astype(np.uint8)
    noisy = image.copy()
    noisy[::7, ::5] += 9
    a, b, c = (int(media.feature_bits(i), 16) for i in (image, noisy, image[::-1]))
    assert bin(a ^ b).count("1") <= 6 < bin(a ^ c).count("1")


def plain_file(payload):
    """The stored form written out: header, the best of three row filters, one data chunk, end."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    left = [bytes((r[i] - (r[i - 1] if i else 0)) & 255 for i in range(64)) for r in rows]
    above = [bytes((b - a) & 255 for a, b in zip(p, r)) for p, r in zip([bytes(64), *rows], rows)]

    def entropy(lines):
        counts, n = Counter(b"".join(lines)), 64 * len(lines)
        return round(-sum(c / n * math.log2(c / n) for c in counts.values()), 9)

    kinds = (rows, left, above)
    best = min(range(3), key=lambda k: (entropy(kinds[k]), k))
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0))]
    chunks += [(b"IDAT", zlib.compress(b"".join(bytes([best]) + line for line in kinds[best]), 1)), (b"IEND", b"")]
    body = b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)
    return b"\x89PNG\r\n\x1a\n" + body


def plain_feature(payload):
    """32 x 32 means, the cosine transform by its formula, and which of 64 low frequencies exceed their median."""
    height = len(payload) // 64
    rows = [[(payload[64 * r + 2 * c] + payload[64 * r + 2 * c + 1]) / 2 for c in range(32)] for r in range(height)]
    if height < 32:
        grid = [rows[y * height // 32] for y in range(32)]
    else:
        edges = [y * height // 32 for y in range(33)]
        grid = [[sum(rows[r][c] for r in range(lo, hi)) / (hi - lo) for c in range(32)] for lo, hi in zip(edges, edges[1:])]
    wave = [[math.cos(math.pi * (n + 0.5) * k / 32) for n in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * grid[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = round(sorted(low[1:])[31], 6)
    return f"{int(''.join('01'[round(x, 6) > middle] for x in low), 2):016x}"


@pytest.mark.parametrize("text", ["", "a", "hello " * 9, "Some longer text, é and ü.\n" * 90, "0123456789" * 700, "漢" * 500])
def test_stored_form_and_feature_by_their_definition(text):
    payload = media.pad_payload(text.encode())
    stored = media.encode_png(payload)
    assert stored == plain_file(payload)
    assert media.feature_bits(media.decode_png(stored)) == plain_feature(payload)


def test_query_rows(spark):
    rows = [(1, "hello", "x"), (2, None, "y"), (3, "hello", "z"), (3, "hello", "z"), (4, "w" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = media.media_columns(docs).collect()
    assert len(got) == 5
    for r in got:
        raw = {1: b"hello", 2: b"", 3: b"hello", 4: b"w" * 200_000}[r.doc_id]
        payload = media.pad_payload(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = plain_file(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload))
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in got if r.doc_id in (1, 3)}
    assert len(same) == 1
    assert media.media_columns(docs.limit(0)).count() == 0
