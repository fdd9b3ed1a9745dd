"""Packing documents into sequences by cutting-stock column generation.

Each document is cut into full sequences and a rest. The rests, sorted into
length classes, are the demand of a cutting-stock problem whose linear program
is solved over patterns; a knapsack dynamic program prices new patterns. Counts
of patterns are rounded down, what they leave is placed greedily, and documents
are assigned to patterns by their rank in the class. One rest in
`FILLER_SHARE`, chosen by its id, is held back as filler: laid end to end,
these documents are cut to fill what the sequences still lack, and what is left
of them makes full sequences. So only the last sequence is padded.

Nothing is ranked in one task: each input partition numbers its own rows, and
running totals over partitions turn these numbers into ranks.

Defined cases: a null text is the empty text, whose document is the end token
alone. Repeated rows and repeated or null ids are packed one by one. Columns
beside id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMOS, lean, materialise, text_of

CAPACITY = 2048
END_ID = 1
#: Width of a length class in tokens.
CLASS_WIDTH = 16
FILLER_SHARE = 16
#: Words that the tokenizer's memo holds at most, and the longest one that it keeps.
MEMO_WORDS, LONGEST_KEPT = 800_000, 32
#: Stretch of the filler stream that is matched with gaps by one join key.
BUCKET = 8192
#: Running totals over sequences are taken in at most about so many blocks.
MAX_BLOCKS = 8192


#: Words of these characters are encoded by the merges alone: the normalizer
#: only lowers their case, and how they are split is known.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's pieces of such a word in lower case.
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


_NAMES = _byte_names()


class _Words(dict):
    """Packed ids by word. Two generations: what is used stays, the rest goes; long words are never kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = self.encode(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MEMO_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class WordTokenizer:
    """Ids of a tokenizer whose pieces never hold white space, word by word; words seen before are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if self.small else "<u4")
        self.words = _Words(self._encode_word)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encode_word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._encode(word)
        low = word.lower()
        pieces = (low,) if low.isalpha() else _PIECES.findall(low)
        if len(pieces) > 1:
            return b"".join(map(self.words.__getitem__, pieces))
        piece = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(_NAMES)
        return np.array([t.id for t in self.merges.tokenize(piece)], self.kind).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as packed little-endian numbers of `kind`."""
        get = self.words.__getitem__
        out = []
        for text in texts:
            # The characters \x1c-\x1f are white space to str.split only.
            if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                out.append(self._encode(text))
            else:
                out.append(b"".join(map(get, (text.lower() if text.isascii() else text).split())))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _forget_words() -> None:
    for own in _TOKENIZERS.values():
        own.words.clear()
        own.words.old = {}


MEMOS["packed words"] = _forget_words


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# ---------------------------------------------------------------- patterns


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total value that fits into `room` (unbounded knapsack)."""
    total = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for r in range(1, room + 1):
        total[r] = total[r - 1]
        able = np.flatnonzero(sizes <= r)
        if len(able):
            gains = values[able] + total[r - sizes[able]]
            top = int(gains.argmax())
            if gains[top] > total[r] + 1e-12:
                total[r], pick[r] = gains[top], able[top]
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            pattern[pick[r]] += 1
            r -= sizes[pick[r]]
    return float(total[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used to cover `demand` exactly.

    The linear program is solved by the revised simplex method with a column
    priced in each round, until no column is worth more than a sequence; its
    counts are rounded down and the rest of the demand is placed by first fit,
    longest class first. A round that does not shorten the plan any more is
    degenerate; after twice as many of them in a row as there are classes the plan at
    hand is taken, so that rounding noise cannot make it go round in circles.
    """
    basis = np.diag(room // sizes).astype(float)
    count = demand / np.diag(basis)
    least, idle = np.inf, 0
    while idle <= 2 * len(sizes):
        idle = idle + 1 if count.sum() >= least - 1e-9 else 0
        least = min(least, count.sum())
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_pattern(prices, sizes, room)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.full(len(sizes), np.inf)
        np.divide(count, way, out=ratio, where=way > 1e-9)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        count = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0.0)
    patterns = np.rint(basis.T).astype(np.int64)
    times = np.floor(count + 1e-9).astype(np.int64)
    left = demand - times @ patterns
    while (left < 0).any():  # rounding noise: take back one use of a pattern with too much
        worst = int(np.flatnonzero(left < 0)[0])
        take = int(np.flatnonzero((patterns[:, worst] > 0) & (times > 0))[0])
        times[take] -= 1
        left = demand - times @ patterns
    rest: list[np.ndarray] = []
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        free, pattern = room, np.zeros(len(sizes), np.int64)
        for c in order:
            n = min(left[c], free // sizes[c])
            pattern[c] += n
            free -= n * sizes[c]
        n = int(min(left[c] // pattern[c] for c in np.flatnonzero(pattern)))
        rest.append(np.concatenate([[n], pattern]))
        left = left - n * pattern
    if rest:
        more = np.array(rest)
        patterns, times = np.vstack([patterns, more[:, 1:]]), np.concatenate([times, more[:, 0]])
    used = times > 0
    return patterns[used], times[used]


# ---------------------------------------------------------------- stages

_CUT_SCHEMA = "start long, length long, crc long, doc_tokens long, part int, kind int, cls int, local long, before long, ids binary"
FULL, FIT, FILLER = 0, 1, 2


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut_documents(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Tokenizes once; a row per full sequence and per rest, numbered within its partition."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind_of_id = source.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in _CUT_SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        n_full, n_filler, stream = 0, 0, 0
        in_class = [0] * (CAPACITY // CLASS_WIDTH + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                doc_ids = batch.column(0).to_pylist()
                rows: list[tuple] = []
                for doc_id, packed in zip(doc_ids, own.encode_batch(batch.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(packed, own.kind), own.kind.type(END_ID))
                    n = len(ids)
                    cut_at = n - n % CAPACITY
                    for start in range(0, cut_at, CAPACITY):
                        rows.append((doc_id, start, CAPACITY, _crc(ids[start : start + CAPACITY]), n, part, FULL, 0, n_full, 0, None))
                        n_full += 1
                    rest = ids[cut_at:]
                    if not len(rest):
                        continue
                    if zlib.crc32(str(doc_id).encode()) % FILLER_SHARE == 0:
                        rows.append((doc_id, cut_at, len(rest), 0, n, part, FILLER, 0, n_filler, stream, rest.astype("<u4").tobytes()))
                        n_filler += 1
                        stream += len(rest)
                    else:
                        cls = -(-len(rest) // CLASS_WIDTH)
                        rows.append((doc_id, cut_at, len(rest), _crc(rest), n, part, FIT, cls, in_class[cls], 0, None))
                        in_class[cls] += 1
                columns = list(zip(*rows)) if rows else [()] * 11
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
                    ["doc_id", *names],
                )

    return source.mapInArrow(lean(cut, keep="packed words"), f"doc_id {kind_of_id}, {_CUT_SCHEMA}")


def _part_offsets(cut: DataFrame, kind: int, amount, by: list[str]) -> DataFrame:
    """For each partition (and class) the total of the partitions before it."""
    sums = cut.where(F.col("kind") == kind).groupBy("part", *by).agg(amount.alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", *by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))


def _assign(cut: DataFrame) -> tuple[DataFrame, int]:
    """Rests with their sequence, and how many sequences there are."""
    spark = cut.sparkSession
    fit = cut.where(F.col("kind") == FIT)
    # At most CAPACITY / CLASS_WIDTH rows.
    found = sorted((r.cls, r["n"]) for r in fit.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect())
    slots, n_sequences = [], 0
    if found:
        sizes = np.array([c for c, _ in found])
        demand = np.array([n for _, n in found], np.int64)
        patterns, times = solve_patterns(sizes, demand, CAPACITY // CLASS_WIDTH)
        given = np.zeros(len(sizes), np.int64)
        for pattern, n in zip(patterns, times.tolist()):
            for c in np.flatnonzero(pattern):
                a = int(pattern[c])
                slots.append((int(sizes[c]), int(given[c]), int(given[c]) + a * n, n_sequences, a))
                given[c] += a * n
            n_sequences += n
    # Bounded by the number of classes times the slots of a pattern.
    table = spark.createDataFrame(slots, "cls int, lo long, hi long, base long, each long")
    ranked = fit.join(_part_offsets(cut, FIT, F.count(F.lit(1)), ["cls"]), ["part", "cls"]).withColumn(
        "rank", F.col("off") + F.col("local")
    )
    placed = ranked.join(
        F.broadcast(table), (ranked.cls == table.cls) & (ranked["rank"] >= table.lo) & (ranked["rank"] < table.hi)
    ).select(
        "doc_id", "start", "length", "crc", "doc_tokens", ranked.cls, "rank",
        (F.col("base") + F.expr("(rank - lo) div each")).alias("sequence_id"),
    )
    return placed, n_sequences


def _gaps(placed: DataFrame, n_sequences: int) -> DataFrame:
    """What each sequence lacks, and where its gap lies when all gaps are laid end to end."""
    size = max(256, -(-n_sequences // MAX_BLOCKS))
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    used = used.select("sequence_id", "used", (F.lit(CAPACITY) - F.col("used")).alias("gap"), F.expr(f"sequence_id div {size}").alias("block"))
    blocks = used.groupBy("block").agg(F.sum("gap").alias("in_block"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("block_at"))
    inside = Window.partitionBy("block").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    return used.join(blocks, "block").select(
        "sequence_id", "used", "gap", (F.col("block_at") + F.coalesce(F.sum("gap").over(inside), F.lit(0))).alias("gap_at")
    )


def _fill(cut: DataFrame, gaps: DataFrame, total_gap: int, n_sequences: int) -> DataFrame:
    """Pieces of the filler stream: first into the gaps, then into sequences of their own."""
    offsets = _part_offsets(cut, FILLER, F.sum("length"), [])
    stream = (
        cut.where(F.col("kind") == FILLER)
        .join(offsets, "part")
        .select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("off") + F.col("before")).alias("at"))
    )
    end = F.col("at") + F.col("length")

    def buckets(df: DataFrame, at, after) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.expr(f"{at} div {BUCKET}"), F.expr(f"({after} - 1) div {BUCKET}"))))

    open_gaps = buckets(gaps.where("gap > 0"), "gap_at", "(gap_at + gap)")
    early = buckets(stream.where(F.col("at") < total_gap), "at", "(at + length)")
    lo = F.greatest("at", "gap_at")
    hi = F.least(end, F.col("gap_at") + F.col("gap"))
    into_gaps = (
        early.join(open_gaps, "bucket")
        .where((lo < hi) & (F.expr(f"greatest(at, gap_at) div {BUCKET}") == F.col("bucket")))
        .select(
            "doc_id", "doc_tokens", "ids", (F.col("start") + lo - F.col("at")).alias("start"), (lo - F.col("at")).alias("skip"),
            (hi - lo).alias("length"), "sequence_id", (F.col("used") + lo - F.col("gap_at")).alias("offset"),
        )
    )
    late = stream.where(end > total_gap).withColumn("first", F.greatest("at", F.lit(total_gap)) - total_gap)
    late = late.withColumn("last", end - total_gap).withColumn(
        "n", F.explode(F.sequence(F.expr(f"first div {CAPACITY}"), F.expr(f"(last - 1) div {CAPACITY}")))
    )
    lo = F.greatest("first", F.col("n") * CAPACITY)
    hi = F.least("last", (F.col("n") + 1) * CAPACITY)
    skip = lo + total_gap - F.col("at")
    into_own = late.select(
        "doc_id", "doc_tokens", "ids", (F.col("start") + skip).alias("start"), skip.alias("skip"), (hi - lo).alias("length"),
        (F.col("n") + n_sequences).alias("sequence_id"), (lo - F.col("n") * CAPACITY).alias("offset"),
    )
    pieces = into_gaps.unionByName(into_own)
    kind_of_id = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skips, lengths = b.column("skip").to_pylist(), b.column("length").to_pylist()
            crcs = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for ids, s, n in zip(b.column("ids").to_pylist(), skips, lengths)]
            given = {n: b.column(n) for n in names if n != "crc"} | {"crc": pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_arrays([given[n] for n in names], names)

    return pieces.mapInArrow(
        lean(checksum), f"doc_id {kind_of_id}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    cut = materialise(_cut_documents(docs, tokenizer_path, id_col, text_col), "cut")
    placed, n_sequences = _assign(cut)
    placed = materialise(placed, "placed")
    gaps = _gaps(placed, n_sequences)
    total_gap = gaps.agg(F.sum("gap")).first()[0] or 0
    stream = cut.where(F.col("kind") == FILLER).agg(F.sum("length")).first()[0] or 0
    n_late = max(0, -(-(stream - total_gap) // CAPACITY))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    fit = placed.select(
        "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )
    full = (
        cut.where(F.col("kind") == FULL)
        .join(_part_offsets(cut, FULL, F.count(F.lit(1)), []), "part")
        .select(
            "doc_id", "start", "length", "crc", "doc_tokens",
            (F.col("off") + F.col("local") + n_sequences + n_late).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    every = full.unionByName(fit).unionByName(_fill(cut, gaps, total_gap, n_sequences))
    return every.select(
        F.col("doc_id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
