"""Text scores of a hidden Markov language model trained by Baum-Welch.

Words are bytes between space and \\t-\\r with A-Z in lower case; each text ends
with one end token. Token counts are taken over all training texts. The most
frequent words are symbols of their own, other words share a symbol by the hash
of their ending, so the model is of fixed size; within a shared symbol a word
has the probability of its count plus one. Expected counts of a Baum-Welch
round are summed in each partition and then over partitions. A text is scored
by the forward recursion over all its tokens, scaled in each step, so that

    log10 P(text) = forward(symbols) + sum of log10 P(word | its shared symbol).

The counts of very many words do not fit into a broadcast. The `HEAD` most
frequent do, whatever the size of the corpus; the rest of each text's words
meet their counts in a join on the word.

Defined cases: a null text is the empty text, which has the end token only. A
null id counts as the empty id when the texts are divided. Repeated rows and
ids are scored one by one; columns beside id and text are not read. Without
training texts all counts are zero and the symbols are uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, materialise, text_of

STATES = 8
#: Words with a symbol of their own, and symbols that the other words share.
OWN, SHARED = 2048, 256
#: Words whose counts are broadcast.
HEAD = 262_144
#: Baum-Welch rounds, all over all training texts.
ROUNDS = 6
#: All rounds but the first and the last go so many times as far as the new
#: estimates, in logarithms; below 2 that still ends where plain rounds end, sooner.
STRETCH = 1.8
#: Sequences that are aligned in one go, at most; fewer where their number times the longest length passes GROUP_CELLS.
GROUP, GROUP_CELLS = 2048, 1_000_000
#: Tokens whose sequences are sorted by length together, about.
POOL = 4_000_000
#: Steps of the recursions between two scalings; probabilities of so many steps are far from underflow.
SCALE_EVERY = 8
SEED = 20240101
END = b""
N_SYMBOLS = 1 + OWN + SHARED


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def shared_symbol(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-3:]) % SHARED


@dataclass
class Lexicon:
    """Counts of the head words, and totals of all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    symbols: np.ndarray
    n_tokens: int
    n_distinct: int
    shared_mass: np.ndarray  # per shared symbol: tokens + distinct words + 1

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


# ---------------------------------------------------------------- recursions


def forward_log10(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole symbol sequence (none is empty).

    Alphas are kept with a column for each sequence, longest first, and scaled
    in every `SCALE_EVERY`th step and where sequences end.
    """
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    out = np.zeros(len(sequences))
    if not len(order):
        return out
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order]).astype(np.intp)
    at = np.cumsum(lengths) - lengths
    back = np.ascontiguousarray(model.move.T)
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
    alpha = model.start[:, None] * model.emit.take(flat[at], axis=1)
    log = np.zeros(len(order))
    for t in range(int(lengths[0])):
        n = live[t]
        if t:
            alpha = (back @ alpha[:, :n]) * model.emit.take(flat[at[:n] + t], axis=1)
        ended = t + 1 == len(live) or live[t + 1] < n
        if ended or t % SCALE_EVERY == SCALE_EVERY - 1:
            scale = alpha.sum(axis=0)
            log[:n] += np.log10(scale)
            alpha /= scale
        if not ended and n <= 4 and lengths[0] - t > 1024:
            scale = alpha.sum(axis=0)
            log[:n] += np.log10(scale)
            for i in range(n):
                log[i] += _finish(model, alpha[:, i] / scale[i], flat[at[i] + t + 1 : at[i] + lengths[i]])
            break
    out[order] = log
    return out


def _finish(model: Model, alpha: np.ndarray, symbols: np.ndarray) -> float:
    """The rest of one long recursion, by products of blocks of step matrices."""
    total, emit = 0.0, np.ascontiguousarray(model.emit.T)
    for lo in range(0, len(symbols), 16384):
        steps = model.move[None] * emit[symbols[lo : lo + 16384]][:, None, :]
        log = 0.0
        while len(steps) > 1:
            odd = steps[-1:] if len(steps) % 2 else None
            steps = steps[: len(steps) // 2 * 2 : 2] @ steps[1 : len(steps) // 2 * 2 : 2]
            top = steps.max(axis=(1, 2))
            log += float(np.log10(top).sum())
            steps /= top[:, None, None]
            if odd is not None:
                steps = np.concatenate([steps, odd])
        alpha = alpha @ steps[0]
        scale = alpha.sum()
        total += log + math.log10(scale)
        alpha = alpha / scale
    return total


def expected_counts(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Start, move and emission counts of one round, flat, and the log10 likelihood at the end.

    Forward values are scaled in every `SCALE_EVERY`th step and in the last step
    of each sequence, backward values by the same scales, so that their product
    is the posterior of the state at every step.
    """
    k, n_symbols = model.emit.shape
    start, move, emission = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_symbols))
    back = np.ascontiguousarray(model.move.T)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    total = 0.0
    lo = 0
    while lo < len(order):
        size = max(1, min(GROUP, GROUP_CELLS // len(sequences[order[lo]])))
        group = [sequences[i] for i in order[lo : lo + size]]
        lo += size
        lengths = np.array([len(s) for s in group])
        span = int(lengths[0])
        symbols = np.zeros((span, len(group)), np.intp)
        for i, s in enumerate(group):
            symbols[: len(s), i] = s
        live = np.searchsorted(-lengths, -np.arange(span), side="left")
        alphas = np.zeros((span, k, len(group)))
        scales: dict[int, np.ndarray] = {}
        for t in range(span):
            n = live[t]
            seen = model.emit.take(symbols[t, :n], axis=1)
            a = np.multiply(seen, back @ alphas[t - 1, :, :n] if t else model.start[:, None], out=alphas[t, :, :n])
            if t % SCALE_EVERY == SCALE_EVERY - 1 or t + 1 == span or live[t + 1] < n:
                scales[t] = a.sum(axis=0)
                a /= scales[t]
                total += float(np.log10(scales[t]).sum())
        beta = np.ones((k, len(group)))
        for t in range(span - 1, 0, -1):
            n, m = live[t], live[t - 1]
            ahead = model.emit.take(symbols[t, :n], axis=1)
            ahead *= beta[:, :n]
            if t in scales:
                ahead /= scales[t]
            move += model.move * (alphas[t - 1, :, :n] @ ahead.T)
            alphas[t, :, :n] *= beta[:, :n]  # now the posterior of the state
            beta[:, :n] = model.move @ ahead
            beta[:, n:m] = 1.0
        alphas[0] *= beta
        start += alphas[0].sum(axis=1)
        flat = symbols.ravel()
        for s in range(k):  # where a sequence has ended its posteriors are zero
            emission[s] += np.bincount(flat, alphas[:, s, :].ravel(), n_symbols)
    return np.concatenate([start, move.ravel(), emission.ravel(), [total]])


def reestimate(counts: np.ndarray, k: int, n_symbols: int) -> Model:
    """Probabilities from expected counts; each count gets a little added, none is zero."""
    start = counts[:k] + 0.1
    move = counts[k : k + k * k].reshape(k, k) + 0.1
    emit = counts[k + k * k : k + k * k + k * n_symbols].reshape(k, n_symbols) + 0.01
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def stretched(old: Model, new: Model) -> Model:
    """The model beyond `new` on the way from `old`."""

    def beyond(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.exp(np.log(a) + STRETCH * (np.log(b) - np.log(a)))
        return x / x.sum(axis=-1, keepdims=True)

    return Model(beyond(old.start, new.start), beyond(old.move, new.move), beyond(old.emit, new.emit))


def first_model(symbol_counts: np.ndarray, k: int = STATES) -> Model:
    """Symbol frequencies disturbed differently in each state, and states that last.

    Both break the symmetry of the states, which a few rounds would not.
    """
    rng = np.random.default_rng(SEED)
    emit = (symbol_counts + 0.5) * rng.gamma(0.5, 2.0, (k, len(symbol_counts))) + 1e-9
    move = rng.uniform(0.5, 1.5, (k, k)) + 3 * k * np.eye(k)
    start = rng.uniform(0.5, 1.5, k)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- stages


def _count_tokens(train: DataFrame) -> DataFrame:
    """`token`, `symbol` (its shared one) and `c`; partial counts leave each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["token", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                seen[END] += 1
                if len(seen) > 300_000:
                    yield flush()
        if seen:
            yield flush()

    partial = train.select("t").mapInArrow(count, "token binary, c long")
    shared = F.crc32(F.substring("token", -3, 3)) % SHARED + (1 + OWN)  # as `shared_symbol`
    symbol = F.when(F.length("token") == 0, F.lit(0)).otherwise(shared).cast("int")
    counts = partial.groupBy("token").agg(F.sum("c").alias("c")).select("token", symbol.alias("symbol"), "c")
    return materialise(counts, "counts")


def _least_head_count(counts: DataFrame) -> int:
    """The least count with which at most `HEAD` words are as frequent or more.

    Counts are gathered in classes, exact ones below 4,096 and 64 for each
    doubling above, so that a bounded number of rows decides and no task sorts words.
    """
    c = F.col("c")
    exact = 4096
    above = exact + F.floor(F.log2(c / exact) * 64).cast("long")
    classes = counts.where(F.length("token") > 0).groupBy(F.when(c < exact, c).otherwise(above).alias("class"))
    found = sorted(((r["class"], r["n"], r["least"]) for r in classes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, n = (1 << 62), 0
    for _, here, low in found:
        n += here
        if n > HEAD:
            break
        least = low
    return least


def _lexicon(counts: DataFrame) -> tuple[Lexicon, np.ndarray]:
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    # At most HEAD rows.
    head = counts.where((F.length("token") > 0) & (F.col("c") >= _least_head_count(counts))).toArrow()
    ranked = sorted(zip(head.column("token").to_pylist(), head.column("c").to_pylist(), head.column("symbol").to_pylist()), key=lambda x: (-x[1], x[0]))
    words = [w for w, _, _ in ranked]
    c = np.array([n for _, n, _ in ranked], np.int64)
    shared = np.array([s for _, _, s in ranked], np.int64)
    own = min(OWN, len(words))
    symbols = shared.copy()
    symbols[:own] = 1 + np.arange(own)
    # At most SHARED rows.
    mass = np.ones(N_SYMBOLS)
    for r in counts.where("symbol > 0").groupBy("symbol").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r.symbol] += r.n + r.v
    np.subtract.at(mass, shared[:own], c[:own] + 1)
    n_texts = counts.where(F.length("token") == 0).first()
    symbol_counts = np.zeros(N_SYMBOLS)
    symbol_counts[0] = n_texts["c"] if n_texts else 0
    symbol_counts[1 : own + 1] = c[:own]
    symbol_counts[1 + OWN :] = mass[1 + OWN :] - 1
    return Lexicon(words, c, symbols, totals[0] or 0, totals[1], mass), symbol_counts


_LOADED: dict[int, dict[bytes, int]] = {}


def _index(shared) -> dict[bytes, int]:
    """The head's dictionary, made once in each Python process."""
    if shared.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value[0]] = shared.value[1].index()
    return _LOADED[shared.value[0]]


_ENCODED = "row long, n_tokens long, known long, base double, inner double, s binary, tail array<struct<token: binary, n: int>>"
_ENCODED_NAMES = ["row", "n_tokens", "known", "base", "inner", "s", "tail"]


def _encode(source: DataFrame, shared) -> DataFrame:
    """All that a text's words are looked up for, once: `s` are its symbols as 16-bit numbers.

    `known` and `base` are over the words in the broadcast head, `inner` their
    log probabilities within shared symbols, `tail` the words that the head lacks.
    """
    kind = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lexicon, end_count = _index(shared), shared.value[1], shared.value[2]
        log_c = np.log10(lexicon.counts + 1.0)
        log_mass = np.log10(lexicon.shared_mass)
        per_token = math.log10(lexicon.n_tokens + lexicon.n_distinct + 1)
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                words: list[bytes] = []
                ends = []
                for text in batch.column(1):
                    words += words_of(text.as_py())
                    ends.append(len(words))
                    words.append(END)
                last = np.array(ends)
                first = np.concatenate([[0], last[:-1] + 1])
                place = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                symbols = lexicon.symbols[place] if len(lexicon.symbols) else np.zeros(len(words), np.int64)
                symbols[last] = 0
                in_head = place >= 0
                rest = np.flatnonzero(~in_head)
                rest = rest[symbols[rest] != 0] if len(lexicon.symbols) else np.setdiff1d(rest, last, assume_unique=True)
                lacking = [words[i] for i in rest.tolist()]
                symbols[rest] = [shared_symbol(w) for w in lacking]
                logs = np.where(in_head, log_c[place], 0.0) if len(log_c) else np.zeros(len(words))
                within = np.where(symbols > OWN, logs - log_mass[symbols], 0.0)
                base = np.add.reduceat(logs, first) + math.log10(end_count + 1) - (last - first + 1) * per_token
                known = np.add.reduceat(in_head.astype(np.int64), first) + (end_count > 0)
                tail_words, tail_counts, tail_ends = [], [], [0]
                cuts = np.searchsorted(rest, last).tolist()
                for lo, hi in zip([0, *cuts[:-1]], cuts):
                    if lo < hi:
                        tail = Counter(lacking[lo:hi])
                        tail_words += tail
                        tail_counts += tail.values()
                    tail_ends.append(len(tail_words))
                words_of_tails = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int32())], ["token", "n"])
                tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), words_of_tails)
                offsets = np.concatenate([[0], (last + 1) * 2]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(offsets), pa.py_buffer(symbols.astype(np.int16))])
                rows = np.arange(row, row + len(last))
                row += len(last)
                columns = [pa.array(c) for c in (rows, last - first + 1, known, base, np.add.reduceat(within, first))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, packed, tails], ["id", "held_out", *_ENCODED_NAMES])

    return source.select("id", "t", "held_out").mapInArrow(encode, f"id {kind}, held_out boolean, {_ENCODED}")


def _pools(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with their symbol sequences, about `POOL` tokens at a time."""
    held: list[pa.RecordBatch] = []
    sequences: list[np.ndarray] = []
    tokens = 0
    for batch in batches:
        found = [np.frombuffer(s.as_py(), np.int16) for s in batch.column(column)]
        held.append(batch)
        sequences += found
        tokens += sum(map(len, found))
        if tokens > POOL:
            yield held, sequences
            held, sequences, tokens = [], [], 0
    if sequences:
        yield held, sequences


def _round(train: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all symbol sequences, summed by partition and then over partitions."""
    n = STATES + STATES**2 + STATES * N_SYMBOLS + 1

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for _, sequences in _pools(batches, 0):
            total += expected_counts(model, sequences)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["i", "x"])

    out = np.zeros(n)
    # At most n rows, whatever the size of the corpus.
    found = train.mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out[found.column("i").to_numpy()] = found.column("x").to_numpy()
    return out


def train_model(train: DataFrame, symbol_counts: np.ndarray) -> Model:
    """All rounds over all training texts (`s`), each text as one sequence."""
    model = first_model(symbol_counts)
    if symbol_counts[0]:
        for k in range(ROUNDS):
            new = reestimate(_round(train, model), STATES, N_SYMBOLS)
            model = stretched(model, new) if 0 < k < ROUNDS - 1 else new
    return model


def _score(encoded: DataFrame, model: Model) -> DataFrame:
    """`row`, `id` and the other columns of each text, with the log probability of its symbols in `forward`."""
    kind = encoded.schema["id"].dataType.simpleString()
    names = ["row", "id", "held_out", "n_tokens", "known", "base", "inner"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sequences in _pools(batches, len(names)):
            logs = pa.array(forward_log10(model, sequences), pa.float64())
            at = 0
            for batch in held:
                columns = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, logs.slice(at, batch.num_rows)], [*names, "forward"])
                at += batch.num_rows

    schema = f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, inner double, forward double"
    return encoded.select(*names, "s").mapInArrow(score, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per document; texts whose crc32 of the id modulo `folds` is `held_fold` are not learned from."""
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("t"), (crc_remainder(id_col, folds) == held_fold).alias("held_out")
    )
    counts = _count_tokens(source.where(~F.col("held_out")))
    lexicon, symbol_counts = _lexicon(counts)
    shared = spark.sparkContext.broadcast((id(lexicon) ^ SEED, lexicon, int(symbol_counts[0])))
    encoded = materialise(_encode(source, shared), "encoded")
    model = train_model(encoded.where(~F.col("held_out")).select("s"), symbol_counts)
    tail = encoded.select("row", F.explode("tail").alias("w")).select("row", "w.token", "w.n")
    tail = tail.join(counts.select("token", "c"), "token", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = tail.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k")
    )
    more = F.coalesce("logs", F.lit(0.0))
    return _score(encoded, model).join(sums, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(lexicon.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("inner") + F.col("forward") + more).alias("score"),
    )
