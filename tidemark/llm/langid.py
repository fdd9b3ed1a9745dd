"""Language identification by Kneser-Ney character models.

For each language an interpolated Kneser-Ney model over characters is counted
from labelled texts. The n-grams of all languages together are kept in sorted
arrays of 64-bit hashes, one array for each order, with the log probability of
each language beside each hash; a lookup is a binary search, and where the
n-gram is in no language the search goes on one order down with the weight that
each language gives to such steps. The language of the lowest cross-entropy per
character wins. A text is rejected where that entropy lies far outside of what
labelled texts of the language show.

Characters: letters in lower case; each run of anything else is one space.

Defined cases: a text that is null or has no letter is `und`, rejected, with
score 0. A null id counts as the empty id when the texts are divided. With no
labelled text every text is `und`. Of languages of equal cross-entropy the first
by name wins. A text shorter than the n-grams is judged by its shorter ones. Rows are judged one by one, so repeated rows
agree; columns other than id, text and (for training) the label are not read.
Whole texts are scored, in stretches of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, lean, materialise, text_of

ORDER = 4
DISCOUNT = 0.75
#: About how many labelled texts of each language the models are fitted on: the bound of the labelled sample.
FIT_TEXTS = 1500
#: One in so many of them is not counted but tells how far entropies spread.
CALIBRATE = 5
#: Rejection: cross-entropy above the mean of fitted texts by so many of their
#: standard deviations, and at least by so many bits.
REJECT_SD, REJECT_BITS = 8.0, 1.0
#: Shorter texts vary more; the distance allowed grows with this over the root of the length.
REJECT_SHORT_BITS = 12.0
#: What differences of bits per character are multiplied with before they are compared as probabilities.
SHARPNESS = 12
#: Characters scored in one go.
STRETCH = 1 << 20
UNKNOWN = "und"
SPACE = 32

_U = np.uint64


def _letter_table() -> np.ndarray:
    """For each code point of the first plane: its lower case if it is a letter, else a space."""
    table = np.full(0x10000, SPACE, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return table


_LETTERS = _letter_table()


def characters(text: str) -> np.ndarray:
    """Letters in lower case, runs of other characters as one space, a space at both ends.

    Characters beyond the first plane count as letters where Python says so.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 0x10000:
        high = codes >= 0x10000
        low = _LETTERS[np.where(high, SPACE, codes)]
        low[high] = [c if chr(c).isalpha() else SPACE for c in codes[high].tolist()]
    else:
        low = _LETTERS[codes]
    padded = np.concatenate([[SPACE], low, [SPACE]]).astype(np.uint32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE)
    return padded[keep]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that begin at each place."""
    size = len(chars) - n + 1
    if size <= 0:
        return np.zeros(0, _U)
    acc = np.full(size, n, _U)
    for i in range(n):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + chars[i : i + size].astype(_U) + _U(1))
    return acc


# ---------------------------------------------------------------- the model


@dataclass
class Models:
    """Sorted hash arrays by order, from 1 up.

    `hashes[n]` are the n-grams of any language; `log_p[n]` their base 2 log
    probabilities, a column for each language; `context[n]` are the n-grams
    with a successor in any language, and `log_back[n]` the log weights of
    going down from them.
    """

    languages: list[str]
    hashes: dict[int, np.ndarray]
    log_p: dict[int, np.ndarray]
    context: dict[int, np.ndarray]
    log_back: dict[int, np.ndarray]
    log_floor: np.ndarray
    limits: np.ndarray | None = None


def _ordered_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of characters, as `gram_hashes` gives it."""
    acc = np.full(len(codes), codes.shape[1], _U)
    for i in range(codes.shape[1]):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + codes[:, i].astype(_U) + _U(1))
    return acc


@dataclass
class _Level:
    """n-grams of one order in one language, by hash: probability, and of their histories the weight of going down."""

    hashes: np.ndarray
    p: np.ndarray
    histories: np.ndarray
    back: np.ndarray


def _levels(codes: np.ndarray, counts: np.ndarray, order: int) -> tuple[dict[int, _Level], float, dict[int, np.ndarray]]:
    """Levels of one language, the probability of a character never seen, and the n-grams of each order."""
    grams, seen = {order: codes}, {order: counts.astype(np.float64)}
    for n in range(order - 1, 0, -1):
        # Continuation counts: how many different n-grams end in each shorter one.
        hashes, at, kinds = np.unique(_ordered_hashes(grams[n + 1][:, 1:]), return_index=True, return_counts=True)
        grams[n], seen[n] = grams[n + 1][at][:, 1:], kinds.astype(np.float64)
    total = seen[1].sum() + 1
    # Characters never seen share the mass of one count.
    hashes = _ordered_hashes(grams[1])
    at = np.argsort(hashes)
    none = np.zeros(0)
    out = {1: _Level(hashes[at], (seen[1] / total)[at], np.zeros(0, _U), none)}
    for n in range(2, order + 1):
        histories, which, kinds = np.unique(_ordered_hashes(grams[n][:, :-1]), return_inverse=True, return_counts=True)
        mass = np.bincount(which, seen[n])
        back = DISCOUNT * kinds / mass
        lower, found = _find(out[n - 1].hashes, _ordered_hashes(grams[n][:, 1:]))
        p = (seen[n] - DISCOUNT) / mass[which] + back[which] * np.where(found, out[n - 1].p[lower], 0.0)
        hashes = _ordered_hashes(grams[n])
        at = np.argsort(hashes)
        out[n] = _Level(hashes[at], p[at], histories, back)
    return out, 1 / total, grams


def build_models(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney models from n-grams of the highest order (rows of code points) and their counts."""
    languages = sorted(counts)
    fitted = [_levels(*counts[language], order) for language in languages]
    floor = np.array([f[1] for f in fitted])
    out = Models(languages, {}, {}, {}, {}, np.log2(floor))
    for n in range(1, order + 1):
        grams = [f[2][n] for f in fitted]
        every = np.concatenate(grams) if grams else np.zeros((0, n), np.uint32)
        out.hashes[n], at = np.unique(_ordered_hashes(every), return_index=True)
        table = np.zeros((len(at), len(languages)))
        for which, (levels, low, _) in enumerate(fitted):
            # A gram that only other languages have is found by going down.
            weight, pending = np.ones(len(at)), np.arange(len(at))
            for k in range(n, 0, -1):
                part = every[at[pending]][:, n - k :]
                place, found = _find(levels[k].hashes, _ordered_hashes(part))
                table[pending[found], which] = weight[pending[found]] * levels[k].p[place[found]]
                pending, part = pending[~found], part[~found]
                if k > 1 and len(pending):
                    place, found = _find(levels[k].histories, _ordered_hashes(part[:, :-1]))
                    weight[pending[found]] *= levels[k].back[place[found]]
            table[pending, which] = weight[pending] * low
        out.log_p[n] = np.log2(table) if len(table) else table
    for n in range(1, order):
        every = [f[0][n + 1].histories for f in fitted]
        out.context[n] = np.unique(np.concatenate(every)) if every else np.zeros(0, _U)
        table = np.ones((len(out.context[n]), len(languages)))
        for which, (levels, _, _) in enumerate(fitted):
            place, found = _find(levels[n + 1].histories, out.context[n])
            table[found, which] = levels[n + 1].back[place[found]]
        out.log_back[n] = np.log2(table)
    return out


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def log_probabilities(models: Models, chars: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Sum of base 2 logs over all characters after the first, one value for each language."""
    total = np.zeros(len(models.languages))
    for lo in range(1, len(chars), STRETCH):
        ends = np.arange(lo, min(lo + STRETCH, len(chars)))
        begin = max(0, lo - order + 1)
        window = chars[begin : ends[-1] + 1]
        hashes = {n: gram_hashes(window, n) for n in range(1, order + 1)}
        n = order
        # The first characters of a text have shorter histories.
        early = ends[ends - order + 1 < 0]
        pending = ends[len(early) :]
        while n >= 1:
            if n < order:
                short = early[early == n - 1]
                pending = np.concatenate([short, pending]) if len(short) else pending
            if len(pending):
                at, found = _find(models.hashes[n], hashes[n][pending - n + 1 - begin])
                total += models.log_p[n][at[found]].sum(axis=0) if found.any() else 0.0
                pending = pending[~found]
                if n > 1 and len(pending):
                    at, found = _find(models.context[n - 1], hashes[n - 1][pending - n + 1 - begin])
                    if found.any():
                        total += models.log_back[n - 1][at[found]].sum(axis=0)
            n -= 1
        total += len(pending) * models.log_floor
    return total


def judge(models: Models, text: str | None) -> tuple[str, float, float, bool]:
    """(language, score, bits per character, rejected) of one text.

    The score is the share of the best language when the mean bits a character,
    times `SHARPNESS`, are compared as probabilities, times a factor that falls
    to 0 at rejection.
    """
    chars = characters(text or "")
    if not models.languages or len(chars) < 3:
        return UNKNOWN, 0.0, 0.0, True
    n = len(chars) - 1
    bits = -log_probabilities(models, chars) / n
    best = int(bits.argmin())
    share = float(1.0 / np.exp2((bits[best] - bits) * SHARPNESS).sum())
    if models.limits is None:
        return models.languages[best], share, float(bits[best]), False
    mean, room = models.limits[best]
    room = room + REJECT_SHORT_BITS / np.sqrt(n)
    excess = (float(bits[best]) - mean) / room
    return models.languages[best], share * min(1.0, max(0.0, 1.0 - max(0.0, excess) ** 4)), float(bits[best]), bool(excess > 1.0)


# ---------------------------------------------------------------- stages


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1) -> Models:
    """Models from labelled texts outside the held-out fold.

    The sample is bounded: about `FIT_TEXTS` texts for each language, chosen by
    the hash of their ids; all their n-grams are counted, except of one in
    `CALIBRATE`, on which entropies are measured. Where a language has none of
    these, its limit is the mean of the others'.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("t"), F.col(id_col).alias("id")).where(
        F.col("lang").isNotNull() & (crc_remainder("id", folds) != held_fold)
    )
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return build_models({})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, FIT_TEXTS / n)))])
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    apart = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(CALIBRATE)) == 0
    sample = materialise(labelled.where(drawn).select("lang", "t", apart.alias("apart")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chars = characters(text)
                if len(chars) >= ORDER:
                    by_lang.setdefault(lang, []).append(
                        (gram_hashes(chars, ORDER), np.lib.stride_tricks.sliding_window_view(chars, ORDER))
                    )
            for lang, found in by_lang.items():
                _, at, n = np.unique(np.concatenate([h for h, _ in found]), return_index=True, return_counts=True)
                grams = np.concatenate([w for _, w in found])[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(["".join(map(chr, g)) for g in grams.tolist()], pa.string()),
                        pa.array(n, pa.int64()),
                    ],
                    ["lang", "gram", "n"],
                )

    counted = sample.where(~F.col("apart")).mapInArrow(lean(count), "lang string, gram string, n long")
    # The n-grams of a bounded number of texts.
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = {}
    for lang, part in grams.groupby("lang"):
        codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        counts[lang] = (codes, part["n"].to_numpy())
    models = build_models(counts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(shared.value, t) for t in batch.column(1).to_pylist()]
            same = [(lang, j[2]) for lang, j in zip(batch.column(0).to_pylist(), judged) if lang == j[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in same], pa.string()), pa.array([s[1] for s in same], pa.float64())], ["lang", "bits"]
            )

    spread = sample.where("apart").select("lang", "t").mapInArrow(lean(entropies), "lang string, bits double").groupBy("lang")
    # A row for each language.
    known = {r["lang"]: (r["m"], r["s"] or 0.0) for r in spread.agg(F.avg("bits").alias("m"), F.stddev_pop("bits").alias("s")).collect()}
    usual = tuple(np.mean(list(known.values()), axis=0)) if known else (0.0, 99.0)
    models.limits = np.array([(m, max(REJECT_SD * s, REJECT_BITS)) for m, s in (known.get(x, usual) for x in models.languages)])
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per document: language, score, entropy and whether the text is rejected."""
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("t"), (crc_remainder(id_col, folds) == held_fold).alias("held_out")
    )
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(shared.value, t) for t in batch.column(1).to_pylist()]
            langs, scores, bits, rejected = zip(*judged) if judged else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_()),
                ],
                [id_col, "held_out", "lang_pred", "score", "bits_per_char", "rejected"],
            )

    return source.mapInArrow(
        lean(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean"
    )


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows of `docs` and judges all of its rows."""
    return identify(docs, fit(docs))


def keep_identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with their columns unchanged."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not judge(shared.value, t)[3] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
