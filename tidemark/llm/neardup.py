"""Near-duplicate documents by dart throwing signatures and banded joining.

Each element of a weighted set owns a region as wide as its weight, into which
a hashed Poisson process throws darts over time; a set sees the darts in the
regions of its elements. About k ln k + 2k of them are looked at, few for each
element of a long text, and each falls to one of k coordinates, which keeps its
earliest. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. Bands of coordinates give buckets of candidates; whether
two candidates are linked is decided by the similarity of their whole shingle
sets, and classes are the connected components of the links.

The weight of a shingle is how often it occurs, so the similarity is that of the
multisets: shared occurrences over all occurrences. With the weighting "binary"
all weights are one.

In a bucket all members are compared with a hub, and those that it is not
similar to with a hub of their own, which joins most members of a group in a
number of comparisons linear in its size. Members of a bucket that this leaves
in different classes are all joined exactly, by their rarest shingles.

A text travels as the 32-bit hashes of its words, from which its shingles are
made where they are compared: two shingles are equal if five words in a row have
equal hashes. A hub's words are sent once to each task that compares with it.

Defined cases: words are runs of other characters than space and \\t-\\r, with
A-Z in lower case. Texts of equal word sequence are copies and share a class,
and so do all texts without a word, null among them. A text of fewer than five
words has one shingle, all its words. Repeated rows and ids share the class of
their text. The class id is the least id in the class; null ids come last.
Other columns than id and text are not read, whatever their names; where rows
are kept they are carried along. Of several rows of equal id and text one is
kept, whichever is read first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, behind_leaders, free_name, lean, materialise, text_of
from .components import connected

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 27, 5
#: Hubs that a bucket gets one after the other, each for the members that those before left. Pairs left then are joined exactly.
HUB_ROUNDS = 3
#: Words after which the memo of word hashes is emptied, and the longest word that it keeps.
MEMO_WORDS, LONGEST_KEPT = 500_000, 32
#: Comparisons with one hub that share a task's key.
PER_HUB = 100
#: Shingles that are signed in one go.
CHUNK = 400_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of n weighted sets.

    `owner` gives the set of each element, all sets are non-empty. A value
    holds the time of the dart and bits of its name, so equal values mean
    the same dart.
    """
    out = np.full(n * k, np.iinfo(np.uint64).max, _U)
    total = np.bincount(owner, weights, n)
    # Each unit of weight has a process of its own; the last part of a unit takes its share of darts.
    units = np.ceil(weights).astype(np.int64)
    if (units > 1).any():
        at = np.repeat(np.arange(len(units)), units)
        step = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
        unit = mix(elements[at] + step.astype(_U) * _U(0x9E3779B97F4A7C15))
        unit[step == 0] = elements[at][step == 0]
        share, owner = np.minimum(1.0, weights[at] - step), owner[at]
    else:
        unit, share = elements, weights
    horizon = (k * np.log(k) + 2 * k) / total
    open_sets = np.ones(n, bool)
    while True:
        live = np.flatnonzero(open_sets[owner])
        names, part, sets = mix(unit[live]), share[live], owner[live]
        time = np.zeros(len(live))
        while len(names):
            names = mix(names + _U(0x9E3779B97F4A7C15))
            time = time - np.log(((names >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            seen = time <= horizon[sets]
            names, part, sets, time = names[seen], part[seen], sets[seen], time[seen]
            fall = mix(names ^ _U(0xD6E8FEB86659FD93))
            inside = (part >= 1.0) | ((fall & _U(0xFFFFFF)).astype(np.float64) * 2.0**-24 < part)
            coordinate = ((fall >> _U(32)) % _U(k)).astype(np.int64)
            value = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (mix(fall) >> _U(32))
            np.minimum.at(out, (sets * k + coordinate)[inside], value[inside])
        open_sets = (out.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_sets.any():
            return out.reshape(n, k)
        horizon = np.where(open_sets, horizon * 2, horizon)


class _WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _WordHashes()
MEMOS["word hashes"] = _WORDS.clear


def word_hashes(text: str) -> tuple[bytes, np.ndarray]:
    """A key of the word sequence, and the 32-bit hash of each word."""
    words = text.encode("utf-8").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)), np.fromiter(map(_WORDS.__getitem__, words), np.uint32, len(words))


def weighted_shingles(words: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the different shingles, ascending, and their weights."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = words.astype(_U)
    acc = np.zeros(len(h) - size + 1, _U)
    for i in range(size):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    found, counts = np.unique(acc, return_counts=True)
    return found, np.ones(len(found), np.int64) if weighting == "binary" else counts


def numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set whose similarity is that of the weighted set: each element once for each unit of its weight."""
    at = np.repeat(np.arange(len(elements)), weights)
    step = np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)
    return mix(elements[at] + step.astype(_U) * _U(0x9E3779B97F4A7C15))


def _sign(docs: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """Id, key of the text, the hashes of its words, and its bucket of each band."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def flush(ids, keys, words, sets, id_type):
        n = len(keys)
        buckets: list = [[] for _ in range(n)]
        full = [i for i in range(n) if len(sets[i][0])]
        if full:
            owner = np.repeat(np.arange(len(full)), [len(sets[i][0]) for i in full])
            elements, weights = (np.concatenate([sets[i][x] for i in full]) for x in (0, 1))
            sig = signatures(elements, weights.astype(float), owner, len(full), BANDS * ROWS)
            sig = sig.reshape(len(full), BANDS, ROWS)
            acc = np.broadcast_to(np.arange(1, BANDS + 1).astype(_U), (len(full), BANDS)).copy()
            for r in range(ROWS):
                acc = mix(acc * _U(0x9E3779B97F4A7C15) + sig[:, :, r])
            for i, row in zip(full, acc.view(np.int64).tolist()):
                buckets[i] = row
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(keys, pa.binary()), pa.array(words, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            ["doc_id", "key", "words", "buckets"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, keys, words, sets, held = [], [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, hashes = word_hashes(text.as_py())
                ids.append(doc_id), keys.append(key), words.append(hashes.astype("<u4").tobytes())
                sets.append(weighted_shingles(hashes, weighting))
                held += len(hashes) + 200
                if held > CHUNK:
                    yield flush(ids, keys, words, sets, id_type)
                    ids, keys, words, sets, held = [], [], [], [], 0
            if ids:
                yield flush(ids, keys, words, sets, id_type)

    return source.mapInArrow(lean(sign), f"doc_id {kind}, key binary, words binary, buckets array<long>")


def _verify(pairs: DataFrame, pool: DataFrame, weighting: str) -> DataFrame:
    """The pairs `hub`, `key` whose weighted shingle sets are similar enough."""
    percent = round(SIMILARITY * 100)
    sizes = materialise(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # Keys grow with the corpus, so they are never broadcast.
    leaders = pool.select(F.col("key").alias("hub"), F.col("words").alias("lead")).join(sizes.select("hub").hint("merge"), "hub")
    rows = pool.join(pairs.hint("merge"), "key").select("hub", "key", "words")
    stream = behind_leaders(rows, leaders, sizes, "hub", PER_HUB, F.col("key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_weights, lead_total = np.zeros(0, _U), np.zeros(0, np.int64), 0
        for batch in batches:
            found = []
            for hub, key, words, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key is None:
                    lead, lead_weights = weighted_shingles(np.frombuffer(own, "<u4"), weighting)
                    lead_total = int(lead_weights.sum())
                    continue
                elements, weights = weighted_shingles(np.frombuffer(words, "<u4"), weighting)
                total = int(weights.sum())
                if min(total, lead_total) * 100 < max(total, lead_total) * percent:
                    continue
                at = np.minimum(np.searchsorted(lead, elements), len(lead) - 1)
                same = lead[at] == elements
                shared = int(np.minimum(lead_weights[at[same]], weights[same]).sum())
                # shared / (total + lead_total - shared) >= similarity, in whole numbers
                if shared * 100 >= (total + lead_total - shared) * percent:
                    found.append((hub, key))
            hubs, keys = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.binary()), pa.array(keys, pa.binary())], ["hub", "key"])

    return stream.select("hub", "key", "words", "lead").mapInArrow(lean(compare), "hub binary, key binary")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_texts(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """`key` and `label` of the texts in buckets that hold pairs neither compared nor in one class yet.

    A bucket of two texts has been compared by its first hub.
    """
    labelled = buckets.join(connected(links), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    labelled = materialise(labelled, "labelled")
    unsettled = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    unsettled = materialise(unsettled.where("n > 2 AND lo <> hi").select("bucket"), "unsettled")
    return labelled.join(unsettled.hint("merge"), "bucket", "left_semi").groupBy("key").agg(F.first("label").alias("label"))


def _prefix_pairs(texts: DataFrame, pool: DataFrame, weighting: str) -> DataFrame:
    """Pairs `a`, `b` of `texts` of different labels that can be similar; no similar pair is missing.

    Shingles, each unit of weight one, are put in one order, rare ones first. The
    first one that two similar sets share has as many shingles from it on in either
    set as they must share, so it is among the first fifth of both.
    """
    percent = round(SIMILARITY * 100)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbered(*weighted_shingles(np.frombuffer(w, "<u4"), weighting)).view(np.int64) for w in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["key", "label", "s"]
            )

    sets = pool.join(texts.hint("merge"), "key").select("key", "label", "words")
    sets = materialise(sets.mapInArrow(lean(units), "key binary, label binary, s array<long>"), "sets")
    tokens = sets.select("key", "label", F.size("s").alias("n"), F.explode("s").alias("token"))
    common = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "common")
    shared = tokens.join(common.hint("merge"), "token")
    # At most the shingles of one text. Those that no other text has come first and need no place of their own.
    order = F.sort_array(F.collect_list(F.struct("c", "token")))
    placed = shared.groupBy("key", "label", "n").agg(order.alias("o")).withColumn("alone", F.col("n") - F.size("o"))
    placed = placed.withColumn("room", F.expr(f"n * {100 - percent} div 100").cast("int") + 1 - F.col("alone")).where("room > 0")
    prefix = placed.select("key", "label", "n", "alone", F.posexplode(F.slice("o", F.lit(1), F.col("room"))).alias("i", "o"))
    prefix = prefix.select("key", "label", "n", (F.col("alone") + F.col("i")).alias("place"), F.col("o.token").alias("token"))
    prefix = materialise(prefix, "prefixes")
    # A shingle that one class alone has in its prefixes gives no pair.
    mixed = prefix.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    prefix = materialise(prefix.join(materialise(mixed, "mixed").hint("merge"), "token", "left_semi"), "prefixes")
    x, y = (prefix.select("token", *[F.col(c).alias(c + side) for c in ("key", "label", "n", "place")]) for side in "xy")
    least = (F.col("nx") + F.col("ny")) * percent
    enough = ((F.col("nx") - F.col("placex")) * (100 + percent) >= least) & ((F.col("ny") - F.col("placey")) * (100 + percent) >= least)
    same = x.hint("merge").join(y, (x["token"] == y["token"]) & (F.col("labelx") < F.col("labely")) & enough)
    return same.select(*_ordered("keyx", "keyy")).distinct()


def _links(signed: DataFrame, reps: DataFrame, weighting: str) -> DataFrame:
    """Links found in the buckets, as pairs `a`, `b` of text keys.

    A bucket's hub is the member whose buckets hold most texts, which in a
    group of near copies is the text they were made from. All members are
    compared with it; those it is not similar to form the bucket of the next
    round, with a hub of their own. What the hubs leave apart is joined exactly.
    """
    members = reps.select("key", F.explode("buckets").alias("bucket"))
    sizes = materialise(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    # A text has at most BANDS buckets, so its list is short.
    scored = members.join(sizes.hint("merge"), "bucket").groupBy("key").agg(F.sum("n").alias("score"), F.collect_list("bucket").alias("buckets"))
    scored = materialise(scored, "scored")
    state = buckets = materialise(scored.select("key", "score", F.explode("buckets").alias("bucket")), "buckets")
    # Only texts that share a bucket are ever compared. One of each text first, so that copies are joined in each task.
    pool = signed.groupBy("key").agg(F.first("words").alias("words")).join(scored.select("key").hint("merge"), "key", "left_semi")
    pool = materialise(pool, "pool")
    links = asked = None
    for _ in range(HUB_ROUNDS):
        hubs = state.groupBy("bucket").agg(F.max(F.struct("score", "key")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        hubs = materialise(hubs.select("bucket", F.col("top.key").alias("hub")), "hubs")
        rows = materialise(state.join(hubs.hint("merge"), "bucket").where(F.col("key") != F.col("hub")), "buckets")
        # Of two texts it is always the same one that can be the other's hub.
        fresh = rows.select("hub", "key").distinct()
        if asked is not None:
            fresh = fresh.join(asked, ["hub", "key"], "left_anti")
        fresh = materialise(fresh, "asked")
        if links is None or not fresh.isEmpty():
            found = materialise(_verify(fresh, pool, weighting), "linked")
            links = found if links is None else links.unionByName(found)
            asked = fresh if asked is None else asked.unionByName(fresh)
        state = rows.join(links, ["hub", "key"], "left_anti").select("bucket", "key", "score")
    links = materialise(links.select(*_ordered("hub", "key")), "links")
    texts = materialise(_open_texts(buckets, links), "open")
    if texts.isEmpty():
        return links
    rest = _prefix_pairs(texts, pool, weighting).join(asked.select(*_ordered("hub", "key")), ["a", "b"], "left_anti")
    rest = materialise(rest.select(F.col("a").alias("hub"), F.col("b").alias("key")), "asked")
    return materialise(links.unionByName(_verify(rest, pool, weighting).select(*_ordered("hub", "key"))), "links")


def _classes(docs: DataFrame, id_col: str, text_col: str, weighting: str) -> tuple[DataFrame, DataFrame]:
    """(`doc_id`, `key`) of each row, and for each key its class id, sizes, links and whether it stands for the class."""
    signed = materialise(_sign(docs, id_col, text_col, weighting), "signed")
    reps = materialise(
        signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("buckets").alias("buckets")),
        "texts",
    )
    links = _links(signed, reps, weighting)
    degrees = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    named = reps.select("key", "least_id", "copies").join(connected(links).join(degrees, "key", "left"), "key", "left")
    named = materialise(named.select("key", "least_id", "copies", F.coalesce("label", "key").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    sizes = named.groupBy("label").agg(
        F.min("least_id").alias("class_id"),
        F.sum("copies").alias("class_rows"),
        F.count(F.lit(1)).alias("class_texts"),
        F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "key")).alias("first"),
    )
    by_key = named.join(materialise(sizes, "classes").hint("merge"), "label").select(
        "key", "least_id", "class_id", "class_rows", "class_texts", "links", (F.col("first.key") == F.col("key")).alias("stands")
    )
    return signed.select("doc_id", "key"), materialise(by_key, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "count") -> DataFrame:
    """One row per document: its class id, how many rows and different texts the class has, and the text's links.

    `weighting` is "count" for shingles weighted by how often they occur, or
    "binary". `links` counts the other texts that this one was compared with and
    found similar to; they hold each class together, but members that a hub
    joins are not compared with each other.
    """
    rows, classes = _classes(docs, id_col, text_col, weighting)
    return rows.join(classes.hint("merge"), "key").select(F.col("doc_id").alias(id_col), "class_id", "class_rows", "class_texts", "links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "count") -> DataFrame:
    """One row of each class, that of the least id, with the columns of `docs`."""
    _, classes = _classes(docs, id_col, text_col, weighting)
    text_at = docs.columns.index(text_col)
    key_name, id_name = free_name("__key", docs.columns), free_name("__id", docs.columns)

    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8").lower().split())) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, key_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = docs.mapInArrow(lean(add_key), f"{fields}, {key_name} binary")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    chosen = classes.where("stands").select(F.col("key").alias(key_name), known("least_id").alias(id_name))
    kept = keyed.withColumn(id_name, known(f"`{id_col}`")).join(chosen, [key_name, id_name], "left_semi")
    return kept.dropDuplicates([key_name, id_name]).select(*[F.col(f"`{c}`") for c in docs.columns])
