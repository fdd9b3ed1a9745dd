from collections import Counter

import numpy as np
import pytest

from tidemark.llm import neardup
from tidemark.llm.components import connected


def shingle_counts(text):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(rows, weighting="count"):
    """Least id of each row's component under similarity of at least 0.8."""
    sets = [shingle_counts(t) for _, t in rows]
    if weighting == "binary":
        sets = [Counter(set(s)) for s in sets]
    totals = [s.total() for s in sets]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = (sets[i] & sets[j]).total() if min(totals[i], totals[j]) * 5 >= max(totals[i], totals[j]) * 4 else 0
            if shared * 5 >= (totals[i] + totals[j] - shared) * 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(rows))]


def fixture():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(2000)])
    rows = []
    for n in (8, 30, 120, 900):
        for _ in range(12):
            rows.append((len(rows), " ".join(rng.choice(words, n))))
    base = rng.choice(words, 200)
    for i in range(60):  # a large group of near copies, all different
        copy = base.copy()
        copy[rng.integers(0, 200)] = f"edit{i}"
        rows.append((len(rows), " ".join(copy)))
    chain = list(rng.choice(words, 100))
    for i in range(12):  # each near the one before, the ends far apart
        rows.append((len(rows), " ".join(chain)))
        chain[8 * i % 100 : 8 * i % 100 + 3] = [f"c{i}", f"d{i}", f"e{i}"]
    line = list(rng.choice(words, 40))
    for n in (1, 2, 9, 10, 11):  # one line repeated: the same shingles, but not as often
        rows.append((len(rows), " ".join(line * n)))
    shared = list(rng.choice(words, 60))
    for _ in range(20):  # one passage in texts that are otherwise different
        rows.append((len(rows), " ".join(shared + list(rng.choice(words, 60)))))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "a b c d e"), (906, "a b c d e f")]
    rows += [(907, "copied text here of six words"), (907, "copied text here of six words"), (None, "copied text here of six words")]
    rows += [(None, "text without an id"), (908, "x " * 30000)]
    return rows


@pytest.mark.parametrize("weighting", ["count", "binary"])
def test_classes_equal_brute_force_and_one_of_each_is_kept(spark, weighting, monkeypatch):
    monkeypatch.setattr(neardup, "PER_HUB", 7)
    rows = fixture()
    clash = "doc_id long, text string, key string, class_id int, __key int, __id int, hub string, links int"
    docs = spark.createDataFrame([(*r, "clash", 5, 6, None, "h", 0) for r in rows], clash).repartition(5)
    got = neardup.near_duplicates(docs, weighting=weighting).collect()
    want = brute_classes(rows, weighting)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(((r[0], w) for r, w in zip(rows, want)), key=key)
    sizes = {r.doc_id: (r.class_rows, r.class_texts) for r in got}
    assert sizes[48] == (60, 60) and sizes[900] == (3, 1) and sizes[907] == (3, 1)
    assert sum(r.links for r in got if r.doc_id is not None and 48 <= r.doc_id < 108) >= 2 * 59 and {r.links for r in got if r.doc_id in (900, 903)} <= {0, 1}
    kept = neardup.keep_one_of_each(docs, weighting=weighting)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({w for w in want if w is not None}) and ids.count(None) == 1


def test_pairs_between_members_of_a_crowd_are_found(spark):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(30)]
    rows = []
    for i in range(300):  # most similarities lie between 0.5 and 0.79, and no shingle is rare
        kept = rng.random(30) < 0.8
        rows.append((len(rows), " ".join(p for p, k in zip(passages, kept) if k)))
        if i % 5 == 0:  # a partner that lacks one passage
            kept[rng.choice(np.flatnonzero(kept))] = False
            rows.append((len(rows), " ".join(p for p, k in zip(passages, kept) if k)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == brute_classes(rows)


def test_pairs_just_above_the_limit_in_a_crowd_just_below_it(spark):
    """All texts share a passage and are 0.79 similar; partners share ten shingles more and are 0.82 similar."""
    rows, passage = [], [f"p{i}" for i in range(445)]
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(10)]
        for side in "ab":
            rows.append((len(rows), " ".join([*passage, *own, *[f"{side}{i}x{j}" for j in range(49)]])))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_classes(rows)
    assert want == [i - i % 2 for i in range(180)]
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.keep_one_of_each(docs).count() == 0


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    names = neardup.mix(np.arange(300, dtype=np.uint64))
    for weights in (np.ones(300), rng.integers(1, 6, 300).astype(float), rng.random(300) * 3 + 0.05):
        other = weights * np.where(rng.random(300) < 0.2, rng.random(300) * 2, 1.0)
        sig = neardup.signatures(np.tile(names, 2), np.concatenate([weights, other]), np.repeat([0, 1], 300), 2, 2000)
        truth = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        assert abs((sig[0] == sig[1]).mean() - truth) < 0.05


def test_signatures_do_not_depend_on_company():
    names = neardup.mix(np.arange(50, dtype=np.uint64))
    both = neardup.signatures(np.concatenate([names, names[:3]]), np.ones(53), np.repeat([0, 1], [50, 3]), 2, 64)
    alone = neardup.signatures(names[:3], np.ones(3), np.zeros(3, int), 1, 64)
    assert (both[1] == alone[0]).all()


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.key: r.label for r in connected(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
