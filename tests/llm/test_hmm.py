import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import hmm


def small_model(k=3, n=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda *s: (x := rng.random(s) + 0.05) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(rows(k), rows(k, k), rows(k, n))


def over_all_paths(model, symbols):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[path[0], symbols[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    return math.log10(total)


def test_forward_equals_the_sum_over_all_paths():
    model = small_model()
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 4, 4, 0], [3, 1, 0, 2, 4, 1, 0])]
    got = hmm.forward_log10(model, sequences)
    for g, s in zip(got, sequences):
        assert abs(g - over_all_paths(model, s)) < 1e-10


def test_long_sequences_by_blocks_equal_single_steps():
    model = small_model()
    symbols = np.random.default_rng(0).integers(0, 5, 40_001)
    alpha, total = None, 0.0
    for s in symbols:
        alpha = model.emit[:, s] * (model.start if alpha is None else alpha @ model.move)
        total += math.log10(alpha.sum())
        alpha = alpha / alpha.sum()
    assert abs(hmm.forward_log10(model, [symbols, symbols[:3]])[0] - total) < 1e-6 * abs(total)


def test_expected_counts_equal_posteriors_over_all_paths():
    model = small_model()
    sequences = [np.array(s) for s in ([0, 3, 1], [2], [4, 4, 1, 0])]
    k, n = model.emit.shape
    start, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, n)), 0.0
    for symbols in sequences:
        whole = 10 ** over_all_paths(model, symbols)
        log += math.log10(whole)
        for path in itertools.product(range(k), repeat=len(symbols)):
            p = model.start[path[0]] * model.emit[path[0], symbols[0]]
            for a, b, s in zip(path, path[1:], symbols[1:]):
                p *= model.move[a, b] * model.emit[b, s]
            p /= whole
            start[path[0]] += p
            for a, b in zip(path, path[1:]):
                move[a, b] += p
            for a, s in zip(path, symbols):
                emit[a, s] += p
    want = np.concatenate([start, move.ravel(), emit.ravel(), [log]])
    assert np.allclose(hmm.expected_counts(model, sequences), want, atol=1e-9)


def test_rounds_do_not_lower_the_likelihood():
    rng = np.random.default_rng(4)
    sequences = [np.concatenate([rng.integers(0, 4, 30), rng.integers(4, 8, 30)]) for _ in range(50)]
    model, last = hmm.first_model(np.ones(8), 2), -np.inf
    for _ in range(8):
        counts = hmm.expected_counts(model, sequences)
        assert counts[-1] >= last - 0.5
        last = counts[-1]
        model = hmm.reestimate(counts, 2, 8)
    assert hmm.forward_log10(model, sequences).sum() > 3000 * math.log10(1 / 8) + 100


def test_stretched_rounds_get_as_far_as_more_plain_ones():
    rng = np.random.default_rng(7)
    sequences = []
    for _ in range(300):  # runs of two kinds of symbols, partly shared
        kinds = np.repeat(rng.integers(0, 2, 8), rng.integers(3, 9, 8))
        sequences.append(np.where(kinds == 0, rng.integers(0, 6, len(kinds)), rng.integers(4, 10, len(kinds))))
    counts = np.bincount(np.concatenate(sequences), minlength=10).astype(float)

    def likelihood(rounds, stretch):
        model = hmm.first_model(counts, 2)
        for k in range(rounds):
            new = hmm.reestimate(hmm.expected_counts(model, sequences), 2, 10)
            model = hmm.stretched(model, new) if stretch and 0 < k < rounds - 1 else new
        return hmm.forward_log10(model, sequences).sum()

    assert likelihood(hmm.ROUNDS, True) > likelihood(hmm.ROUNDS + 2, False) - 5
    assert likelihood(40, True) > likelihood(40, False) - 5


@pytest.mark.parametrize("head", [hmm.HEAD, 3])
def test_scores_equal_brute_force(spark, monkeypatch, head):
    """With a head of three words the rest goes through the join; nothing else changes."""
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm, "OWN", 3)
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    texts = ["The cat the dog", "a b c a", None, "", "cat é É dog\tthe\x0bend", "unseen zzz zzz", "the the the"] * 3
    rows = [(i, t, 1, 0.5) for i, t in enumerate(texts)] + [(None, "cat", 1, 0.5), (4, texts[4], 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token int, score double").repartition(3)
    got = hmm.score_documents(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update(hmm.words_of(t) + [hmm.END])
    n, v = sum(counts.values()), len(counts)
    by_id = {i: t for i, t, *_ in rows}
    for r in got:
        tokens = hmm.words_of(by_id[r.doc_id]) + [hmm.END]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens), n)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert abs(r.base_score - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-9
        assert r.score < 0 and math.isfinite(r.score)


def test_model_is_a_probability_over_continuations():
    """Words known to the lexicon and one unseen word per shared symbol have mass one."""
    mass = np.ones(hmm.N_SYMBOLS)
    counts = {b"aab": 3, b"xab": 2}
    symbol = hmm.shared_symbol(b"aab")
    assert symbol == hmm.shared_symbol(b"aab") >= 1 + hmm.OWN
    mass[symbol] += sum(counts.values()) + len(counts)
    assert abs(sum((c + 1) / mass[symbol] for c in counts.values()) + 1 / mass[symbol] - 1) < 1e-12


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score_documents(docs).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = hmm.score_documents(held).collect()
    assert rows and {(r.train_tokens, r.n_known, r.base_score) for r in rows} == {(0, 0, 0.0)}


def test_all_rounds_see_all_texts_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(3800)] + ["a b c " * 300, "a b c " * 300]
    sizes = []
    real = hmm._round
    monkeypatch.setattr(hmm, "_round", lambda *a: sizes.append(real(*a)) or sizes[-1])
    hmm.score_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = sum(len(t.split()) + 1 for t in learned)
    k = hmm.STATES
    assert len(sizes) == hmm.ROUNDS
    for counts in sizes:  # one start a text, a transition between all neighbours, all tokens emitted
        sums = counts[:k].sum(), counts[k : k + k * k].sum(), counts[k + k * k : -1].sum()
        assert np.allclose(sums, (len(learned), tokens - len(learned), tokens))
