import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces, limit=packing.CAPACITY):
    """Each id of each document in one piece, sequences gapless and not too long."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(np.array(plain_ids(text), "<u4"))
    assert set(want) == set(documents)
    for doc_id, texts in want.items():
        if len(texts) > 1:  # repeated ids: compare totals only
            assert sum(p.length for p in documents[doc_id]) == sum(map(len, texts))
            continue
        at = 0
        for p in sorted(documents[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(texts[0])
            assert p.ids_crc32 == zlib.crc32(texts[0][at : at + p.length].tobytes())
            at += p.length
        assert at == len(texts[0])
    return sequences


def test_documents_are_cut_into_whole_sequences(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 900, 160))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "long " * 9000), (1004, "\x1codd\x1fspace"), (7, "again"), (None, "no id")]
    rows += [(2000 + i, "copy of one text") for i in range(50)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    sequences = check(rows, packing.pack(docs, PATH).collect())
    full = sum(sum(n for _, n in s) for s in sequences.values())
    assert full > 0.97 * packing.CAPACITY * (len(sequences) - 1)


def test_empty_table_and_single_row(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
    one = spark.createDataFrame([(16, None)], "doc_id long, text string")
    assert [(r.start, r.length, r.offset, r.doc_tokens) for r in packing.pack(one, PATH).collect()] == [(0, 1, 0, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cover_the_demand_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 65), 40, replace=False))
    demand = rng.integers(0, 900, 40) + 1
    patterns, times = packing.solve_patterns(sizes, demand, 128)
    assert (times @ patterns == demand).all()
    assert (patterns @ sizes <= 128).all()
    assert times.sum() <= 1.02 * (int(demand @ sizes) / 128) + 40


def test_pricing_equals_trying_all_patterns():
    sizes, values = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.74])
    best = max(
        (a * 0.31 + b * 0.5 + c * 0.74) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16
    )
    value, pattern = packing.best_pattern(values, sizes, 16)
    assert abs(value - best) < 1e-9 and pattern @ sizes <= 16 and abs(pattern @ values - value) < 1e-9


def test_word_by_word_equals_whole_texts():
    own = packing.word_tokenizer(PATH)
    texts = ["It's  A\u0085test of　İx", "ΑΣ ΑΣ. é é", "<|endoftext|> a", "\x1d a", "don't 123abc", "", "ß漢字 word"]
    for text, packed in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(packed, own.kind).tolist() == plain_ids(text)[:-1], text
