import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


CASES = [
    "", " ", "\n", "  two  spaces ", "a\nb\n\nc \n d", "it's we'll I'd", "don't'S", "\x1c\x1d\x85\xa0　x", "漢字 é ü ñ 😀",
    "x" * 5000, " " * 3001, "-=" * 4000, "0123456789²½", "<|endoftext|>", "\ttab\tand\r\nline",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_tiktoken(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abehnt 'rs\n\t.,!19éß漢　\x1c")), max_size=80))
def test_random_texts_equal_tiktoken(own, other, text):
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_plain_merging_on_every_piece_of_a_small_vocabulary():
    ranks = {bytes([i]): i for i in range(256)}
    for i, token in enumerate(["ab", "bc", "abc", "cd", "bcd", "aa", "aaa"]):
        ranks[token.encode()] = 256 + i
    vocabulary = bpe.Vocabulary(ranks)

    def merged(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    import itertools

    tokens = vocabulary.tokens
    for a, b in itertools.product([i for i in tokens if i > 255 or i in b"abcd"], repeat=2):
        assert vocabulary._apart(a, b) == (merged(tokens[a] + tokens[b]) == [a, b]), (tokens[a], tokens[b])
    for size in range(1, 8):
        for letters in itertools.product(b"abcd", repeat=size):
            piece = bytes(letters)
            if piece not in ranks:
                assert vocabulary.encode_piece(piece) == merged(piece), piece


def test_memo_keeps_what_is_used():
    memo = bpe._Memo(str.upper, 4)
    assert [memo[x] for x in "abcabcdeaf"] == list("ABCABCDEAF")
    assert len(memo) + len(memo.old) <= 4


def test_pairs_of_the_vocabulary_stay_apart_or_merge(own, other):
    """Random pairs of tokens against merging their bytes whole."""
    import random

    rng = random.Random(6)
    tokens = own.vocabulary.tokens
    for _ in range(4000):
        a, b = rng.choice([i for i in (rng.randrange(50_000), rng.randrange(600))]), rng.randrange(50_000)
        both = tokens[a] + tokens[b]
        if len(both) < 40:
            want = other._core_bpe.encode_single_piece(both) == [a, b]
            assert own.vocabulary._apart(a, b) == want, (tokens[a], tokens[b])


def test_query_shape(spark, other):
    rows = [(1, "a b", "u", 1), (2, None, "v", 2), (1, "a b", "u", 1), (None, "x\n", None, 3), (5, "y" * 300_000, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    want = []
    for i, text, *_ in rows:
        ids = other.encode_ordinary(text or "")
        joined = " ".join(map(str, ids)).encode()
        want.append((i, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, PATH, PATTERN).collect()}
    assert ids[1] == other.encode_ordinary("a b") and ids[2] == []
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
