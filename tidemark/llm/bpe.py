"""Byte-level BPE, encoded by backtracking over longest matches.

The vocabulary is a table of byte strings and ranks. Bytes are mapped to the
Latin-1 characters of the same number, so that an Aho-Corasick automaton finds
for each position of a piece the longest token that begins there. A token may
follow another only if merging their bytes together would give exactly these
two; that test looks for a merge across the seam that would come first, and is memoised. Where no token that
begins at a position is compatible, the last token is taken back and its next
shorter prefix tried; a position found hopeless is never entered again, so the
work is linear in the piece.

Defined cases: a null text is the empty text, which has no ids. Repeated rows
are encoded one by one; columns beside id and text are not read. Texts of any
length are encoded whole, and a single piece of any length as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Entries of the memo of encoded units at most, and the longest unit that it keeps.
MEMO_UNITS, LONGEST_KEPT = 1_000_000, 48
#: Entries after which the memo of token pairs is emptied.
MEMO_PAIRS = 1_000_000
#: The characters of the Unicode property White_Space (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Tokens by rank, with the tables that exact backtracking needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys()))
        self.length = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        #: The token that two tokens make where they are the last two pieces of its own merging.
        self.joined: dict[tuple[int, int], int] = {}
        #: The pieces at the right end and at the left end of each token, the
        #: token itself first, with the rank of the merge that ends each piece.
        self.right_ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left_ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._add(token, i)
        self.allowed.clear()

    def _add(self, token: bytes, i: int) -> None:
        prefixes = [p for cut in range(len(token) - 1, 0, -1) if (p := self.ranks.get(token[:cut])) is not None]
        if prefixes:
            self.shorter[i] = prefixes[0]
        never = len(self.ranks) + 1
        self.right_ends[i] = self.left_ends[i] = ((i, never),)
        for left in prefixes:
            right = self.ranks.get(token[self.length[left] :])
            if right is not None and left < i and right < i and self._apart(left, right):
                self.joined[left, right] = i
                # The halves lived until this merge; their own ends until the merges that made the halves.
                self.right_ends[i] = ((i, never), (right, i), *self.right_ends[right][1:])
                self.left_ends[i] = ((i, never), (left, i), *self.left_ends[left][1:])
                return

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging leaves `left` and `right` side by side as they are.

        Merges happen in the order of their ranks, the leftmost first among
        equals. While both are built, the piece at the right end of `left` and
        the one at the left end of `right` are neighbours until one of them is
        merged inside its token. If they make a token of a rank before that,
        they are merged across the seam; so the tokens stay apart if and only
        if no pair of end pieces does. A merge inside `left` of the same rank
        lies further left and wins, one inside `right` does not.
        """
        joined = self.joined
        for a, ends in self.right_ends[left]:
            for b, also in self.left_ends[right]:
                rank = joined.get((a, b))
                if rank is not None and rank < ends and rank <= also:
                    return False
        return True

    def may_follow(self, left: int, right: int) -> bool:
        known = self.allowed.get((left, right))
        if known is None:
            if len(self.allowed) >= MEMO_PAIRS:
                self.allowed.clear()
            known = self.allowed[left, right] = self._apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as merging by rank gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, length, shorter, allowed = len(piece), self.length, self.shorter, self.allowed
        text = piece.decode("latin-1")
        longest = [-1] * size
        for end, (i, before) in self.automaton.iter(text):
            longest[end - before] = i
        closed: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            end = at + length[token]
            if end not in closed:
                fits = True if last < 0 else allowed.get((last, token))
                if fits is None:
                    fits = self.may_follow(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    if at < size:
                        token = longest[at]
                    continue
            if token in shorter:
                token = shorter[token]
                continue
            if not out:
                raise ValueError("the vocabulary lacks single bytes")
            closed.add(at)
            token = out.pop()
            at -= length[token]
            last = out[-1] if out else -1
        return out


class _Memo(dict):
    """A memo of two generations, bounded in entries and their length: what is used stays, the rest goes."""

    def __init__(self, make, limit: int = MEMO_UNITS):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST_KEPT:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Splits texts into pieces and keeps the ids of units seen before.

    A unit is a run of white space with the run of other characters after it.
    No match of the pattern goes on from a visible character into white space,
    so units can be encoded apart from each other.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.odd = [c for c in self._white() if c not in " \n"] + ["  ", "\n\n", " \n", "\n "]
        self.memo = _Memo(self._encode_unit)
        self.names = {i: f" {i}" for i in self.vocabulary.tokens}
        #: Ids are kept packed, in two bytes each if they fit.
        self.kind = "H" if max(self.vocabulary.tokens, default=0) < 1 << 16 else "I"

    def _encode_unit(self, unit: str) -> bytes:
        pieces = self.pieces.findall(unit)
        if len(pieces) > 1:  # each of them, alone, is a unit of one piece
            return b"".join(map(self.memo.__getitem__, pieces))
        return array(self.kind, self.vocabulary.encode_piece(unit.encode("utf-8"))).tobytes()

    @staticmethod
    def _white() -> list[str]:
        return [c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]

    def split(self, text: str) -> list[str]:
        if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in self.odd):
            return self.units.findall(text)
        first, *lines = text.split("\n")
        head, *words = first.split(" ")
        units = [head, *[" " + w for w in words]]
        for line in lines:
            head, *words = line.split(" ")
            units.append("\n" + head)
            units += [" " + w for w in words]
        return units

    def packed(self, text: str) -> memoryview:
        """The ids of a text."""
        return memoryview(b"".join(map(self.memo.__getitem__, self.split(text))) if text else b"").cast(self.kind)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and the array `ids` of each text."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return source.mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text; digests of its ids and of the decoded bytes."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        name = own.names.__getitem__
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.packed(text).tolist()
                counts.append(len(ids))
                id_digests.append(hashlib.sha256("".join(map(name, ids))[1:].encode("ascii")).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
