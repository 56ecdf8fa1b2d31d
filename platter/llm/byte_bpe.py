"""Byte-level BPE by backtracking over an Aho-Corasick automaton (operator 8).

A vocabulary's tokens, their bytes mapped to Latin-1, make one automaton. From
each position the longest token that starts there is tried; two neighbours are
compatible if merging their bytes by rank gives just these two, which is read
off the two tokens' own merge trees and memoised; a position that leads nowhere
is marked and never tried again, so a piece of n bytes takes time linear in n:
the longest match at a place is looked for in a window of the longest token.
The encoding is the one that merging by rank gives.

A token that merging its own bytes doesn't give back never arises inside a
piece; it is left out of the automaton and stands for a whole piece only.
Whole pieces are looked up first, as tiktoken does, and pieces and words
between single spaces are remembered, if short and within a bound.

Defined results: null is the empty text, of no ids. Very long texts and pieces:
time grows with the length, memory by some 100 bytes a byte of the longest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from platter.llm._common import as_binary, map_batches

#: Words remembered by a process, and the most characters of one.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
MEMO_PAIRS = 500_000
_COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word that _COMMON_PATTERN cuts before its point, if it has one.
_SIMPLE = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]?)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._split: dict[int, tuple[int, int]] = {}
        self._pair: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._prefix: dict[int, int | None] = {}
        usable = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._split[rank] = (rank, rank)
                usable.append(token)
            elif parts := self._halves(token):
                self._split[rank] = parts
                self._pair.setdefault(parts, rank)
                usable.append(token)
        self._longest = self._automaton(usable)
        self._reach = max(map(len, usable), default=1)

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The last two parts when token's bytes are merged by rank; None if a token remains unreached."""
        parts = [token[i : i + 1] for i in range(len(token))]
        if any(p not in self.ranks for p in parts):
            return None
        while len(parts) > 2:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _automaton(self, tokens: list[bytes]):
        import ahocorasick

        made = ahocorasick.Automaton()
        for t in tokens:
            made.add_word(t.decode("latin-1"), self.ranks[t])
        made.make_automaton()
        return made

    def _shorter(self, token: int) -> int | None:
        """The longest usable token that is a proper prefix of this one."""
        if token not in self._prefix:
            data, found = self.bytes_of[token], None
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n])
                if rank is not None and rank in self._split:
                    found = rank
                    break
            self._prefix[token] = found
        return self._prefix[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank gives these two and no other."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 62
        split, pair = self._split, self._pair
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            # Undo the later of the two merges on its side of the boundary.
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        # The longest match at each place in turn: mostly all neighbours are compatible.
        out = [token for _, token in self._longest.iter_long(text)]
        fits = self._fits.get
        for pair in zip(out, out[1:]):
            known = fits(pair)
            if not (self.fits(*pair) if known is None else known):
                return self._backtrack(text)
        if not out or sum([len(self.bytes_of[t]) for t in out]) != len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return out

    def _backtrack(self, text: str) -> list[int]:
        n, at = len(text), 0
        out: list[int] = []
        dead = bytearray(n + 1)
        token: int | None = self._at(text, 0)
        while at < n:
            end = at + len(self.bytes_of[token]) if token is not None else 0
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1  # nothing goes on from here, whatever compatible token ends here
                token = out.pop()
                at -= len(self.bytes_of[token])
                token = self._shorter(token)
            elif not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = self._at(text, at)
            else:
                token = self._shorter(token)
        return out

    def _at(self, text: str, at: int) -> int:
        """The longest token that starts at a place. The search copies its text, so it gets a window."""
        for end, token in self._longest.iter_long(text[at : at + self._reach]):
            if end + 1 != len(self.bytes_of[token]):
                break
            return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.pattern.findall(text) for t in self.encode_piece(as_binary(piece))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(path), pattern)


def words_of(text: str) -> list[str] | None:
    """The text cut before each single space between other characters; None where spaces meet other white space.

    The pattern starts a new match at such a space whatever comes before, so
    the parts can be encoded by themselves.
    """
    words = text.split(" ")
    for w in words:
        if not w or w[0].isspace() or w[-1].isspace():
            return None
    return [words[0], *(" " + w for w in words[1:])]


class Memo(dict):
    """Word to what `make` gives for it; when it is full, the newer half goes: frequent words come early. Long words aren't held."""

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(word) > MEMO_CHARS:
            return self.make(word)
        if len(self) >= self.most:
            for old in list(islice(self, self.most // 2, None)):
                del self[old]
        made = self[word] = self.make(word)
        return made


@cache
def _memos(path: str, pattern: str) -> tuple[Memo, Memo]:
    """Pieces to ids; words to their decimal ids joined by commas, the bytes that these decode to, their number."""
    e = encoder(path, pattern)
    pieces = Memo(lambda piece: tuple(e.encode_piece(as_binary(piece))))
    common = pattern == _COMMON_PATTERN

    def word(text: str) -> tuple[str, bytes, int]:
        # Latin letters and a point: what the pattern's own engine would find, without its cost
        simple = _SIMPLE.fullmatch(text) if common else None
        if simple is None:
            ids = [t for piece in e.pattern.findall(text) for t in pieces[piece]]
        else:
            letters, point = simple.groups()
            ids = e.encode_piece(letters.encode())
            if point:
                ids = [*ids, *pieces[point]]
        return ",".join(map(str, ids)), e.decode(ids), len(ids)

    return pieces, Memo(word)


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids and of the bytes that they decode to."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, words = _memos(path, pattern)
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            parts = (words_of(text) or [text]) if text else []
            found = list(map(words.__getitem__, parts))
            counts.append(sum([f[2] for f in found]))
            ids_sha.append(hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(b"".join([f[1] for f in found])).hexdigest())
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": ids_sha,
                "decoded_sha256": text_sha,
            }
        )

    return map_batches(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"),
        one,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of docs with the column ids (array<int>)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(col):
        pieces, _ = _memos(path, pattern)
        find = encoder(path, pattern).pattern.findall
        return type(col)([[t for p in find(x or "") for t in pieces[p]] for x in col], index=col.index)

    return docs.withColumn("ids", ids("text"))


def decode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of df with the column decoded (binary) of its column ids; null ids give no bytes."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def decoded(col):
        e = encoder(path, pattern)
        return type(col)([e.decode(x) if x is not None else b"" for x in col], index=col.index)

    return df.withColumn("decoded", decoded("ids"))
