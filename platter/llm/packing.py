"""Best-fit packing of tokenised documents (operator 6).

A document's ids, with a separator at the end, are cut into pieces of at most
`tokens`, the first of which may be shorter. Pieces go into sequences by vector
best-fit decreasing: a piece asks for tokens, one document and its attention
cost (its length squared); of the open sequences whose residual capacities all
hold it, it takes the one with the least weighted norm of what would remain
(`by="norm"`) or the greatest weighted dot product of residual and demand
(`by="dot"`).

The production capacities of a sequence are `TOKENS`, `DOCUMENTS` pieces and
an attention cost: a piece costs its length squared and `TILE`, the least block
that an attention kernel computes for it. All three can bind: many tiny pieces
meet the document capacity, those beside a nearly whole one the cost.

Pieces are dealt evenly to shards of about `shard_pieces`, which are packed
independently; a shard adds at most a few sequences to the whole.

Defined results: null is the empty text, of the separator alone. Repeated rows
are packed each. Very long texts: time and memory grow with the text's length
(some 20 bytes a character); long runs of white space are cut as the pattern
would before the tokenizer sees them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import Scratch, map_batches, partitions

TOKENS = 2048
SEPARATOR = 0
SHARD_PIECES = 16_000
#: Pieces of a sequence; attention cost of a piece beside its length squared.
DOCUMENTS, TILE = 128, 64 * 64
#: Of the residuals' shares of capacity: tokens, documents, attention cost.
WEIGHTS = (1.0, 0.01, 0.01)
#: White space of so many characters is cut by hand: the tokenizer's engine gives up at about a million.
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_SPACE},}}")  # Unicode's White_Space

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Tokenizer:
    """Ids of texts by a `tokenizers` file.

    Where the file is plain byte-level BPE whose ids grow in merge order, they
    are tiktoken's ranks, and tiktoken gives the same ids in a quarter of the
    time. Texts that hold an added token, and other kinds of file, are left to
    the `tokenizers` library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [x["content"] for x in made["added_tokens"]]
        self.ranked = self._by_rank(made)

    @staticmethod
    def _by_rank(made: dict):
        kind, before = made["model"], made["pre_tokenizer"] or {}
        plain = kind["type"] == "BPE" and not any(
            kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        level = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not (plain and level) or made["normalizer"] or made["truncation"] or made["post_processor"]:
            return None
        bytes_of = _byte_alphabet()
        vocab, added = kind["vocab"], {x["content"] for x in made["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        single = {t for t in vocab if len(t) == 1}
        if order != sorted(set(order)) or len(single) + len(order) + len(added - single) != len(vocab | dict.fromkeys(added, 0)):
            return None
        if single and order and max(vocab[t] for t in single) > order[0]:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """32-bit little-endian ids."""
        if self.ranked is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) < LONG_SPACE or not (runs := list(_LONG_SPACE.finditer(text))):
            return self._ranked_ids(text)
        parts, at = [], 0
        for run in runs:
            # the pattern takes the whole run at the end of the text, else all but its last character
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts.append(self._ranked_ids(text[at : run.start()]))
            parts.append(np.array(self.ranked._core_bpe.encode_single_piece(text[run.start() : end].encode()), "<u4").tobytes())
            at = end
        return b"".join([*parts, self._ranked_ids(text[at:])])

    def _ranked_ids(self, text: str) -> bytes:
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


def _encode(texts: list[str], path: str) -> list[bytes]:
    return list(map(_tokenizer(path).encode, texts))


def piece_lengths(n: int, most: int) -> list[int]:
    """Whole pieces at the end, what is left over at the start."""
    whole, rest = divmod(n, most)
    return ([rest] if rest else []) + [most] * whole


def tokenised_pieces(docs: DataFrame, path: str, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece."""
    separator = np.array([SEPARATOR], "<u4").tobytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _encode(texts, path)):
            ids += separator
            start = 0
            for i, length in enumerate(piece_lengths(len(ids) // 4, tokens)):
                part = ids[4 * start : 4 * (start + length)]
                for k, v in zip(rows, (doc_id, i, start, length, zlib.crc32(part), part)):
                    rows[k].append(v)
                start += length
        if not with_ids:
            del rows["ids"]
        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(docs, one, _PIECES + (", ids binary" if with_ids else ""))


def best_fit(
    demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, by: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place (sum of the first demand before it) of each item, packed in the given order.

    demands: [items, dimensions], none above its capacity.
    """
    if by not in ("norm", "dot"):
        raise ValueError(f"by must be norm or dot, not {by!r}")
    n = len(demands)
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    scale = weights / capacities.astype(np.float64) ** 2
    left = np.empty((capacities.shape[0], 1024), np.int64)  # residuals of open bins
    names = np.empty(1024, np.int64)
    opened = live = 0
    least_after = np.minimum.accumulate(demands[::-1], axis=0)[::-1] if n else demands
    for i in range(n):
        d = demands[i]
        if i % 512 == 0 and live:  # bins too full for all that is to come are closed
            keep = np.flatnonzero((left[:, :live] >= least_after[i][:, None]).all(axis=0))
            left[:, : len(keep)], names[: len(keep)] = left[:, keep], names[keep]
            live = len(keep)
        after = left[:, :live] - d[:, None]
        fits = np.flatnonzero((after >= 0).all(axis=0))
        if len(fits):
            if by == "norm":
                score = (scale[:, None] * after[:, fits].astype(np.float64) ** 2).sum(axis=0)
            else:
                score = -(scale[:, None] * left[:, fits].astype(np.float64) * d[:, None]).sum(axis=0)
            at = fits[np.argmin(score)]
        else:
            if live == left.shape[1]:
                left, names = np.concatenate([left, left], axis=1), np.concatenate([names, names])
            at = live
            left[:, at], names[at] = capacities, opened
            live += 1
            opened += 1
        bins[i], places[i] = names[at], capacities[0] - left[0, at]
        left[:, at] -= d
    return bins, places


def pack_pieces(
    pieces: DataFrame,
    tokens: int = TOKENS,
    documents: int = DOCUMENTS,
    attention: int | None = None,
    by: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """pieces (a written table, with length) and the columns sequence_id and offset.

    documents and attention: capacities of a sequence, at least 1 and the cost
    of a whole piece; None takes the cost of a whole piece and of one tile.
    """
    attention = tokens * tokens + 2 * TILE if attention is None else attention
    capacities = np.array([tokens, documents, attention], np.int64)
    if documents < 1 or attention < tokens * tokens + TILE:
        raise ValueError("a sequence must have room for a whole piece")
    many = pieces.count()
    shards = max(1, min(max(partitions(pieces.sparkSession), -(-many // shard_pieces)), -(-many // 1000)))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        length = rows.column("length").to_numpy()
        keys = [rows.column(c).fill_null(-1).to_numpy() for c in ("piece", "doc_id")]
        order = np.lexsort([*keys, -length])
        rows, length = rows.take(pa.array(order)), length[order]
        demands = np.stack([length, np.ones_like(length), length * length + TILE], axis=1)
        whole = int((length == tokens).sum())  # they come first, each in a sequence of its own
        bins, places = best_fit(demands[whole:], capacities, np.array(weights), by)
        shard = TaskContext.get().partitionId() << 32
        sequence = shard + np.concatenate([np.arange(whole), bins + whole])
        out = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
        out = out.append_column("offset", pa.array(np.concatenate([np.zeros(whole, np.int64), places])))
        yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.repartition(shards).mapInArrow(run, schema).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, tokens: int = TOKENS, with_ids: bool = False, **options) -> DataFrame:
    """Rows of tokenised_pieces with their sequence and place."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack_pieces(scratch.table(tokenised_pieces(docs, path, tokens, with_ids), "pieces"), tokens, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, 32-bit little-endian) and n_tokens, from pack_documents(..., with_ids=True).

    A group is one sequence, so at most its token capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"), F.sum("length").alias("n_tokens"))
