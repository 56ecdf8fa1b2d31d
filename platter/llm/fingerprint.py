"""Document fingerprints by consistent weighted sampling (operator 1).

A text is a multiset of terms: pairs of adjacent words with their counts, or the
word itself where a text has one. Sample d of a term with weight S draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from tables that the term's hash indexes,
quantises ln S to t = floor(ln S / r + b) and scores ln c - r (t - b + 1).
The least score over all terms is the sample. Scores depend on (term, t) alone,
so two texts share a sample with the probability of their generalised Jaccard
similarity, sum of min over sum of max of the weights, and the score's bits
identify the sample. The fingerprint holds 16 bits of each of `SAMPLES`.

Each of r, c and b has its own table, indexed by its own bits of the hash, so a
term has one of 2**36 triples for each sample. Arithmetic is IEEE single
precision; the one logarithm taken, of a count above 1, is rounded from double
precision, so machines agree.

Very long texts: time grows with the length, memory by some 100 bytes a word.

Defined results: null text is the empty text. Empty texts (no word) have the
fingerprint of f digits; they are alike (1.0) to one another, to others 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import partitions, sha256_hex, slices

SAMPLES = 128
TABLE_BITS = 12
#: A word longer than this counts as pieces of PIECE code points: texts without spaces have terms too.
LONGEST_WORD, PIECE = 40, 8
CACHED_WORDS = 300_000
_EMPTY = "f" * (4 * SAMPLES)


class _Words(dict):
    """Word to 64-bit hash, emptied when it holds CACHED_WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_words = _Words()
_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """ln c, r, 1/r and b, of 2**TABLE_BITS rows and SAMPLES columns; the same in every process."""
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(20240607))
        shape = (1 << TABLE_BITS, SAMPLES)
        u = [rng.integers(1, 1 << 53, shape) / float(1 << 53) for _ in range(5)]
        r = -np.log(u[0] * u[1])
        c = -np.log(u[2] * u[3])
        # Rounded so that the last bit of some machine's logarithm doesn't show.
        _tables.extend(np.round(x, 9).astype(np.float32) for x in (np.log(c), r, 1 / r, u[4]))
    return _tables


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, ascending, and their counts."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if max(map(len, words)) > LONGEST_WORD:
        words = [
            w[i : i + PIECE] if len(w) > LONGEST_WORD else w
            for w in words
            for i in range(0, len(w) if len(w) > LONGEST_WORD else 1, PIECE)
        ]
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h, return_counts=True)


def scores(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[terms, SAMPLES] scores."""
    log_c, r, inv_r, b = tables()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    i, j, k = ((hashes >> np.uint64(s) & mask).astype(np.intp) for s in (4, 24, 44))
    rr, out = r[j], b[k]
    if len(many := np.flatnonzero(counts > 1)):  # floor(0 / r + b) is 0 for the others
        log_s = np.log(counts[many].astype(np.float64)).astype(np.float32)[:, None]
        out[many] -= np.floor(log_s * inv_r[j[many]] + out[many])
    out -= np.float32(1)
    out *= rr
    out += log_c[i]
    return out


def _bits(least: np.ndarray) -> np.ndarray:
    return (least.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def signatures(texts: list[str | None], at_once: int = 4096) -> np.ndarray:
    """[texts, SAMPLES] of 16-bit samples; rows of empty texts are all ones. Scores of about at_once terms are held."""
    out = np.full((len(texts), SAMPLES), 0xFFFF, np.uint16)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if todo:
            starts = np.cumsum([0, *(len(h) for _, h, _ in todo[:-1])])
            rows = scores(np.concatenate([h for _, h, _ in todo]), np.concatenate([c for *_, c in todo]))
            out[[n for n, *_ in todo]] = _bits(np.minimum.reduceat(rows, starts, axis=0))
            todo.clear()

    size = 0
    for n, text in enumerate(texts):
        h, c = terms(text)
        if len(h) > at_once:  # a very long text: the least of its parts' least
            parts = [scores(h[i : i + at_once], c[i : i + at_once]).min(axis=0) for i in range(0, len(h), at_once)]
            out[n] = _bits(np.minimum.reduce(parts))
        elif len(h):
            todo.append((n, h, c))
            size += len(h)
            if size >= at_once:
                flush()
                size = 0
    flush()
    return out


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row; 1 for two empty texts, 0 for one."""
    share = (a == b).mean(axis=1)
    none = [(x == 0xFFFF).all(axis=1) for x in (a, b)]
    return np.where(none[0] != none[1], 0.0, share)


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df with the column fingerprint (string): the operator by itself, one narrow pass."""

    @F.pandas_udf("string")
    def of(col):
        return type(col)([to_text(x) for x in signatures(list(col))], index=col.index)

    return df.withColumn("fingerprint", of(F.col(text).cast("string")))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str], following: list[str], sigs: np.ndarray) -> pa.RecordBatch:
    """sigs: of the texts, and of the last row's following text at the end."""
    edited = [edited_text(t, n) for t, n in zip(texts, following)]
    own, nxt, changed = sigs[:-1], sigs[1:], signatures(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array(map(len, texts), pa.int64()),
            "edited_sha256": [sha256_hex(e) for e in edited],
            "fingerprint": [to_text(x) for x in own],
            "edited_fingerprint": [to_text(x) for x in changed],
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, nxt),
        }
    )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Each text against its edit and against the next text by descending doc_id, the first after the last.

    One shuffle of the texts by ranges of doc_id, whose bounds are quantiles of
    doc_id alone, so their number follows the number of partitions and not the
    rows. The first row of each range is sent to the range before too: no
    range waits for another. Ties of doc_id go by the text, null doc_ids come last.
    One document is its own next; no rows give no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(
        key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    parts = partitions(spark)
    cut = docs.agg(
        F.percentile_approx("k", [i / parts for i in range(parts + 1)], 50 * parts).alias("q"), F.max("k").alias("m")
    ).first()
    if cut.m is None:
        return spark.createDataFrame([], _OUT)
    bounds = np.unique(np.array([*cut.q, cut.m], np.int64))  # ascending; a bound is the greatest key of its range
    last = len(bounds) - 1

    @F.pandas_udf("array<int>")
    def where(k):  # ranges number from the greatest keys down
        own = last - np.searchsorted(bounds, k.to_numpy(np.int64))
        head = bounds[last - own] == k.to_numpy(np.int64)
        return type(k)([[o, (o - 1) % (last + 1)] if h else [o] for o, h in zip(own, head)])

    sent = (
        docs.withColumn("to", where("k"))
        .select("k", "doc_id", "text", F.posexplode("to").alias("extra", "range"))
        # An extra copy closes its range, whatever its key: the first range's head comes round to the last range.
        .repartitionById(last + 1, F.col("range"))
        .sortWithinPartitions("range", "extra", F.desc("k"), F.desc("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        kept = np.empty((0, SAMPLES), np.uint16)
        closed = False
        for batch in (part for b in batches for part in slices(b, 4 << 20)):
            if closed:
                continue
            extra = np.flatnonzero(batch.column("extra").to_numpy() == 1)
            upto = int(extra[0]) + 1 if len(extra) else batch.num_rows
            closed = bool(len(extra))
            new = batch.column("text").slice(0, upto).to_pylist()
            ids += batch.column("doc_id").slice(0, upto).to_pylist()
            texts += new
            kept = np.concatenate([kept, signatures(new)])
            if len(texts) > 1:
                yield _rows(ids[:-1], texts[:-1], texts[1:], kept)
                ids, texts, kept = ids[-1:], texts[-1:], kept[-1:]

    return sent.select("extra", "doc_id", "text").mapInArrow(run, _OUT)
