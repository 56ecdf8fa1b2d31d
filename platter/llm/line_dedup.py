"""Line dedup over a sharded minimal perfect hash (operator 7).

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z
lower-cased, as 128 bits of hash. One grouped count finds the keys of at least
`min_chars` code points that at least `min_docs` documents hold, and the
greatest doc_id of each. These keys, split into shards by their hash, are
indexed by a minimal perfect hash: levels of bit vectors in which each key owns
the first bit that no other key of its level hits; a bit's rank is the key's
slot in compact arrays of fingerprints, counts and greatest doc_ids. Shards are
files of a fixed number of keys in the shared folder.

Where all shards fit a worker's `CACHE_BYTES`, documents probe them in place,
in one narrow pass. A larger index would be read again for every batch, so
there the documents' distinct line hashes go to the shards: each task takes the
hashes of its shards in order and loads a shard once; what comes back is the
places of lines to drop, which the documents meet by their key. The few keys
that hold a thousandth of all lines or more are decided before that shuffle, so
no shard is hot. Both ways give the same rows.

The key's 128 bits decide: the slot takes both halves and the stored
fingerprint is the second half, so a line that isn't indexed passes for one
that is with probability of about 2**-64.

Very long texts: time and memory grow with the length, by some 200 bytes a line.

Defined results: null or empty text is one empty line. Rows that repeat a
doc_id are one document when documents are counted, and each is cleaned. A null
doc_id counts as the least of all. Extra columns pass through.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import MASK64, SPACES, Scratch, as_binary, map_batches, sha256_hex

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 200_000
#: Most bytes of loaded shards in a worker.
CACHE_BYTES = 48 << 20
#: Tasks that the lines of a shard are dealt to; a key of 1 / HOT_SHARE of all lines is decided before.
SALTS, HOT_SHARE = 4, 1000
_LEVELS, _GAMMA = 48, 2.0
_NO_ID = -(1 << 63)


def key_hash(line: str) -> int:
    """128 bits of a line's key; bytes.lower() changes A-Z alone."""
    return xxhash.xxh3_128_intdigest(as_binary(line.strip(SPACES)).lower())


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & MASK64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class LineIndex:
    """Minimal perfect hash of one shard with its arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.sizes = arrays["sizes"]
        self.words = arrays["words"]
        self.ranks = arrays["ranks"]
        self.nbytes = sum(a.nbytes for a in arrays.values())

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        """Keys must be distinct."""
        sizes, words, order = [], [], []
        left = np.arange(len(h1))
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-int(_GAMMA * len(left) + 1) // 64) * 64
            at = (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            order.append(left[alone][np.argsort(at[alone])])
            left = left[~alone]
        order.append(left)  # keys that no level could part: found by search
        order = np.concatenate(order).astype(np.int64) if len(h1) else np.empty(0, np.int64)
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        return cls(
            {
                "sizes": np.array(sizes, np.int64),
                "words": flat,
                "ranks": np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.int64)]).astype(np.int64),
                "over1": h1[left],
                "fingerprints": h2[order],
                "counts": counts[order].astype(np.uint32),
                "last": last[order].astype(np.int64),
            }
        )

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = (_mix(h1[todo], h2[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[base + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[base + (at >> 6)] + below)[hit]
            todo = todo[~hit]
            base += size // 64
        over = len(self.arrays["over1"])
        if over:
            start = len(self.arrays["fingerprints"]) - over
            for i in todo.tolist():
                same = np.flatnonzero(
                    (self.arrays["over1"] == h1[i]) & (self.arrays["fingerprints"][start:] == h2[i])
                )
                if len(same):
                    out[i] = start + same[0]
        known = np.flatnonzero(out >= 0)
        out[known[self.arrays["fingerprints"][out[known]] != h2[known]]] = -1
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return cls({k: z[k] for k in z.files})


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.npz"


def _write(name: str, index: LineIndex) -> None:
    """Written whole and then renamed; where an earlier attempt at the task has finished, its bytes are the same."""
    fs, path = _filesystem(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        return
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(index.dump())
    fs.move(part, path)


def _load(folder: str, shard: int) -> LineIndex:
    fs, path = _filesystem(_shard_name(folder, shard))
    with fs.open_input_stream(path) as f:
        return LineIndex.load(f.read())


@dataclass
class Index:
    """Where the shards are, their number and bytes, and (h1, h2, n, last) of the keys."""

    folder: str
    shards: int
    nbytes: int
    frequent: DataFrame


#: Shards of the index that this worker probed last; it holds them all, within CACHE_BYTES.
_held: dict[str, dict[int, LineIndex]] = {}


def _held_shard(folder: str, shard: int) -> LineIndex:
    if folder not in _held:
        _held.clear()
    shards = _held.setdefault(folder, {})
    if shard not in shards:
        shards[shard] = _load(folder, shard)
    return shards[shard]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, k): each document's distinct keys of min_chars code points or more; k is its doc_id."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids: list[int] = []
        both: list[int] = []
        for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
            if text and len(text) >= min_chars:
                found = {key_hash(s) for s in text.split("\n") if len(s) >= min_chars and len(s.strip(SPACES)) >= min_chars}
                both += found
                ids += [k] * len(found)
        h1, h2 = _halves(both)
        return pa.RecordBatch.from_pydict(
            {"h1": h1.view(np.int64), "h2": h2.view(np.int64), "k": pa.array(ids, pa.int64())}
        )

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k")
    return map_batches(docs.select(key, "text"), one, "h1 long, h2 long, k long")


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join([h.to_bytes(16, "little") for h in hashes]), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(data[:, 0]), np.ascontiguousarray(data[:, 1])


def build_index(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> Index:
    """Writes the shards."""
    frequent = scratch.table(
        line_hashes(docs, min_chars)
        .groupBy("h1", "h2")
        .agg(F.count_distinct("k").alias("n"), F.max("k").alias("last"))
        .where(F.col("n") >= min_docs),
        "frequent",
    )
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    folder = scratch.path("index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.record_batch(b) for b in batches]
        whole = pa.Table.from_batches(held) if held else None
        of = whole.column("shard").to_numpy() if whole else np.empty(0, np.int64)
        for shard in np.unique(of).tolist():
            rows = whole.filter(pa.array(of == shard))
            h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            index = LineIndex.build(h1, h2, rows.column("n").to_numpy(), rows.column("last").to_numpy())
            _write(_shard_name(folder, shard), index)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "bytes": pa.array([index.nbytes], pa.int64())})

    of = F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)).cast("int")
    built = (
        frequent.withColumn("shard", of)
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(build, "shard int, bytes long")
        .collect()  # a row a shard
    )
    empty = np.empty(0, np.uint64)
    for shard in set(range(shards)) - {r.shard for r in built}:  # a shard without keys
        _write(_shard_name(folder, shard), LineIndex.build(empty, empty, empty, empty.astype(np.int64)))
    return Index(folder, shards, sum(r.bytes for r in built), frequent)


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _hits(index: LineIndex, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each key is indexed and kept in another document than that of ids."""
    out = np.zeros(len(h1), bool)
    slot = index.slots(h1, h2)
    known = np.flatnonzero(slot >= 0)
    out[known] = index.arrays["last"][slot[known]] != ids[known]
    return out


def _lines(batch: pa.RecordBatch, min_chars: int) -> tuple[list[int], list[int], list[int]]:
    """Row, place in its text and hash of every line whose key has min_chars code points or more."""
    rows, places, hashes = [], [], []
    for n, text in enumerate(batch.column("text").to_pylist()):
        if text and len(text) >= min_chars:
            for i, s in enumerate(text.split("\n")):
                if len(s) >= min_chars and len(s.strip(SPACES)) >= min_chars:
                    rows.append(n)
                    places.append(i)
                    hashes.append(key_hash(s))
    return rows, places, hashes


def _probe(batch: pa.RecordBatch, index: Index, min_chars: int) -> dict[int, set[int]]:
    """Places of the lines to drop, by row, from the held shards."""
    rows, places, hashes = _lines(batch, min_chars)
    h1, h2 = _halves(hashes)
    ids = batch.column(_KEY).to_numpy()[np.array(rows, np.int64)] if rows else np.empty(0, np.int64)
    of = _shard_of(h1, index.shards)
    drop: dict[int, set[int]] = {}
    for shard in np.unique(of).tolist():
        own = np.flatnonzero(of == shard)
        for j in own[_hits(_held_shard(index.folder, shard), h1[own], h2[own], ids[own])].tolist():
            drop.setdefault(rows[j], set()).add(places[j])
    return drop


def probe_sorted(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The rows of (shard, h1, h2, k, text_hash, places), ascending by shard, that are to go; a shard is loaded once. Shard -1 is decided."""
    shard, index = -1, None
    for batch in batches:
        of = batch.column("shard").to_numpy()
        h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        ids, gone = batch.column("k").to_numpy(), of == -1
        for s in np.unique(of[of >= 0]).tolist():
            if s != shard:
                shard, index = s, _load(folder, s)
            own = np.flatnonzero(of == s)
            gone[own] = _hits(index, h1[own], h2[own], ids[own])
        yield batch.select(["k", "text_hash", "places"]).filter(pa.array(gone))


def _routed(docs: DataFrame, index: Index, scratch: Scratch, min_chars: int) -> DataFrame:
    """(key, text_hash, drop): the places of lines to drop, of every text that has some; docs as of _keyed."""
    total = index.frequent.agg(F.sum("n")).first()[0] or 0
    hot = {  # HOT_SHARE keys at most
        (r.h1, r.h2): r.last for r in index.frequent.where(F.col("n") >= max(1, total / HOT_SHARE)).select("h1", "h2", "last").collect()
    }
    folder, shards = index.folder, index.shards

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, hashes = _lines(batch, min_chars)
        by: dict[tuple[int, int], list[int]] = {}
        for n, i, h in zip(rows, places, hashes):
            by.setdefault((n, h), []).append(i)
        h1, h2 = _halves([h for _, h in by])
        of = _shard_of(h1, shards)
        row = np.array([n for n, _ in by], np.int64)
        ids = batch.column(_KEY).to_numpy()[row] if len(row) else np.empty(0, np.int64)
        signed = list(zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist()))
        keep, where = [], list(by.values())
        for j, (key, k) in enumerate(zip(signed, ids.tolist())):
            last = hot.get(key)
            if last != k:
                keep.append(j)
            if last is not None:
                of[j] = -1
        at = pa.array(row[keep])
        return pa.RecordBatch.from_pydict(
            {
                "shard": of[keep],
                "h1": h1.view(np.int64)[keep],
                "h2": h2.view(np.int64)[keep],
                "k": batch.column(_KEY).take(at),
                "text_hash": batch.column(_HASH).take(at),
                "places": pa.array([where[j] for j in keep], pa.list_(pa.int32())),
            }
        )

    lines = map_batches(docs.select(_KEY, _HASH, "text"), one, "shard long, h1 long, h2 long, k long, text_hash long, places array<int>")
    salted = lines.withColumn("salt", F.when(F.col("shard") < 0, F.col("text_hash")).otherwise(F.pmod("text_hash", F.lit(SALTS))))
    gone = (
        salted.repartition("shard", "salt")
        .sortWithinPartitions("shard")
        .drop("salt")
        .mapInArrow(lambda batches: probe_sorted(batches, folder), "k long, text_hash long, places array<int>")
    )
    by_text = gone.groupBy("k", "text_hash").agg(F.flatten(F.collect_list("places")).alias(_DROP))
    return scratch.table(by_text.select(F.col("k").alias(_KEY), F.col("text_hash").alias(_HASH), _DROP), "hits")


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Index | None]:
    """docs with the key and, where lines were routed to the shards, the places to drop; the index to probe in place otherwise."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    index = build_index(docs, scratch, min_chars, min_docs)
    docs = docs.withColumn(_KEY, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    if index.nbytes <= CACHE_BYTES:
        return docs, Index(index.folder, index.shards, index.nbytes, None)
    docs = docs.withColumn(_HASH, F.xxhash64("text"))
    return docs.join(_routed(docs, index, scratch, min_chars), [_KEY, _HASH], "left").drop(_HASH), None


def _clean(batch: pa.RecordBatch, index: Index | None, min_chars: int) -> tuple[list[str], list[int], list[int]]:
    """Kept text, lines before and lines dropped of each row."""
    if index is None:
        drop = {n: set(places) for n, places in enumerate(batch.column(_DROP).to_pylist()) if places}
    else:
        drop = _probe(batch, index, min_chars)
    kept, before = [], []
    for n, text in enumerate(batch.column("text").to_pylist()):
        lines = (text or "").split("\n")
        before.append(len(lines))
        kept.append("\n".join([s for i, s in enumerate(lines) if i not in drop[n]]) if n in drop else text or "")
    return kept, before, [len(drop.get(n, ())) for n in range(len(kept))]


#: Beside the columns of documents.
_KEY, _HASH, _DROP = "__line_dedup_key", "__line_dedup_hash", "__line_dedup_drop"


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The same rows and columns with repeated lines gone from text, and n_chars, where there is one, counted anew.

    A text that loses nothing stays as it is, null too.
    """
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    marked, index = _marked(docs, min_chars, min_docs)
    names, schema = docs.columns, docs.schema

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, _, dropped = _clean(batch, index, min_chars)
        columns = {c: batch.column(c) for c in names}
        texts = [k if n else t for k, n, t in zip(kept, dropped, columns["text"].to_pylist())]
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    return map_batches(marked, one, schema)


def line_dedup_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's SHA-256."""
    marked, index = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, lines, dropped = _clean(batch, index, min_chars)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_lines": pa.array(lines, pa.int64()),
                "n_dropped": pa.array(dropped, pa.int64()),
                "kept_sha256": [sha256_hex(t) for t in kept],
            }
        )

    return map_batches(marked, one, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
