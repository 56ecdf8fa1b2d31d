"""MinHash near-dedup (operator 5).

A document's set holds its distinct shingles of five words, as 64-bit hashes.
Equal sets are one class. Each class has `HASHES` universal-hash minima; bands
of `ROWS` make its buckets. `DESIGNS` has the number of bands by the least
similarity asked for, so two sets at it miss each other with probability 4e-7.
Candidates whose signatures agree in too few minima are dropped (a true link
with probability under 1e-6), the others are confirmed on the full sets by exact integer
arithmetic. Connected components, by alternating large-star and small-star,
give the groups.

No bucket is expanded into its pairs. First each member is compared with the
bucket's least member only; groups of copies become components here. Large
buckets that still hold several components are tried with another member. What
then remains, pairs of one bucket but of two components, is searched by blocks
of signatures, and only pairs whose signatures agree are rows. Members of
buckets of `HOT` or more are first parted by their rarest shingles: two sets of
similarity t share one of the n - ceil(t n) + 1 rarest of each, whatever order
"rare" is, so texts that have only a common template meet in no group. Links
between members of a component that are already joined are not looked for:
components are exact, copies aren't expanded.

Very long texts: time grows with the length, memory by some 100 bytes a word.

Defined results: null and empty texts and texts without a word have an empty
set and link with nothing. Rows that repeat a doc_id are judged each by its
text. A null doc_id links with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm._common import Scratch, as_binary, map_batches
from platter.llm.components import components

SHINGLE = 5
LEAST_PERCENT = 85
HASHES, ROWS = 128, 4
#: Least percent, bands, and least equal minima of a candidate: five standard deviations below the mean at that percent.
DESIGNS = ((85, 20, 88), (80, 28, 79))
#: Buckets of at least so many members get a second pivot; members of a block; partners of a pivot in a task.
LARGE, BLOCK, STAR = 32, 512, 2000
#: Buckets of at least so many members are parted by rare shingles, of which 2**RARE_BITS counters tell how rare.
HOT, RARE_BITS = 512, 20
#: Bits of the filter that keeps most texts that share no bucket from being shuffled; beyond some 10**7 that do it lets more pass.
FILTER_BITS = 24
#: Words remembered by a process, and the most bytes of one.
CACHED_WORDS, CACHED_BYTES = 250_000, 64

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(word) > CACHED_BYTES:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
_family: list[np.ndarray] = []


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends; the same in every process."""
    if not _family:
        rng = np.random.Generator(np.random.PCG64(8_675_309))
        _family.append(rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        _family.append(rng.integers(0, 1 << 64, HASHES, dtype=np.uint64))
    return _family[0], _family[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes. bytes.lower() and bytes.split() know just A-Z and `[\\x20\\x09-\\x0D]`."""
    words = as_binary(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _K[0]
    for i in range(1, SHINGLE):
        s += h[i : i + n] * _K[i]
        s ^= s >> np.uint64(31)
        s *= _K[i - 1]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set, which isn't empty."""
    a, b = hash_family()
    low = s & np.uint64(0xFFFFFFFF)  # ax + b over 32-bit x, of whose 64 bits the upper are compared first
    out = None
    for at in range(0, len(low), 2048):
        least = (low[at : at + 2048, None] * a + b).min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out >> np.uint64(32)


def design(percent: int) -> tuple[int, int]:
    """Bands and least equal minima for links from `percent` on."""
    for least, many, agree in DESIGNS:
        if percent >= least:
            return many, agree
    raise ValueError(f"the bands are made for {DESIGNS[-1][0]} percent or more")


def bands(least: np.ndarray, many: int) -> list[int]:
    """One 64-bit bucket a band, with the band's number in its hash."""
    return [
        int(np.frombuffer(xxhash.xxh3_64_digest(least[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i), np.int64)[0])
        for i in range(many)
    ]


def _signed(docs: DataFrame, many: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (class), buckets and signature; null for documents that link with nothing."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            s = shingles(text)
            if len(s) == 0 or i is None:
                rows.append((i, len(s), None, None, None, None))
                continue
            h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
            least = minima(s)
            rows.append((i, len(s), h1, h2, bands(least, many), least.astype(np.uint16).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        names = ("doc_id", "n_shingles", "h1", "h2", "buckets", "signature")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        one,
        "doc_id long, n_shingles long, h1 long, h2 long, buckets array<long>, signature binary",
    )


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[rows of a, rows of b] equal minima."""
    out = np.empty((len(a), len(b)), np.int16)
    for i in range(len(a)):
        out[i] = (a[i] == b).sum(axis=1)
    return out


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), HASHES)


def _may_link(n: Column, m: Column, percent: int) -> Column:
    """The smaller set is at least `percent` of the larger one."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def similar_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Search:
    """The state of one call: classes, buckets, sets, and the pairs found and refused so far."""

    def __init__(self, docs: DataFrame, percent: int):
        self.scratch = Scratch(docs.sparkSession, "minhash-dedup")
        self.percent = percent
        many, self.agree = design(percent)
        self.docs = docs
        self.signed = self.scratch.table(_signed(docs, many), "signed")
        self.classes = self.scratch.table(
            self.signed.where("h1 is not null")
            .groupBy("h1", "h2")
            .agg(
                F.min("doc_id").alias("rep"),
                F.first("n_shingles").alias("n"),
                F.first("buckets").alias("buckets"),
                F.first("signature").alias("signature"),
            ),
            "classes",
        )
        rows = self.classes.select(F.explode("buckets").alias("bucket"), "rep")
        shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
        self.members = self.scratch.table(rows.join(shared, "bucket"), "members")
        self.sets = None
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.groups: DataFrame | None = None
        self.steps = 0

    def _maybe_of(self, wanted: DataFrame):
        """A test that is true for all reps of wanted and for few others: a bitmap of hashes, of FILTER_BITS at most."""
        words = wanted.selectExpr(
            f"shiftright(xxhash64(rep) & {(1 << FILTER_BITS) - 1}, 6) AS at", "shiftleft(1L, cast(xxhash64(rep) & 63 AS int)) AS bits"
        )
        set_ = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(1 << FILTER_BITS - 6, np.int64)
        bitmap[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()
        sent = wanted.sparkSession.sparkContext.broadcast(bitmap)

        @F.pandas_udf("boolean")
        def maybe(h):
            at = h.to_numpy(np.int64) & ((1 << FILTER_BITS) - 1)
            return type(h)(sent.value[at >> 6] >> (at & 63) & 1 == 1, index=h.index)

        return lambda rep: maybe(F.xxhash64(rep))

    def _make_sets(self) -> None:
        """Full sets of the classes that share a bucket. A doc_id may have rows of other classes: they are told apart."""
        wanted = self.members.select("rep").distinct()
        texts = self.docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where(self._maybe_of(wanted)(F.col("rep")))
        texts = texts.join(wanted.join(self.classes.select("rep", "h1", "h2"), "rep"), "rep")

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for i, text, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("rep", "text", "h1", "h2"))):
                s = shingles(text)
                if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() == [h1, h2]:
                    rows.append((i, h1, h2, s.tobytes()))
            if not rows:
                return None
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ("rep", "h1", "h2", "shingles"))

        made = map_batches(texts.select("rep", "text", "h1", "h2"), one, "rep long, h1 long, h2 long, shingles binary")
        self.sets = self.scratch.table(made.dropDuplicates(["h1", "h2"]).select("rep", "shingles"), "sets")

    def confirm(self, pairs: DataFrame, by_signature: bool) -> None:
        """Adds the pairs (p, x) whose sets are similar to the links; each pair is tried once."""
        self.steps += 1
        name = str(self.steps)
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["p", "x"], "left_anti")
        small = self.classes.select("rep", "n", "signature") if by_signature else self.classes.select("rep", "n")
        pairs = pairs.join(small.toDF(*(f"p_{c}" for c in small.columns)), F.col("p") == F.col("p_rep"))
        pairs = pairs.join(small.toDF(*(f"x_{c}" for c in small.columns)), F.col("x") == F.col("x_rep"))
        if by_signature:
            least = self.agree

            @F.pandas_udf("boolean")
            def agree(a, b):
                return type(a)((_matrix(list(a)) == _matrix(list(b))).sum(axis=1) >= least if len(a) else [], dtype=bool)

            maybe = _may_link(F.col("p_n"), F.col("x_n"), self.percent) & agree("p_signature", "x_signature")
        else:
            maybe = _may_link(F.col("p_n"), F.col("x_n"), self.percent)
        pairs = self.scratch.table(pairs.select("p", "x", maybe.alias("maybe")), f"pairs-{name}")
        self.tried = pairs.select("p", "x") if self.tried is None else self.tried.unionByName(pairs.select("p", "x"))
        pairs = pairs.where("maybe").select("p", "x")
        if pairs.isEmpty():
            return
        if self.sets is None:
            self._make_sets()
        # A pivot with many partners is dealt to several tasks, each with its set.
        stars = pairs.groupBy("p").agg(F.ceil(F.count("*") / STAR).alias("tasks"))
        dealt = pairs.join(stars, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("tasks")).alias("task"))
        partners = dealt.join(self.sets.withColumnRenamed("rep", "x"), "x").select("p", "task", F.lit(1).alias("side"), "x", "shingles")
        pivots = (
            stars.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
            .join(self.sets.withColumnRenamed("rep", "p"), "p")
            .select("p", "task", F.lit(0).alias("side"), F.col("p").alias("x"), "shingles")
        )
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot, own = None, None
            for batch in batches:
                found = []
                for p, side, x, data in zip(*(batch.column(c) for c in ("p", "side", "x", "shingles"))):
                    s = np.frombuffer(data.as_buffer(), np.uint64)
                    if side.as_py() == 0:
                        pivot, own = p.as_py(), s
                    elif pivot == p.as_py() and similar_sets(own, s, percent):
                        found.append((pivot, x.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ("p", "x"))

        streams = partners.unionByName(pivots).repartition("p", "task").sortWithinPartitions("p", "task", "side")
        links = self.scratch.table(streams.select("p", "side", "x", "shingles").mapInArrow(run, "p long, x long"), f"links-{name}")
        self.links = links if self.links is None else self.links.unionByName(links)
        found = components(self.links.select(F.col("p").alias("u"), F.col("x").alias("v")), self.scratch, f"cc-{name}")
        self.groups = self.scratch.table(found, f"groups-{name}")

    def mixed(self) -> DataFrame:
        """Members, with their components, of the buckets that hold more than one component."""
        placed = self.members
        if self.groups is not None:
            placed = placed.join(self.groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
                "component", F.coalesce("component", "rep")
            )
        else:
            placed = placed.withColumn("component", F.col("rep"))
        several = placed.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d")
        return placed.join(several.select("bucket"), "bucket")

    def search(self) -> None:
        self.confirm(self.members.where("rep != pivot").select(F.col("pivot").alias("p"), F.col("rep").alias("x")).distinct(), True)
        # Pairs of a bucket of two have all been tried.
        rest = self.scratch.table(self.mixed().where("size > 2"), "mixed-1")
        large = rest.where(F.col("size") >= LARGE)
        if not large.isEmpty():
            other = large.groupBy("bucket").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("rep", "bucket")).alias("o"))
            pairs = large.join(other, "bucket").where("component != o.component")
            ends = (F.least("rep", "o.rep").alias("p"), F.greatest("rep", "o.rep").alias("x"))
            self.confirm(pairs.select(*ends).distinct(), True)
            rest = self.scratch.table(self.mixed().where("size > 2"), "mixed-2")
        hot = rest.where(F.col("size") >= HOT)
        if not hot.isEmpty():
            rest = rest.where(F.col("size") < HOT).unionByName(self._parted(hot))
        if not rest.isEmpty():
            self.confirm(self._across(rest), False)

    def _parted(self, hot: DataFrame) -> DataFrame:
        """Members of hot buckets by each of their rarest shingles that several components hold, in the form of members."""
        if self.sets is None:
            self._make_sets()
        sets = self.scratch.table(
            hot.select("rep", "component").distinct().join(self.sets, "rep").select("rep", "component", "shingles"), "hot-sets"
        )
        shift, percent = np.uint64(64 - RARE_BITS), self.percent

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << RARE_BITS, np.int64)
            for batch in batches:
                for data in batch.column("shingles"):
                    total += np.bincount((np.frombuffer(data.as_buffer(), np.uint64) >> shift).astype(np.int64), minlength=len(total))
            at = np.flatnonzero(total)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ("at", "n"))

        counted = sets.select("shingles").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counters = np.zeros(1 << RARE_BITS, np.int64)  # the driver's bound: a row a counter
        counters[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
        common = self.classes.sparkSession.sparkContext.broadcast(counters)

        def rarest(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, many = [], []
            for data in batch.column("shingles"):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                keep = len(s) + (-len(s) * percent) // 100 + 1  # n - ceil(t n) + 1
                found.append(s[np.lexsort((s, common.value[(s >> shift).astype(np.int64)]))[:keep]])
                many.append(keep)
            at = pa.array(np.repeat(np.arange(len(many)), many))
            names = ("bucket", "rep", "component")
            tokens = np.concatenate(found) if found else np.empty(0, np.uint64)
            columns = [pa.array(tokens.view(np.int64)), *(batch.column(c).take(at) for c in names[1:])]
            return pa.RecordBatch.from_arrays(columns, names)

        rows = map_batches(sets, rarest, "bucket long, rep long, component long")
        rows = self.scratch.table(rows, "hot-shingles")
        several = rows.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("component").alias("c"), F.max("component").alias("d"), F.min("rep").alias("pivot")
        )
        return rows.join(several.where("c != d").select("bucket", "size", "pivot"), "bucket").select(*hot.columns)

    def _across(self, rest: DataFrame) -> DataFrame:
        """Pairs of one bucket and two components whose signatures agree, by blocks of a bucket."""
        blocks = F.ceil(F.col("size") / BLOCK)
        own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        least = self.agree
        rows = (
            rest.join(self.classes.select("rep", "signature"), "rep")
            .withColumn("blocks", blocks)
            .withColumn("block", own)
            .withColumn(
                "task",
                F.explode(
                    F.transform(
                        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b")),
                    )
                ),
            )
            .select("bucket", "task.a", "task.b", "block", "rep", "component", "signature")
        )

        def compare(ids: np.ndarray, of: np.ndarray, block: np.ndarray, m: np.ndarray, a: int, b: int):
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            if len(left) and len(right):
                hit = (agreement(m[left], m[right]) >= least) & (of[left][:, None] != of[right][None, :])
                for i, j in zip(*np.nonzero(hit)):
                    p, x = int(ids[left[i]]), int(ids[right[j]])
                    if a != b or p < x:
                        yield (min(p, x), max(p, x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Groups arrive sorted; one, of two blocks at most, is held."""
            held: list[tuple] = []
            key = None

            def flush():
                if len(held) < 2:
                    return []
                ids, of, block = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
                return list(compare(ids, of, block, _matrix([h[3] for h in held]), key[1], key[2]))

            def table(found):
                return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ("p", "x"))

            for batch in batches:
                names = ("bucket", "a", "b", "rep", "component", "block", "signature")
                out = []
                for bucket, a, b, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                    if (bucket, a, b) != key:
                        out += flush()
                        held, key = [], (bucket, a, b)
                    held.append(row)
                if out:
                    yield table(out)
            if out := flush():
                yield table(out)

        sorted_ = rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
        return sorted_.mapInArrow(run, "p long, x long").distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row."""
        found = self.classes.select("h1", "h2", "rep")
        if self.groups is not None:
            found = found.join(self.groups.withColumnRenamed("node", "rep"), "rep", "left")
        else:
            found = found.withColumn("component", F.col("rep"))
        found = self.scratch.table(found.select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "found")
        out = self.signed.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
        component = F.coalesce("component_id", "doc_id")
        return out.select(
            "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
        )


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. percent: links from this similarity on, 80 at least (the bands' design)."""
    search = _Search(docs, percent)
    search.search()
    return search.result()


def drop_near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """The rows and columns of docs without those that aren't their group's least doc_id.

    Rows that repeat a doc_id stand together: they stay if one of them is kept.
    """
    judged = near_duplicates(docs, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = judged.where("not kept").select("doc_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
