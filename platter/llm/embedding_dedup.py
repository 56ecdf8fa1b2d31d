"""Embedding near-dedup by spherical k-means cells and blocked cosines (operator 4).

Equal vectors are one class, with a count. Spherical k-means, fitted to a
bounded sample, gives each its cell. Of a pair in two cells, each vector must
lie near the plane between them: for unit vectors u, v of cosine `least` or
more, v is beyond that plane, so the margin u.(c_i - c_j) of u's home over the
other cell is at most sqrt(1 - least^2) |c_i - c_j|. Only vectors that keep this
are compared between cells. This finds every pair, whatever the spread of
the vectors. A number as `probe` takes so many standard deviations of an
isotropic difference instead, sqrt(2 - 2 least) / sqrt(dimension) each: fewer
comparisons, but pairs are lost where differences aren't isotropic.

A cell's vectors are written once, as files of at most `BLOCK` in the shared
folder. A task holds some `HOLD` components of blocks and reads the blocks that
it compares them with one after another, so no vector is copied between cells
and neither memory nor disk grows with the cells. At most `MOST_CELLS` cells are
made, and vectors that spread alike in all dimensions leave little out, so the
work grows with the square of the rows; README has figures.

A task multiplies tile by tile, first an upper bound of the cosines: the product
of the vectors' parts in the sample's leading directions and the product of the
lengths of the rest, by Cauchy-Schwarz, in single precision with a bound of its
error. Where that leaves a link possible, whole vectors are multiplied, in the
end in double precision. A task returns, per vector, the weight of its links and
one edge to its local root: pairs are never rows. Components of these edges, by
alternating stars, give the groups; the least vec_id of each is kept.

Defined results: a null or empty vector, one with a null or non-finite
component, and the zero vector link with nothing and are kept. Vectors of
different dimensions don't link. Rows that repeat a vec_id with an equal vector
count as one vector. A null vec_id links with nothing; its component is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import Scratch, map_batches, partitions
from platter.llm.components import components
from platter.llm.line_dedup import _filesystem

LEAST = 0.9
PROBE = None
CELL_VECTORS, MOST_CELLS = 1500, 2048
#: Rows and floats of the sample, and the least sampled rows of a cell.
SAMPLE_ROWS, SAMPLE_FLOATS, CELL_SAMPLE = 20_000, 8_000_000, 8
#: Most vectors of a block, and about as many components at most.
BLOCK, BLOCK_FLOATS = 2048, 1 << 20
#: Components of the blocks that a task holds, and products that it computes.
HOLD, WORK = 1 << 22, 1 << 38
#: Numbers of leading directions to choose from, and the share of pairs, beside as many as link, that their bound may leave in vain.
LEADING, LEAVE = (8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128), 1e-5
#: Most entries of a matrix of vectors by cells.
TILE = 1 << 20


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row and its product with that centroid; a matrix of TILE entries is held."""
    step = max(1, TILE // len(centres))
    tiles = (x[at : at + step] @ centres.T for at in range(0, len(x), step))
    home, best = zip(*((t.argmax(axis=1), t.max(axis=1)) for t in tiles))
    return np.concatenate(home), np.concatenate(best)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows; a cell that empties takes the row that its own centroid fits worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home, best = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        worst = np.argsort(best)
        for i, j in enumerate(np.flatnonzero(np.einsum("ij,ij->i", sums, sums) < 1e-18)):
            sums[j] = x[worst[i % len(worst)]]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def reach_of(dim: int, least: float, probe: float | None) -> float:
    """Greatest margin of a home over another cell, by the distance of their centroids, with links into that cell."""
    reach = np.sqrt(max(0.0, 1 - least * least)) if least > 0 else 1.0
    return reach if probe is None else min(reach, probe * np.sqrt(max(0.0, 2 - 2 * least) / dim))


def near_plane(x: np.ndarray, home: np.ndarray, other: np.ndarray, reach: float) -> np.ndarray:
    """Which unit rows of the cell `home` may link into the cell `other`, by the centroids."""
    across = home - other
    return x @ across <= reach * np.linalg.norm(across) + 1e-12


def cells_of(x: np.ndarray, centres: np.ndarray, least: float, probe: float | None) -> list[np.ndarray]:
    """Home cell of each unit row, then the higher cells it may link into: `near_plane` for all cells, in tiles."""
    reach = reach_of(x.shape[1], least, probe)
    out: list[np.ndarray] = []
    step = max(1, TILE // len(centres))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ centres.T
        home = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
        margin = near[np.arange(len(near)), home][:, None] - near
        copied = (margin <= reach * apart + 1e-12) & (np.arange(len(centres)) > home[:, None])
        out += [np.concatenate([[h], np.flatnonzero(c)]) for h, c in zip(home, copied)]
    return out


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Each row's vector, or None where it links with nothing."""
    out: list[np.ndarray | None] = []
    for v in batch.column("embedding"):
        values = v.values if v.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False)
        x = x if x.dtype in (np.float32, np.float64) else x.astype(np.float64)
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _classes(df: DataFrame) -> DataFrame:
    """vec_id, h1, h2 (null for vectors that don't link), x: the vector's own bytes, wide: bytes a component, dim."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, x in zip(batch.column("vec_id").to_pylist(), _vectors(batch)):
            if x is None or i is None:
                rows.append((i, None, None, None, None, None))
            else:
                x = x + x.dtype.type(0)  # -0.0 is 0.0
                data = x.tobytes()
                h = xxhash.xxh3_128_digest(data + x.dtype.char.encode())
                rows.append((i, *np.frombuffer(h, np.int64).tolist(), data, x.itemsize, len(x)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        names = ("vec_id", "h1", "h2", "x", "wide", "dim")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return map_batches(
        df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
        one,
        "vec_id long, h1 long, h2 long, x binary, wide int, dim int",
    )


def _matrix(data: list[bytes], wide: int) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(data), np.float32 if wide == 4 else np.float64).reshape(len(data), -1))


def leading_directions(x: np.ndarray, least: float, seed: int = 5) -> np.ndarray | None:
    """Orthonormal columns, as few as leave little of the sample's unlinked pairs; None where whole vectors cost no more."""
    dim = x.shape[1]
    most = max((p for p in LEADING if p <= dim * 0.75), default=0)
    if not most:
        return None
    basis = np.random.default_rng(seed).normal(size=(dim, most))
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    part = x @ basis
    basis = basis @ np.linalg.eigh(part.T @ part)[1][:, ::-1]
    basis = np.linalg.qr(basis)[0]  # any orthonormal columns give a bound
    x = x[:1500]
    apart = x @ x.T < least
    leave = LEAVE + max(0.0, (~apart).mean() - 1 / len(x))
    for p in (p for p in LEADING if p <= most):
        part = with_rest(x, basis[:, :p])
        if (apart & (part @ part.T >= least)).mean() <= leave:
            return np.ascontiguousarray(basis[:, :p])
    return None


def with_rest(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Components of unit rows along the basis, then the length of the rest, which rounding may only raise."""
    part = x @ basis
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", part, part)) + 1e-13)
    return np.concatenate([part, rest[:, None]], axis=1)


class Block:
    """Vectors of one cell: ids, numbers of equal ones, unit rows, these in single precision, and their leading parts."""

    def __init__(self, cell: int, ids: np.ndarray, n: np.ndarray, x: np.ndarray, single: np.ndarray, leading: np.ndarray | None):
        self.cell, self.ids, self.n, self.x, self.single, self.leading = cell, ids, n, x, single, leading

    def where(self, keep: np.ndarray) -> Block:
        leading = None if self.leading is None else self.leading[keep]
        return Block(self.cell, self.ids[keep], self.n[keep], self.x[keep], self.single[keep], leading)

    @staticmethod
    def dump(ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> bytes:
        return ids.astype(np.int64).tobytes() + n.astype(np.int64).tobytes() + b"".join(data)

    @classmethod
    def read(cls, name: str, cell: int, rows: int, wide: int, basis: np.ndarray | None) -> Block:
        fs, path = _filesystem(name)
        with fs.open_input_stream(path) as f:
            data = f.read()
        ids, n = np.frombuffer(data, np.int64, 2 * rows).reshape(2, rows)
        x = np.frombuffer(data, np.float32 if wide == 4 else np.float64, offset=16 * rows)
        x = unit_rows(x.reshape(rows, -1))
        return cls(cell, ids, n, x, x.astype(np.float32), None if basis is None else with_rest(x, basis).astype(np.float32))


def _roots(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name that each row and each column reaches by the True entries."""
    names, ranks = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    ranks = ranks.astype(np.int16 if len(names) < 1 << 15 else np.int64)  # short ones are some 4 times as fast
    top = np.iinfo(ranks.dtype).max
    rows, cols = ranks[: len(rows)], ranks[len(rows) :]
    while True:
        new_cols = np.minimum(cols, np.where(hit, rows[:, None], top).min(axis=0))
        new_rows = np.minimum(rows, np.where(hit, new_cols[None, :], top).min(axis=1))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return names[rows], names[cols]
        rows, cols = new_rows, new_cols


def possible(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b, in single precision, that have a product of `least` or more but for rounding; same: of two rows."""
    # A sum of d products of single precision, in any order, and its rounded factors.
    least -= (a.shape[1] + 4) * 2.0**-24
    rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
    step = 512
    for at in range(0, len(a), step):
        for to in range(at if same else 0, len(b), step):
            tile = a[at : at + step] @ b[to : to + step].T
            if same and at == to:
                np.fill_diagonal(tile, -2)
            if tile.max() >= least:
                hit = tile >= least
                rows[at : at + step] |= hit.any(axis=1)
                cols[to : to + step] |= hit.any(axis=0)
    if same:
        rows = cols = rows | cols
    return np.flatnonzero(rows), np.flatnonzero(cols)


def compare_blocks(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, root and weight of its links of every vector that links; a may be b."""
    same = a is b
    r, c = np.arange(len(a.ids)), np.arange(len(b.ids))
    if a.leading is not None and b.leading is not None:
        r, c = possible(a.leading, b.leading, least, same)
    if len(r):
        i, j = possible(a.single[r], b.single[c], least, same)
        r, c = r[i], c[j]
    if not len(r):
        return (np.empty(0, np.int64),) * 3
    hit = a.x[r] @ b.x[c].T >= least
    if same:
        hit |= hit.T
        np.fill_diagonal(hit, False)
    r_roots, c_roots = _roots(hit, a.ids[r], b.ids[c])
    hit = hit.astype(np.float64)  # sums of whole numbers below 2**53 are exact
    if same:  # the roots of one vector as row and as column are the same component's
        ids, roots, weights = a.ids[r], np.minimum(r_roots, c_roots), hit @ a.n[r].astype(np.float64)
    else:
        ids, roots = np.concatenate([a.ids[r], b.ids[c]]), np.concatenate([r_roots, c_roots])
        weights = np.concatenate([hit @ b.n[c].astype(np.float64), a.n[r].astype(np.float64) @ hit])
    weights = weights.astype(np.int64)
    keep = weights > 0
    return ids[keep], roots[keep], weights[keep]


def gather(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each vector of the parts: its least name by all their edges, and its weight."""
    u, root, weight = (np.concatenate(x) for x in zip(*parts))
    ids, ends = np.unique(np.concatenate([u, root]), return_inverse=True)
    u, root = ends[: len(u)], ends[len(u) :]
    name = np.arange(len(ids))
    while True:
        least = np.minimum(name[u], name[root])
        new = name.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, root, least)
        new = new[new]
        if (new == name).all():
            break
        name = new
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, u, weight)
    return ids, ids[name], total


def plan_tasks(blocks: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to): every two blocks (cell, rows, dim), sorted by cell, meet in one task, a block with itself too.

    A negative cell holds one of the rarer dimensions and meets itself alone.
    parts: tasks at least, where the blocks allow it.
    """
    out: list[tuple[int, int, int, int]] = []
    shared = next((i for i, x in enumerate(blocks) if x[0] >= 0), len(blocks))
    spans, at = [], 0
    while at < shared:
        end = next((i for i in range(at, shared) if blocks[i][0] != blocks[at][0]), shared)
        spans.append((at, end))
        at = end
    spans.append((shared, len(blocks)))
    work = sum(sum(x[1] for x in blocks[i:j]) ** 2 * blocks[i][2] for i, j in spans if i < j) // 2
    most = min(WORK, work // parts)
    for first, last in spans:
        at = first
        while at < last:
            end, held, rows = at, 0, 0
            while end < last and (end == at or held + blocks[end][1] * blocks[end][2] <= HOLD):
                held, rows, end = held + blocks[end][1] * blocks[end][2], rows + blocks[end][1], end + 1
            start, done = at, 0
            for b in range(at, last):
                done += held * blocks[b][1]
                if done >= most or b == last - 1:
                    out.append((at, end, start, b + 1))
                    start, done = b + 1, 0
            at = end
    return out


def link_classes(reps: DataFrame, scratch: Scratch, least: float, probe: float | None) -> DataFrame:
    """(u, root, weight) of classes that link, once for each task that found some; reps is a written table."""
    spark = reps.sparkSession
    dims = {r.dim: r["count"] for r in reps.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}
    if not dims:
        return spark.createDataFrame([], "u long, root long, weight long")
    dim = next(iter(dims))
    rows = min(SAMPLE_ROWS, max(64, SAMPLE_FLOATS // dim))
    of = reps.where(F.col("dim") == dim)
    if dims[dim] > 2 * rows:  # else every task sends the driver as many rows as the whole sample has
        of = of.where(F.xxhash64("h1") < int(-(2**63) + 2**64 * 1.5 * rows / dims[dim]))
    sample = of.orderBy(F.xxhash64("h1"), "h2").limit(rows).select("x", "wide").collect()
    cells = int(max(1, min(MOST_CELLS, round(dims[dim] / CELL_VECTORS), len(sample) // CELL_SAMPLE)))
    x = np.concatenate([unit_rows(np.frombuffer(r.x, np.float32 if r.wide == 4 else np.float64)[None]) for r in sample])
    centres = spark.sparkContext.broadcast(fit_cells(x, cells))  # MOST_CELLS rows at most
    basis = spark.sparkContext.broadcast(leading_directions(x, least))
    folder, most = scratch.path("blocks"), BLOCK
    reach = reach_of(dim, least, probe)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide, dims_, data = (batch.column(c).to_pylist() for c in ("wide", "dim", "x"))
        cell = np.array([-1 - d for d in dims_], np.int64)  # other dimensions: a cell each, cut to blocks like any
        for w in (4, 8):
            own = [i for i in range(len(data)) if dims_[i] == dim and wide[i] == w]
            if own:
                cell[own] = nearest(_matrix([data[i] for i in own], w), centres.value)[0]
        return batch.select(["rep", "n", "x", "wide", "dim"]).append_column("cell", pa.array(cell))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and wide; those of an attempt that failed are files that no row names."""
        held: list[pa.RecordBatch] = []
        key: tuple = ()

        def put() -> pa.RecordBatch:
            block = pa.Table.from_batches(held)
            held.clear()
            name = f"{folder}/{uuid.uuid4().hex}"
            fs, path = _filesystem(name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(Block.dump(block.column("rep").to_numpy(), block.column("n").to_numpy(), block.column("x").to_pylist()))
            return pa.RecordBatch.from_pylist([{"cell": key[0], "wide": key[1], "dim": key[2], "rows": block.num_rows, "name": name}], kinds)

        kinds = pa.schema({"cell": pa.int64(), "wide": pa.int32(), "dim": pa.int32(), "rows": pa.int64(), "name": pa.string()})
        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in ("cell", "wide", "dim")], axis=1)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), len(of)]
            for at, end in zip(cuts, cuts[1:]):
                if at < end and key != tuple(of[at].tolist()):
                    if held:
                        yield put()
                    key = tuple(of[at].tolist())
                while at < end:
                    step = min(end - at, max(1, min(most, BLOCK_FLOATS // key[2])) - sum(x.num_rows for x in held))
                    held.append(batch.slice(at, step))
                    at += step
                    if sum(x.num_rows for x in held) >= max(1, min(most, BLOCK_FLOATS // key[2])):
                        yield put()
        if held:
            yield put()

    placed = map_batches(reps.select("rep", "n", "x", "wide", "dim"), assign, "rep long, n long, x binary, wide int, dim int, cell long")
    written = scratch.table(
        placed.repartition("cell")
        .sortWithinPartitions("cell", "wide", "rep")
        .mapInArrow(write, "cell long, wide int, dim int, rows long, name string"),
        "written",
    )
    blocks = [tuple(r) for r in written.orderBy("cell", "wide", "name").collect()]  # a row a block
    tasks = plan_tasks([(cell, rows, d) for cell, _, d, rows, _ in blocks], 4 * partitions(spark))
    named, todo = spark.sparkContext.broadcast(blocks), spark.sparkContext.broadcast(tasks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(i: int) -> Block:
            cell, wide, _, rows, name = named.value[i]
            return Block.read(name, cell, rows, wide, basis.value if cell >= 0 else None)

        for i in [i for batch in batches for i in batch.column(0).to_pylist()]:
            a_from, a_to, b_from, b_to = todo.value[i]
            mine = {k: read(k) for k in range(a_from, min(a_to, b_to))}
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(b_from, b_to):
                b = mine[k] if k in mine else read(k)
                for at, a in mine.items():
                    if at > k:
                        break
                    if a.cell == b.cell:
                        found.append(compare_blocks(a, b, least))
                        continue
                    home, other, two = centres.value[a.cell], centres.value[b.cell], (a, b)
                    # Every 16th row tells whether copying the rest saves more than it costs.
                    if probe is not None or near_plane(a.x[::16], home, other, reach).mean() * near_plane(b.x[::16], other, home, reach).mean() < 0.7:
                        near = near_plane(a.x, home, other, reach)
                        far = near_plane(b.x, other, home, reach) if probe is None else np.ones(len(b.ids), bool)
                        two = a.where(near), b.where(far)
                    found.append(compare_blocks(*two, least))
                found = [gather(found)] if sum(len(x[0]) for x in found) > 1 << 20 else [x for x in found if len(x[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in gather(found)], ["u", "root", "weight"])

    return spark.range(len(tasks), numPartitions=len(tasks)).mapInArrow(compare, "u long, root long, weight long")


def dedup_embeddings(df: DataFrame, least: float = LEAST, probe: float | None = PROBE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of df (vec_id, embedding)."""
    scratch = Scratch(df.sparkSession, "embedding-dedup")
    vectors = scratch.table(_classes(df), "vectors")
    classes = scratch.table(
        vectors.where("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.min("x").alias("x"), F.min("wide").alias("wide"), F.min("dim").alias("dim")),
        "classes",
    )
    # Later steps need no components: these tables go as soon as they are read.
    all_ = scratch.table(vectors.select("vec_id", "h1", "h2"), "ids")
    scratch.drop("vectors")
    links = scratch.table(link_classes(classes, scratch, least, probe), "links")
    reps = scratch.table(classes.select("h1", "h2", "rep", "n"), "reps")
    for done in ("classes", "blocks"):
        scratch.drop(done)
    groups = components(links.select("u", F.col("root").alias("v")), scratch)
    weights = links.groupBy(F.col("u").alias("rep")).agg(F.sum("weight").alias("weight"))
    found = (
        reps.select("h1", "h2", "rep", "n")
        .join(weights, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    found = scratch.table(found, "found")
    out = all_.join(found, ["h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
