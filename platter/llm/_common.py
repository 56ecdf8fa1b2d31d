"""Helpers shared by the operators: written tables in the shared folder, batch adapters, hashing."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session, with its scheme.

    Where none is named a local master, as in tests, gets a temporary one; on a
    cluster that would be a folder of the driver alone, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="platter-shared-")
        spark.sparkContext.setCheckpointDir(named)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString().rstrip("/")


class Scratch:
    """Written tables of one operator call, below the shared folder.

    A table cuts lineage: executors may be lost and the rows are read again,
    not computed again. `drop` deletes a table that later steps don't need; what
    results still read is deleted by `clear_scratch`.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        Scratch.roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this process's operators wrote to the shared folder; their results can't be read after it."""
    while Scratch.roots:
        _delete(spark, Scratch.roots.pop())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_binary(text: str | None) -> bytes:
    """UTF-8; a lone surrogate, which no Parquet text holds, becomes a question mark."""
    return (text or "").encode("utf-8", "replace")


def sha256_hex(text: str | bytes | None) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else as_binary(text)).hexdigest()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch; None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, one row at least, so that long texts don't add up."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, rows * most // max(batch.nbytes, 1))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
