"""Functions of Python values over Arrow batches, a few rows at a time.

A batch has up to 10,000 rows. All of them as Python values, or what is made of them gathered to
their end, are some times the batch: a batch of commands of a few MB became a GB of images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Rows that are Python values at once; rows and bytes of results that are gathered before they are handed on.
ROWS, GATHERED, GATHERED_BYTES = 16, 512, 4 << 20


def map_rows(df: DataFrame, made: Callable[[dict], tuple], ddl: str) -> DataFrame:
    """The row of made(row) for each row, in mapInArrow."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator):
        import pyarrow as pa

        rows, size = [], 0

        def gathered():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    rows.append(made(row))
                    size += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
                    if len(rows) >= GATHERED or size >= GATHERED_BYTES:
                        yield gathered()
                        rows, size = [], 0
        if rows:
            yield gathered()

    return df.mapInArrow(run, ddl)


def per_row(made: Callable, ddl: str) -> Callable[..., Column]:
    """A scalar function of columns: made(values of a row) for each row."""
    kind = to_arrow_type(DataType.fromDDL(ddl))

    @F.arrow_udf(ddl)
    def run(*columns):
        import pyarrow as pa

        parts = []
        for at in range(0, len(columns[0]), ROWS):
            rows = zip(*(c.slice(at, ROWS).to_pylist() for c in columns))
            parts.append(pa.array([made(*row) for row in rows], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run
