"""Sidecar lines as columns: parsing, formatting, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions import inf


def parse(line: Column) -> Column:
    """Struct of inf.SCHEMA; what can't be parsed has its reason in error."""

    @F.pandas_udf(inf.SCHEMA)
    def parsed(s):
        import pandas as pd

        names = [x.split()[0] for x in inf.SCHEMA.split(", ")]
        return pd.DataFrame([[d[n] for n in names] for d in map(inf.parse, s)], columns=names)

    return parsed(line)


def format_lines(entries: DataFrame, data: str | None = None, into: str = "inf") -> DataFrame:
    """Adds an entry's line, with the checksums of its data if a column is named. Needs a sidecar access_byte."""
    names = ("directory", "name", "load_addr", "exec_addr", "length", "access_byte", "start_sector")

    @F.pandas_udf("string")
    def lines(rows, content):
        out = []
        for row, x in zip(rows[list(names)].itertuples(index=False), content):
            entry = {n: (None if v is None or v != v else v if isinstance(v, str) else int(v)) for n, v in zip(names, row)}
            out.append(inf.format_entry(entry, None if x is None else bytes(x)))
        return type(content)(out, index=content.index)

    content = F.lit(None).cast("binary") if data is None else F.col(data)
    return entries.withColumn(into, lines(F.struct(*names), content))


def start_sector(extra: Column) -> Column:
    @F.pandas_udf("int")
    def start(s):
        return type(s)([inf.start_sector(dict(x) if x is not None else None) for x in s], index=s.index, dtype="Int32")

    return start(extra)


def checksums(data: Column) -> Column:
    """Struct crc16 (XMODEM) and crc32 of files' bytes; null counts as none."""

    @F.pandas_udf("int")
    def xmodem(s):
        return type(s)([inf.crc16(bytes(x or b"")) for x in s], index=s.index, dtype="int32")

    return F.struct(xmodem(data).alias("crc16"), F.crc32(F.coalesce(data, F.lit(b""))).alias("crc32"))


def mismatches(files: DataFrame, data: str = "data", extra: str = "extra") -> DataFrame:
    """Rows whose stored CRC or CRC32, where readable, isn't that of their data: expected and actual values."""
    stored16 = F.when(F.col(extra)["CRC"].rlike(r"\A[0-9A-Fa-f]{1,8}\z"), F.conv(F.col(extra)["CRC"], 16, 10).cast("long"))
    stored32 = F.when(F.col(extra)["CRC32"].rlike(r"\A[0-9A-Fa-f]{1,8}\z"), F.conv(F.col(extra)["CRC32"], 16, 10).cast("long"))
    summed = files.withColumns({"expected_crc": stored16, "expected_crc32": stored32, "actual": checksums(F.col(data))})
    wrong = (F.col("expected_crc") != F.col("actual.crc16")) | (F.col("expected_crc32") != F.col("actual.crc32"))
    return summed.where(F.coalesce(wrong, F.lit(False)))
