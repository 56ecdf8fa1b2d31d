"""Programs and lines of files: classification, listing, tokenizing, spacing, search.

The state machines run in Arrow batches; gates on metadata are built-in
expressions and come first, so data that no row needs isn't decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import basic
from platter.functions import bytes as B
from platter.functions import slices

LINES = "array<struct<ord:int,line_number:int,text:string>>"


def keywords(spark: SparkSession) -> DataFrame:
    """dialect, ord, token, name and traits of the two dialects."""
    rows = [r for v in ("II", "IV") for r in basic.keyword_rows(v)]
    return spark.createDataFrame(rows, "dialect string, ord int, token int, name string, traits array<string>")


def _starts_program(data: Column) -> Column:
    """What every tokenized program starts with: a carriage return and the high byte of a line number or the end mark."""
    return F.coalesce(F.substring(data, 1, 1) == F.lit(b"\r"), F.lit(False))


def program_size(data: Column) -> Column:
    """Bytes of the tokenized program that data start with; 0 without one. Only data that may be one go to Python."""

    @F.pandas_udf("int")
    def size(s):
        return s.map(lambda x: basic.program_size(bytes(x)) if x is not None else 0).astype("int32")

    return F.when(_starts_program(data), size(F.when(_starts_program(data), data))).otherwise(0)


def classify(is_basic: Column, data: Column) -> Column:
    """BASIC, BASIC+MC, BASIC?, TEXT or BINARY. Only data that may be a program go to Python, null where they don't."""

    @F.pandas_udf("string")
    def kind(gate, s):
        return type(s)([None if x is None else basic.classify(bool(g), bytes(x)) for g, x in zip(gate, s)], index=s.index)

    plain = F.when(B.is_plain_text(F.decode(F.coalesce(data, F.lit(b"")), "ISO-8859-1")), "TEXT").otherwise("BINARY")
    return F.coalesce(
        F.when(_starts_program(data), kind(is_basic, F.when(_starts_program(data), data))),
        F.when(F.coalesce(is_basic, F.lit(False)), "BASIC?").otherwise(plain),
    )


def lines(files: DataFrame, pretty: bool = False, version: str = "II", data: str = "data") -> DataFrame:
    """A row a line of each tokenized program: ord, line_number and text without the number."""

    def listed_lines(x):
        rows = []
        for i, (n, body) in enumerate(basic.records(x or b"")[0]):
            text = basic.decode_line(body, version)
            if pretty:
                text = basic.pretty_line(f"{n:>5d}{text}")[5:] if n < 100000 else text
            rows.append({"ord": i, "line_number": n, "text": text})
        return rows

    listing = slices.per_row(listed_lines, LINES)
    kept = [c for c in files.columns if c not in (data, "line_ord", "line_number", "text")]
    listed = files.select(*kept, F.explode(listing(F.col(data))).alias("__line"))
    return listed.select(
        *kept, F.col("__line.ord").alias("line_ord"), F.col("__line.line_number").alias("line_number"), F.col("__line.text").alias("text")
    )


def list_lines(text: Column, number: Column) -> Column:
    """The line as LIST shows it, its number right-justified in five columns."""
    return F.concat(F.lpad(number.cast("string"), 5, " "), text)


def tokenize(source: Column, version: str = "II", on_overflow: str = "error", strict: bool = False) -> Column:
    """A program of an array of source lines: struct data, warnings, error."""

    def made(lines):
        try:
            data, warnings = basic.tokenize(lines or [], version, on_overflow, strict)
            return {"data": data, "warnings": warnings, "error": None}
        except ValueError as e:
            return {"data": None, "warnings": [], "error": str(e)}

    return slices.per_row(made, "struct<data:binary,warnings:array<string>,error:string>")(source)


def detokenize(data: Column, version: str = "II") -> Column:
    """Array of LIST lines."""

    @F.pandas_udf("array<string>")
    def listed(s):
        return type(s)([basic.detokenize(bytes(x or b""), version) for x in s], index=s.index)

    return listed(data)


def encode_line(text: Column, version: str = "II") -> Column:
    @F.pandas_udf("binary")
    def encoded(s):
        return type(s)([None if x is None else basic.encode_line(x, version) for x in s], index=s.index)

    return encoded(text)


def decode_line(body: Column, version: str = "II") -> Column:
    @F.pandas_udf("string")
    def decoded(s):
        return type(s)([None if x is None else basic.decode_line(bytes(x), version) for x in s], index=s.index)

    return decoded(body)


def _per_text(fn):
    def apply(text: Column, *args) -> Column:
        return slices.per_row(lambda x: None if x is None else fn(x, *args), "string")(text)

    return apply


pretty = _per_text(basic.pretty_line)
compact = _per_text(basic.compact_line)
escape = _per_text(basic.escape)
unescape = _per_text(basic.unescape)


def has_escapes(text: Column) -> Column:
    return text.rlike(r"\\x[0-9A-F]{2}")


def source_lines(data: Column) -> Column:
    """Array of lines of a source file's bytes."""

    @F.pandas_udf("array<string>")
    def split(s):
        return type(s)([basic.source_lines(bytes(x or b"")) for x in s], index=s.index)

    return split(data)


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a line, cut at CR LF, CR and LF alone: line_ord from 0 and line."""
    kept = [c for c in df.columns if c not in (text, "line_ord", "line")]
    cut = F.split(F.col(text), "\\r\\n|\\r|\\n")
    return df.select(*kept, F.posexplode(cut).alias("line_ord", "line"))


def matches(text: Column, pattern: str, ignore_case: bool = False, use_regex: bool = False, engine: str = "java") -> Column:
    """Whether a line has the pattern: literally, or as a Java expression, or as a Python one (in Arrow batches)."""
    import re

    if engine not in ("java", "python"):
        raise ValueError(f"engine must be java or python, not {engine!r}")
    if not use_regex and not ignore_case:
        return text.contains(pattern)
    if use_regex and engine == "python":
        found = re.compile(pattern, re.I if ignore_case else 0)

        @F.pandas_udf("boolean")
        def search(s):
            return s.map(lambda x: x is not None and found.search(x) is not None).astype(bool)

        return search(text)
    source = pattern if use_regex else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text.rlike(("(?iu)" if ignore_case else "") + source)


def search(
    files: DataFrame,
    pattern: str,
    *,
    use_regex: bool = False,
    ignore_case: bool = False,
    engine: str = "java",
    filename: str | None = None,
    pretty: bool = False,
    version: str = "II",
    ordered: bool = True,
) -> DataFrame:
    """Lines of tokenized programs that match: image_id, side, full_name, line_number, line, in disc order.

    That order is a sort of the matches, whose ranges are sampled by a run of
    the whole query: ordered=False saves both.

    The exec address gates first; filename is a full or a bare name, its case
    counts; the number isn't searched.
    """
    scope = files.where("is_basic and not is_directory")
    if filename is not None:
        scope = scope.where((F.col("full_name") == filename) | (F.col("name") == filename))
    scope = scope.where(program_size(F.col("data")) > 0)
    found = lines(scope.select("image_id", "side", "ord", "full_name", "data"), pretty, version)
    found = found.where(matches(F.col("text"), pattern, ignore_case, use_regex, engine))
    if ordered:
        found = found.orderBy("image_id", "side", "ord", "line_ord")
    return found.select(
        "image_id", "side", "full_name", "line_number", F.col("text").alias("line")
    )
