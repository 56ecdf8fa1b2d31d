"""Extraction of images into files with sidecars, and building of images from such trees.

Extraction is a table (path, content); `write_tree` stores it below a folder,
partition by partition. Building pairs each file with `file.inf` by an
equi-join, orders the files and assembles each disc in a grouped map.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import access as A
from platter.functions import basic, inf, slices
from platter.functions import bytes as B
from platter.operators import programs, sidecars
from platter.sources import discs, images

MODES = ("ascii", "utf8", "escape")


def _stem(flat: bool) -> Column:
    side = F.when(F.col("side_count") > 1, F.concat(F.lit("side"), F.col("side").cast("string"), F.lit("/"))).otherwise("")
    if flat:
        whole = F.when(F.col("name") == "", F.col("directory")).otherwise(F.concat("directory", F.lit("."), "name"))
        return F.concat(side, B.sanitized(whole))
    return F.concat(side, B.sanitized_directory(F.col("directory")), F.lit("/"), B.sanitized(F.col("name")))


def extract(source: DataFrame, flat: bool = False, pretty: bool = False, text_mode: str = "ascii", with_inf: bool = True) -> DataFrame:
    """image_id, path, type, content: a file each, its sidecar, and `$.inf` of each side.

    Programs become `.bas` source, plain text `.txt` with line feeds, the rest
    and programs with machine code `.bin`. The sidecars' checksums are of the
    disc's bytes. Directories give no file.
    """
    if text_mode not in MODES:
        raise ValueError(f"text_mode must be one of {', '.join(MODES)}, not {text_mode!r}")
    found = images.files(source).withColumn("stem", _stem(flat))
    found = found.withColumn("size", programs.program_size(F.col("data"))).withColumn(
        "type",
        F.when(F.col("is_basic") & (F.col("size") > 0), F.when(F.col("size") < F.length("data") - basic.SLACK, "BASIC+MC").otherwise("BASIC"))
        .when(B.is_plain_text(F.decode("data", "ISO-8859-1")), "text")
        .otherwise("binary"),
    )

    @F.pandas_udf("binary")
    def converted(kind, data):
        out = []
        for k, x in zip(kind, data):
            x = bytes(x)
            if k == "BASIC":
                lines = basic.detokenize(x)
                if pretty:
                    lines = list(map(basic.pretty_line, lines))
                if text_mode == "escape":
                    lines = list(map(basic.escape, lines))
                text = "".join(f"{line}\n" for line in lines)
                x = text.encode("utf-8") if text_mode == "utf8" else text.encode("ascii", "replace")
            elif k == "text":
                x = re.sub(rb"\r\n?", b"\n", x)
            out.append(x)
        return type(data)(out, index=data.index)

    suffix = F.when(F.col("type") == "BASIC", ".bas").when(F.col("type") == "text", ".txt").otherwise(".bin")
    found = found.withColumn("path", F.concat("stem", suffix))
    out = found.select("image_id", "path", "type", converted("type", "data").alias("content"))
    if not with_inf:
        return out
    lines = sidecars.format_lines(found, data="data")
    infs = lines.select("image_id", F.concat("path", F.lit(".inf")).alias("path"), F.lit("inf").alias("type"), F.encode(F.concat("inf", F.lit("\n")), "UTF-8").alias("content"))

    @F.pandas_udf("binary")
    def root(title, boot):
        return type(title)([(inf.format_directory(t, b) + "\n").encode() for t, b in zip(title, boot)], index=title.index)

    info = images.catalogues(source).select("image_id", "side", "side_count", "title", "boot_option")
    where = F.when(F.col("side_count") > 1, F.concat(F.lit("side"), F.col("side").cast("string"), F.lit("/$.inf"))).otherwise("$.inf")
    roots = info.select("image_id", where.alias("path"), F.lit("inf").alias("type"), root("title", "boot_option").alias("content"))
    return out.unionByName(infs).unionByName(roots)


def write_tree(files: DataFrame, folder: str, by_image: bool = True) -> int:
    """Stores the rows of extract below a folder; their number. A second attempt at a task writes the same files."""

    def store(batches: Iterator):
        import pandas as pd
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        n = 0
        for batch in batches:
            for image, path, content in zip(batch.image_id, batch.path, batch.content):
                at = f"{root.rstrip('/')}/{image}/{path}" if by_image else f"{root.rstrip('/')}/{path}"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(bytes(content))
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("image_id", "path", "content").mapInPandas(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content")


def paired(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data files with their parsed sidecars, files without a readable one): path, content, p, problem.

    A side's `$.inf` describes the disc and is in neither.
    """
    is_inf = F.lower("path").endswith(".inf")
    line = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"\A[\r\n]*([^\r\n]*)", 1)
    infs = files.where(is_inf).select(F.expr("left(path, length(path) - 4)").alias("path"), sidecars.parse(line).alias("p"))
    data = files.where(~is_inf).join(infs, "path", "left")
    ready = F.col("p").isNotNull() & F.col("p.error").isNull()
    lost = data.where(~ready).select("path", F.coalesce("p.error", F.lit("no sidecar")).alias("problem"))
    return data.where(ready), lost


def build_images(files: DataFrame, images_: DataFrame, image_of: Column, side_of: Column | None = None, force: bool = False) -> DataFrame:
    """New images from a tree: image_id, content, log.

    images_: image_id, ext, tracks, title, boot_option. Where a side's tree has a
    `$.inf`, that decides title and boot option and the log tells where the
    table says otherwise; with force the table's values win. image_of, side_of: a file's image and side from its path.
    Placed files come first, by ascending end and descending start, so that the
    last writer of a shared sector is the file that reaches furthest; the others
    follow by path. Locks and access bits of the sidecars are kept.
    """
    side = F.lit(0) if side_of is None else side_of
    root = F.col("path").endswith("/$.inf") | (F.col("path") == "$.inf")
    heads = files.where(root).select(image_of.alias("image_id"), side.alias("side"), F.decode("content", "UTF-8").alias("line"))
    data, lost = paired(files.where(~root))
    rows = data.select(image_of.alias("image_id"), F.struct(side.alias("side"), "path", "content", "p").alias("file"))
    grouped = rows.groupBy("image_id").agg(F.collect_list("file").alias("files"))
    titles = heads.groupBy("image_id").agg(F.collect_list(F.struct("side", "line")).alias("heads"))

    def make(r: dict) -> tuple:
        log: list[str] = []
        return r["image_id"], _assemble(SimpleNamespace(**r), log, force), log

    joined = images_.join(grouped, "image_id", "left").join(titles, "image_id", "left")
    return slices.map_rows(joined, make, "image_id string, content binary, log array<string>")


def _value(x):
    return None if x is None or x != x else x


def _assemble(r, log: list[str], force: bool) -> bytes:
    double = r.ext in (".dsd", ".adl")
    tracks, title, boot = (_value(x) for x in (r.tracks, r.title, r.boot_option))
    blank = discs.blank_image(r.ext, int(tracks or 80))
    sides = discs.open_image(blank, "dfs" if r.ext in (".ssd", ".dsd") else "adfs", double)
    described: dict[int, dict] = {}
    for head in r.heads if r.heads is not None else []:
        described[min(int(head["side"]), len(sides) - 1)] = inf.parse(head["line"])["extra"] or {}
    for n, side in enumerate(sides):
        for key, asked, put in (("TITLE", title, side.set_title), ("OPT", None if boot is None else int(boot), side.set_boot)):
            told = described[n].get(key, "" if key == "TITLE" else None) if n in described else None
            if key == "OPT" and told is not None:
                told = int(told) if told.isdecimal() and int(told) in range(4) else None
            if told is not None and not (force and asked is not None):
                if asked is not None and asked != told:
                    log.append(f"$.inf: its {key} {told!r} stands, not {asked!r}")
                _try(log, put, told)
            elif asked is not None:
                _try(log, put, asked)
    todo = []
    for f in r.files if r.files is not None else []:
        p = dict(f["p"])
        extra = dict(p["extra"] or {})
        start = inf.start_sector(extra)
        data = _disc_bytes(f["path"], bytes(f["content"]), int(p["exec_addr"]), log)
        length = p["length"] if _value(p["length"]) is not None else len(data)
        end = None if start is None else start + max(1, discs.sectors_of(int(length))) - 1
        todo.append((start is None, end or 0, -(start or 0), f["path"], int(f["side"]), p, extra, start, data))
    made: set[tuple[int, str]] = set()
    for *_, path, side, p, extra, start, data in sorted(todo, key=lambda t: t[:4]):
        disc = sides[min(side, len(sides) - 1)]
        if disc.format == "adfs":
            for folder in _ancestors(p["directory"]):
                if (side, folder.upper()) not in made:
                    made.add((side, folder.upper()))
                    _try(log, disc.make_directory, folder)
        for key, actual in (("CRC", inf.crc16(data)), ("CRC32", zlib.crc32(data))):
            try:
                if key in extra and int(extra[key], 16) != actual:
                    log.append(f"{path}: {key} is {actual:X}, not {extra[key]}")
            except ValueError:
                log.append(f"{path}: {key}={extra[key]} isn't hexadecimal")
        byte = int(p["access_byte"])
        native = A.native_of(byte) if disc.format == "adfs" else (A.L if byte & 8 else 0)
        name = f"{p['directory']}.{p['name']}"
        _try(log, disc.add, name, data, int(p["load_addr"]), int(p["exec_addr"]), False, start, native)
    return discs.image_bytes(sides, double)


def _ancestors(directory: str) -> list[str]:
    parts = directory.split(".")
    return [".".join(parts[: i + 1]) for i in range(1, len(parts))]


def _disc_bytes(path: str, data: bytes, exec_addr: int, log: list[str]) -> bytes:
    """Source of programs is tokenized, text gets carriage returns."""
    if path.endswith(".txt"):
        return re.sub(rb"\r?\n", b"\r", data)
    if path.endswith(".bas") and exec_addr & 0xFFFF in basic.BASIC_EXEC:
        try:
            data, warnings = basic.tokenize(basic.source_lines(data), on_overflow="compact")
            log += [f"{path}: {w}" for w in warnings]
        except ValueError as e:
            log.append(f"{path}: {e}")
    return data


def _try(log: list[str], fn, *args) -> None:
    try:
        fn(*args)
    except ValueError as e:
        log.append(f"{args[0]}: {e}")
