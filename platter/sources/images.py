"""Disc images as tables: images, surfaces and, for flat catalogues, sides and entries.

A row is an image, so parallelism comes from their number, and columns that a
query doesn't ask for are never decoded. Formats, titles, maps, free space and
file bytes are built-in expressions; catalogue rows are listed in Arrow batches. Bytes of sides are made linear once, after which every
file is one substring of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import access as A
from platter.functions import bytes as B
from platter.functions import slices

EXTENSIONS = (".ssd", ".dsd", ".adf", ".adl")
TRACK = 10 * 256
ADFS_TRACK = 16 * 256
LARGEST_ADF = 1280 * 256
HUGO = b"Hugo"
#: Bytes of a side's catalogue or map and root directory.
HEAD = 7 * 256


def name_glob(extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """A pattern of file names with one of the extensions, in any case."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def read_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """image_id, path, ext, length and content of the image files below a path."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", name_glob(extensions)).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        F.sha2(F.col("path").cast("binary"), 256).alias("image_id"),
        "path",
        B.extension(F.col("path")).alias("ext"),
        "length",
        "content",
    )


def _recorded_sectors(content: Column) -> Column:
    return B.u8(content, 256 + 7).bitwiseOR(F.shiftleft(B.u8(content, 256 + 6).bitwiseAND(3), 8))


def detect_format(images: DataFrame) -> DataFrame:
    """Adds format (dfs, adfs, null), double_sided and problem.

    The extension decides between the two filing systems, the bytes where it
    says nothing. Of flat discs the bytes decide whether sides are interleaved:
    102,400 bytes are one side and 409,600 two; 204,800 are two sides of 40
    tracks or one of 80, as the catalogue records; else the extension decides.
    """
    ext, content = F.col("ext"), F.col("content")
    length = F.length(content)
    hugo = B.cut(content, 2 * 256 + 1, 4) == F.lit(HUGO)
    kind = (
        F.when(ext.isin(".ssd", ".dsd"), "dfs")
        .when(ext.isin(".adf", ".adl"), "adfs")
        .when(hugo, "adfs")
        .when(length >= 512, "dfs")
    )
    recorded = _recorded_sectors(content)
    sniffed = (
        F.when(length == 40 * TRACK, False)
        .when(length == 160 * TRACK, True)
        .when((length == 80 * TRACK) & (recorded == 400), True)
        .when((length == 80 * TRACK) & (recorded == 800), False)
    )
    hint = F.when(ext == ".dsd", True).when(ext == ".ssd", False)
    double = F.when(kind == "adfs", (ext == ".adl") | (F.coalesce(ext != ".adf", F.lit(True)) & (length > LARGEST_ADF))).otherwise(
        F.coalesce(sniffed, hint, F.lit(False))
    )
    too_short = F.when(kind == "adfs", length < 7 * 256).otherwise(length < F.when(double, 2 * TRACK).otherwise(512))
    problem = (
        F.when(kind.isNull(), "unknown format")
        .when(too_short, "too short")
        .when((kind == "adfs") & ~hugo, "no root directory")
        .when(
            (kind == "dfs") & hint.isNotNull() & (hint != sniffed),
            F.concat(F.lit("bytes are "), F.when(sniffed, "DSD").otherwise("SSD")),
        )
    )
    fatal = kind.isNull() | too_short | ((kind == "adfs") & ~hugo)
    return images.withColumns(
        {"format": F.when(~fatal, kind), "double_sided": double, "problem": problem, "fatal": F.coalesce(fatal, F.lit(True))}
    )


def _joined(content: Column, first: Column | int, step: int, size: int, count: Column) -> Column:
    """`size` bytes at first, first + step, ... joined; linear in their number, unlike repeated concatenation."""
    parts = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda t: F.hex(B.cut(content, t * step + first, size)))
    return F.when(count > 0, F.unhex(F.array_join(parts, ""))).otherwise(F.lit(b""))


def interleave(first: Column, second: Column, size: int = TRACK) -> Column:
    """Tracks of two surfaces in turn."""
    tracks = F.greatest(F.ceil(F.length(first) / size), F.ceil(F.length(second) / size))
    parts = F.transform(
        F.sequence(F.lit(0), tracks.cast("int") - 1),
        lambda t: F.concat(F.hex(B.cut(first, t * size, size)), F.hex(B.cut(second, t * size, size))),
    )
    return F.when(tracks > 0, F.unhex(F.array_join(parts, ""))).otherwise(F.lit(b""))


def deinterleave(content: Column, surface: int, size: int = TRACK) -> Column:
    """Every other track from a surface's first."""
    tracks = F.ceil((F.length(content) - surface * size) / (2 * size))
    return _joined(content, surface * size, 2 * size, size, tracks)


def surfaces(images: DataFrame, heads: bool = False) -> DataFrame:
    """One row a side of the readable images, its content linear: image_id, ext, format, side, content, side_count; other columns don't pass.

    heads: with a side's first bytes, catalogue or map and root, as head, and the sectors and bytes of all
    directories of a tree. A lambda copies all bytes of a column at each use, so sides are cut up here in
    lambdas over the content itself; these can't stand in a Python function's arguments, from which the explosion keeps them.
    """
    known = detect_format(images.select("image_id", "ext", "content")).where(~F.col("fatal"))
    dfs, double = F.col("format") == "dfs", F.col("double_sided")

    def sides(content):
        flat = F.when(double, F.array(deinterleave(content, 0), deinterleave(content, 1))).otherwise(F.array(content))
        adl = F.concat(deinterleave(content, 0, ADFS_TRACK), deinterleave(content, 1, ADFS_TRACK))
        return F.when(dfs, flat).otherwise(F.array(F.when(double, adl).otherwise(content)))

    linear = F.transform(F.array("content"), sides)[0]
    columns = ["image_id", "ext", "format", "double_sided", F.when(dfs & double, 2).otherwise(1).alias("side_count")]
    if not heads:
        return known.select(*columns, F.posexplode(linear).alias("side", "content"))
    directories = lambda c: F.when(~dfs, _directory_blocks(c)).alias("directories")
    headed = F.transform(linear, lambda c: F.struct(c.alias("content"), B.cut(c, 0, HEAD).alias("head"), directories(c)))
    return known.select(*columns, F.posexplode(headed).alias("side", "__side")).select("*", "__side.*").drop("__side")


ENTRY = (
    "ord int, directory string, name string, full_name string, load_addr long, exec_addr long, length long, "
    "start_sector int, locked boolean, is_directory boolean, access int, sequence int, problem string"
)


def listed_entries(flat: Column, head: Column, directories: Column) -> Column:
    """Array of ENTRY structs of each side, in Arrow batches: catalogue order of flat sides, pre-order of trees.

    A flat side sends its catalogue of 512 bytes alone, a tree what has the marks of directories. Nested lambdas over
    bytes run interpreted and took some hundred times as long for the same rows.
    A directory that an ancestor already is, or that is nested too deep, is
    reported in problem and not entered.
    """
    from platter.sources import discs

    names = [x.split()[0] for x in ENTRY.split(", ")]

    def walk(catalogue, directories):
        rows = discs.list_dfs(catalogue) if catalogue is not None else discs.walk_adfs({x["sector"]: x["block"] for x in directories})
        return [dict(zip(names, (i, *e))) for i, e in enumerate(rows)]

    walked = slices.per_row(walk, "array<struct<" + ", ".join(":".join(x.split()) for x in ENTRY.split(", ")) + ">>")
    return walked(F.when(flat, B.cut(head, 0, 512)), directories)


def _directory_blocks(content: Column) -> Column:
    """Sector and bytes of all that has both marks of a directory; without them, it is broken wherever it is."""
    mark = lambda at: B.cut(content, at, 4) == F.lit(HUGO)
    last = F.floor(F.length(content) / 256).cast("int") - 1
    sectors = F.filter(F.sequence(F.lit(0), last), lambda s: mark(s * 256 + 1) & mark(s * 256 + 0x4FB))
    return F.transform(sectors, lambda s: F.struct(s.alias("sector"), B.cut(content, s * 256, 1280).alias("block")))


def file_bytes(content: Column, start_sector: Column, length: Column) -> Column:
    """A file's bytes on a linear side."""
    return B.cut(content, start_sector * 256, length)


def adfs_map(content: Column) -> Column:
    """Free-space map of a hierarchical disc: total_sectors, disc_id, boot_option, blocks, free_sectors, problem."""
    zero, one = B.cut(content, 0, 256), B.cut(content, 256, 256)
    count = F.floor(B.u8(one, 254) / 3).cast("int")
    blocks = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(B.u24(zero, i * 3).alias("start_sector"), B.u24(one, i * 3).alias("sectors")),
        ),
    ).otherwise(F.array().cast("array<struct<start_sector:int,sectors:int>>"))
    wrong = [B.adfs_checksum(s) != B.u8(s, 255) for s in (zero, one)]
    return F.struct(
        B.u24(zero, 0xFC).alias("total_sectors"),
        B.u16(one, 0xFB).alias("disc_id"),
        B.u8(one, 0xFD).bitwiseAND(3).alias("boot_option"),
        blocks.alias("blocks"),
        F.aggregate(blocks, F.lit(0), lambda t, b: t + b["sectors"]).alias("free_sectors"),
        F.when(wrong[0], "checksum of map sector 0").when(wrong[1], "checksum of map sector 1").alias("problem"),
    )


def adfs_directory(block: Column) -> Column:
    """A decoded directory of 1,280 bytes: name, title, parent_sector, sequence, entries, problem."""
    slot = lambda i: i * 26 + 5
    live = F.filter(F.sequence(F.lit(0), F.lit(46)), lambda i: B.u8(block, slot(i)).bitwiseAND(127) == 0)
    count = F.coalesce(F.array_min(live), F.lit(47))

    def entry(i):
        name = B.cut(block, slot(i), 10)
        access = F.aggregate(
            F.sequence(F.lit(0), F.lit(9)),
            F.lit(0),
            lambda t, k: t + F.when(B.u8(name, k) >= 128, F.pow(F.lit(2), k).cast("int")).otherwise(0),
        )
        return F.struct(
            i.alias("ord"),
            B.terminated(B.seven_bit(name)).alias("name"),
            access.alias("access"),
            B.u32(block, slot(i) + 10).alias("load_addr"),
            B.u32(block, slot(i) + 14).alias("exec_addr"),
            B.u32(block, slot(i) + 18).alias("length"),
            B.u24(block, slot(i) + 22).alias("start_sector"),
            B.u8(block, slot(i) + 25).alias("sequence"),
        )

    return F.struct(
        B.terminated(B.seven_bit(B.cut(block, 0x4CC, 10))).alias("name"),
        B.terminated(B.seven_bit(B.cut(block, 0x4D9, 19))).alias("title"),
        B.u24(block, 0x4D6).alias("parent_sector"),
        B.u8(block, 0).alias("sequence"),
        F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).alias("entries"),
        directory_problem(block).alias("problem"),
    )


def directory_problem(block: Column) -> Column:
    """What is wrong with a directory's marks, or null."""
    return (
        F.when(B.cut(block, 1, 4) != F.lit(HUGO), "header mark")
        .when(B.cut(block, 0x4FB, 4) != F.lit(HUGO), "footer mark")
        .when(B.u8(block, 0) != B.u8(block, 0x4FA), "sequence numbers differ")
    )


COMMON = (
    "image_id side ord directory name full_name load_addr exec_addr length start_sector locked is_directory access_byte "
    "access_string is_basic problem"
).split()


def catalogues(images: DataFrame) -> DataFrame:
    """A row a side with its catalogue as columns: title, cycle, boot_option, disc_size, tracks, free_sectors,
    problem, entries (array of ENTRY) and the linear content. One narrow pass over the images, without a shuffle.

    Free space of a flat disc is what lies after its last file; of a
    hierarchical one the sum of its free blocks.
    """
    sides = surfaces(images, heads=True)
    c, flat = F.col("head"), F.col("format") == "dfs"
    stored, derived = _recorded_sectors(c), F.floor(F.length("content") / 256).cast("int")
    trusted = stored.isin(400, 800) | ~F.floor(derived / 10).isin(40, 80)
    offset = B.u8(c, 256 + 5)
    listed = sides.withColumns(
        {
            "entries": listed_entries(flat, c, F.col("directories")),
            "__map": F.when(~flat, adfs_map(c)),
        }
    )
    size = F.when(flat, F.when(trusted, stored).otherwise(derived)).otherwise(F.col("__map.total_sectors"))
    ends = F.transform("entries", lambda e: F.when(e["length"] > 0, e["start_sector"] + B.sectors(e["length"])).otherwise(F.lit(2).cast("long")))
    above = F.greatest(F.lit(0).cast("long"), size - F.greatest(F.lit(2).cast("long"), F.coalesce(F.array_max(ends), F.lit(2).cast("long"))))
    title = F.regexp_replace(B.seven_bit(F.concat(B.cut(c, 0, 8), B.cut(c, 256, 4))), r"[\x00 ]+\z", "")
    problem = (
        F.when(offset % 8 != 0, "file offset isn't a multiple of 8")
        .when(offset > 248, "more than 31 files")
        .when(size != stored, "stored size replaced by the image's")
    )
    return listed.select(
        "image_id",
        "side",
        "side_count",
        "format",
        F.when(flat, title).otherwise(B.terminated(B.seven_bit(B.cut(c, 512 + 0x4D9, 19)))).alias("title"),
        F.when(flat, B.u8(c, 256 + 4)).otherwise(B.u8(c, 512)).alias("cycle"),
        F.when(flat, F.shiftright(B.u8(c, 256 + 6), 4).bitwiseAND(3)).otherwise(F.col("__map.boot_option")).alias("boot_option"),
        size.alias("disc_size"),
        F.floor(size / F.when(flat, 10).otherwise(16)).cast("int").alias("tracks"),
        F.when(flat, above).otherwise(F.col("__map.free_sectors").cast("long")).alias("free_sectors"),
        F.when(flat, problem).otherwise(F.coalesce(F.col("__map.problem"), directory_problem(B.cut(c, 512, 1280)))).alias("problem"),
        "entries",
        "content",
    )


def side_info(images: DataFrame) -> DataFrame:
    """A row a side: title, cycle, boot_option, disc_size, tracks, entry_count, free_sectors, free_bytes, problem."""
    return catalogues(images).select(
        "image_id", "side", "format", "title", "cycle", "boot_option", "disc_size", "tracks", F.size("entries").alias("entry_count"),
        "free_sectors", (F.col("free_sectors") * 256).alias("free_bytes"), "problem",
    )


def _listed(images: DataFrame, *more: str) -> DataFrame:
    rows = catalogues(images).select("image_id", "side", *more, F.inline("entries"))
    flat = F.col("format") == "dfs"
    return rows.withColumns(
        {
            "access_byte": F.when(flat, F.when(F.col("locked"), 8).otherwise(0)).otherwise(A.to_sidecar(F.col("access"))),
            "access_string": F.when(flat, F.when(F.col("locked"), "L").otherwise("")).otherwise(
                A.access_string(F.col("access"), F.col("is_directory"))
            ),
            "is_basic": ~F.col("is_directory") & B.is_basic_exec(F.col("exec_addr")),
        }
    )


def entries(images: DataFrame) -> DataFrame:
    """Entries of both filing systems."""
    return _listed(images, "format").select(*COMMON)


def files(images: DataFrame) -> DataFrame:
    """Entries that aren't directories, with their data: a substring of the side in the same row."""
    data = file_bytes(F.col("content"), F.col("start_sector"), F.col("length"))
    return _listed(images, "format", "side_count", "content").where("not is_directory").select(*COMMON, "format", "side_count", data.alias("data"))
