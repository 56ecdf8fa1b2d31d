"""Changes of images: a table of commands applied to a table of images.

Commands of one image run in the order of seq, each on the result of the one
before; the grouped map holds one image and its commands. A command that fails
changes nothing and is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import basic, slices
from platter.sources import discs
from platter.sources.images import detect_format

#: op is add, delete, rename, attributes, title, boot, compact or mkdir. flag is the lock;
#: text is the new name, the access spec or the title, or `retokenize` for an add whose plain
#: source becomes a program; number the boot option or start sector.
COMMANDS = (
    "image_id string, seq long, side int, op string, path string, data binary, load_addr long, exec_addr long, flag boolean, "
    "text string, number int"
)
RESULT = "image_id string, content binary, changed boolean, log array<struct<seq:bigint,op:string,path:string,won:bigint,error:string>>"


_NEED_PATH = frozenset(("add", "delete", "rename", "attributes", "mkdir"))


def retokenized(data: bytes) -> bytes:
    """Plain source text as a program; programs and other data as they are."""
    if basic.is_program(data) or not basic.is_plain_text(data):
        return data
    return basic.tokenize(basic.source_lines(data))[0]


def _apply(sides: list, c: dict) -> int | None:
    if not 0 <= (c["side"] or 0) < len(sides):
        raise discs.DiscError(f"no side {c['side']}")
    side, op, path = sides[c["side"] or 0], c["op"], c["path"]
    if not path and op in _NEED_PATH:
        raise discs.DiscError(f"{op} needs a path")
    if not c["text"] and op == "rename":
        raise discs.DiscError("rename needs a new name")
    if op == "add":
        data = bytes(c["data"] or b"")
        if c["text"] == "retokenize":
            data = retokenized(data)
        side.add(path, data, c["load_addr"] or 0, c["exec_addr"] or 0, bool(c["flag"]), c["number"])
    elif op == "delete":
        side.delete(path)
    elif op == "rename":
        side.rename(path, c["text"])
    elif op == "attributes":
        side.set_attributes(path, c["load_addr"], c["exec_addr"], c["flag"], c["text"])
    elif op == "title":
        side.set_title(c["text"] or "")
    elif op == "boot":
        side.set_boot(c["number"])
    elif op == "mkdir":
        side.make_directory(path)
    elif op == "compact":
        return side.compact()
    else:
        raise discs.DiscError(f"no command {op!r}")
    return None


def _listed(commands: DataFrame) -> DataFrame:
    """Commands by image, dealt to all cores by number: images of few bytes of commands are large."""
    names = [x.split()[0] for x in COMMANDS.split(", ")]
    spark = commands.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return commands.select(*names).repartition(tasks, "image_id").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("commands"))


def _run(sides: list, todo, log: list[dict]) -> bool:
    """Applies commands in turn; whether one of them changed something."""
    changed = False
    for c in todo:
        try:
            won, error = _apply(sides, c), None
            changed = True
        except ValueError as e:
            won, error = None, str(e)
        log.append({"seq": c["seq"], "op": c["op"], "path": c["path"], "won": won, "error": error})
    return changed


def apply_commands(images: DataFrame, commands: DataFrame) -> DataFrame:
    """image_id, content, changed and log of every image; images without commands pass through."""
    known = detect_format(images.select("image_id", "ext", "content"))

    def applied(r: dict) -> tuple:
        content, log, changed, double = r["content"], [], False, bool(r["double_sided"])
        if r["commands"] is not None:
            try:
                sides = discs.open_image(content, r["format"], double)
                if changed := _run(sides, r["commands"], log):
                    content = discs.image_bytes(sides, double)
            except (discs.DiscError, IndexError) as e:
                log.append({"seq": None, "op": "open", "path": None, "won": None, "error": str(e)})
        return r["image_id"], content, changed, log

    joined = known.select("image_id", "format", "double_sided", "content").join(_listed(commands), "image_id", "left")
    return slices.map_rows(joined, applied, RESULT)


def new_images(commands: DataFrame, ext: str, *, boot_option: int = 0, title: str = "", tracks: int = 80) -> DataFrame:
    """image_id, ext, content and log of a new image for each image_id that commands name, with these applied.

    One shuffle of the commands; blank discs are made where they are filled. An
    image that can't be written has null content and a `save` row in its log.
    """
    return fill_images(_listed(commands), ext, boot_option=boot_option, title=title, tracks=tracks)


def fill_images(listed: DataFrame, ext: str, *, boot_option: int = 0, title: str = "", tracks: int = 80) -> DataFrame:
    """As new_images, of rows that hold all commands of an image (image_id, commands: an array of structs): no shuffle."""
    blank = discs.blank_image(ext, tracks, title, boot_option)
    double, kind = ext in (".dsd", ".adl"), "dfs" if ext in (".ssd", ".dsd") else "adfs"

    def filled(r: dict) -> tuple:
        sides, log = discs.open_image(blank, kind, double), []
        _run(sides, r["commands"], log)
        try:
            content = discs.image_bytes(sides, double)
        except discs.DiscError as e:
            content = None
            log.append({"seq": None, "op": "save", "path": None, "won": None, "error": str(e)})
        return r["image_id"], ext, content, log

    return slices.map_rows(listed.select("image_id", "commands"), filled, RESULT.replace("content binary, changed boolean", "ext string, content binary"))


def commands(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of commands from dicts; seq defaults to the place in the list."""
    names = [x.split()[0] for x in COMMANDS.split(", ")]
    return spark.createDataFrame([tuple({"seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], COMMANDS)


def blank_images(specs: DataFrame) -> DataFrame:
    """content of new images from ext, tracks, title and boot_option; rows pass through."""

    @F.pandas_udf("binary")
    def made(ext, tracks, title, boot):
        return type(ext)([discs.blank_image(*x) for x in zip(ext, tracks.astype(int), title, boot.astype(int))], index=ext.index)

    return specs.withColumn("content", made("ext", "tracks", "title", "boot_option"))


def split_names(path: Column, stem: Column | None = None) -> Column:
    """The two file names of a split image: `STEM-side0.ssd` and `STEM-side1.ssd`, the stem being the path without its extension."""
    whole = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "") if stem is None else stem
    return F.array(*(F.concat(whole, F.lit(f"-side{n}.ssd")) for n in (0, 1)))


def _told(images: DataFrame) -> DataFrame:
    """With format and double_sided; images without ext are told by their bytes."""
    return detect_format(images if "ext" in images.columns else images.withColumn("ext", F.lit(None).cast("string")))


def split_surfaces(images: DataFrame, sequential: bool = False) -> DataFrame:
    """image_id, surface, content and problem: two one-sided images of each two-sided flat one.

    Others have one row, with the problem and a null surface: one-sided and
    hierarchical discs, whose surfaces are no discs, and sizes of no disc.
    """
    from platter.sources.images import TRACK, deinterleave

    size = F.length("content")
    problem = (
        F.when(F.col("format") == "adfs", "the surfaces of a hierarchical disc aren't discs")
        .when(F.col("format").isNull() | ~size.isin(80 * TRACK, 160 * TRACK), "no two-sided disc has this size")
        .when(~F.col("double_sided"), "the disc has one side")
    )
    half = (size / 2).cast("int")
    if sequential:
        sides = F.array(F.substring("content", F.lit(1), half), F.substring("content", half + 1, half))
    else:
        sides = F.array(deinterleave(F.col("content"), 0), deinterleave(F.col("content"), 1))
    nothing = F.array(F.lit(None).cast("binary"))
    told = _told(images).withColumn("problem", problem)
    rows = told.select("image_id", "problem", F.posexplode(F.when(F.col("problem").isNull(), sides).otherwise(nothing)).alias("surface", "content"))
    return rows.select("image_id", F.when(F.col("problem").isNull(), F.col("surface")).alias("surface"), "content", "problem")


def merge_surfaces(first: DataFrame, second: DataFrame, key: str = "image_id", sequential: bool = False) -> DataFrame:
    """key, content and problem: a two-sided image of each pair of one-sided flat ones of equal legal size.

    Other pairs have the problem and null content; rows without a partner too.
    """
    from platter.sources.images import TRACK, interleave

    def side(df: DataFrame, name: str) -> DataFrame:
        told = _told(df.withColumn("image_id", F.col(key).cast("string")) if "image_id" not in df.columns else df)
        flat = (F.col("format") == "dfs") & ~F.col("double_sided") & F.length("content").isin(40 * TRACK, 80 * TRACK)
        return told.select(key, F.col("content").alias(f"__{name}"), F.coalesce(flat, F.lit(False)).alias(f"__{name}_flat"))

    pairs = side(first, "a").join(side(second, "b"), key, "full")
    problem = (
        F.when(F.col("__a").isNull() | F.col("__b").isNull(), "a side is missing")
        .when(~(F.col("__a_flat") & F.col("__b_flat")), "a side isn't a one-sided flat disc")
        .when(F.length("__a") != F.length("__b"), "the sides differ in size")
    )
    whole = F.concat("__a", "__b") if sequential else interleave(F.col("__a"), F.col("__b"))
    return pairs.withColumn("problem", problem).select(key, F.when(F.col("problem").isNull(), whole).alias("content"), "problem")
