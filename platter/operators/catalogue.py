"""Catalogue queries: sort modes, lookups, duplicates, tree walks, path prefixes."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("name", "catalog", "size")


def sort_keys(mode: str, name: str = "full_name", length: str = "length", ordinal: str = "ord") -> list[Column]:
    """Columns of a total order; the ordinal breaks ties as a stable sort would."""
    if mode not in MODES:
        raise ValueError(f"sort mode must be one of {', '.join(MODES)}, not {mode!r}")
    by_name = [F.upper(name), F.col(ordinal)]
    return {"name": by_name, "size": [F.col(length), *by_name], "catalog": [F.col(ordinal)]}[mode]


def sort_catalogue(entries: DataFrame, mode: str = "name") -> DataFrame:
    """Entries of each side in the order of a mode."""
    return entries.orderBy("image_id", "side", *sort_keys(mode))


def ranked(df: DataFrame, by: list[str], mode: str, name: str, length: str, ordinal: str, rank: str = "position") -> DataFrame:
    """Position from 1 in the order of a mode within each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*sort_keys(mode, name, length, ordinal))).cast("long"))


def listing(files: DataFrame, mode: str = "name", inspect: bool = False) -> DataFrame:
    """The `cat` rows: file_type is `BASIC` or null by the exec address alone, or from the content with inspect."""
    from platter.operators.programs import classify

    kind = classify(F.col("is_basic"), F.col("data")) if inspect else F.when(F.col("is_basic"), "BASIC")
    return sort_catalogue(files.withColumn("file_type", kind).drop("data"), mode)


def find(entries: DataFrame, name: str) -> DataFrame:
    """Entries of a name regardless of case: a full name, else a bare one, which must be alone on its image.

    The column ambiguous tells where a bare name has several.
    """
    wanted = name.upper()
    full = F.upper("full_name") == wanted
    either = entries.withColumn("__full", full).where(full | (F.upper("name") == wanted))
    by_image = Window.partitionBy("image_id")
    best = either.withColumn("__any", F.max("__full").over(by_image)).where(F.col("__full") == F.col("__any"))
    return best.withColumn("ambiguous", F.count("*").over(by_image) > 1).drop("__full", "__any")


def attributes(entries: DataFrame, path: str) -> DataFrame:
    """Exact lookup of a path, `$.` before it where it names no directory."""
    path = "$." * (path[1:2] != "." or len(path) < 3) + path
    return entries.where(F.col("full_name") == path)


def duplicate_names(df: DataFrame, group: list[str], name: str, ignore_case: bool = True, count: str = "copies") -> DataFrame:
    """Names that occur more than once in a group, with their number."""
    key = F.upper(name) if ignore_case else F.col(name)
    return df.groupBy(*group, key.alias(name)).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def name_counts(df: DataFrame, group: list[str], name: str, count: str = "same_name") -> DataFrame:
    """Each row with the number of rows of its group that share its name, whatever the case."""
    return df.withColumn(count, F.count("*").over(Window.partitionBy(*group, F.upper(name))))


def directory_prefixes(df: DataFrame, path: str, separator: str = ".", group: list[str] | None = None) -> DataFrame:
    """Every ancestor of every path once: group columns, depth from 1 and prefix; order by depth, prefix to make them."""
    group = group or []
    parts = F.split(F.col(path), f"\\Q{separator}\\E")
    prefixes = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), separator).alias("prefix")),
    )
    return df.select(*group, F.inline(prefixes)).distinct()


def walk_tree(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """key, depth from 0 and path of every node under roots, whose parent is null, however deep.

    A level is one join with the nodes. It is cut off from its lineage by a
    checkpoint, so no level is computed twice. A cycle isn't reached from a root.
    """
    level = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("key"), F.lit(0).alias("depth"), F.col(name).alias("path"))
    children = nodes.select(F.col(key).alias("child"), F.col(parent).alias("key"), F.col(name).alias("leaf"))
    levels = [checkpointed(level)]
    while not levels[-1].isEmpty():
        below = children.join(levels[-1], "key").select(
            F.col("child").alias("key"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("."), "leaf").alias("path")
        )
        levels.append(checkpointed(below))
    return functools.reduce(DataFrame.unionByName, levels)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names in spark.checkpoint.dir; where none is named, a local master gets one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="platter-checkpoints-"))
    return df.checkpoint()


def with_sidecars(files: DataFrame, sidecars: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Files with their sidecar's columns, and the files without one."""
    return files.join(sidecars, key), files.join(sidecars.select(key), key, "left_anti")
