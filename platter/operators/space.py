"""Space on discs as windows and interval joins: allocation, compaction, free blocks, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_SECTOR = 2


def allocate(df: DataFrame, disc: list[str], order: list[str], sectors: str, first: int | str = FIRST_SECTOR) -> DataFrame:
    """Adds start_sector: items packed upwards in the given total order from `first`, a number or a column.

    Bottom-up allocation of new files and, ordered by their old starts,
    compaction. Items without sectors take the place where the next one starts.
    """
    before = Window.partitionBy(*disc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(first) if isinstance(first, int) else F.col(first)
    return df.withColumn("start_sector", (base + F.coalesce(F.sum(sectors).over(before), F.lit(0))).cast("long"))


def compact(df: DataFrame, disc: list[str], start: str, ordinal: str, sectors: str) -> DataFrame:
    """Adds new_start: files moved down to sector 2 in the order of their starts."""
    moved = allocate(df.withColumnRenamed("start_sector", "__old") if start == "start_sector" else df, disc, ["__old" if start == "start_sector" else start, ordinal], sectors)
    moved = moved.withColumnRenamed("start_sector", "new_start")
    return moved.withColumnRenamed("__old", "start_sector") if start == "start_sector" else moved


def free_space(df: DataFrame, disc: list[str], start: str, sectors: str, disc_size: int | str) -> DataFrame:
    """next_free, free_sectors and free_bytes of flat discs: all above the last file that has sectors."""
    size = F.lit(disc_size) if isinstance(disc_size, int) else F.max(disc_size)
    end = F.max(F.when(F.col(sectors) > 0, F.col(start) + F.col(sectors)))
    out = df.groupBy(*disc).agg(F.greatest(F.lit(FIRST_SECTOR).cast("long"), F.coalesce(end, F.lit(FIRST_SECTOR)).cast("long")).alias("next_free"), size.cast("long").alias("__size"))
    free = F.greatest(F.lit(0).cast("long"), F.col("__size") - F.col("next_free"))
    return out.select(*disc, "next_free", free.alias("free_sectors"), (free * 256).alias("free_bytes"))


def coalesce_blocks(df: DataFrame, disc: list[str], start: str, sectors: str) -> DataFrame:
    """Free blocks that touch or overlap merged: disc columns, start_sector, sectors."""
    order = Window.partitionBy(*disc).orderBy(start, sectors)
    reach = F.max(F.col(start) + F.col(sectors)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(sectors) > 0).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*disc, "__island")
        .agg(F.min(start).cast("long").alias("start_sector"), F.max(F.col(start) + F.col(sectors)).cast("long").alias("__end"))
        .select(*disc, "start_sector", (F.col("__end") - F.col("start_sector")).alias("sectors"))
    )


def free_totals(blocks: DataFrame, disc: list[str], sectors: str = "sectors") -> DataFrame:
    """Sum, number and largest of free blocks."""
    return blocks.groupBy(*disc).agg(
        F.sum(sectors).cast("long").alias("free_sectors"), F.count("*").alias("blocks"), F.max(sectors).cast("long").alias("largest_block")
    )


def reservable(requests: DataFrame, blocks: DataFrame, disc: list[str], request: str, start: str, sectors: str) -> DataFrame:
    """Adds reserved: whether one free block holds all of a requested range. blocks: start_sector and sectors, coalesced.

    A range join within each disc: the block with the greatest start not above
    the request's is found by one sorted pass instead of comparing all.
    """
    a = requests.select(*disc, F.col(request).alias("__id"), F.col(start).cast("long").alias("__at"), F.col(sectors).cast("long").alias("__need"), F.lit(None).cast("long").alias("__end"), F.lit(1).alias("__kind"))
    b = blocks.select(*disc, F.lit(None).cast("long").alias("__id"), F.col("start_sector").cast("long").alias("__at"), F.lit(None).cast("long").alias("__need"), (F.col("start_sector") + F.col("sectors")).cast("long").alias("__end"), F.lit(0).alias("__kind"))
    order = Window.partitionBy(*disc).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("__reach", F.last("__end", ignorenulls=True).over(order)).where("__kind = 1")
    fits = (F.col("__need") <= 0) | F.coalesce(F.col("__at") + F.col("__need") <= F.col("__reach"), F.lit(False))
    return seen.select(*disc, F.col("__id").alias(request), fits.alias("reserved"))


def last_writers(files: DataFrame, disc: list[str], ident: str, start: str, sectors: str) -> DataFrame:
    """Who owns each sector where placed files overlap: the one whose end is greatest, then whose start is least, then the least id.

    Going up a disc's starts, a file owns sectors only if it ends above all files before it,
    and then as far as the start of the next such file: sectors are made of the owners alone.
    """
    end = F.col(start) + F.col(sectors)
    placed = files.where((F.col(sectors) > 0) & F.col(start).isNotNull()).select(*disc, F.col(ident), F.col(start).alias("__s"), end.alias("__e"))
    upwards = Window.partitionBy(*disc).orderBy("__s", F.desc("__e"), ident)
    reach = F.max("__e").over(upwards.rowsBetween(Window.unboundedPreceding, -1))
    owners = placed.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__e") > F.col("__reach")))
    owners = owners.withColumn("__next", F.lead("__s").over(upwards))
    return owners.select(*disc, F.explode(F.sequence("__s", F.least("__e", "__next") - 1)).alias("sector"), ident)


def overlaps(files: DataFrame, disc: list[str], ident: str, start: str, sectors: str, bucket: int = 64) -> DataFrame:
    """Pairs of files of a disc that share sectors, each once: ident, other, shared.

    The later start of a pair lies in the other file. So one side of the join has a file
    in every bucket of sectors that it touches, the other side in its start's alone:
    a pair meets once, and candidates beyond the result are those within a bucket. The result itself
    grows with the square of the files of a disc; buckets are dealt to all tasks, few as their bytes may be.
    """
    f = files.where(F.col(sectors) > 0).select(
        *disc, F.col(ident).alias("id"), F.col(start).cast("long").alias("s"), (F.col(start) + F.col(sectors)).cast("long").alias("e")
    )
    g = f.select(*disc, F.floor(F.col("s") / bucket).alias("bucket"), *(F.col(c).alias(f"{c}2") for c in ("id", "s", "e")))
    f = f.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f, g = (x.repartition(tasks, *disc, "bucket") for x in (f, g))  # a number that is asked for isn't coalesced by bytes
    later = (F.col("s") < F.col("s2")) & (F.col("id") != F.col("id2")) | (F.col("s") == F.col("s2")) & (F.col("id") < F.col("id2"))
    pairs = f.hint("merge").join(g, [*disc, "bucket"]).where(later & (F.col("s2") < F.col("e")))
    return pairs.select(*disc, F.least("id", "id2").alias(ident), F.greatest("id", "id2").alias("other"), (F.least("e", "e2") - F.col("s2")).alias("shared"))
