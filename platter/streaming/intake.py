"""Images from a folder as a stream: the stateless read path, each image once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import bytes as B
from platter.sources.images import name_glob

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """image_id, path, ext, length, content, seen_at of images as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(SCHEMA)
        .option("pathGlobFilter", name_glob())
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    return files.select(
        F.sha2("content", 256).alias("image_id"), "path", B.extension(F.col("path")).alias("ext"), "length", "content",
        F.col("modificationTime").alias("seen_at"),
    )


def without_copies(images: DataFrame, late: str = "1 day") -> DataFrame:
    """Equal images once, among those whose times are at most `late` apart: the state is bounded by the watermark."""
    return images.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["image_id"])
