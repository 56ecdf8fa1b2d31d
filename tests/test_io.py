"""The stream of images, the image sink, and the entry module's promises."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from platter.functions import bytes as B
from platter.operators import mutate, sidecars, space
from platter.sources import discs, images
from platter.sources.sink import DiscImageSource
from platter.streaming import intake


def test_stream(spark, tmp_path):
    for n, title in (("a", "ONE"), ("b", "ONE"), ("c", "TWO")):
        (tmp_path / f"{n}.ssd").write_bytes(discs.blank_image(".ssd", 40, title))
    (tmp_path / "note.txt").write_text("no image")
    found = intake.without_copies(intake.stream_images(spark, str(tmp_path)))
    query = found.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 2
    assert {r.title for r in images.side_info(spark.table("seen")).collect()} == {"ONE", "TWO"}


def test_sink(spark, tmp_path):
    spark.dataSource.register(DiscImageSource)
    specs = spark.createDataFrame([("x.ssd", ".ssd", 80, "T", 1), ("d/y.adl", ".adl", 80, "U", 2)], "path string, ext string, tracks int, title string, boot_option int")
    made = mutate.blank_images(specs).select("path", "content")
    made.write.format("discimage").mode("append").save(str(tmp_path))
    back = images.read_images(spark, str(tmp_path))
    assert sorted((r.title, r.boot_option, r.disc_size) for r in images.side_info(back).collect()) == [("T", 1, 800), ("U", 2, 2560)]
    assert {r.problem for r in images.detect_format(back).collect()} == {None}
    with pytest.raises(Exception, match="there already"):
        made.write.format("discimage").mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.part"))


def test_entry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 40


def test_checksums(spark):
    rows = spark.createDataFrame([(b"123456789",), (b"",)], "data binary")
    got = rows.select(sidecars.checksums(F.col("data")).alias("s"), B.crc16(F.col("data")).alias("native")).collect()
    assert [(r.s.crc16, r.s.crc32, r.native) for r in got] == [(0x31C3, 0xCBF43926, 0x31C3), (0, 0, 0)]
    stored = rows.withColumn("extra", F.create_map(F.lit("CRC"), F.lit("31C3"), F.lit("CRC32"), F.lit("zz")))
    assert [bytes(r.data) for r in sidecars.mismatches(stored).collect()] == [b""]


def test_space(spark):
    blocks = spark.createDataFrame([("d", 7, 2), ("d", 9, 3), ("d", 20, 5), ("e", 0, 0)], "disc string, s int, n int")
    merged = space.coalesce_blocks(blocks, ["disc"], "s", "n")
    assert sorted(map(tuple, merged.collect())) == [("d", 7, 5), ("d", 20, 5)]
    wants = spark.createDataFrame([(1, "d", 8, 4), (2, "d", 8, 5), (3, "d", 20, 5), (4, "d", 1, 1), (5, "x", 0, 0), (6, "x", 0, 1)], "id long, disc string, s int, n int")
    got = {r.id: r.reserved for r in space.reservable(wants, merged, ["disc"], "id", "s", "n").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    placed = spark.createDataFrame([(1, "d", 2, 4), (2, "d", 4, 2), (3, "d", 5, 3)], "id long, disc string, s int, n int")
    owners = {r.sector: r.id for r in space.last_writers(placed, ["disc"], "id", "s", "n").collect()}
    assert owners == {2: 1, 3: 1, 4: 1, 5: 3, 6: 3, 7: 3}
    pairs = sorted(tuple(r) for r in space.overlaps(placed, ["disc"], "id", "s", "n", bucket=2).collect())
    assert pairs == [("d", 1, 2, 2), ("d", 1, 3, 1), ("d", 2, 3, 1)]
