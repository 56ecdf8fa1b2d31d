"""Steps whose memory or time must not follow the size of a table."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platter.functions import basic, slices
from platter.operators import mutate, space
from platter.plans import queries
from platter.sources import discs, images


def placed_at_random(spark, n=300):
    dice = random.Random(4)
    rows = [(i, dice.choice("de"), dice.randrange(200), dice.randrange(-1, 40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, disc string, s long, n long").coalesce(1)


def test_overlaps_are_dealt_to_all_tasks(spark):
    """However few bytes the files take: their pairs are many."""
    rows, placed = placed_at_random(spark)
    brute = sorted(
        (d, i, j, min(s + n, t + m) - max(s, t)) for i, d, s, n in rows for j, e, t, m in rows if d == e and i < j and n > 0 and m > 0 and s < t + m and t < s + n
    )
    for bucket in (1, 7, 64, 1000):
        found = space.overlaps(placed, ["disc"], "id", "s", "n", bucket=bucket)
        assert sorted(map(tuple, found.collect())) == brute
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_last_writers_sort_no_sectors(spark):
    """Sectors are made of owners; none is sorted or shuffled."""
    rows, placed = placed_at_random(spark)
    best = {}
    for i, d, s, n in rows:
        for sector in range(s, s + n):
            best.setdefault((d, sector), []).append((-(s + n), s, i))
    found = space.last_writers(placed, ["disc"], "id", "s", "n")
    assert sorted(map(tuple, found.collect())) == sorted((*k, min(v)[2]) for k, v in best.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "SortAggregate" not in plan
    assert plan.index("Generate") < plan.index("Window")  # above it


def handed_on(made, ddl, batches):
    """Row counts of the batches that map_rows makes of batches, without a cluster."""
    seen = {}
    df = type("Table", (), {"mapInArrow": lambda self, run, schema: seen.setdefault("run", run)})()
    slices.map_rows(df, made, ddl)
    return [b.num_rows for b in seen["run"](iter(batches))]


def test_images_are_handed_on_in_small_batches(spark):
    """A batch of commands of a few KB would become a GB of images."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    sizes = handed_on(lambda r: (r["n"], bytes(100_000)), "n long, content binary", [batch, batch])
    assert sum(sizes) == 2000 and max(sizes) * 100_000 <= slices.GATHERED_BYTES + 100_000
    sizes = handed_on(lambda r: (r["n"], None), "n long, content binary", [batch, batch])
    assert sum(sizes) == 2000 and max(sizes) <= slices.GATHERED


@pytest.mark.parametrize("ext", [".ssd", ".dsd", ".adf", ".adl"])
def test_images_of_few_commands_are_dealt_to_all_tasks(spark, ext):
    """Few as the commands' bytes may be."""
    todo = mutate.commands(spark, [{"image_id": f"i{i}", "op": "add", "path": "$.A", "data": b"x"} for i in range(150)])
    made = mutate.new_images(todo, ext)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert images.files(made).where("full_name = '$.A' and data = X'78'").count() == 150


def test_trees_send_directories_alone(spark):
    """Broken and cyclic ones give the rows that the whole disc gives."""
    d = discs.AdfsDisc.blank(640)
    for name in ("$.A", "$.A.B", "$.C"):
        d.make_directory(name)
    d.add("$.A.B.F", b"1Hugo" * 400)
    start = {f.name: f.start_sector for f in d.directory().files}
    inner = d.directory(start["A"])
    inner.files.append(discs.File("", "LOOP", 0, 0, 1280, 2, True, True, 13))
    d._store(start["A"], inner)
    whole = bytearray(d.content())
    contents = [bytes(whole)]
    for at in (1, 0x4FA, 0x4FB):  # a header mark, a sequence number, a footer mark
        broken = whole.copy()
        broken[start["C"] * 256 + at] ^= 1
        contents.append(bytes(broken))
    contents.append(bytes(whole[: start["C"] * 256 + 1278]))  # cut off in a directory
    df = spark.createDataFrame([(str(i), ".adf", c) for i, c in enumerate(contents)], "image_id string, ext string, content binary")
    sides = images.surfaces(df, heads=True)
    assert sides.agg(F.max(F.size("directories"))).first()[0] <= 4  # and no file's bytes
    names = [x.split()[0] for x in images.ENTRY.split(", ")]
    found = {r.image_id: [tuple(e) for e in r.entries] for r in images.catalogues(df).select("image_id", "entries").collect()}
    assert names[0] == "ord" and found == {str(i): [(k, *e) for k, e in enumerate(discs.walk_adfs(c))] for i, c in enumerate(contents)}


def test_texts_are_python_values_in_slices():
    """No more than a few rows of a batch at once, and all of them."""
    alive = []

    def fn(x):
        alive.append(x)
        return x

    for k in (0, 1, 15, 16, 17, 1000):
        texts = pa.array([None if i % 7 == 3 else "x" * i for i in range(k)], pa.string())
        made = slices.per_row(fn, "string")
        assert made.func(texts).equals(texts)


def test_digest_that_starts_as_a_program(spark, tmp_path):
    """0D FF is an empty program with machine code behind it, whatever the exec address; the listed discs hold none."""
    text = next(t for t in map(str, range(1 << 22)) if hashlib.md5(t.encode()).hexdigest().startswith("0dff"))
    rows = [(i, text, "en", "src", len(text)) for i in (1, 2, 59)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r)[1:] for r in queries.cat_listing(spark, str(tmp_path)).collect())
    assert found == [("D.F1", "BINARY", 32), ("D.F2", "BINARY", 48), ("D.F59", "BINARY", 960)]
    assert basic.classify(False, bytes.fromhex("0dff") + bytes(30)) == "BASIC+MC"
