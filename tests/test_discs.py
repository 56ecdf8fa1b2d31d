import pytest
from pyspark.sql import functions as F

from platter.functions import basic, inf
from platter.functions import access as A
from platter.operators import catalogue, mutate, programs
from platter.sources import discs, images, tree


def raw_ssd():
    """Packed by hand: one locked file `$.HELLO` of 300 bytes at sector 2."""
    d = bytearray(80 * 2560)
    d[:8] = b"HANDMADE"
    d[8:16] = b"HELLO  " + bytes([ord("$") | 0x80])
    d[256:260] = b"TITL"
    d[260], d[261], d[262], d[263] = 0x42, 8, 0x23, 0x20
    d[264:272] = bytes([0x00, 0x19, 0x23, 0x80, 0x2C, 0x01, 0b11_00_11_00, 2])
    d[512:812] = b"\xaa" * 300
    return bytes(d)


def corpus():
    program = basic.tokenize(["10PRINT \"HI\"", "20GOTO 10", "30END"])[0]
    ssd = discs.DfsSide.blank(80, "STANDARD", 3)
    ssd.add("$.BASIC", program, 0xFFFF0E00, 0xFFFF8023)
    ssd.add("$.BASMC", program + bytes(24), 0xFFFF0E00, 0xFFFF8023)
    ssd.add("$.ISH", program, 0xFFFF1900, 0x1900)
    ssd.add("$.TEXT", b"one\rtwo\r", 0, 0, True)
    ssd.add("T.BIN", bytes(range(96)), 0x3000, 0x3000)
    other = discs.DfsSide.blank(80)
    other.add("$.SIDE1", b"side one")
    adl = discs.AdfsDisc.blank(2560, "TREE", 2)
    adl.make_directory("$.A")
    adl.make_directory("$.A.B")
    adl.add("$.A.B.PROG", program, 0xFFFF0E00, 0xFFFF8023, True)
    adl.add("$.T>D", b"text", 1, 2, access=A.R | A.PUBLIC_R)
    return [
        ("ssd", "x/s.ssd", ".ssd", discs.image_bytes([ssd], False)),
        ("dsd", "x/s.dsd", ".dsd", discs.image_bytes([ssd, other], True)),
        ("adl", "x/s.adl", ".adl", discs.image_bytes([adl], True)),
        ("raw", "x/raw", "", raw_ssd()),
        ("bad", "x/bad.adf", ".adf", bytes(7 * 256)),
    ]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(corpus(), "image_id string, path string, ext string, content binary").cache()


def test_hand_packed(spark, df):
    e = images.entries(df).where("image_id = 'raw'").first()
    assert (e.full_name, e.load_addr, e.exec_addr, e.length, e.start_sector, e.locked) == ("$.HELLO", 0x31900, 0x38023, 300, 2, True)
    s = images.side_info(df).where("image_id = 'raw'").first()
    assert (s.title, s.cycle, s.boot_option, s.disc_size, s.tracks, s.free_sectors) == ("HANDMADETITL", 0x42, 2, 800, 80, 796)
    d = discs.DfsSide(raw_ssd())
    assert d.content() == raw_ssd() and d.read(d.files[0]) == b"\xaa" * 300


def test_formats(df):
    found = {r.image_id: (r.format, r.double_sided) for r in images.detect_format(df).collect()}
    assert found == {"ssd": ("dfs", False), "dsd": ("dfs", True), "adl": ("adfs", True), "raw": ("dfs", False), "bad": (None, False)}


def test_entries_agree_with_classes(df):
    rows = images.files(df).collect()
    by = {(r.image_id, r.side, r.full_name): r for r in rows}
    for image, _, ext, content in corpus()[:2]:
        for n, side in enumerate(discs.open_image(content, "dfs", ext == ".dsd")):
            for f in side.files:
                r = by[image, n, f.path]
                assert (r.load_addr, r.exec_addr, r.length, r.start_sector, r.locked) == (f.load_addr, f.exec_addr, f.length, f.start_sector, f.locked)
                assert bytes(r.data) == side.read(f)
    assert by["adl", 0, "$.A.B.PROG"].access_string == "LWR" and by["adl", 0, "$.T>D"].access_string == "R/r"
    assert by["adl", 0, "$.A.B.PROG"].is_basic


def test_adfs_order_and_native_directory(df):
    names = [r.full_name for r in images.entries(df).where("image_id = 'adl'").orderBy("ord").collect()]
    assert names == ["$.A", "$.A.B", "$.A.B.PROG", "$.T>D"]
    root = images.surfaces(df).where("image_id = 'adl'").select(images.adfs_directory(F.substring("content", 513, 1280)).alias("d")).first().d
    assert (root.name, root.title, [e.name for e in root.entries], root.problem) == ("$", "TREE", ["A", "T>D"], None)
    m = images.surfaces(df).where("image_id = 'adl'").select(images.adfs_map(F.col("content")).alias("m")).first().m
    assert (m.total_sectors, m.boot_option, m.free_sectors, m.problem) == (2560, 2, 2560 - 7 - 10 - 2, None)


def test_cycle_is_reported():
    d = discs.AdfsDisc.blank(640)
    d.make_directory("$.A")
    start = d.directory().files[0].start_sector
    inner = d.directory(start)
    inner.files.append(discs.File("", "LOOP", 0, 0, 1280, 2, True, True, 13))
    d._store(start, inner)
    rows = list(discs.walk_adfs(d.content()))
    assert [r[-1] for r in rows] == [None, "the directory holds itself"]


def test_classify_and_search(df):
    files = images.files(df).where("image_id = 'ssd'")
    kinds = {r.full_name: r.file_type for r in catalogue.listing(files, inspect=True).collect()}
    assert kinds == {"$.BASIC": "BASIC", "$.BASMC": "BASIC+MC", "$.ISH": "BASIC?", "$.TEXT": "TEXT", "T.BIN": "BINARY"}
    found = programs.search(files, "GOTO").collect()
    assert sorted((r.full_name, r.line_number, r.line) for r in found) == [("$.BASIC", 20, "GOTO 10"), ("$.BASMC", 20, "GOTO 10")]
    assert programs.search(files, "goto", ignore_case=True, filename="BASIC").count() == 1
    assert programs.search(files, "goto").count() == 0
    assert programs.search(files, r"G.TO \d+", use_regex=True, engine="python").count() == 2
    assert programs.search(files, ".", use_regex=False).count() == 0


def test_sorts_and_lookups(df):
    e = images.entries(df).where("image_id = 'ssd'")
    assert [r.name for r in catalogue.sort_catalogue(e, "size").collect()][0] == "TEXT"
    assert catalogue.find(e, "basic").first().ambiguous is False
    assert catalogue.attributes(e, "TEXT").first().locked


def test_commands(spark, df):
    todo = mutate.commands(spark, [
        {"image_id": "ssd", "op": "delete", "path": "$.BASMC"},
        {"image_id": "ssd", "op": "delete", "path": "$.NONE"},
        {"image_id": "ssd", "op": "rename", "path": "$.ISH", "text": "$.NEW"},
        {"image_id": "ssd", "op": "attributes", "path": "$.NEW", "text": "+L"},
        {"image_id": "ssd", "op": "title", "text": "CHANGED"},
        {"image_id": "ssd", "op": "compact"},
        {"image_id": "adl", "op": "mkdir", "path": "$.a"},
        {"image_id": "adl", "op": "delete", "path": "$.A.B.PROG"},
        {"image_id": "adl", "op": "attributes", "path": "$.A", "text": "LWR/r"},
        {"image_id": "adl", "op": "boot", "number": 1},
        {"image_id": "dsd", "side": 1, "op": "add", "path": "X.F", "data": b"abc", "number": 700},
    ])
    out = {r.image_id: r for r in mutate.apply_commands(df.where("image_id != 'bad'"), todo).collect()}
    assert [x.error for x in out["ssd"].log][1] == "no file $.NONE" and sum(x.error is not None for x in out["ssd"].log) == 1
    side = discs.DfsSide(bytes(out["ssd"].content))
    assert side.title == "CHANGED" and {f.path: f.locked for f in side.files}["$.NEW"] and side.next_free() == 2 + 1 + 1 + 1 + 1
    assert out["ssd"].log[-1].won == 256
    adl = discs.open_image(bytes(out["adl"].content), "adfs", True)[0]
    assert out["adl"].log[0].error == "a is there already" and adl.boot_option == 1 and adl.free_sectors() == 2560 - 7 - 10 - 1
    assert adl.directory().files[0].access == A.D | A.L | A.R
    dsd = discs.open_image(bytes(out["dsd"].content), "dfs", True)
    assert dsd[1].files[0].start_sector == 700 and not out["raw"].changed


def test_first_fit_reserve_release():
    d = discs.AdfsDisc.blank(640)
    for n in "ABCD":
        d.add(f"$.{n}", bytes(512))
    d.delete("$.A"), d.delete("$.C")
    assert d.blocks == [(7, 2), (11, 2), (15, 625)]
    d.add("$.E", bytes(768))
    assert d.directory().files[-1].start_sector == 15
    assert not d.reserve(8, 4) and d.reserve(11, 2) and d.blocks == [(7, 2), (18, 622)]
    d.release(9, 2)
    assert d.blocks == [(7, 4), (18, 622)]


def test_surfaces_round_trip(spark):
    sides = [bytes((s + 37 * i) & 255 for i in range(204800)) for s in (1, 2)]
    a, b = (spark.createDataFrame([("i", s)], "image_id string, content binary") for s in sides)
    for sequential in (False, True):
        merged = mutate.merge_surfaces(a, b, sequential=sequential)
        back = mutate.split_surfaces(merged, sequential).orderBy("surface").collect()
        assert [bytes(r.content) for r in back] == sides and [r.problem for r in back] == [None, None]
    assert bytes(mutate.merge_surfaces(a, b).first().content) == discs.interleaved(*sides)


def test_surfaces_of_other_discs(spark):
    """One-sided, hierarchical and odd images are reported, not cut."""
    ssd, dsd = discs.blank_image(".ssd", 80), discs.blank_image(".dsd", 80)
    rows = [("ssd", ".ssd", ssd), ("unnamed", "", ssd), ("dsd", ".dsd", dsd), ("half", ".dsd", discs.blank_image(".dsd", 40)), ("img", ".img", dsd),
            ("adl", ".adl", discs.blank_image(".adl", 80)), ("odd", ".dsd", dsd + b"x"), ("none", ".dsd", b"")]
    every = spark.createDataFrame(rows, "image_id string, ext string, content binary")
    out = {}
    for r in mutate.split_surfaces(every).collect():
        out.setdefault(r.image_id, []).append((r.surface, r.content and len(r.content), r.problem))
    for i in ("dsd", "img"):
        assert sorted(out[i]) == [(0, 204800, None), (1, 204800, None)]
    assert sorted(out["half"]) == [(0, 102400, None), (1, 102400, None)]
    assert out["ssd"] == out["unnamed"] == [(None, None, "the disc has one side")]
    assert out["adl"] == [(None, None, "the surfaces of a hierarchical disc aren't discs")]
    assert out["odd"] == out["none"] == [(None, None, "no two-sided disc has this size")]
    other = spark.createDataFrame([("ssd", ".ssd", ssd), ("unnamed", ".ssd", discs.blank_image(".ssd", 40)), ("dsd", ".ssd", ssd), ("adl", ".ssd", ssd), ("more", ".ssd", ssd)], every.schema)
    merged = {r.image_id: (r.content and len(r.content), r.problem) for r in mutate.merge_surfaces(every, other).collect()}
    assert merged["ssd"] == (409600, None) and merged["unnamed"] == (None, "the sides differ in size")
    assert merged["dsd"] == merged["adl"] == (None, "a side isn't a one-sided flat disc")
    assert merged["more"] == merged["half"] == (None, "a side is missing")
    names = spark.createDataFrame([("/a.b/disc.dsd",), ("/a.b/disc",), ("x.y.img",)], "p string").select(mutate.split_names(F.col("p")).alias("n")).collect()
    assert [r.n[1] for r in names] == ["/a.b/disc-side1.ssd", "/a.b/disc-side1.ssd", "x.y-side1.ssd"]


def test_commands_that_cannot_be_done(spark):
    """Nulls and unwritable discs are reported, and programs are made of source on request."""
    source = b"10 PRINT 1\n20 GOTO 10\n"
    program = basic.tokenize(["10 PRINT 1", "20 GOTO 10"])[0]
    todo = [
        {"image_id": "a", "op": op, "path": None} for op in ("add", "delete", "rename", "attributes", "mkdir", None)
    ] + [
        {"image_id": "a", "op": "rename", "path": "$.X"}, {"image_id": "a", "op": "boot"},
        {"image_id": "a", "op": "add", "path": "$.SRC", "data": source, "text": "retokenize"}, {"image_id": "a", "op": "add", "path": "$.RAW", "data": source},
        {"image_id": "a", "op": "add", "path": "$.BIN", "data": b"\x00\xff", "text": "retokenize"}, {"image_id": "a", "op": "add", "path": "$.P", "data": program, "text": "retokenize"},
    ]
    made = mutate.new_images(mutate.commands(spark, todo), ".ssd")
    log = made.first().log
    assert [x.error is None for x in log] == [False] * 8 + [True] * 4
    assert {r.name: bytes(r.data) for r in images.files(made).collect()} == {"SRC": program, "RAW": source, "BIN": b"\x00\xff", "P": program}
    # over 82 gaps of a tree's map
    rows = [{"image_id": "t", "op": "mkdir", "path": f"$.{d}"} for d in "ABCD"] + [{"image_id": "t", "op": "add", "path": f"$.{'ABCD'[i % 4]}.F{i}", "data": b"x"} for i in range(184)]
    rows += [{"image_id": "t", "op": "delete", "path": f"$.{'ABCD'[i % 4]}.F{i}"} for i in range(0, 184, 2)]
    full = mutate.new_images(mutate.commands(spark, rows), ".adf").first()
    assert full.content is None and full.log[-1].op == "save" and full.log[-1].error


def test_names_in_any_case(spark, tmp_path):
    for n in ("a.ssd", "b.SSD", "c.Ssd", "d.aDl", "e.txt", "f.ssd.bak"):
        (tmp_path / n).write_bytes(b"x" * 512)
    found = images.read_images(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("n")).collect()
    assert sorted(r.n for r in found) == ["a.ssd", "b.SSD", "c.Ssd", "d.aDl"]
    from platter.streaming import intake

    query = intake.stream_images(spark, str(tmp_path)).select("path").writeStream.format("memory").queryName("anycase").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("anycase").count() == 4


def test_deep_tree(spark):
    rows = [(0, None, "r"), *((i, i - 1, "d") for i in range(1, 14)), (90, 91, "c"), (91, 90, "c")]
    out = catalogue.walk_tree(spark.createDataFrame(rows, "k int, p int, n string"), "k", "p", "n").collect()
    assert {r.key: r.depth for r in out} == {i: i for i in range(14)} and max(out, key=lambda r: r.depth).path == "r" + ".d" * 13


@pytest.mark.parametrize("force", [False, True])
def test_title_of_the_tree_and_of_the_table(spark, force):
    """A side's `$.inf` decides unless forced, and where it doesn't the log says so."""
    files = spark.createDataFrame(
        [("a/$.inf", b"$ 0 0 0 0 TITLE=FOLDER OPT=3"), ("b/$/X.bin", b"x"), ("b/$/X.bin.inf", b"$.X 0 0 1")], "path string, content binary"
    )
    specs = spark.createDataFrame([("a", ".ssd", 80, "ASKED", 1), ("b", ".ssd", 80, "ASKED", 1), ("c", ".ssd", 40, None, None)], "image_id string, ext string, tracks int, title string, boot_option int")
    built = tree.build_images(files, specs, F.substring_index("path", "/", 1), force=force)
    log = {r.image_id: r.log for r in built.collect()}
    info = {r.image_id: (r.title, r.boot_option) for r in images.side_info(built.join(specs.select("image_id", "ext"), "image_id")).collect()}
    assert info == {"a": ("ASKED", 1) if force else ("FOLDER", 3), "b": ("ASKED", 1), "c": ("", 0)}
    assert len(log["a"]) == (0 if force else 2) and log["c"] == []


def test_extract_and_build(spark, df, tmp_path):
    source = df.where("image_id in ('ssd', 'dsd', 'adl')")
    out = tree.extract(source, text_mode="escape")
    assert tree.write_tree(out, str(tmp_path)) == out.count()
    files = tree.read_tree(spark, str(tmp_path))
    image = F.regexp_extract("path", rf"{tmp_path}/([^/]+)/", 1)
    side = F.coalesce(F.expr("try_cast(regexp_extract(path, '/side([01])/', 1) as int)"), F.lit(0))
    specs = spark.createDataFrame([("ssd", ".ssd"), ("dsd", ".dsd"), ("adl", ".adl")], "image_id string, ext string")
    specs = specs.selectExpr("*", "80 as tracks", "cast(null as string) as title", "cast(null as int) as boot_option")
    built = tree.build_images(files, specs, image, side).join(specs, "image_id")
    assert [r.log for r in built.collect()] == [[], [], []]
    cols = ["image_id", "side", "full_name", "load_addr", "exec_addr", "start_sector", "locked", "access_byte", "data"]
    before, after = ({tuple(map(str, r)) for r in images.files(x).select(cols).collect()} for x in (source, built))
    assert before == after
    info = {(r.image_id, r.side): (r.title, r.boot_option) for r in images.side_info(built).collect()}
    assert info["ssd", 0] == ("STANDARD", 3) and info["adl", 0] == ("TREE", 2)


INF = [
    ("$.HELLO FFFF1900 FFFF8023 00000123 08 CRC=1234", ("$", "HELLO", 0xFFFF1900, 0xFFFF8023, 0x123, 8)),
    ("$.A FF1900 FF8023", ("$", "A", 0xFFFF1900, 0xFFFF8023, None, 0)),
    ("$.A 1900 8023 L", ("$", "A", 0x1900, 0x8023, None, 8)),
    ("$.G.E DLR", ("$.G", "E", 0, 0, None, 9)),
    ('"$.B%2E1" 0 0 0 0', ("$", "B.1", 0, 0, 0, 0)),
    ("TAPE X 1 2 3", ("$", "X", 1, 2, 3, 0)),
    ("$ 0 0 0 0 TITLE=a%20b OPT=3 NEXT Z", ("$", "", 0, 0, 0, 0)),
]


@pytest.mark.parametrize("line,expected", INF)
def test_inf(line, expected):
    p = inf.parse(line)
    assert p["error"] is None and tuple(p[k] for k in ("directory", "name", "load_addr", "exec_addr", "length", "access_byte")) == expected


def test_inf_edges():
    assert inf.parse('"abc 1 2')["error"] and inf.parse("")["error"] and inf.parse(None)["error"]
    assert inf.parse("$.A 0 0 0 0 CRC= 12AB")["extra"] == {"CRC": "12AB"}
    assert inf.percent_decode("%41%+1%4") == "A%+1%4"
    assert inf.start_sector({"X_START_SECTOR": "0x10"}) == 16 and inf.start_sector({"START_SECTOR": "-1"}) is None
    for name in ("A", "B.1", 'Q"X', "%P", "sp ace", "\x06", " "):
        p = inf.parse(inf.format_line("$", name, 1, 2, 3, 8, {"K": "a b%"}))
        assert (p["name"], p["extra"]) == (name, {"K": "a b%"})


@pytest.mark.parametrize("spec,kind,masks", [
    ("LWR/r", "adfs", (A.L | A.W | A.R | A.PUBLIC_R, A.ALL)), ("LWRr", "adfs", (A.L | A.W | A.R | A.PUBLIC_R, A.ALL)),
    ("+L-W", "adfs", (A.L, A.W)), ("", "adfs", (0, A.ALL)), ("LOCKED", "dfs", (A.L, A.L)), ("-L", "dfs", (0, A.L)), ("LWR", "dfs", (A.L, A.L)),
])
def test_access_specs(spec, kind, masks):
    assert A.parse_spec(spec, kind)[:2] == masks


@pytest.mark.parametrize("spec", ["+L-L", "+", "L+R", "+LW", "1"])
def test_bad_access_specs(spec):
    with pytest.raises(A.AccessError):
        A.parse_spec(spec, "adfs")


def test_bcd_and_checksum():
    assert discs.bcd_next(0x99, True) == 0 and discs.bcd_next(0x99, False) == 0xA0 and discs.bcd_next(0x09, True) == 0x10
    assert discs.checksum(bytes(256)) == 255
