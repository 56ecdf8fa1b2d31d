"""Column expressions over bytes, names and paths; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ILLEGAL_ON_HOSTS = '\\/:*?"<>|'
BASIC_EXEC = (0x801F, 0x8023, 0x802B)


def _at(offset: int | Column) -> Column:
    return (F.lit(offset) if isinstance(offset, int) else offset).cast("int") + 1


def cut(data: Column, offset: int | Column, length: int | Column) -> Column:
    """Bytes from a zero-based offset."""
    return F.substring(data, _at(offset), F.lit(length) if isinstance(length, int) else length.cast("int"))


def u8(data: Column, offset: int | Column) -> Column:
    """One byte as INT; null beyond the end."""
    one = cut(data, offset, 1)
    return F.when(F.length(one) == 1, F.ascii(F.decode(one, "ISO-8859-1")))



def u16(data: Column, offset: int | Column) -> Column:
    return _sum(data, offset, 2).cast("int")


def u24(data: Column, offset: int | Column) -> Column:
    return _sum(data, offset, 3).cast("int")


def u32(data: Column, offset: int | Column) -> Column:
    return _sum(data, offset, 4)


def _sum(data: Column, offset: int | Column, size: int) -> Column:
    total = None
    for i in range(size):
        byte = u8(data, offset + i).cast("long") * (1 << 8 * i)
        total = byte if total is None else total + byte
    return total


def seven_bit(data: Column) -> Column:
    """Text of the low seven bits of each byte."""
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.char(F.ascii(F.decode(F.substring(data, i, F.lit(1)), "ISO-8859-1")).bitwiseAND(127)))
    return F.when(F.length(data) > 0, F.array_join(codes, "")).otherwise("")


def terminated(text: Column) -> Column:
    """Text up to the first CR or NUL."""
    return F.regexp_extract(text, "\\A[^\\r\\x00]*", 0)


def bit(value: Column, n: int) -> Column:
    return F.shiftright(value, n).bitwiseAND(1) == 1


def is_basic_exec(exec_addr: Column) -> Column:
    return exec_addr.bitwiseAND(0xFFFF).isin(*BASIC_EXEC)


def bcd_next(value: Column, top_digit: int = 9) -> Column:
    """Next BCD byte. DFS wraps 0x99 to 0; ADFS lets the high digit go on to F (top_digit 15)."""
    low, high = value.bitwiseAND(15), F.shiftright(value, 4).bitwiseAND(15)
    up = F.when(high + 1 > top_digit, 0).otherwise(high + 1)
    return F.when(low + 1 > 9, up * 16).otherwise(high * 16 + low + 1).cast("int")


def sign_extend_24(value: Column) -> Column:
    """FFxxxx as FFFFxxxx."""
    return F.when((F.shiftright(value, 16) == 0xFF) & (value < 1 << 24), value.bitwiseOR(F.lit(0xFF000000).cast("long"))).otherwise(value)


def line_ref_mask(n: Column) -> Column:
    """First of the three bytes of a packed line number; the others are line_ref_low and line_ref_high."""
    return F.shiftright(n.bitwiseAND(0xC0), 2).bitwiseOR(F.shiftright(n.bitwiseAND(0xC000), 12)).bitwiseXOR(F.lit(0x54))


def line_ref_low(n: Column) -> Column:
    return n.bitwiseAND(63).bitwiseOR(64)


def line_ref_high(n: Column) -> Column:
    return F.shiftright(n, 8).bitwiseAND(63).bitwiseOR(64)


def line_ref_value(mask: Column, low: Column, high: Column) -> Column:
    m = mask.bitwiseXOR(F.lit(0x54))
    return F.shiftleft(high.bitwiseAND(63).bitwiseOR(F.shiftleft(m.bitwiseAND(12), 4)), 8).bitwiseOR(
        low.bitwiseAND(63).bitwiseOR(F.shiftleft(m.bitwiseAND(48), 2))
    )


def sectors(length: Column) -> Column:
    """256-byte sectors that hold so many bytes."""
    return F.ceil(length / 256).cast("long")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def qualified(path: Column) -> Column:
    """`$.` before a path that isn't of the form X.NAME."""
    has = (F.length(path) >= 3) & (F.substring(path, 2, 1) == ".")
    return F.when(has, path).otherwise(F.concat(F.lit("$."), path))


def split_path(path: Column) -> tuple[Column, Column]:
    """(directory, name) of a qualified flat path."""
    has = (F.length(path) >= 3) & (F.substring(path, 2, 1) == ".")
    return F.when(has, F.substring(path, 1, 1)).otherwise("$"), F.when(has, F.substring(path, 3, 1 << 30)).otherwise(path)


def full_name(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("."), name))


def host_path(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("/"))


def sanitized(name: Column) -> Column:
    """A name that all hosts take: control characters dropped, illegal ones as `_xHH_`."""
    out = F.regexp_replace(name, "[\\x00-\\x1F]", "")
    marked = out
    for c in ILLEGAL_ON_HOSTS:
        marked = F.replace(marked, F.lit(c), F.lit(f"_x{ord(c):02X}_"))
    return marked


def sanitized_directory(directory: Column) -> Column:
    """Each dotted part sanitized, joined by slashes."""
    return F.array_join(F.transform(F.split(directory, "\\."), sanitized), "/")


def valid_dfs_name(directory: Column, name: Column, strict: bool = False) -> Column:
    body = r"[\x21-\x7E&&[^.:\"#* ]]" if strict else r"[\x00-\x7F]"
    return directory.rlike(rf"(?s)\A{body}\z") & name.rlike(rf"(?s)\A{body}{{1,7}}\z")


def valid_adfs_name(name: Column) -> Column:
    return name.rlike(r"\A[\x21-\x7E]{1,10}\z")


def is_plain_text(text: Column) -> Column:
    """Not empty, printable ASCII, tabs and line ends alone."""
    return text.rlike(r"\A[\x09\x0A\x0D\x20-\x7E]+\z")


def boot_option(value: Column) -> Column:
    """0 to 3 of a number or a name; null for anything else."""
    v = F.upper(F.trim(value))
    return (
        F.when(v.isin("OFF", "0"), 0).when(v.isin("LOAD", "1"), 1).when(v.isin("RUN", "2"), 2).when(v.isin("EXEC", "3"), 3)
    )


def crc16(data: Column) -> Column:
    """CRC-16/XMODEM, bit by bit, for short data; `platter.operators.files` has the checksum of files."""

    def step(crc, i):
        byte = F.ascii(F.decode(F.substring(data, i, F.lit(1)), "ISO-8859-1"))
        start = crc.bitwiseXOR(F.shiftleft(byte, 8))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(8)),
            start,
            lambda c, _: F.when(c.bitwiseAND(0x8000) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(c, 1)).bitwiseAND(0xFFFF),
        )

    return F.when(F.length(data) > 0, F.aggregate(F.sequence(F.lit(1), F.length(data)), F.lit(0), step)).otherwise(0)


def adfs_checksum(sector: Column) -> Column:
    """Of the 255 bytes before a map sector's checksum: added downwards, each carry added to the next sum."""
    return F.aggregate(
        F.sequence(F.lit(254), F.lit(0), F.lit(-1)),
        F.lit(255),
        lambda t, i: F.when(t > 255, (t + 1).bitwiseAND(255)).otherwise(t) + u8(sector, i),
    ).bitwiseAND(255)


def pack_slot(load: Column, exec_addr: Column, length: Column, start: Column) -> Column:
    """The eight bytes of a flat catalogue entry's numbers: three of 18 bits and one of 10."""
    low = lambda v, n: F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * n).bitwiseAND(255)), 2, "0")
    high = lambda v, by: F.shiftleft(F.shiftright(v.cast("long"), 16).bitwiseAND(3), by)
    tail = high(load, 2).bitwiseOR(high(length, 4)).bitwiseOR(high(exec_addr, 6)).bitwiseOR(F.shiftright(start.cast("long"), 8).bitwiseAND(3))
    words = [low(v, n) for v in (load, exec_addr, length) for n in (0, 1)]
    return F.unhex(F.concat(*words, F.lpad(F.hex(tail), 2, "0"), low(start, 0)))


def unpack_slot(slot: Column) -> dict[str, Column]:
    """load_addr, exec_addr, length and start_sector of a slot."""
    tail = u8(slot, 6)
    high = lambda n: F.shiftright(tail, n).bitwiseAND(3).cast("long") * 65536
    return {
        "load_addr": u16(slot, 0).cast("long") + high(2),
        "exec_addr": u16(slot, 2).cast("long") + high(6),
        "length": u16(slot, 4).cast("long") + high(4),
        "start_sector": (u8(slot, 7) + tail.bitwiseAND(3) * 256).cast("int"),
    }
