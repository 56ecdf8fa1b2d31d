"""Sidecar lines: parsing of the three syntaxes, and formatting.

`parse` returns a dict with the columns of SCHEMA; what can't be parsed has its
reason in `error`, oddities that are passed over are in `warnings`.
"""

from __future__ import annotations

import re
import zlib

SCHEMA = (
    "directory string, name string, load_addr long, exec_addr long, length long, access_byte int, "
    "extra map<string,string>, error string, warnings array<string>"
)

_TOKEN = re.compile(r'[ \t]*(?:"(?P<quoted>[^"\r\n]*)(?P<close>"?)|(?P<bare>[^ \t\r\n]+))')
_PERCENT = re.compile(r"%(?:([0-9A-Fa-f]{2})|(.{0,2}))", re.S)
_EXTRA = re.compile(r"([A-Za-z0-9_]+)=(.*)", re.S)
_HEX = re.compile(r"[0-9A-Fa-f]+\Z")
_SYMBOLIC = re.compile(r"[ELWRDelwrd]+\Z")
_LOCKS = ("L", "LOCKED", "Locked")
_LETTERS = {c: 1 << i for i, c in enumerate("RWELrwel")}
_BARE_NAME = re.compile(r"[\x21\x23\x24\x26-\x7E]+\Z")


def percent_decode(raw: str, warnings: list[str] | None = None) -> str:
    """`%XX` of two hex digits becomes the character of that value; any other percent sign stays."""

    def one(m: re.Match) -> str:
        if m.group(1):
            return chr(int(m.group(1), 16))
        if warnings is not None:
            warnings.append(f"percent sign without two hex digits: {m.group()!r}")
        return "%" + percent_decode(m.group(2), warnings)

    return _PERCENT.sub(one, raw) if "%" in raw else raw


def percent_encode(raw: str, also: str = "") -> str:
    return "".join(c if " " <= c <= "~" and c not in '"%' and c not in also else f"%{ord(c):02X}" for c in raw)


def sign_extend(value: int) -> int:
    """A 24-bit address in the top page, FFxxxx, as 32 bits."""
    return value | 0xFF000000 if value >> 16 == 0xFF else value


def symbolic_access(letters: str) -> int:
    return sum({_LETTERS.get(c, 0) for c in letters})


def split_name(raw: str, warnings: list[str] | None = None) -> tuple[str, str]:
    """(directory, leaf), cut at the last dot that isn't an escape; the root without one."""
    if raw == "$":
        return "$", ""
    head, dot, leaf = raw.rpartition(".")
    if not dot:
        return "$", percent_decode(raw, warnings)
    return (head if len(head) == 1 else percent_decode(head, warnings)), percent_decode(leaf, warnings)


def _tokens(line: str) -> list[tuple[str, bool]]:
    out, at = [], 0
    line = re.split(r"[\r\n]", line, maxsplit=1)[0]
    while m := _TOKEN.match(line, at):
        if m.group("quoted") is not None:
            if not m.group("close"):
                raise ValueError("a quoted name has no end")
            out.append((m.group("quoted"), True))
        else:
            out.append((m.group("bare"), False))
        at = m.end()
    return out


def parse(line: str | None) -> dict:
    warnings: list[str] = []
    try:
        return _parse(line or "", warnings) | {"error": None, "warnings": warnings}
    except ValueError as e:
        return dict.fromkeys(("directory", "name", "load_addr", "exec_addr", "length", "access_byte", "extra")) | {
            "error": str(e),
            "warnings": warnings,
        }


def _parse(line: str, warnings: list[str]) -> dict:
    tokens = _tokens(line)
    if not tokens:
        raise ValueError("the line is empty")
    if tokens[0][0] == "TAPE":  # an old prefix
        tokens.pop(0)
        if not tokens:
            raise ValueError("no name after TAPE")
    raw, quoted = tokens[0]
    if quoted:
        directory, name = ("$", "") if percent_decode(raw) == "$" else split_name(raw, warnings)
    else:
        directory, name = split_name(raw, warnings) if "." in raw else ("$", "" if raw == "$" else raw)
    numbers: list[int] = []
    extra: dict[str, str] = {}
    access = 0
    for token, quoted in tokens[1:]:
        if quoted:
            token = percent_decode(token, warnings)
        if token == "NEXT":
            break
        if m := _EXTRA.match(token):
            extra[m.group(1)] = percent_decode(m.group(2), warnings)
        elif extra.get("CRC") == "":  # CRC= and its value apart
            extra["CRC"] = token
        elif token in _LOCKS:
            access |= 8
        elif _HEX.match(token):
            numbers.append(int(token, 16))
        elif not numbers and _SYMBOLIC.match(token):
            access = symbolic_access(token)
        else:
            warnings.append(f"{token!r} isn't known and was passed over")
    load, exec_, length, byte = (numbers + [None] * 4)[:4]
    return {
        "directory": directory,
        "name": name,
        "load_addr": sign_extend(load or 0),
        "exec_addr": sign_extend(exec_ or 0),
        "length": length,
        "access_byte": access if byte is None else byte,
        "extra": extra,
    }


def start_sector(extra: dict[str, str] | None) -> int | None:
    """START_SECTOR, else X_START_SECTOR; decimal or with a 0x, 0o or 0b prefix; negative or bad values are none."""
    for key in ("START_SECTOR", "X_START_SECTOR"):
        if extra and key in extra:
            try:
                value = int(extra[key], 0)
            except ValueError:
                return None
            return value if value >= 0 else None
    return None


def format_name(directory: str, name: str) -> str:
    if _BARE_NAME.match(directory) and _BARE_NAME.match(name) and "." not in name:
        return f"{directory}.{name}"
    return f'"{percent_encode(directory)}.{percent_encode(name, ".")}"'


def format_line(
    directory: str, name: str, load: int, exec_: int, length: int, access_byte: int = 0, extra: dict[str, str] | None = None
) -> str:
    fields = [format_name(directory, name)]
    fields += [f"{v & 0xFFFFFFFF:08X}" for v in (load, exec_, length)] + [f"{access_byte & 0xFF:02X}"]
    return " ".join(fields + [f"{k}={percent_encode(v, ' ')}" for k, v in (extra or {}).items()])


def crc16(data: bytes) -> int:
    """CRC-16/XMODEM."""
    import binascii

    return binascii.crc_hqx(data, 0)


def format_entry(entry: dict, data: bytes | None = None) -> str:
    """An entry's line, with its start sector and, where data are given, their checksums. entry: stardot access in access_byte."""
    extra = {}
    if entry.get("start_sector") is not None:
        extra["X_START_SECTOR"] = str(entry["start_sector"])
    if data is not None:
        extra |= {"CRC": f"{crc16(data):04X}", "CRC32": f"{zlib.crc32(data):08X}"}
    return format_line(
        entry["directory"], entry["name"], entry["load_addr"], entry["exec_addr"], entry["length"], entry["access_byte"], extra
    )


def format_directory(title: str, boot_option: int, directory: str = "$") -> str:
    extra = ({"TITLE": title} if title else {}) | {"OPT": str(int(boot_option))}
    return format_line(directory, "", 0, 0, 0, 0, extra)
