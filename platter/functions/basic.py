"""BBC BASIC programs: keyword tables, tokenizing, listing, line numbers, spacing, escapes.

Plain functions of one line or one program; `platter.operators.programs` applies
them to columns. A program is a chain of records `0D hi lo len body` that ends
with `0D FF`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

# Keyword names in token order; a dash is a byte without a keyword.
_NAMES = """
AND DIV EOR MOD OR ERROR LINE OFF STEP SPC TAB( ELSE THEN - OPENIN PTR PAGE TIME LOMEM HIMEM
ABS ACS ADVAL ASC ASN ATN BGET COS COUNT DEG ERL ERR EVAL EXP EXT FALSE FN GET INKEY INSTR( INT LEN LN LOG NOT
OPENUP OPENOUT PI POINT( POS RAD RND SGN SIN SQR TAN TO TRUE USR VAL VPOS CHR$ GET$ INKEY$ LEFT$( MID$( RIGHT$( STR$
STRING$( EOF AUTO DELETE LOAD LIST NEW OLD RENUMBER SAVE - - - - - - SOUND BPUT CALL CHAIN CLEAR CLOSE CLG CLS DATA
DEF DIM DRAW END ENDPROC ENVELOPE FOR GOSUB GOTO GCOL IF INPUT LET LOCAL MODE MOVE NEXT ON VDU PLOT PRINT PROC READ
REM REPEAT REPORT RESTORE RETURN RUN STOP COLOUR TRACE UNTIL WIDTH OSCLI
""".split()

# What a keyword does to the rest of its line.
_WHOLE_WORD = frozenset(
    "PTR PAGE TIME LOMEM HIMEM BGET COUNT ERL ERR EXT FALSE PI POS RND TRUE VPOS EOF NEW OLD BPUT CLEAR CLOSE CLG CLS END "
    "ENDPROC REPORT RETURN RUN STOP EDIT".split()
)
_STAYS_INSIDE = frozenset(
    "PTR PAGE TIME LOMEM HIMEM LOAD SAVE SOUND BPUT CALL CHAIN CLOSE DIM DRAW ENVELOPE FOR GOSUB GOTO GCOL IF INPUT LOCAL "
    "MODE MOVE NEXT ON VDU PLOT PRINT PROC READ REPEAT RESTORE COLOUR TRACE UNTIL WIDTH OSCLI".split()
)
_OPENS_STATEMENT = frozenset("ERROR ELSE THEN LET".split())
_WANTS_LINE = frozenset("ELSE THEN AUTO DELETE LIST RENUMBER GOSUB GOTO RESTORE TRACE".split())
_LITERAL_TAIL = frozenset("DATA REM".split())
_NAMES_FOLLOW = frozenset("FN PROC".split())
_TWO_FORMS = frozenset("PTR PAGE TIME LOMEM HIMEM".split())
_FIRST_ABBREVIATED = frozenset("AND TIME ENDPROC PRINT PROC REPEAT".split())

LINE_REF, RECORD, END = 0x8D, 0x0D, 0xFF
STATEMENT_FORM = 0x40
LONGEST_RECORD = 255
BASIC_EXEC = (0x801F, 0x8023, 0x802B)
#: Bytes after a program that don't make it a program with machine code.
SLACK = 16


@dataclass(frozen=True)
class Dialect:
    name: str
    #: (name, token), in the order in which names and abbreviations are tried.
    keywords: tuple[tuple[str, int], ...]
    by_byte: dict[int, str]
    matcher: re.Pattern

    def abbreviated(self, prefix: str) -> tuple[str, int] | None:
        for name, token in self.keywords:
            if len(name) > len(prefix) and name.isalpha() and name.startswith(prefix):
                return name, token
        return None


@cache
def dialect(version: str = "II") -> Dialect:
    """II, or IV, which adds EDIT."""
    if version not in ("II", "IV"):
        raise ValueError(f"no BASIC dialect {version!r}")
    table = {0x80 + i: name for i, name in enumerate(_NAMES) if name != "-"}
    if version == "IV":
        table[0xCE] = "EDIT"
    order = sorted(table.items(), key=lambda kv: (kv[1] not in _FIRST_ABBREVIATED, -len(kv[1]), kv[0]))
    names = [re.escape(n) + (r"(?![\w`])" if n in _WHOLE_WORD else "") for _, n in order]
    by_byte = table | {b + STATEMENT_FORM: n for b, n in table.items() if n in _TWO_FORMS}
    return Dialect(f"BASIC {version}", tuple((n, b) for b, n in order), by_byte, re.compile("|".join(names)))


def keyword_rows(version: str = "II") -> list[tuple[str, int, int, str, list[str]]]:
    """(dialect, ordinal, token, name, traits): the static dimension of keywords."""
    traits = {
        "whole_word": _WHOLE_WORD,
        "stays_inside": _STAYS_INSIDE,
        "opens_statement": _OPENS_STATEMENT,
        "wants_line": _WANTS_LINE,
        "literal_tail": _LITERAL_TAIL,
        "names_follow": _NAMES_FOLLOW,
        "two_forms": _TWO_FORMS,
        "first_abbreviated": _FIRST_ABBREVIATED,
    }
    d = dialect(version)
    return [(d.name, i, b, n, [t for t, of in traits.items() if n in of]) for i, (n, b) in enumerate(d.keywords)]


# -- line references


def pack_line_ref(number: int) -> bytes:
    high, low = number >> 8 & 0xFF, number & 0xFF
    return bytes((LINE_REF, (low >> 6 << 4 | high >> 6 << 2) ^ 0x54, low & 63 | 64, high & 63 | 64))


def unpack_line_ref(mask: int, low: int, high: int) -> int:
    mask ^= 0x54
    return (high & 63 | (mask >> 2 & 3) << 6) << 8 | low & 63 | (mask >> 4 & 3) << 6


# -- tokenizing

_HEX = re.compile(r"&[0-9A-Fa-f]*")
_DIGITS = re.compile(r"[0-9]+")
_NAME = re.compile(r"[\w`]*")
_STRING = re.compile(r'"[^"]*"?')


def _raw(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def _letters(text: str, at: int) -> int:
    while at < len(text) and text[at].isalpha():
        at += 1
    return at


def encode_line(text: str, version: str = "II") -> bytes:
    """Token bytes of a line's text. Characters above U+00FF become question marks."""
    d, out, at, size = dialect(version), bytearray(), 0, len(text)
    opening, wants_line = True, False  # at the start of a statement; digits are line references
    while at < size:
        c = text[at]
        if c.isalpha() or c in "_`":
            m = d.matcher.match(text, at)
            if m:
                name, end = m.group(), m.end()
            else:
                stop = _letters(text, at)
                short = d.abbreviated(text[at:stop]) if at < stop < size and text[stop] == "." else None
                name, end = (short[0], stop + 1) if short else (None, 0)
            if name is None:
                m = _NAME.match(text, at)
                out += _raw(m.group())
                at, opening, wants_line = m.end(), False, False
                continue
            token = next(b for n, b in d.keywords if n == name)
            out.append(token + STATEMENT_FORM if opening and name in _TWO_FORMS else token)
            at = end
            if name in _NAMES_FOLLOW:
                m = _NAME.match(text, at)
                out += _raw(m.group())
                at = m.end()
            wants_line = name in _WANTS_LINE
            if name in _LITERAL_TAIL:
                break
            opening = name in _OPENS_STATEMENT or (opening and name not in _STAYS_INSIDE)
        elif c == '"':
            m = _STRING.match(text, at)
            out += _raw(m.group())
            at, opening = m.end(), False
        elif c == "*" and opening:
            break
        elif c in "0123456789" and wants_line:
            m = _DIGITS.match(text, at)
            out += pack_line_ref(int(m.group()) & 0xFFFF)
            at, opening = m.end(), False
        elif c == "&":
            m = _HEX.match(text, at)
            out += _raw(m.group())
            at, opening, wants_line = m.end(), False, False
        else:
            out += _raw(c)
            at += 1
            if c == ":":
                opening, wants_line = True, False
            elif not (c.isspace() or c == ","):
                opening = False
                wants_line = wants_line and c in "0123456789"
    return bytes(out + _raw(text[at:]))


def decode_line(body: bytes, version: str = "II") -> str:
    """A record's body as LIST shows it; unknown tokens as `[&HH]`, a cut line reference as `?`."""
    names, out, at, size = dialect(version).by_byte, [], 0, len(body)
    end = body.find(RECORD)
    size = size if end < 0 else end
    while at < size:
        b = body[at]
        if b == 0x22:
            close = body.find(0x22, at + 1, size)
            stop = size if close < 0 else close + 1
            out.append(body[at:stop].decode("latin-1"))
            at = stop
        elif b == LINE_REF:
            if at + 3 < len(body):
                out.append(str(unpack_line_ref(*body[at + 1 : at + 4])))
                at += 4
            else:
                out.append("?")
                at += 1
        elif b < 0x80:
            out.append(chr(b))
            at += 1
        else:
            out.append(names.get(b) or f"[&{b:02X}]")
            at += 1
            if names.get(b) in _LITERAL_TAIL:
                out.append(body[at:size].decode("latin-1"))
                break
    return "".join(out)


def records(data: bytes):
    """(line number, body) of each record, then the offset after the end marker, or where the chain breaks, and whether it ends well."""
    at, size, lines, whole = 0, len(data), [], False
    while at < size and data[at] == RECORD:
        if at + 1 >= size:
            at += 1
            break
        if data[at + 1] == END:
            at, whole = at + 2, True
            break
        if at + 3 >= size or data[at + 3] < 4:
            at += 1
            break
        lines.append((data[at + 1] << 8 | data[at + 2], data[at + 4 : at + data[at + 3]]))
        at += data[at + 3]
    return lines, at, whole


def program_size(data: bytes) -> int:
    """Bytes up to the end marker and with it; 0 where there is no program, or the chain runs out of the data."""
    _, at, whole = records(data)
    return at if whole else 0


def is_program(data: bytes) -> bool:
    return records(data)[2]


def detokenize(data: bytes, version: str = "II") -> list[str]:
    return [f"{n:>5d}{decode_line(body, version)}" for n, body in records(data)[0]]


def is_plain_text(data: bytes) -> bool:
    return bool(data) and not data.translate(None, bytes((9, 10, 13, *range(32, 127))))


def classify(is_basic: bool, data: bytes) -> str:
    """BASIC, BASIC+MC, BASIC?, TEXT or BINARY, by the exec address and the content."""
    size = program_size(data)
    if size:
        if size < len(data) - SLACK:
            return "BASIC+MC"
        return "BASIC" if is_basic else "BASIC?"
    if is_basic:
        return "BASIC?"
    return "TEXT" if is_plain_text(data) else "BINARY"


# -- numbering and assembly

_NUMBERED = re.compile(r"(?s)\s*(?P<number>\d+)(?P<text>.*)")


def number_lines(lines: list[str], strict: bool = False) -> tuple[list[tuple[int, str]], list[str]]:
    """(number, text) of lines that aren't blank, and warnings; blank lines advance the automatic number."""
    out, warnings, last = [], [], 0
    for line in lines:
        bare = line.lstrip()
        if not bare:
            last += 1
        elif bare[0].isdigit() and (m := _NUMBERED.match(line)):
            number = int(m.group(1))
            if number <= last and (out or last):
                problem = f"line {number} isn't above line {last}"
                if strict:
                    raise ValueError(problem)
                warnings.append(problem)
            out.append((number, m.group(2)))
            last = max(last, number)
        else:
            last += 1
            out.append((last, " " + line.rstrip("\r\n")))
    return out, warnings


def tokenize(
    lines: list[str], version: str = "II", on_overflow: str | Callable[[int, str], str] = "error", strict: bool = False
) -> tuple[bytes, list[str]]:
    """A program and warnings. on_overflow, for lines of over 255 bytes: `error`, `compact`, or a function of number and text that gives a shorter text."""
    if not callable(on_overflow) and on_overflow not in ("error", "compact"):
        raise ValueError(f"on_overflow must be error or compact, not {on_overflow!r}")
    numbered, warnings = number_lines(lines, strict)
    out = bytearray()
    for number, text in numbered:
        body = encode_line(text, version)
        if len(body) + 4 > LONGEST_RECORD and on_overflow == "compact":
            warnings.append(f"line {number} of {len(body) + 4} bytes was compacted")
            body = encode_line(_NUMBERED.match(compact_line(f"{number}{text}")).group(2), version)
        elif len(body) + 4 > LONGEST_RECORD and callable(on_overflow):
            warnings.append(f"line {number} of {len(body) + 4} bytes was changed")
            body = encode_line(on_overflow(number, text), version)
        if len(body) + 4 > LONGEST_RECORD:
            raise ValueError(f"line {number} takes {len(body) + 4} bytes, {LONGEST_RECORD} at most")
        out += bytes((RECORD, number >> 8 & 255, number & 255, len(body) + 4)) + body
    return bytes(out + bytes((RECORD, END))), warnings


# -- spacing

_COMPARE = re.compile(r"<>|<=|>=|[=<>]")


def _literal_end(code: str, at: int) -> int:
    """End of the string or of the REM or DATA tail that starts at a place; `at` where none does."""
    if code[at] == '"':
        return _STRING.match(code, at).end()
    if code.startswith(("REM", "DATA"), at):
        return len(code)
    return at


def pretty_line(line: str, preserve_literals: bool = False) -> str:
    """Spaces around operators and colons and after commas.

    Runs of spaces collapse everywhere at the end, in literals too, unless
    preserve_literals: these stay as they are then.
    """
    m = _NUMBERED.match(line)
    if not m:
        return line
    number, code = line[: m.start(2)], m.group(2)
    if code.lstrip().startswith("*|"):
        return f"{number} {code.lstrip()}"
    if code and not code[0].isspace():
        code = " " + code
    parts: list[tuple[str, bool]] = []  # text, literal

    def put(text: str, literal: bool = False) -> None:
        parts.append((text, literal))

    def trim() -> None:
        while parts and not parts[-1][1]:
            text = parts.pop()[0].rstrip(" ")
            if text:
                return put(text)

    def last() -> str:
        for text, _ in reversed(parts):
            if text.rstrip():
                return text.rstrip()[-1]
        return ""

    at = 0
    while at < len(code):
        c = code[at]
        end = _literal_end(code, at)
        if end > at:
            put(code[at:end], True)
            at = end
            continue
        if m := _COMPARE.match(code, at):
            trim()
            put(f" {m.group()} ")
            at = m.end()
        elif c == "*" and last() in ("", ":"):
            put(code[at:], True)
            break
        elif c in "+-*/":
            at += 1
            if c in "+-" and last() in ("", *"(,:+-*/="):
                put(c)
                continue
            trim()
            put(f" {c} ")
        elif c in ":,":
            trim()
            put(" : " if c == ":" else ", ")
            at += 1
        else:
            put(c)
            at += 1
            continue
        while at < len(code) and code[at] == " ":
            at += 1
    if not preserve_literals:
        return number + re.sub(" {2,}", " ", "".join(t for t, _ in parts))
    out = ""
    for text, literal in parts:
        out += text if literal else re.sub(" {2,}", " ", text[1:] if text[:1] == " " and out.endswith(" ") else text)
    return number + out


def compact_line(line: str) -> str:
    """Drops spaces that don't part two word characters, outside literals."""
    m = _NUMBERED.match(line)
    if not m:
        return line
    code, out, at = m.group(2).lstrip(), line[: m.start(2)], 0
    made = ""
    while at < len(code):
        end = _literal_end(code, at)
        if end > at:
            made += code[at:end]
            at = end
        elif code[at] == " ":
            rest = code[at:].lstrip(" ")
            around = made[-1:], rest[:1]
            made += " " if all(x.isalnum() or x == "_" for x in around) and all(around) else ""
            at = len(code) - len(rest)
        else:
            made += code[at]
            at += 1
    return out + made


# -- escapes

_UPPER_HEX = "[0-9A-F]"
_ESCAPED = re.compile(rf"\\x({_UPPER_HEX}{_UPPER_HEX})")
_TO_ESCAPE = re.compile(r"[^\x20-\x5B\x5D-\x7E]")


def escape(text: str) -> str:
    """Backslash and all outside 0x20-0x7E as `\\xHH`; code points above U+00FF don't come back."""
    return _TO_ESCAPE.sub(lambda m: f"\\x{ord(m.group()):02X}", text)


def _character(escaped: re.Match) -> str:
    return chr(int(escaped[1], base=16))


def unescape(text: str) -> str:
    return _ESCAPED.sub(_character, text)


def has_escapes(text: str) -> bool:
    return _ESCAPED.search(text) is not None


def _is_utf8(data: bytes) -> bool:
    try:
        return data.decode() is not None
    except ValueError:
        return False


def source_lines(data: bytes) -> list[str]:
    """Lines of a source file: UTF-8, else ASCII with replacements; escapes undone; cut at CR LF, CR and LF alone."""
    text = data.decode("utf-8" if _is_utf8(data) else "ascii", errors="replace")
    if has_escapes(text):
        text = unescape(text)
    lines = re.split(r"\r\n|\r|\n", text)
    return lines[:-1] if lines[-1] == "" else lines
