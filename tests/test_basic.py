import random

import pytest

from platter.functions import basic as B


@pytest.mark.parametrize(
    "source,body",
    [
        ('PRINT"HELLO"', b'\xf1"HELLO"'),
        ("P.1", b"\xf11"),
        ("E.", b"\xe1"),
        ("REP.", b"\xf5"),
        ("A.", b"\x80"),
        ("T.=0", b"\xd1=0"),
        ("X=TIME", b"X=\x91"),
        ("TIME=0:PAGE=&1900", b"\xd1=0:\xd0=&1900"),
        ("TIMER=1", b"TIMER=1"),
        ("GOTO 10, 20", b"\xe5 \x8dTJ@, \x8dTT@"),
        ("GOTO A", b"\xe5 A"),
        ("IFA THEN10", b"\xe7A \x8c\x8dTJ@"),
        ("REM PRINT", b"\xf4 PRINT"),
        ("DATA PRINT", b"\xdc PRINT"),
        ("*FX PRINT", b"*FX PRINT"),
        ("A=2*3", b"A=2*3"),
        ("PROCPRINT", b"\xf2PRINT"),
        ("FNend:END", b"\xa4end:\xe0"),
        ('A$="PRINT', b'A$="PRINT'),
        ("&END", b"&E" + b"ND"),
    ],
)
def test_encode(source, body):
    assert B.encode_line(source) == body


def test_dialects():
    assert B.encode_line("EDIT") == b"EDIT" and B.encode_line("EDIT", "IV") == b"\xce"
    assert B.decode_line(b"\xce") == "[&CE]" and B.decode_line(b"\xce", "IV") == "EDIT"
    with pytest.raises(ValueError):
        B.dialect("V")


def test_decode_edges():
    assert B.decode_line(b"\x8dTJ") == "?TJ"
    assert B.decode_line(b'"\xf1"\xf1') == '"\xf1"PRINT'
    assert B.decode_line(b"\xf4\xf1\x0dX") == "REM\xf1"


def test_line_refs():
    for n in range(65536):
        assert B.unpack_line_ref(*B.pack_line_ref(n)[1:]) == n


def test_program_round_trip():
    rng = random.Random(3)
    names = [n for n, _ in B.dialect().keywords]
    for _ in range(50):
        source = [f"{10 * i:>5d}" + ":".join(rng.choice(names) + f"{rng.randint(0, 99)}" for _ in range(5)) for i in range(1, 9)]
        data, _ = B.tokenize(source)
        listed = B.detokenize(data)
        assert B.tokenize(listed)[0] == data and B.detokenize(B.tokenize(listed)[0]) == listed
        assert B.is_program(data) and B.program_size(data) == len(data) == B.program_size(data + b"xyz")


@pytest.mark.parametrize("data", [b"", b"\r", b"\r" + b" " * 40, b"\r\0\x0a\xf0", b"\r\0\x0a\x03abc", b"abc", b"\r\0\x0a\x05\xe0"])
def test_broken_chains(data):
    assert not B.is_program(data) and B.program_size(data) == 0


def test_classify():
    program, _ = B.tokenize(["10PRINT"])
    assert B.classify(True, program) == "BASIC" and B.classify(False, program) == "BASIC?"
    assert B.classify(True, program + bytes(17)) == "BASIC+MC" == B.classify(False, program + bytes(17))
    assert B.classify(True, program + bytes(16)) == "BASIC"
    assert B.classify(True, b"text") == "BASIC?" and B.classify(False, b"text\r\n") == "TEXT"
    assert B.classify(False, b"\x00") == B.classify(False, b"") == "BINARY"


def test_numbering():
    assert B.number_lines(["PRINT", "", "END"])[0] == [(1, " PRINT"), (3, " END")]
    assert B.number_lines(["", "10A", "B", "5C", "D"]) == ([(10, "A"), (11, " B"), (5, "C"), (12, " D")], ["line 5 isn't above line 11"])
    with pytest.raises(ValueError):
        B.number_lines(["10A", "10B"], strict=True)


def test_overflow():
    line = "10PRINT" + " : ".join("A = 1" for _ in range(40))
    with pytest.raises(ValueError):
        B.tokenize([line])
    data, warnings = B.tokenize([line], on_overflow="compact")
    assert len(warnings) == 1 and B.is_program(data)
    with pytest.raises(ValueError):
        B.tokenize(["10REM" + "x" * 300], on_overflow="compact")


@pytest.mark.parametrize(
    "line,pretty",
    [
        ("   10A=1", "   10 A = 1"),
        ("10IFA<>B:C=-1", "10 IFA <> B : C = -1"),
        ("10PRINTA,B;-C", "10 PRINTA, B; - C"),
        ("10*FX 1=2", "10 *FX 1=2"),
        ("10*|x  y", "10 *|x  y"),
        ('10P="a  b=c"', '10 P = "a b=c"'),
        ("10REMa=b", "10 REMa=b"),
        ("none", "none"),
    ],
)
def test_pretty(line, pretty):
    assert B.pretty_line(line) == pretty


def test_pretty_literals_and_compact():
    assert B.pretty_line('10P="a  b"', preserve_literals=True) == '10 P = "a  b"'
    assert B.compact_line('10 IF A = 1 THEN PRINT "a  b" , -X') == '10IF A=1 THEN PRINT"a  b",-X'
    assert B.compact_line("10 REM  a  b") == "10REM  a  b"


def test_escapes():
    text = "".join(map(chr, range(256)))
    assert B.unescape(B.escape(text)) == text and B.has_escapes("\\x85") and not B.has_escapes("\\x8g")


def test_source_lines():
    assert B.source_lines(b"a\r\nb\rc\nd\x85e\x0bf") == ["a", "b", "c", "d\ufffde\x0bf"]
    assert B.source_lines("a\x85b".encode()) == ["a\x85b"]
    assert B.source_lines(b"\\x41\n") == ["A"]


def test_overflow_by_a_function():
    long = ["10 PRINT 1", "20 REM " + "x" * 300]
    with pytest.raises(ValueError):
        B.tokenize(long)
    data, warnings = B.tokenize(long, on_overflow=lambda number, text: text[:20] + str(number))
    assert B.detokenize(data)[1] == "   20" + (" REM " + "x" * 300)[:20] + "20" and len(warnings) == 1
    with pytest.raises(ValueError):
        B.tokenize(long, on_overflow=lambda number, text: text)
