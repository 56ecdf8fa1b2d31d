"""File access: the grammar of access specs, and native, stardot and display forms.

ADFS bits on disc: R W L D E r w e from bit 0. Sidecar bits: R W E L r w e l.
A flat-catalogue file knows the lock alone. `native_*` functions take and give
Columns, the parsers run on the driver when a query is made.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

R, W, L, D, E, PUBLIC_R, PUBLIC_W, PUBLIC_E = (1 << i for i in range(8))
ALL = 0xFF & ~D
#: Bits that a directory may not have.
NOT_ON_DIRECTORIES = W | PUBLIC_R | PUBLIC_W | PUBLIC_E
_BITS = {"R": R, "W": W, "L": L, "E": E, "r": PUBLIC_R, "w": PUBLIC_W, "e": PUBLIC_E}
#: (bit on disc, bit in sidecars)
_PAIRS = ((R, 1), (W, 2), (L, 8), (E, 4), (PUBLIC_R, 16), (PUBLIC_W, 32), (PUBLIC_E, 64))
_OWNER, _PUBLIC = (("L", L), ("W", W), ("R", R), ("E", E)), (("w", PUBLIC_W), ("r", PUBLIC_R), ("e", PUBLIC_E))


class AccessError(ValueError):
    pass


def parse_spec(spec: str, disc_format: str) -> tuple[int, int, list[str]]:
    """(bits to set, bits to clear, letters passed over) of `LWR/r`, `+L-W` or the empty spec.

    New access is `current & ~clear | set`. An absolute spec clears all bits. A
    DFS disc knows L, and LOCKED in full; its lock is the bit L here.
    """
    if disc_format not in ("dfs", "adfs"):
        raise ValueError(f"no disc format {disc_format!r}")
    flat = disc_format == "dfs"
    everything = L if flat else ALL
    known = {"L": L, "l": L} if flat else _BITS
    if flat and spec.upper() == "LOCKED":
        return L, L, []
    if spec[:1] in ("+", "-") and spec:
        pairs = re.findall(r"[+-][^+-]", spec)
        if "".join(pairs) != spec:
            raise AccessError(f"{spec!r}: a change is pairs of + or - and a letter, not mixed with plain letters")
        masks, ignored = {"+": 0, "-": 0}, []
        for op, letter in pairs:
            if letter in known:
                masks[op] |= known[letter]
            else:
                ignored.append(op + letter)
        if masks["+"] & masks["-"]:
            raise AccessError(f"{spec!r} both sets and clears a bit")
        return masks["+"], masks["-"], ignored
    if spec and not spec[0].isalpha():
        raise AccessError(f"{spec!r} must start with a letter, + or -")
    if "+" in spec or "-" in spec:
        raise AccessError(f"{spec!r} mixes plain letters with changes")
    bits, ignored = 0, []
    owner, slash, public = spec.partition("/")
    for part, fold in ((owner, False), (public, True)):
        for letter in part:
            found = known.get(letter.lower() if fold and not flat else letter)
            if found is None and letter != "/":
                ignored.append(letter)
            bits |= found or 0
    return bits, everything, ignored


def access_string(access: Column, is_directory: Column) -> Column:
    """`D` of a directory, owner letters as LWRE, public ones as wre after a slash."""
    has = lambda bit: access.bitwiseAND(bit) != 0
    letters = [F.when(is_directory, "D").otherwise("")]
    letters += [F.when(has(bit), c).otherwise("") for c, bit in _OWNER]
    letters += [F.when(has(PUBLIC_R | PUBLIC_W | PUBLIC_E), "/").otherwise("")]
    letters += [F.when(has(bit), c).otherwise("") for c, bit in _PUBLIC]
    return F.concat(*letters)


def _moved(value: Column, pairs) -> Column:
    out = F.lit(0)
    for a, b in pairs:
        out = out.bitwiseOR(F.when(value.bitwiseAND(a) != 0, b).otherwise(0))
    return out.cast("int")


def to_sidecar(access: Column) -> Column:
    """Sidecar byte of a native ADFS byte."""
    return _moved(access, _PAIRS)


def from_sidecar(byte: Column, is_directory: Column) -> Column:
    """Native ADFS byte of a sidecar byte, with D for directories."""
    return _moved(byte, [(b, a) for a, b in _PAIRS]).bitwiseOR(F.when(is_directory, D).otherwise(0))


def changed(access: Column, is_directory: Column, set_bits: int, clear_bits: int) -> Column:
    """The byte after a parsed spec; bits that a directory may not have are dropped, D stays."""
    new = access.bitwiseAND(F.lit(0xFF & ~clear_bits & ~D)).bitwiseOR(F.lit(set_bits))
    return F.when(is_directory, new.bitwiseAND(F.lit(0xFF & ~NOT_ON_DIRECTORIES)).bitwiseOR(F.lit(D))).otherwise(new)


def sidecar_of(access: int) -> int:
    return sum(b for a, b in _PAIRS if access & a)


def native_of(byte: int) -> int:
    return sum(a for a, b in _PAIRS if byte & b)
