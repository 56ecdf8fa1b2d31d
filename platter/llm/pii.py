"""Personal data by anchor expansion (operator 10).

One pass of an Aho-Corasick automaton over the lower-cased text finds the
anchors: at-signs, plus signs, schemes (`https://`), obfuscated at-signs
(` (at) `) and identifier cues (`password=`, `token =`, `iban`, `account`).

Base spans are those of the contract's patterns, leftmost and non-overlapping.
E-mail addresses are expanded from at-signs, phone numbers from plus signs. The
other two kinds have no anchor but their digits: maximal runs of digits, with
points or with spaces and hyphens between, are read once and cut.

The method adds spans. From each further anchor a deterministic parser expands
and validates the boundary:

* email: `name (at) host (dot) tld`, words of letters, digits, dots and hyphens;
* url: an address with user information (`scheme://user:secret@host`) or a
  personal query field (`email=`, `phone=`, `user=`, `name=`);
* secret: a quoted or bare value of 12 or more letters, digits, `+/_-`, with a
  digit and a letter, after a cue and `=` or `:`;
* account: an IBAN with valid check digits after or without a cue word, or 8 to
  17 digits after `account` or `acct`. An IBAN is cut to its country's length,
  and where no cue stands, a listed country code and two digits are its anchor.

Defined results: null is the empty text and has no spans. Base spans stay; an
added span that overlaps a base span or an earlier added one is dropped. Very
long texts: each parser reads a character a bounded number of times, so time
and memory grow with the length.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from platter.llm._common import map_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "secret", "account")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Four or more numbers with points between: the pattern's matches are each four of them in turn.
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}([\"']?)([A-Za-z0-9+/_\-]{12,})\1")
_URL = re.compile(r"[^\s<>\"']+")
_PERSONAL_FIELD = re.compile(r"[?&](?:email|e-mail|phone|tel|user|username|name|ssn)=(?=[^&#])", re.I)
_AUTHORITY = re.compile(r"[^/?#]*")
_OBFUSCATED = re.compile(
    r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)((?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\.)[A-Za-z0-9-]+)+", re.I
)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_ANCHOR = re.compile(r"[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
        "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
        "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
        "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_IBAN_OF = {
    n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + rf"\x20?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) + "(?![A-Za-z0-9])")
    for n in set(_IBAN_LENGTHS.values())
}
_ACCOUNT = re.compile(r"(?:\s?(?:no\.?|number|nr\.?|#))?\s{0,2}[:=#]?\s{0,2}([0-9]{8,17})(?![0-9])", re.I)

_GAP = re.compile(r"[\x20:]{0,2}")

_CUES = {
    "@": "@",
    "+": "+",
    **dict.fromkeys(("http://", "https://", "ftp://", "ssh://", "mailto:"), "url"),
    **dict.fromkeys(("(at)", "[at]", "{at}"), "at"),
    **dict.fromkeys(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key"), "secret"),
    **dict.fromkeys(("account", "acct"), "account"),
    "iban": "iban",
}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for cue, kind in _CUES.items():
            made.add_word(cue, (len(cue), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def lower_case(text: str) -> str:
    """Lower case, a code point for each."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case has two code points
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower


def anchors(lower: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every cue, ascending by end."""
    return [(end + 1 - length, end + 1, kind) for end, (length, kind) in automaton().iter(lower)]


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, leftmost and non-overlapping, from the at-signs."""
    out, done = [], 0
    for at in ats:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out, done = [], 0
    for at in pluses:
        if at >= done and (m := _PHONE.match(text, at)):
            done = m.end()
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(m.span())
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of the ip pattern whose parts are at most 255."""
    out = []
    for m in _NUMBERS.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str, found: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """found: the text's anchors."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if ats := [start for start, _, kind in found if kind == "@"]:
        out["email"] = emails(text, ats)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = addresses(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if pluses := [start for start, _, kind in found if kind == "+"]:
        out["phone"] = phones(text, pluses)
    return out


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """End of the valid IBAN of its country's length that starts at `at`, if there is one."""
    length = _IBAN_LENGTHS.get(text[at : at + 2])
    m = length and _IBAN_OF[length].match(text, at)
    return m.end() if m and iban_valid(m.group()) else None


class _Taken:
    """Disjoint intervals, ascending."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def claim(self, a: int, b: int) -> bool:
        """Takes [a, b) unless part of it is taken."""
        i = bisect.bisect_right(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class _Urls:
    """Addresses around scheme cues. A run of characters that an address may have is read once, however many cues it holds."""

    def __init__(self, text: str):
        self.text = text
        self.run_end = self.end = self.personal = -1
        self.authority_end = self.colon = self.at = -1

    def expand(self, start: int, after: int) -> tuple[str, int, int] | None:
        if start >= self.run_end:
            m = _URL.match(self.text, start)
            self.run_end, self.end = m.end(), start + len(m.group().rstrip(".,;:!?)"))
            # where the last personal field begins
            self.personal = max((f.start() for f in _PERSONAL_FIELD.finditer(self.text, start, self.end)), default=-1)
        if self.personal < start:
            if after >= self.authority_end:
                self.authority_end = _AUTHORITY.match(self.text, after, max(after, self.end)).end()
                self.colon, self.at = (self.text.rfind(c, after, self.authority_end) for c in ":@")
            if self.colon < after or self.at < after:
                return None
        return ("url", start, self.end) if self.end > start else None


def _expand(text: str, lower: str, start: int, after: int, kind: str, urls: _Urls) -> tuple[str, int, int] | None:
    """The validated span around the cue text[start:after], if there is one."""
    if kind == "secret":
        m = _SECRET.match(text, after)
        if m and any(c.isdigit() for c in m.group(2)) and any(c.isalpha() for c in m.group(2)):
            return ("secret", *m.span(2))
    elif kind == "at":
        before = text[max(0, start - 66) : start]
        name = before.removesuffix(" ")
        left = _LOCAL_END.search(name)
        m = _OBFUSCATED.match(text, after + (text[after : after + 1] == " "))
        if left and m:
            return ("email", start - len(before) + left.start(), m.end())
    elif kind == "url":
        return urls.expand(start, after)
    elif kind in "@+":
        return None
    elif start == 0 or not lower[start - 1].isalnum():
        at = _GAP.match(text, after).end()
        if end := iban_end(text, at):
            return ("account", at, end)
        if (m := _IBAN.match(text, at)) and iban_valid(m.group()):  # a country that isn't listed
            return ("account", *m.span())
        if kind == "account" and (m := _ACCOUNT.match(text, after)):
            return ("account", *m.span(1))
    return None


def added_spans(
    text: str, lower: str, found: list[tuple[int, int, str]], base: dict[str, list[tuple[int, int]]]
) -> dict[str, list[tuple[int, int]]]:
    """Spans expanded from cues, by kind; none overlaps a base span or an earlier added one."""
    out: dict[str, list[tuple[int, int]]] = {"email": [], **{k: [] for k in ADDED}}
    taken, urls = None, _Urls(text)
    for start, after, kind in found:
        span = _expand(text, lower, start, after, kind, urls)
        if span:
            taken = taken or _Taken([s for k in BASE for s in base[k]])
            if taken.claim(*span[1:]):
                out[span[0]].append(span[1:])
    for m in _IBAN_ANCHOR.finditer(text):
        at = m.start()
        if (not at or not _ALNUM.match(text, at - 1)) and (end := iban_end(text, at)):
            taken = taken or _Taken([s for k in BASE for s in base[k]])
            if taken.claim(at, end):
                out["account"].append((at, end))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, all spans."""
    lower = lower_case(text)
    cues = anchors(lower)
    base = base_spans(text, cues)
    added = added_spans(text, lower, cues, base)
    return base, {k: sorted(base.get(k, []) + added.get(k, [])) for k in KINDS}


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Each maximal run of overlapping spans replaced by the kind of its first, in angle brackets."""
    flat = sorted((a, -b, KINDS.index(k)) for k, v in spans.items() for a, b in v)
    parts, at = [], 0
    for a, minus_b, kind in flat:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, -minus_b)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Digest of the spans of every text; n_ columns count base spans, n_added the method's."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in batch.column("text").to_pylist():
            base, every = find(text or "")
            for k in BASE:
                rows[f"n_{k}"].append(len(base[k]))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(every))
            rows["n_added"].append(sum(map(len, every.values())) - sum(map(len, base.values())))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **rows})

    return map_batches(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]),
        one,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns with spans replaced in text, and n_chars, where there is one, counted anew; null stays null."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redact(t, find(t)[1]) for t in batch.column("text").to_pylist()]
        columns = dict(zip(batch.schema.names, batch.columns))
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", docs["n_chars"].cast("long"))
    return map_batches(docs, one, docs.schema)
