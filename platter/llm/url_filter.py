"""URL filters with redirect equivalence (operator 9).

Rules are (host, path, verdict). A rule fits its host and all subdomains where
the url's path starts with the rule's; the longest (host and path together)
wins. Where no rule fits, aliases decide: redirect and canonical-link edges,
taken from the pages' own markup, join urls into components, found by
alternating stars. A component in which a rule blocks any url, whether the
table holds its page or an edge alone names it, blocks its pages without a rule;
an explicit allow of a page always stands for that page. Else the verdict is
`default`.

Edges: every `<link>` tag with `canonical` among the words of its rel, and
every `<meta>` refresh; names in any case. Entities of `&`, `/`, `:`, `=`, `?`
are decoded, references resolved against the page's url (scheme-relative,
absolute and relative paths, queries alone) and dot segments removed. A tag ends
at its first `>`; `<base>` isn't regarded.

A url's identity is its host, path and query, as 128 bits; scheme and fragment
don't count. Defined results: null urls and urls without `://` have an empty
host and path, fit no rule and take the default. Repeated rows are judged
alike. Null or empty html has no edges. Very long html is searched in linear
time. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm._common import Scratch, map_batches
from platter.llm.components import components

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)
_TAG = re.compile(r"<(link|meta)\b[^<>]*+>", re.I | re.A)
_IS_CANONICAL = re.compile(r"[\s\"'/]rel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)", re.I | re.A)
_IS_REFRESH = re.compile(r"[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b", re.I | re.A)
_VALUES = {n: re.compile(rf"[\s\"'/]{n}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.A) for n in ("href", "content")}
_IN_CONTENT = re.compile(r"url\s*=\s*[\"']?([^\"']*)", re.I | re.A)
#: Entities of the characters that part a url; ampersands last: what they make isn't decoded again.
_ENTITIES = [
    (re.compile(f"&(?:{names});", re.I), char)
    for char, names in (("/", "sol|#0*47|#x0*2f"), (":", "colon|#0*58|#x0*3a"), ("=", "equals|#0*61|#x0*3d"), ("?", "quest|#0*63|#x0*3f"), ("&", "amp|#0*38|#x0*26"))
]
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; empty where url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    # substring_index takes what is before the first delimiter; it needs no regular expression
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls. Of equally long ones the first wins."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def without_dots(path: str) -> str:
    """Dot segments of an absolute path removed; a path that ends in one keeps its last slash."""
    if "/." not in path:
        return path or "/"
    done: list[str] = []
    parts = path[1:].split("/")
    for x in parts:
        if x == "..":
            del done[-1:]
        elif x != ".":
            done.append("/" + x)
    return "".join(done) + ("/" if parts[-1] in (".", "..") else "") or "/"


def parts_of(url: str) -> tuple[str, str, str]:
    """Host, A-Z lower-cased, path and query."""
    host, path, query = _PARTS.match(url.partition("://")[2]).groups()
    return host.translate(_LOWERED), path, query or ""


def identity(host: str, path: str, query: str) -> str:
    return hashlib.md5((host + without_dots(path) + query).encode("utf-8", "replace")).hexdigest()


def rule_verdict(host: str, path: str, rules=RULES) -> str | None:
    """Verdict of the longest rule that fits."""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None


def references(html: str) -> list[str]:
    """What canonical links and refreshes point to, decoded."""
    out = []
    for m in _TAG.finditer(html):
        tag = m.group()
        if m.group(1).lower() == "link":
            value = _VALUES["href"].search(tag) if _IS_CANONICAL.search(tag) else None
        else:
            value = _VALUES["content"].search(tag) if _IS_REFRESH.search(tag) else None
        to = next((g for g in value.groups() if g), "") if value else ""
        if to and m.group(1).lower() == "meta":
            to = inner.group(1) if (inner := _IN_CONTENT.search(to)) else ""
        if "&" in to:
            for entity, char in _ENTITIES:
                to = entity.sub(char, to)
        if to := to.strip(" "):
            out.append(to)
    return out


def target(to: str, host: str, path: str) -> tuple[str, str, str] | None:
    """Host, path and query of a reference on a page; None where it is no other place."""
    if m := _SCHEME.match(to):
        return parts_of(to) if to.startswith("//", m.end()) else None
    if to.startswith("#"):
        return None
    if to.startswith("//"):
        rest = to[2:]
    elif to.startswith("/"):
        rest = host + to
    elif to.startswith("?"):
        rest = host + path + to
    else:
        rest = host + (path.rpartition("/")[0] + "/") + to
    return parts_of("://" + rest)


def link_edges(pages: DataFrame, rules=RULES) -> DataFrame:
    """(u, v, u_verdict, v_verdict) of redirects and canonical links, with the verdict of the rule that fits each end."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set()
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            if refs := references(html):
                own = parts_of(url)
                u, u_verdict = identity(*own), rule_verdict(*own[:2], rules)
                for place in filter(None, (target(to, *own[:2]) for to in refs)):
                    v = identity(*place)
                    if u != v:
                        found.add((u, v, u_verdict, rule_verdict(place[0], without_dots(place[1]), rules)))
        names = ("u", "v", "u_verdict", "v_verdict")
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(4)], names)

    lower = F.lower("html")
    cue = (lower.contains("canonical") | lower.contains("refresh")) & (F.instr("url", "://") > 0)
    return map_batches(pages.where(cue).select("url", "html"), one, "u string, v string, u_verdict string, v_verdict string").distinct()


def _identities(url: Column) -> Column:
    @F.pandas_udf("string")
    def of(urls):
        return type(urls)([identity(*parts_of(u)) if u and "://" in u else None for u in urls], index=urls.index, dtype=object)

    return of(url)


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_component (null for pages that no edge names)."""
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    scratch = Scratch(pages.sparkSession, "url-filter")
    edges = scratch.table(link_edges(pages, rules), "edges")
    if edges.isEmpty():
        out = judged.withColumns({"alias_component": F.lit(None).cast("string"), "blocked": F.lit(False)})
    else:
        groups = scratch.table(components(edges.select("u", "v"), scratch), "groups")
        ends = edges.select(F.col("u").alias("id"), F.col("u_verdict").alias("verdict")).unionByName(
            edges.select(F.col("v").alias("id"), F.col("v_verdict").alias("verdict"))
        )
        bad = ends.where("verdict = 'block'").select(F.col("id").alias("node")).distinct()
        bad = groups.join(bad, "node").select("component", F.lit(True).alias("blocked")).distinct()
        aliases = groups.join(bad, "component", "left").select(
            F.col("node").alias("id"), F.col("component").alias("alias_component"), "blocked"
        )
        # A row for each identity that an edge names. Urls without one get a value of their own: nulls would meet in one task.
        spread = F.concat(F.lit("none "), F.xxhash64("page_id", "url").cast("string"))
        out = judged.withColumn("id", F.coalesce(_identities(F.col("url")), spread))
        out = out.join(aliases, "id", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise(default)).alias("verdict"),
        "alias_component",
    )
