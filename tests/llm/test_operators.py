"""Operators against brute force and on odd inputs: nulls, empties, ties, repeats, clashing columns, long texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from platter.llm import (
    byte_bpe,
    components,
    embedding_dedup,
    fingerprint,
    html_text,
    line_dedup,
    minhash_dedup,
    packing,
    pii,
    queries,
    toxicity,
    url_filter,
)
from platter.llm._common import Scratch

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(2, 8))) for _ in range(800)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def variant(text, changes, seed):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"w{r.random()}"
    return " ".join(words)


SHARED = "A line that many documents share, which is long enough."
BASE = prose(200, 1)
DOCS = [
    (1, BASE), (2, BASE), (3, variant(BASE, 2, 2)), (4, variant(BASE, 60, 3)), (5, None), (6, ""), (7, " \n\t"), (8, "one two"),
    (9, "One TWO"), (10, "ÉA b c d e f"), (11, "éa b c d e f"), (12, prose(9000, 4)), (13, f"{SHARED}\nx"), (14, f"  {SHARED.upper()} \ny"),
    (15, f"{SHARED}\n{SHARED}"), (16, f"z\n{SHARED}"), (17, SHARED), (18, "mail a.b+c@x-y.example.org now"), (None, "no id"), (19, "x" * 5000),
    *((100 + i, variant(prose(150, 50), i % 9, i)) for i in range(45)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", None if t is None else len(t), i, "clash", t) for i, t in DOCS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, rep string, component_id string"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1


def jaccard(a, b):
    x, y = (dict(zip(*(v.tolist() for v in fingerprint.terms(t)))) for t in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / (sum(max(x.get(k, 0), y.get(k, 0)) for k in keys) or 1)


def test_fingerprints(docs, empty):
    rows = {r.doc_id: r for r in fingerprint.fingerprint_neighbours(docs).collect()}
    order = sorted(DOCS, key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), d[1] or ""))
    assert len(rows) == len(DOCS)
    off = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        if t.split() and changed.split():
            off.append(r.near_edited - jaccard(t, changed))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.09
    assert rows[1].fingerprint == rows[2].fingerprint and rows[5].fingerprint == rows[6].fingerprint == rows[7].fingerprint
    assert fingerprint.fingerprint_neighbours(empty).count() == 0
    assert len(fingerprint.fingerprint_neighbours(docs.where("doc_id = 4")).collect()) == 1


def test_collision_rate():
    for share in (20, 100, 180):
        off = []
        for seed in range(12):
            words = prose(200, seed).split()
            a, b = " ".join(words), " ".join(words[:share] + prose(200 - share, 99 + seed).split())
            s = fingerprint.signatures([a, b])
            off.append(fingerprint.likeness(s[:1], s[1:])[0] - jaccard(a, b))
        assert abs(np.mean(off)) < 0.04


def test_weights_count():
    a, b = "to be " * 50, "to be " * 5
    s = fingerprint.signatures([a, b])
    assert abs(fingerprint.likeness(s[:1], s[1:])[0] - jaccard(a, b)) < 0.15


# -- 2


def brute_segments(scores):
    """Maximal segments by their definition: every proper part scores less, and no longer segment has that too."""
    n = len(scores)
    s = np.concatenate([[0], np.cumsum(scores)])
    good = [
        (i, j) for i in range(n) for j in range(i + 1, n + 1)
        if s[j] > s[i] and all(s[k] > s[i] for k in range(i + 1, j + 1)) and all(s[k] < s[j] for k in range(i, j))
    ]
    return sorted((i, j) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good))


def test_segments():
    r = np.random.default_rng(1)
    for _ in range(300):
        scores = r.normal(-0.3, 1, r.integers(0, 25)).tolist()
        assert sorted(x[:2] for x in toxicity.segments(scores)) == brute_segments(scores)


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    bad = ["idiot", "moron", "scum"]
    rows = []
    for i in range(1200):
        words = prose(r.randint(5, 120), 1000 + i).split()
        toxic = i % 10 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    out = {x.doc_id: x for x in toxicity.score_toxicity(both.drop("toxic"), model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in out if out[i].held_out} == set(held)
    right = sum(out[i].predicted == (i % 10 == 0) for i in held) / len(held)
    assert right > 0.97 and min(out[i].score for i in held if i % 10 == 0) > max(out[i].score for i in held if i % 10) - 0.5
    odd = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    assert len(odd) == len(DOCS) and all(0 <= x.score <= 1 for x in odd.values()) and odd[5].score == odd[6].score < 0.3
    assert odd[None].held_out is False
    assert toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)


def brute_score(model, text):
    """The score by its definition, with segments by theirs."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    scores, seen = [], {}
    for at, w in enumerate(words):
        known = [model.scores[x] for x in (w, *(w[:n] + "*" for n in (6, 5, 4, 3) if len(w) > n)) if x in model.scores]
        s = known[0] if known else model.unknown
        if s > 0 and w in seen and at - seen[w] < 100:
            scores.append(model.unknown)
        else:
            scores.append(s)
        if s > 0:
            seen[w] = at
    x = [model.lam * sum(scores[a:b]) - math.log(model.k * len(words)) for a, b in brute_segments(scores)]
    best, total = max([0.0, *x]), sum(v for v in x if 1 - math.exp(-math.exp(-v)) < 1e-3)
    w = model.weights
    return 1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(best) + w[2] * math.log1p(total))))


def test_toxicity_scores_and_offset(spark):
    r = random.Random(6)
    rows = []
    for i in range(1600):
        words = prose(r.randint(3, 25), 3000 + i).split()
        toxic = i % 8 == 0
        for _ in range(r.randint(1, 3) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "idiots", "moron", "scum"]))
        rows.append((i, " ".join(words), int(toxic)))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(both, both)
    out = {x.doc_id: x.score for x in toxicity.score_toxicity(both, model).collect()}
    assert max(abs(out[i] - brute_score(model, t)) for i, t, _ in rows[::9]) < 1e-9
    # a bound that drops most clean documents doesn't move the threshold
    few = toxicity.train(both, both, sample=100)
    held = [(few.probability(t)[0] >= 0.3, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p for p, _ in held]) < 0.2 and np.mean([p == y for p, y in held]) > 0.9


def test_toxicity_without_labels(spark, docs):
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    one = toxicity.train(docs, spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, toxic int"))
    assert all(r.score in (0.0, 1.0) for r in toxicity.score_toxicity(docs, one).collect())


# -- 3


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("a<b>b</b>c <i> d</i>", "abc d"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b</div>", "a\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<p hidden>x</p>y", "y"), ('<p style="display: none">x</p>y', "y"),
    ("<style>.n{display:none} p.z,#q{visibility:hidden}</style><p class='a n'>x<p class=z>y<div id=q>z</div>w", "w"),
    ("<script>if(a<b)x='</p>'</script>t", "t"), ("<head><title>t</title></head><body>b", "b"), ("a &amp; b &lt; &eacute; &#65;", "a & b < é A"),
    ("1 < 2 and 3", "1 < 2 and 3"), ("a<!-- x > y -->b", "ab"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("</p>x</div>", "x"), ("<b>unclosed <i>deep", "unclosed deep"),
    ("<blockquote>q</blockquote>", "> q"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ('<img alt="pic">', "pic"), ("<!DOCTYPE html><html><body>x", "x"),
    ("<table><caption>c</caption><tr><th>h</table>", "c\nh"), ("<a href='x>y'>z</a>", "z"),
])
def test_html(source, text):
    assert html_text.to_text(source).strip("\n") == text


@pytest.mark.parametrize("source,text", [
    ("<table><tbody><form><tr><td>a<td>b</tr></form></tbody></table>", "a | b"), ("<table><tr><form><td>a<td>b</form></tr></table>", "a | b"),
    ("<table><tr><a href=x><td>a</td></a><td>b</td></tr></table>", "a | b"), ("<table><tr>x<td>a</td>y</tr></table>", "xy\na"),
    ("<table><tbody>x<tr><td>a</tr>y</tbody></table>", "x y\na"), ("<table><form><td>a<td>b</form></table>", "a | b"),
    ("<table><tr><div>x<table><tr><td>n</table></div><td>a</table>", "x\n\nn\na"), ("<table><tr><font hidden><td>a</font></table>", ""),
])
def test_html_table_parts(source, text):
    got = html_text.to_text(source).strip("\n")
    assert [x for x in got.split("\n") if x] == [x for x in text.split("\n") if x]


@pytest.mark.parametrize("css,text", [
    ("@media print{.n,.s{display:none}}", "x\ny"), ("@media (max-width: 600px){.n{display:none} .s{color:red}}", "x\ny"), ("@media(max-width:9px){.n{display:none}}", "x\ny"),
    ("@media screen and (min-width:1px){.n{display:none}} .s{display:none}", "x"), ("@media screen{.n{display:none}}", "y"), ("@media print, all { .n{display:none}}", "y"),
    ("@supports (display:grid){.n{display:none}}", "x\ny"), ("@layer a{.n{display:none}}", "y"), ("@import 'a';.n{color:red;display:none}", "y"), (".n{color:red; .s{display:none}}", "x\ny"),
    ("@media print{@media all{.n{display:none}}}.s{content:'}';visibility:hidden}", "x"), ("/* } */ .n{display:none", "y"), ("@font-face{a:b}@media print{.n{a:b}}.n{display:none}", "y"),
])
def test_html_at_rules(css, text):
    body = "<div class=n>x</div><div class=s>y</div>"
    assert html_text.to_text(f"<style>{css}</style>{body}") == text
    assert html_text.to_text(f"<style media=print>{css}</style>{body}") == "x\ny"


def test_html_deep_and_table(spark):
    deep = "<div>" * 5000 + "x" + "<ul><li>" * 3000 + "y"
    assert html_text.to_text(deep).replace(" ", "").replace("-", "").split() == ["x", "y"]
    pages = spark.createDataFrame([(1, "u", "<p>a", "old"), (2, "u", None, "old"), (2, None, "", None)], "page_id long, url string, html string, text string")
    assert table(html_text.extract_text(pages)) == [(1, "u", "a"), (2, "u", ""), (2, None, "")]
    assert html_text.extract_text(pages.where("false")).count() == 0


# -- 4


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 24))
    near = np.concatenate([base[:40] + r.normal(size=(40, 24)) * s for s in (0.05, 0.2, 0.4)])
    x = np.concatenate([base, near, base[:10] * 3.0, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [float("inf")] + [1.0] * 23), (904, []), (905, [None] * 24), (None, x[0].tolist()), (906, [1.0, 0.0]), (907, [1.0, 0.1])]
    rows += [(i, v, 0) for i, v in odd] + [rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], 1 << 40).min(axis=1))
        if (new == label).all():
            break
        label = new
    for probe in (None, embedding_dedup.PROBE):
        out = {r.vec_id: r for r in embedding_dedup.dedup_embeddings(df, probe=probe).collect()}
        wrong = sum((out[i].n_links, out[i].component_id) != (link[i].sum(), label[i]) for i in range(len(x)))
        assert wrong == 0
    assert all(out[i].n_links == 0 and out[i].kept and out[i].component_id == i for i in range(900, 906))
    assert out[None].component_id is None and out[906].n_links == 1 and out[907].component_id == 906
    assert embedding_dedup.dedup_embeddings(df).count() == len(rows)
    assert embedding_dedup.dedup_embeddings(df.where("false")).count() == 0


def test_no_pair_is_lost_between_cells():
    """Hundreds of cells, anisotropic vectors and differences: each pair shares a cell by the default rule."""
    r = np.random.default_rng(12)
    scale = 1 / np.arange(1, 129)
    base = embedding_dedup.unit_rows(r.normal(size=(3000, 128)) * scale)
    off = r.normal(size=base.shape) * scale
    off -= np.einsum("ij,ij->i", off, base)[:, None] * base
    cosine = r.uniform(0.9001, 0.93, len(base))[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * embedding_dedup.unit_rows(off)
    centres = embedding_dedup.fit_cells(base, 300)

    def found(probe):
        cells = [embedding_dedup.cells_of(x, centres, 0.9, probe) for x in (base, near)]
        return [bool(a[0] in b or b[0] in a) for a, b in zip(*cells)]

    assert all(found(embedding_dedup.PROBE)) and not all(found(3.5))


@pytest.mark.parametrize("kind", ["isotropic", "rank 2", "rank 8", "power law"])
def test_recall_of_cells(kind, monkeypatch):
    """All pairs of brute force meet in a cell, in many tiles."""
    monkeypatch.setattr(embedding_dedup, "TILE", 10_000)
    r = np.random.default_rng(14)
    if kind.startswith("rank"):
        x = r.normal(size=(5000, int(kind[5:]))) @ r.normal(size=(int(kind[5:]), 64))
    else:
        x = r.normal(size=(5000, 64)) / (np.arange(1, 65) if kind == "power law" else 1)
        x[2500:] = x[:2500] + r.normal(size=(2500, 64)) * np.abs(x[:2500]).mean(axis=0) * 0.35
    x = embedding_dedup.unit_rows(x)
    cells = embedding_dedup.cells_of(x, embedding_dedup.fit_cells(x[:2000], 40), 0.9, embedding_dedup.PROBE)
    inside = np.zeros((len(x), 40), bool)
    for i, c in enumerate(cells):
        inside[i, c] = True
    home = np.array([c[0] for c in cells])
    link = np.triu(x @ x.T >= 0.9, 1)
    i, j = np.nonzero(link)
    assert len(i) > 100 and (inside[i, home[j]] | inside[j, home[i]]).all()


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    r = np.random.default_rng(6)
    x = r.normal(size=16) + r.normal(size=(260, 16)) * 0.35
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [r.n_links for r in embedding_dedup.dedup_embeddings(df).orderBy("vec_id").collect()] == n.tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_not_copied_between_cells(spark, tmp_path, monkeypatch, kind):
    """Isotropic vectors, which may link into nearly every cell: all links, and no written table that grows with the cells."""
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 20)
    monkeypatch.setattr(embedding_dedup.Scratch, "drop", lambda *_: None)
    monkeypatch.setattr("platter.llm._common.shared_dir", lambda _: f"file://{tmp_path}")
    for name, value in (("HOLD", 64 * 300), ("WORK", 64 * 300_000), ("BLOCK", 15)):
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 64))
    x[2000:2900] = x[:900] + r.normal(size=(900, 64)) * r.uniform(0.3, 0.6, 900)[:, None]
    x[2900:] = x[0] + r.normal(size=(100, 64)) * 0.2  # a cell of many blocks
    x = x.astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    out = {r.vec_id: r for r in embedding_dedup.dedup_embeddings(df).collect()}
    unit = embedding_dedup.unit_rows(x)
    link = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    while (new := np.where(link, label[None, :], len(x)).min(axis=1)).tolist() != label.tolist():
        label = new
    assert link.sum() > 5000 and [out[i].n_links for i in range(len(x))] == (link.sum(axis=1) - 1).tolist()
    assert [out[i].component_id for i in range(len(x))] == label.tolist()
    tables = {p.parent: 0 for p in tmp_path.rglob("*.parquet")}
    for p in tmp_path.rglob("*.parquet"):
        tables[p.parent] += pq.read_metadata(p).num_rows
    assert tables and max(tables.values()) <= 2 * len(x)


@pytest.mark.parametrize("kind", ["isotropic", "power law", "narrow"])
def test_leading_directions_bound_every_cosine(kind):
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 64)) / (np.arange(1, 65) if kind == "power law" else 1)
    x[1000:] = x[:1000] + r.normal(size=(1000, 64)) * np.abs(x[:1000]).mean(axis=0) * 0.3
    x = embedding_dedup.unit_rows(x + 10 * (kind == "narrow"))
    basis = embedding_dedup.leading_directions(x, 0.9)
    part = embedding_dedup.with_rest(x, basis)
    assert part.shape[1] < 64 and (part @ part.T >= x @ x.T - 1e-12).all()
    single, leading = x.astype(np.float32), part.astype(np.float32)
    cut = (slice(0, 1000), slice(1000, 2000))
    blocks = [embedding_dedup.Block(0, np.arange(2000)[i], np.ones(1000, int), x[i], single[i], leading[i]) for i in cut]
    link = (x @ x.T >= 0.9) & ~np.eye(2000, dtype=bool)
    total = np.zeros(2000, int)
    for a, b in ((0, 0), (0, 1), (1, 1)):
        ids, _, weight = embedding_dedup.compare_blocks(blocks[a], blocks[b], 0.9)
        total[ids] += weight
    assert total.tolist() == link.sum(axis=1).tolist() and total.any()


def test_every_two_blocks_meet_once(monkeypatch):
    r = np.random.default_rng(3)
    for hold, parts in ((1, 1), (900, 7), (10**9, 40)):
        monkeypatch.setattr(embedding_dedup, "HOLD", hold)
        blocks = sorted([(-9, 5, 8), (-9, 5, 8), (-3, 1, 2), *((int(c), int(n), 16) for c, n in r.integers(1, 30, (40, 2)))])
        tasks = embedding_dedup.plan_tasks(blocks, parts)
        met = [(a, b) for a0, a1, b0, b1 in tasks for b in range(b0, b1) for a in range(a0, min(a1, b + 1))]
        one = lambda c: c if c < 0 else 0
        assert sorted(met) == [(a, b) for a in range(43) for b in range(a, 43) if one(blocks[a][0]) == one(blocks[b][0])]
        assert len(tasks) >= parts // 2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(190)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 3), (3, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 4)], "u long, v long")
    got = {r.node: r.component for r in components.components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(df.where("false"), Scratch(spark, "t")).count() == 0


# -- 5


def brute_near(rows, percent=85):
    up = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = [i for i, _ in rows]
    usable = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    links = [(a, b) for a in usable for b in usable if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return sets, label


def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, label = brute_near(rows)
    expected = sorted(((i, len(s), c, c is None or i == c) for (i, _), s, c in zip(rows, sets, label)), key=repr)
    assert table(minhash_dedup.near_duplicates(df)) == expected


def test_minhash(spark, docs, empty):
    check_near(spark, [*DOCS, DOCS[0], DOCS[30]])
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.drop_near_duplicates(docs)
    _, label = brute_near(DOCS)
    assert kept.columns == docs.columns
    assert table(kept.select("doc_id")) == sorted(((i,) for (i, _), c in zip(DOCS, label) if c is None or i == c), key=repr)


def test_minhash_chains_and_large_buckets(spark, monkeypatch):
    """A ring of small edits, where ends don't link, and variants of one text that link through others."""
    monkeypatch.setattr(minhash_dedup, "LARGE", 6)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "STAR", 5)
    text, rows = prose(120, 77), []
    for i in range(30):
        text = variant(text, 1, i)
        rows.append((i * 3 % 31, text))
    core = prose(150, 78)
    rows += [(100 + i, variant(core, 3 + i % 4, 500 + i)) for i in range(60)]
    check_near(spark, rows)


def test_minhash_hot_bucket(spark, monkeypatch):
    """Texts of one template at similarity 0.7, which share buckets, with links between some."""
    monkeypatch.setattr(minhash_dedup, "HOT", 64)
    template = prose(400, 90).split()
    rows = []
    for i in range(300):
        words = list(template)
        words[150:220] = prose(70, 10_000 + i).split()
        rows.append((i, " ".join(words)))
    for i in range(0, 60, 7):
        rows.append((1000 + i, variant(rows[i][1], 3, i)))
    check_near(spark, rows)


def test_minhash_rarest_shingles_find_every_link():
    r = np.random.default_rng(20)
    for percent in (80, 85, 100):
        for _ in range(200):
            n = int(r.integers(1, 60))
            a = np.unique(r.integers(0, 1 << 20, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) < 0.93], r.integers(0, 1 << 20, int(r.integers(0, 5)), dtype=np.uint64)]))
            if len(b) and minhash_dedup.similar_sets(a, b, percent):
                heads = [set(sorted(x.tolist(), key=lambda v: v * 2_654_435_761 % (1 << 20))[: len(x) + (-len(x) * percent) // 100 + 1]) for x in (a, b)]
                assert heads[0] & heads[1]


# -- 6 and 8


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    packed = packing.pack_documents(docs, path, with_ids=True)
    rows = packed.collect()
    want = Counter()
    for i, t in DOCS:
        ids, start = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for p, n in enumerate(packing.piece_lengths(len(ids), 2048)):
            want[i, p, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert len(whole) <= math.ceil(sum(r.length for r in rows) / 2048) + 2 and sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(empty, path).count() == 0


def test_special_token_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for t in ("a <|endoftext|> b", "<|endoftext|>", " \n x  y\u00a0z 12'll"):
        ids = Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
        assert packing._tokenizer(path).encode(t) == np.array(ids, "<u4").tobytes()
    assert packing._tokenizer(path).ranked is not None
    assert packing._tokenizer(public_tokenizers.path("word_bpe_49k.json")).ranked is None


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_vector_best_fit(by):
    r = np.random.default_rng(3)
    d = np.stack([r.integers(1, 60, 400), np.ones(400, int), r.integers(1, 30, 400)], axis=1)
    d = d[np.argsort(-d[:, 0])]
    capacities = np.array([100, 6, 70])
    bins, places = packing.best_fit(d, capacities, np.array([1.0, 0.3, 0.5]), by)
    for b in set(bins.tolist()):
        mine = d[bins == b]
        assert (mine.sum(axis=0) <= capacities).all()
        assert places[bins == b].tolist() == np.concatenate([[0], np.cumsum(mine[:-1, 0])]).tolist()
    assert len(set(bins.tolist())) <= 1.4 * max(-(-d.sum(axis=0) // capacities))
    with pytest.raises(ValueError):
        packing.best_fit(d, capacities, np.ones(3), "size")


def test_byte_bpe(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    r = random.Random(9)
    letters = "abcdeéßüñ \n\t  0123.,!?'日本🙂\u00a0ªᵃ"
    for n in range(3000):
        t = "".join(r.choice(letters) for _ in range(n % 40))
        assert mine.encode(t) == enc.encode_ordinary(t)
    tokens = list(ranks)
    for _ in range(2000):
        piece = r.choice(tokens) + r.choice(tokens) + r.choice(tokens)
        assert mine.encode_piece(piece) == enc._core_bpe.encode_single_piece(piece)
    out = {x.doc_id: x for x in byte_bpe.round_trip_digest(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in DOCS:
        ids = enc.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip_digest(empty, path, public_tokenizers.PATTERN).count() == 0
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in coded.collect())


def test_unreachable_tokens_stand_for_whole_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"bc": 258}
    e = byte_bpe.BytePairEncoder(ranks, r"\S+|\s+")
    assert e.encode("abcd") == [257] and e.encode("abcdx") == [256, 99, 100, 120] and e.encode("xbc") == [120, 258]


# -- 7


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return sorted(con.sql(sql).fetchall(), key=repr)


def test_lines(docs, empty):
    known = docs.where("doc_id is not null")
    digest = line_dedup.line_dedup_digest(known)
    assert table(digest) == oracle(queries.ORACLE["op7_line_dedup"], documents=known.select("doc_id", "text"))
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[13].text == "x" and kept[13].n_chars == 1 and kept[15].text == "" and kept[17].text == SHARED and kept[5].text is None
    assert line_dedup.dedup_lines(docs).columns == docs.columns and len(kept) == len(DOCS)
    assert line_dedup.line_dedup_digest(empty).count() == 0
    again = known.unionByName(known.where("doc_id = 13"))
    assert line_dedup.line_dedup_digest(again).count() == len(DOCS)


def test_perfect_hash(spark, monkeypatch):
    r = np.random.default_rng(8)
    h1, h2 = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    index = line_dedup.LineIndex.load(line_dedup.LineIndex.build(h1, h2, np.arange(5000) + 5, np.arange(5000)).dump())
    slots = index.slots(h1, h2)
    assert sorted(slots.tolist()) == list(range(5000)) and (index.arrays["last"][slots] == np.arange(5000)).all()
    assert (index.slots(h1, h2 + np.uint64(1)) == -1).all() and (index.slots(h2, h1) == -1).all()
    none = line_dedup.LineIndex.build(h1[:0], h2[:0], h1[:0].astype(int), h1[:0].astype(int))
    assert (none.slots(h1, h2) == -1).all()
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    lines = [f"{i} " + "shared line of more than forty characters" for i in range(40)]
    df = spark.createDataFrame([(d, "\n".join([*lines, f"own {d}"])) for d in range(6)], "doc_id long, text string")
    assert table(line_dedup.line_dedup_digest(df)) == oracle(queries.ORACLE["op7_line_dedup"], documents=df)


def test_lines_of_a_large_index(spark, docs, empty, monkeypatch):
    """An index beyond the cache: lines go to the shards, each of which a task loads once."""
    narrow = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for share in (1, 1000):  # without hot keys and with all keys hot
        monkeypatch.setattr(line_dedup, "CACHE_BYTES", 0)
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        lines = [f"{i} " + "shared line of more than forty characters" for i in range(40)]
        rows = [(d, "\n".join([*lines[: 40 - d], lines[0], f"own {d}"])) for d in range(9)] + [(3, lines[1]), (3, lines[1]), (7, None), (8, "")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup_digest(df).collect())
        monkeypatch.undo()
        assert got == Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup_digest(df).collect())
        monkeypatch.setattr(line_dedup, "CACHE_BYTES", 0)
        known = docs.where("doc_id is not null")
        assert table(line_dedup.line_dedup_digest(known)) == oracle(queries.ORACLE["op7_line_dedup"], documents=known.select("doc_id", "text"))
        wide = line_dedup.dedup_lines(docs)
        assert wide.columns == docs.columns and {r.doc_id: r for r in wide.collect()} == narrow
        assert line_dedup.line_dedup_digest(empty).count() == 0
        monkeypatch.undo()


def test_shards_are_loaded_once(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    r = np.random.default_rng(18)
    h1, h2 = (r.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    of = line_dedup._shard_of(h1, 40)
    for shard in range(40):
        own = of == shard
        index = line_dedup.LineIndex.build(h1[own], h2[own], np.full(own.sum(), 5), np.full(own.sum(), 7))
        for _ in range(2):  # a second attempt at the task
            line_dedup._write(line_dedup._shard_name(str(tmp_path), shard), index)
    loads, load = [], line_dedup._load
    monkeypatch.setattr(line_dedup, "_load", lambda folder, shard: loads.append(shard) or load(folder, shard))
    order = np.argsort(of, kind="stable")
    half = np.arange(4000) % 2
    whole = pa.record_batch({"shard": of[order], "h1": h1[order].view(np.int64), "h2": h2[order].view(np.int64),
                             "k": np.where(half, 7, 8)[order], "text_hash": order, "places": pa.array([[0]] * 4000, pa.list_(pa.int32()))})
    out = list(line_dedup.probe_sorted(iter([whole.slice(i, 300) for i in range(0, 4000, 300)]), str(tmp_path)))
    assert sorted(x for b in out for x in b.column("text_hash").to_pylist()) == [i for i in range(4000) if i % 2 == 0]
    assert loads == list(range(40))


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from platter.llm import _common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        _common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


# -- 9


def page(i, url, canonical=None, refresh=None):
    link = f'<LINK href="{canonical}" rel=canonical>' if canonical else ""
    meta = f"<meta http-equiv=Refresh content='0; URL={refresh}'>" if refresh else ""
    return i, url, f"<html><head>{link}{meta}</head></html>"


PAGES = [
    page(1, "https://a.example.com/en/1"), page(2, "https://a.example.com/en/7x"), page(3, "http://EXAMPLE.net/de/1"), page(4, "http://b.example.net/de/8"),
    page(5, "https://alias.invalid/x", "https://a.example.com/en/1"), page(6, "https://second.invalid/", None, "/moved"), page(7, "https://second.invalid/moved", "//alias.invalid/x#frag"),
    page(8, "https://c.example.com/en/7", "https://a.example.com/en/1"), page(9, "https://free.invalid/", "https://other.invalid/"), (10, None, None), (11, "no scheme", ""),
    page(12, "x://host?q"), page(13, "x://com/en/"), page(14, "x://notcom/en/"), page(15, "https://o.org/es/?x=1#f"), page(5, "https://alias.invalid/x"),
]


def link(i, url, *tags):
    return i, url, "<html><head>" + "\n".join(tags) + "</head></html>"


LINKED = [  # (page, verdict)
    (link(20, "https://off.invalid/1", '<link rel="canonical" href="https://x.example.com/en/1">'), "block"),  # a target without a page
    (link(21, "https://off.invalid/2", '<link rel="canonical" href="https://x.example.com/en/7">'), "allow"),
    (link(22, "https://case.invalid/", '<LINK REL="nofollow cAnonical" HREF = "https://o.org/es/">'), "block"),
    (link(23, "https://amp.invalid/a", '<link rel=canonical href="/b?x=1&amp;y=2">'), "block"),
    (link(24, "https://amp.invalid/b?x=1&y=2", "<meta http-equiv='ReFresh' content='5; url=https://o.org/es/q'>"), "block"),
    (link(25, "https://many.invalid/", '<link rel=canonical href="/one">', '<link rel="canonical" href="//o.org/es/">'), "block"),
    (link(26, "https://many.invalid/2", '<meta http-equiv=refresh content="0;url=/3">', "<meta http-equiv=refresh content=\"0; URL='https://o.org/es/'\">"), "block"),
    (link(27, "https://many.invalid/3"), "block"),
    (link(28, "https://dots.invalid/a/b/c", '<link rel=canonical href="../../d/./e">'), "block"),
    (link(29, "https://dots.invalid/d/e", '<link rel=canonical href="https://n.org/x/../es/z">'), "block"),
    (link(30, "https://dots.invalid/q", '<link rel=canonical href="?z=1">'), "block"),
    (link(31, "https://dots.invalid/q?z=1", '<link rel=canonical href="/d/e">'), "block"),
    (link(32, "https://mail.invalid/", '<link rel=canonical href="mailto:a@o.org/es/">', '<link rel=canonical href="#x">', "<link rel=canonical>"), "allow"),
    (link(33, "https://not.invalid/", '<link rel="alternate" href="https://o.org/es/">', '<link data-rel="canonical" href="https://o.org/es/">'), "allow"),
    (link(34, "https://go.invalid/?u=https://o.org/es/", '<link rel=canonical href="/?u=https://o.org/es/">'), "allow"),
    (link(35, "https://w.example.com/en/7", '<link rel="canonical" href="https://o.org/es/">'), "allow"),  # explicit
    (link(36, "https://chain.invalid/0", '<link rel="canonical" href="https://chain.invalid/1">'), "block"),
    *((link(37 + i, f"https://chain.invalid/{i + 1}", f'<link rel="canonical" href="https://chain.invalid/{i + 2}">'), "block") for i in range(12)),
    (link(60, "https://chain.invalid/13#f", '<link rel="canonical" href="http://com/en/">'), "block"),
    (link(61, "https://enc.invalid/", '<link rel="canonical" href="https&#58;&#x2F;&#47;o.org&#x2f;es&#47;">'), "block"),
]


def test_urls(spark):
    pages = [*PAGES, *(p for p, _ in LINKED)]
    df = spark.createDataFrame([(*p, "clash", i) for i, p in enumerate(pages)], "page_id long, url string, html string, host string, id long")
    out = url_filter.judge_urls(df)
    by = {r.page_id: r for r in out.collect()}
    verdicts = {i: by[i].verdict for i in by}
    expected = {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "block", 14: "allow", 15: "block"}
    assert verdicts == expected | {p[0]: v for p, v in LINKED}
    assert (by[3].host, by[12].host, by[12].path, by[10].host, by[2].rule) == ("example.net", "host", "", "", "example.com/en/7")
    assert table(out.drop("alias_component")) == oracle(queries.ORACLE["op9_url_equivalence"], pages=df)
    assert url_filter.judge_urls(df.where("false")).count() == 0
    no_edges = df.where("page_id in (1, 4, 10, 11)")
    assert [r.verdict for r in url_filter.judge_urls(no_edges).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_urls_of_long_pages(spark):
    html = "<link " * 200_000 + "<meta http-equiv=refresh content='" + "u" * 500_000 + "<link rel='canonical' href='https://o.org/es/'>"
    df = spark.createDataFrame([(1, "https://a.invalid/" + "x/" * 50_000, html), (2, "https://b.invalid/" + "../" * 2000, html)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filter.judge_urls(df).collect()] == ["block", "block"]


# -- 10

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m.group())]


@pytest.mark.parametrize("text", [
    "IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "iban: ES91 2100 0418 4502 0005 1332 EUR 100", "account AT61 1904 3002 3457 3201 BIC",
    "pay to ES9121000418450200051332 today", "AT61 1904 3002 3457 3201", "(NO93 8601 1117 947) BIC", "no cue: GB82 WEST 1234 5698 7654 32.",
])
def test_ibans_of_their_countrys_length(text):
    iban = re.search(r"(ES|AT|NO|GB)[0-9]{2}[A-Z0-9 ]*?(1332|3201|947|32(?=\.))", text)
    assert pii.find(text)[1]["account"] == [iban.span()]
    assert pii.redact(text, pii.find(text)[1]) == text.replace(iban.group(), "<ACCOUNT>")


def test_not_ibans():
    for text in ("ES92 2100 0418 4502 0005 1332", "XES9121000418450200051332", "ES9121000418450200051332X", "ES91 2100 0418 4502 0005"):
        assert pii.find(text)[1]["account"] == []


def test_pii_base():
    r = random.Random(13)
    parts = ["a@b.co", "@", ".", "a.b", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "9", " ", "x@y", "@@", "é", "٣", "-"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        got = [(k, a, b) for k, v in pii.find(t)[0].items() for a, b in v]
        assert got == brute_pii(t), t


@pytest.mark.parametrize("text,found", [
    ("write to bob (at) site (dot) org", [("email", "bob (at) site (dot) org")]), ("password=36fdea71d793cf922e in", [("secret", "36fdea71d793cf922e")]),
    ('token = "24be64439e3e49cf46b2d7c9"', [("secret", "24be64439e3e49cf46b2d7c9")]), ("the token is here and = x", []), ("see https://x.org/a?b=c.", []),
    ("ftp://me:pw@host/x", [("url", "ftp://me:pw@host/x")]), ("https://x.org/?email=a", [("url", "https://x.org/?email=a")]),
    ("IBAN: GB82 WEST 1234 5698 7654 32", [("account", "GB82 WEST 1234 5698 7654 32")]), ("IBAN: GB83 WEST 1234 5698 7654 32", []),
    ("account no. 12345678", [("account", "12345678")]), ("passwords were changed (at) noon", []), ("", []),
])
def test_pii_added(text, found):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, v in every.items() for a, b in v if (a, b) not in base.get(k, ())] == found


def test_pii_table(docs, empty):
    out = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert out[18].n_email == 1 and out[18].spans == "email:5:26" and out[5].spans == "" and len(out) == len(DOCS)
    assert out[18].base_sha256 == hashlib.sha256(b"email:5:26").hexdigest()
    clean = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert clean[18].text == "mail <EMAIL> now" and clean[18].n_chars == 16 and clean[5].text is None and clean[1].text == BASE
    assert pii.redact_pii(docs).columns == docs.columns and pii.find_pii(empty).count() == 0


def test_added_columns_clash(docs):
    assert fingerprint.fingerprint(docs.withColumn("fingerprint", F.lit(1))).count() == len(DOCS)


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from platter.llm import _common

    scratch = Scratch(spark, "t")
    assert scratch.table(spark.range(3), "three").count() == 3
    at = Path(scratch.path("three").removeprefix("file:"))
    assert at.exists()
    mine, _common.Scratch.roots[:] = [scratch.root], [scratch.root]
    _common.clear_scratch(spark)
    assert not at.exists() and mine and not _common.Scratch.roots
