"""Very long and hostile texts: right results, in time that grows with the length."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest

from platter.llm import byte_bpe, fingerprint, html_text, minhash_dedup, packing, pii, toxicity


def grows_linearly(run, make, size):
    """Twice the text takes about twice the time; the slack is for a busy machine."""
    run(make(1000))
    taken = []
    for n in (size, 2 * size):
        text = make(n)
        began = time.process_time()
        run(text)
        taken.append(time.process_time() - began)
    assert taken[1] < 3.2 * taken[0] + 0.5, taken


def unit(text):
    return lambda n: text * (n // len(text))


def letters(alphabet):
    return lambda n: "".join(random.Random(n).choices(alphabet, k=n))


CJK = "".join(chr(0x4E00 + i) for i in range(3000))


@pytest.mark.parametrize("make", [
    unit(" "), unit("\n"), unit("1"), unit("http://"), unit("日本語"), unit("a"), unit(" \n"),
], ids=["spaces", "newlines", "digits", "schemes", "cjk", "one letter", "mixed space"])
def test_packing_ids(make):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in (make(300_000), "x" + make(1_000_000) + " y"):
        ids = packing._tokenizer(path).encode(text)
        assert ids == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_a_million_spaces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 2_000_000 + "x")], "doc_id long, text string")
    rows = packing.pack_documents(docs, path).collect()
    assert {r.doc_id for r in rows} == {1, 2} and max(r.length for r in rows) == 2048


def test_capacities_bind():
    """Tiny pieces meet the document capacity, beside a nearly whole one the attention capacity."""
    cost = packing.TILE
    capacities = np.array([2048, packing.DOCUMENTS, 2048 * 2048 + 2 * cost])
    for lengths, bins in (([2] * 1000, -(-1000 // packing.DOCUMENTS)), ([1985, *[1] * 63], 1), ([1984, *[1] * 64], 2)):
        d = np.array([(n, 1, n * n + cost) for n in lengths])
        found, _ = packing.best_fit(d, capacities, np.array(packing.WEIGHTS))
        assert len(set(found.tolist())) == bins
        for b in set(found.tolist()):
            assert (d[found == b].sum(axis=0) <= capacities).all()


@pytest.mark.parametrize("make", [letters(CJK), letters("abcdefghijklmnopqrstuvwxyz"), unit(" "), letters(" \n\t"), letters("0123456789")],
                         ids=["cjk", "letters", "spaces", "mixed space", "digits"])
def test_byte_bpe(make):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    mine = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    text = make(60_000)
    assert mine.encode(text) == enc.encode_ordinary(text)
    grows_linearly(mine.encode, make, 100_000)


def test_memos_hold_short_words_only():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces, words = byte_bpe._memos(path, public_tokenizers.PATTERN)
    long = "q" * 5000
    assert words[long][2] == len(byte_bpe.encoder(path, public_tokenizers.PATTERN).encode(long))
    assert max(map(len, words), default=0) <= byte_bpe.MEMO_CHARS and max(map(len, pieces), default=0) <= byte_bpe.MEMO_CHARS
    minhash_dedup.shingles(long + " a b c d e")
    assert max(map(len, minhash_dedup._words)) <= minhash_dedup.CACHED_BYTES


@pytest.mark.parametrize("text", [
    "1", "1.", "1.1.1.", "http://", "mailto:a@", "@", "a@", "+1", "+1 (", " ", "token=", "IBAN GB82", "a(at)b(dot)c ", "http://a?email=b ",
    "https://u:p@h/?user=", "account ", "é",
])
def test_pii(text):
    grows_linearly(pii.find, unit(text), 150_000)


def test_pii_of_digit_runs():
    text = "1" * 1_000_000 + ".2.3.4 " + "5" * 1_000_000 + " 1.2.3.4.5.6.7.8.9"
    ips = [m.span() for m in re.finditer(r"1\.2\.3\.4|5\.6\.7\.8", text) if m.start() > 1_000_100]
    assert pii.find(text)[0]["ip"] == ips


@pytest.mark.parametrize("make", [
    unit("<div>"), unit("<ul><li>"), unit("<blockquote>x"), lambda n: "<b>" * (n // 6) + "</i>" * (n // 8), lambda n: "<i><table><td>" + "<b>" * (n // 6) + "</i>" * (n // 8),
    unit("<table><tr><td>x<td>"), lambda n: "<table><tr>" + "<a>" * (n // 4) + "<td>x", unit('<p title="a>'), unit("<p title='a>\""), unit("<"), unit("<p "),
    lambda n: "<style>" + "".join(f".c{i}{{display:none}}" for i in range(n // 40)) + "</style>" + "<p class=z>x" * (n // 24), lambda n: "<style>" + "/*" * (n // 2),
    lambda n: "<style>" + '\\"' * (n // 2), unit("<script></script "), lambda n: "<table><tr><td>" + "x" * (n // 2) + "<tr><td>a<td>b" * (n // 28), unit("<p>"), unit("&#"),
])
def test_html(make):
    grows_linearly(html_text.to_text, make, 100_000)


def test_html_hidden_below_any_depth():
    for tag in ("div", "b", "ul><li", "blockquote", "table><tr><td"):
        for depth in (250, 20_000):
            text = html_text.to_text(f"<{tag}>" * depth + "seen<p style='display:none'>SECRET <b>SECRET</b></p> too")
            assert "SECRET" not in text and "seen" in text and "too" in text


def test_html_open_quotes_and_forms():
    for source, text in (
        ('<p title="a>hello</p><p class="b">x</p>', "x"), ('<p title="a>hello</p>', "hello"), ("<p title=it's>a</p>b'c", "a b'c"), ("a<3 </3> b", "a<3 b"),
        ("<textarea>a\n&lt;b&gt; <b>c</textarea>", "a <b> <b>c"), ("<select><option>a<option selected>b<option>c</select>", "b"), ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><optgroup><option>a<option hidden>x<option>b</select>", "a b"), ("<input type=submit value=Go><input value=x><button>B</button>", "GoB"), ("&#" + "9" * 6000 + ";x", "�x"),
    ):
        assert html_text.to_text(source).split() == text.split()


def build_page(r, depth, words, hidden):
    """A random page and, in `words`, what is visible in it, in order."""
    parts = []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["text", "text", "div", "p", "b", "ul", "ol", "table", "quote", "hide", "class", "pre", "dl", "comment"]) if depth else "text"

        def inner(tag, attrs="", hide=hidden):
            return f"<{tag}{attrs}>{build_page(r, depth - 1, words, hide)}</{tag}>"

        if kind == "text":
            own = [f"w{r.randrange(10**9)}" for _ in range(r.randint(1, 5))]
            words += [] if hidden else own
            parts.append(" " + " ".join(own) + " ")
        elif kind in ("ul", "ol"):
            parts.append(f"<{kind}>" + "".join(inner("li") for _ in range(r.randint(1, 3))) + f"</{kind}>")
        elif kind == "table":
            rows = ("<tr>" + "".join(inner("td") for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(r.randint(1, 3)))
            parts.append("<table>" + "".join(rows) + "</table>")
        elif kind == "hide":
            parts.append(inner(r.choice(["div", "span"]), r.choice([" hidden", " style='color:red; display: none'"]), True))
        elif kind == "class":
            parts.append(inner("div", r.choice([" class='x gone'", " id=lost"]), True))
        elif kind == "comment":
            parts.append("<!-- no --><script>var no = '<p>no</p>'</script>")
        elif kind == "dl":
            parts.append(f"<dl>{inner('dd')}</dl>")
        elif kind == "p":  # a block inside would end it, and what hides in it
            parts.append(f"<p>{build_page(r, 0, words, hidden)}</p>")
        else:
            parts.append(inner({"quote": "blockquote"}.get(kind, kind)))
    return "".join(parts)


def test_html_shows_all_that_is_visible():
    """Against the generator's own account of what is visible; cells with several lines stand side by side, so order is within them."""
    r = random.Random(30)
    for n in range(400):
        words: list[str] = []
        body = build_page(r, r.randint(1, 5), words, False)
        found = re.findall(r"w\d+", html_text.to_text(f"<style>.gone, #lost{{display:none}}</style>{body}"))
        assert sorted(found) == sorted(words)
        if "<table" not in body:
            assert found == words


def test_other_operators():
    for text in ("x" * 1_000_000, "a b " * 250_000, " " * 1_000_000, "é" * 500_000):
        assert fingerprint.signatures([text]).shape == (1, fingerprint.SAMPLES)
        assert len(minhash_dedup.shingles(text)) <= 4
    model = toxicity.ToxicityModel({"bad": 2.0}, -1.0, 1.0, 1.0, (-3.0, 1.0, 1.0))
    grows_linearly(model.probability, unit("bad word "), 400_000)
    assert model.probability("x" * 1_000_000)[0] < 0.3 and not any(len(w) > toxicity.TOKEN_CHARS for w in model._memo)
