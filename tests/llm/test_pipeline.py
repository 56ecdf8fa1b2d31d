"""The pipeline over a small corpus against its operators' brute-force rules, and all queries' columns."""

import os

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from platter.llm import minhash_dedup, pii, toxicity

from .test_operators import SHARED, brute_near, prose, variant


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(400):
        text = prose(20 + i % 90, i)
        if i % 10 == 0:
            text += " idiot scum moron idiot scum " + prose(5, 9000 + i) + " moron"
        if i % 7 == 0:
            text += f"\n{SHARED}\nmail x{i}@example.org"
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(1000 + i, variant(prose(100, 3), 1, i), "en", "src1", 1) for i in range(12)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id: r.text for r in docs.collect() if model.probability(r.text)[0] < toxicity.THRESHOLD}
    assert not any(i % 10 == 0 for i in want if i < 400) and len(want) >= 370
    holders = [i for i, t in want.items() if t and SHARED in t.split("\n")]
    assert len(holders) >= 5
    want = {i: t if i not in holders or i == max(holders) else "\n".join(x for x in t.split("\n") if x != SHARED) for i, t in want.items()}
    rows = list(want.items())
    _, label = brute_near(rows, corpus_pipeline.NEAR_PERCENT)
    want = {i: t for (i, t), c in zip(rows, label) if i == c}
    want = {i: t if t is None else pii.redact(t, pii.find(t)[1]) for i, t in want.items()}
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    assert {r.doc_id: r.text for r in now.collect()} == want
    assert all("@example" not in (t or "") for t in want.values())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == lengths
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert out.sequence_id.nunique() <= np.ceil(sum(lengths.values()) / 2048) + 1


def test_near_copies_from_80_percent(spark):
    """Pairs of similarity 0.80 to 0.85, one below 0.80, and op5's own threshold."""
    rows, near, far = [], set(), set()
    for k in range(40):
        words = prose(100, 700 + k).split()
        for i, changed in ((0, []), (1, [30, 70] if k % 2 else [20, 50, 80])):
            rows.append((10 * k + i, " ".join("new" if j in changed else w for j, w in enumerate(words)), "en", "s", 1))
        (near if k % 2 else far).add(10 * k + 1)  # 86 of 106 shingles, 81 of 111
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - near
    assert all(r.kept for r in minhash_dedup.near_duplicates(docs).collect())
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(docs, 79)


def test_import_without_llm(tmp_path):
    """The entry module works where the subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/platter", tmp_path / "platter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
