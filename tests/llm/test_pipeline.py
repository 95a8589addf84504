"""The pipeline against its stages by hand, and the entry without the subpackage."""

import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pagerefine.llm._common import documents
from pagerefine.llm.secrets import scan_secrets
from tests.conftest import DATA, ROOT
from tests.llm.test_operators import brute_groups, brute_hits


def expected(docs, items):
    """The texts that stay before secrets are masked, by comparing all with all."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    groups = brute_groups(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    return {i: t for i, t in kept.items() if not brute_hits(t, items)[-1]}


def test_stages_like_brute_force(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, str(DATA))
    own = [(10**6, "my api_key = 'abcdef123456' and words of its own", "en", "s", 48), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "123 456", None, None, 7)]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema)).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = expected(docs, items)
    after = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, str(DATA)).cache()
        assert after.columns == docs.columns, name
    got = {r.doc_id: r.text for r in after.collect()}
    assert set(got) == set(words)
    spans = {r.doc_id: r.spans for r in scan_secrets(docs).collect()}
    assert all((got[i] != words[i]) == bool(spans[i]) for i in got) and any(spans[i] for i in got)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, after, str(DATA)).collect()}
    assert last == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in got.items()}


def test_run(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = expected(documents(spark, str(DATA)), items)
    secret = {r.doc_id for r in scan_secrets(documents(spark, str(DATA))).collect() if r.spans}
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(left) and len(got) == out.count()
    for i in set(left) - secret:
        ids = library.encode(left[i], add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest()
    assert all(got[i].decoded_sha256 != hashlib.sha256(left[i].encode()).hexdigest() for i in set(left) & secret)


def test_pipeline_without_languages(spark, tmp_path):
    """Where no document has a language nothing is learned, and whatever has a letter stays."""
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12", None, "s", 2), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "pagerefine"):
        (tmp_path / name).symlink_to(Path(ROOT) / name) if name.endswith(".py") else None
    subprocess.run(["cp", "-r", f"{ROOT}/pagerefine", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", f"{tmp_path}/pagerefine/llm"], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((Path(ROOT) / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
