"""The pipeline's stages, each on what the one before kept."""

from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute
from trackweave.llm import mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "mixing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = before, docs
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = at["language"]
    lost = {r["doc_id"]: r["text"] or "" for r in before.collect() if r["doc_id"] not in set(ids(after))}
    assert len(lost) < 0.2 * before.count() and set(lost) == set(ids(before)) - set(ids(after))
    before, after = at["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == [i for i, _, c in brute(rows, 5, 80) if i == c]
    before, after = at["decontamination"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 5]
    left = [" ".join(r["text"].split()) for r in after.collect()]
    assert not any(i in t for i in items for t in left)
    before, after = at["pii"]
    assert ids(before) == ids(after)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    changed = [r for r in after.collect() if r["text"] != texts[r["doc_id"]]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)
    before, after = at["mixing"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, mixing.mix(before, keep=("text", "n_chars")).select(after.columns).collect()))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run_is_the_stages(spark):
    corpus = corpus_pipeline.run(spark, SF)
    assert corpus.columns == ["doc_id", "domain", "lang", "source", "tokens", "copies", "text", "n_chars"]
    rows = corpus.collect()
    assert rows and all(len(r["text"].split()) == r["tokens"] for r in rows)


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            assert name == "mixing" or out.columns == docs.columns
