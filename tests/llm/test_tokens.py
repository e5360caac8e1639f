"""Token counts of the compiled machine against the library that owns the model."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from trackweave.llm import queries, tokens

LETTERS = [" ", "  ", "a", "the", "ing", "▁", "é", "é", "\n", "\t", "1", "20", "ß", "日本", "\U0001f600", "</s>", "<unk>", "﻿", "=-", "Z", " "]
ODD = ["", " ", "\n", "▁", "a" * 20_000, " " * 20_001, "ab" * 9_999, "=-" * 7_777, "日本語テキスト" * 900, "x" * 255, "x" * 256, "x" * 257, " x" * 128, "<s>hi</s>", "﻿"]


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda text: len(model.encode(text)) if text else 0


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_counts(library, chunk):
    r = random.Random(chunk)
    texts = [t if chunk > 1 else t[:2000] for t in ODD] + ["".join(r.choice(LETTERS) for _ in range(r.randrange(400))) for _ in range(400)] + [prose(k, 300) for k in range(5)]
    got = tokens.counts(pa.array([*texts, None], pa.large_string()), tokens.TokenParams(chunk=chunk))
    assert got.tolist() == [library(t) for t in texts] + [0]


def test_machine_starts_anew(library):
    """A machine that may keep hardly any transitions gives the same counts."""
    params = tokens.TokenParams(max_transitions=50)
    for k in range(4):
        texts = [prose(10 * k + j, 200) for j in range(3)]
        assert tokens.counts(pa.array(texts, pa.large_string()), params).tolist() == [library(t) for t in texts]
    assert tokens._machine(params).size < 20_000


def test_table_of_transitions():
    machine = tokens._machine(tokens.TokenParams())
    machine.reset()
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 200_000))
    machine._put(keys, np.arange(len(keys), dtype=np.int32), np.zeros(len(keys), np.int32))
    assert (machine.next[machine._find(keys)] == np.arange(len(keys))).all()
    assert (machine._find(keys[:100] + (1 << 41)) == -1).all()
    machine.reset()


def test_frame(spark, odd_docs, no_docs, library):
    rows = tokens.count_tokens(odd_docs).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), library(r["text"]), library(r["text"]) > 4096) for r in odd_docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, tuple(r)[0] or 0, tuple(r)[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert tokens.count_tokens(no_docs).collect() == []
    named = tokens.count_tokens(odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(want)


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_tokens"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (library(d["text"]), len((d["text"] or "").encode()))
