"""String kernels: the kernel by brute force, held-out accuracy, and which rows are learned from."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import language

SF = "/root/testdata/sf0.001"


def grams(text, symbols):
    s = [int(symbols[ord(c)]) for c in text]
    out = set()
    for n in range(1, 4):
        for i in range(len(s) - n + 1):
            code = 0
            for x in s[i : i + n]:
                code = code * 128 + x
            out.add(code)
    return out - {0}


def test_presence_and_kernel():
    symbols, flags = language.symbol_table(), np.zeros(language.CODES, bool)
    texts = ["Das ist gut.", "this is good", "", "123 !", "ééé Ünï", "a" * 10_000 + " the end"]
    for t in texts:
        codes, letters = language.marked(t, symbols, flags)
        assert set(codes.tolist()) == grams(t, symbols)
        assert letters == any(c.isalpha() for c in t) and not flags.any()
    sets = [grams(t, symbols) for t in texts[:2]]
    p = language.LanguageParams(landmarks=1, ridge=1e-9)
    model = language.fit([np.array(sorted(s), np.int32) for s in sets], ["de", "en"], p, symbols)
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    rows = np.zeros((2, len(model.vocabulary)), np.float32)
    for i, s in enumerate(sets):
        rows[i] = np.isin(model.vocabulary, sorted(s))
    np.testing.assert_allclose(rows @ model.presence / np.sqrt([[len(s)] for s in sets]), want, atol=1e-5)
    np.testing.assert_allclose(model.scores(texts[:2])[0], np.eye(2), atol=1e-3)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = []
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        if g["held_out"] and r["lang"] is not None and len(r["text"] or "") > 100:
            right.append(g["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.95


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0][:20]
    docs = [(i, "hello there good friend", "xx") for i in ids] + [(i, "guten tag mein freund", "de") for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    got = language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"de"}


def test_odd_rows(spark, odd_docs, no_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert language.identify(no_docs).collect() == []
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    kept = language.with_known_language(odd_docs)
    assert kept.columns == odd_docs.columns and not {3, 4, 5} & {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_without_labels(spark):
    """If nothing can be learned, texts with a letter stay."""
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language.with_known_language(docs).collect()] == [1]
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}


def test_many_labels_are_all_learned():
    """Bounds on documents and landmarks leave one of each label at least."""
    symbols = language.symbol_table()
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(300)]
    codes = [language.marked(f"{w} {w}{w}", symbols)[0] for w in words]
    model = language.fit(codes, words, language.LanguageParams(all_landmarks=100), symbols)
    assert len(model.languages) == 300
    scores, _ = model.scores([f"{w} {w}" for w in words[:50]])
    assert [model.languages[k] for k in scores.argmax(1)] == words[:50]
