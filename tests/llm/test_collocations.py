"""Collocations against a plain count, the perfect hash, and sums of arrays."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from trackweave.llm import collocations
from trackweave.llm.collocations import PerfectHash, PhraseParams

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, p):
    """The contract over (lang, text), in Python's integers."""
    runs, words = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            found = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(found)
            runs.update((lang, *found[i : i + n]) for n in range(1, p.longest + 1) for i in range(len(found) - n + 1))
    out = []
    frequent = {k: v for k, v in runs.items() if v >= p.least}
    longer = Counter()
    for (lang, *ws), f in frequent.items():
        for n in range(2, len(ws)):
            for i in range(len(ws) - n + 1):
                key = (lang, *ws[i : i + n])
                longer[key] = max(longer[key], f)
    for (lang, *ws), a in frequent.items():
        if len(ws) > 1 and not 100 * longer[lang, *ws] >= p.absorbed * a:
            score, k = min((1000 * a * words[lang] // (runs[lang, *ws[:k]] * runs[lang, *ws[k:]]), k) for k in range(1, len(ws)))
            out.append((lang, -score, -a, " ".join(ws).encode(), runs[lang, *ws[:k]], runs[lang, *ws[k:]], words[lang]))
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= p.top:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return result


def texts(seed, n):
    r = random.Random(seed)
    phrases = ["New York City", "of the", "machine   learning model", "a\ta\ta a", "é É", "x y z w v u"]
    return [(r.choice(["en", "en", "de", None, "und"]), "".join(r.choice([*phrases, prose(r.randrange(9), 6)]) + r.choice([" ", ". ", ", ", "\n", "\x0b", "! ", "\t", "\r\n"]) for _ in range(r.randrange(40)))) for _ in range(n)]


def check(spark, rows, p):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("own") for c in ("phrase", "a", "n", "score", "hi", "shard", "doc_id")})
    got = sorted(map(tuple, collocations.collocations(docs.repartition(3), p).select(COLUMNS).collect()))
    assert got == sorted(plain(rows, p))
    return got


def test_small(spark):
    rows = [*texts(1, 300), (None, None), ("en", ""), ("en", " .\n"), ("fr", "un deux " * 150)]
    assert check(spark, rows, PhraseParams())
    assert check(spark, rows, PhraseParams(least=7, longest=3, absorbed=60, top=5))


def test_shards(spark, monkeypatch):
    """Many shards and blocks, and sums over several levels, change nothing."""
    monkeypatch.setattr(collocations, "FAN", 2)
    assert len(check(spark, texts(2, 200), PhraseParams(least=3, slots=1200))) > 10


def test_long_text_and_products_over_64_bits(spark):
    check(spark, [("en", "one two " * 200_000), ("en", "three four. " * 200)], PhraseParams())
    big = spark.createDataFrame([(10**12, 4 * 10**13, 10**12, 10**12), (3, 10**13, 7, 11)], "a long, n long, l long, r long")
    got = [r[0] for r in big.select(collocations._score(*(F.col(c) for c in "anlr"))).collect()]
    assert got == [1000 * 10**12 * 4 * 10**13 // 10**24, 1000 * 3 * 10**13 // 77]


def test_nothing(spark, odd_docs, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    rows = [(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.collocations(odd_docs).select(COLUMNS).collect())) == sorted(plain(rows, PhraseParams()))


def test_perfect_hash():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 64, 1000, 200_000):
        keys = r.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        perfect = PerfectHash(keys[:, 0], keys[:, 1])
        assert sorted(perfect.find(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
        assert (perfect.find(keys[:, 0], keys[:, 1] + np.uint64(1)) == -1).all()
        assert (perfect.find(r.integers(0, 1 << 63, 500).astype(np.uint64), np.zeros(500, np.uint64)) == -1).all()


def test_large_tables_take_few_passes(spark, monkeypatch):
    """Counters of a byte, of which there are four times as many, change nothing; several shards are counted in one pass over the texts."""
    made, passes, counted = [], [], collocations._counted
    monkeypatch.setattr(collocations, "NARROW", 1)
    monkeypatch.setattr(collocations, "_counted", lambda texts, tasks, held, *rest: passes.append(len(held.value.held)) or counted(texts, tasks, held, *rest))
    monkeypatch.setattr(collocations, "_shards", lambda c, shards=collocations._shards: made.append(c.select("shard").distinct().count()) or shards(c))
    rows = texts(2, 200)
    assert len(check(spark, rows, PhraseParams(least=3, slots=250))) > 10
    assert made[0] > 4 and len(passes) == -(-made[0] // 4) and max(passes) == 4
    check(spark, [("en", "one two " * 1000), *rows], PhraseParams(least=250))


def test_byte_counters():
    counters = np.zeros(8, np.uint8)
    for at in ([1] * 1000, [2] * 60, [2] * 50 + [3], []):
        collocations._add(counters, np.array(at, np.int64), 100)
    assert counters.tolist() == [0, 100, 100, 1, 0, 0, 0, 0]
