"""The n-gram Jaccard join against all pairs by brute force."""

import itertools
import random
import re

import pytest

from trackweave.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    """Chains of near copies at all similarities, copies, shared passages, and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = r.choices(vocabulary, k=40)
    texts = []
    for _ in range(12):
        words = r.choices(vocabulary, k=r.choice((3, 10, 40, 150)))
        if r.random() < 0.5:
            words = passage + words
        for _ in range(r.choice((1, 2, 8))):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(r.choice((0, 1, 1, 3))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    texts += ["", None, " \t", "a", "A", "a b", "B a", "a b c", "A B\x0bC"]
    r.shuffle(texts)
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(0, 3, 90), (1, 5, 80), (2, 3, 60), (3, 1, 80)])
def test_components(spark, seed, n, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.near_duplicates(df, jaccard.JaccardParams(n=n, percent=percent)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, n, percent)


def test_few_rounds_give_the_same(spark):
    """Without comparisons with centres, all links come from the pairs, and the result is the same."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (jaccard.JaccardParams(3, 80, star_rounds=0), jaccard.JaccardParams(3, 80, star_rounds=1, table_bits=10, longest=1)):
        assert sorted(tuple(r) for r in jaccard.near_duplicates(df, p).collect()) == brute(rows, 3, 80)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.near_duplicates(odd_docs).collect())
    assert len(got) == odd_docs.count()
    at = {i: c for i, _, c in got if i}
    assert (at[1], at[2], at[3], at[4], at[5], at[6], at[7], at[8], at[9], at[10]) == (1, 1, 3, 4, 5, 6, 6, 8, 8, 10)
    assert jaccard.near_duplicates(no_docs).collect() == []
    kept = jaccard.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 10, 11]


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (50, 100)], "x long, y long")
    got = {r["node"]: r["component"] for r in jaccard.components(links).distinct().collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 100: 50, 101: 50}
