"""Leaks against a brute-force search of every item at every place."""

import random
import re

from tests.llm.conftest import prose
from trackweave.llm import decontaminate


def words(text):
    return [w for w in (re.sub(r"[\W_]+", "", x).lower() for x in (text or "").split()) if w]


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = r.randrange(len(ws))
        r.choice((lambda: ws.__setitem__(k, "zzz"), lambda: ws.insert(k, "yyy"), lambda: len(ws) > 1 and ws.pop(k)))()
    return ws


def test_equals_brute_force(spark):
    r = random.Random(5)
    items = [(k, " ".join(f"t{r.randrange(400)}" for _ in range(n))) for k, n in enumerate([5, 6, 8, 12, 20, 30, 45, 60, 90, 24])]
    docs = []
    for k in range(120):
        text = prose(k, r.choice((5, 80, 300))).split()
        if k % 2:
            item = r.choice(items)[1].split()
            at = r.randrange(len(text))
            text[at:at] = edited(r, item, r.randrange(0, max(1, int(len(item) * 0.12)) + 1))
        docs.append((k, " ".join(text).capitalize()))
    got = {(x["doc_id"], x["item_id"]): (x["edits"], x["n_words"]) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for j, item in items:
            w = words(item)
            d = least_edits(w, words(t))
            if d <= len(w) * 20 // 100:
                want[i, j] = d, len(w)
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    assert len(got) >= 0.97 * len(want)
    assert all(p in got for p, (d, _) in want.items() if d == 0)  # exact passages are never missed


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, prose(2, 60)), (2, None), (3, ""), (4, "word"), (None, prose(3, 40)), (1, prose(2, 60))], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"] or 0, x["edits"]) for x in decontaminate.find_leaks(odd_docs, items).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (10, 0, 0), (10, 0, 0)]
    assert decontaminate.find_leaks(no_docs, items).collect() == []
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).collect() == []
    kept = decontaminate.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    assert decontaminate.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_slices_of_the_benchmark_give_the_same(spark):
    items = spark.createDataFrame([(k, prose(1000 + k, 30)) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{prose(k, 20)} {prose(1000 + k, 30)} {prose(k + 500, 20)}") for k in range(40)], "doc_id long, text string")
    for p in (decontaminate.LeakParams(), decontaminate.LeakParams(slice_bytes=4000)):
        assert sorted((x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, items, p).collect()) == [(k, k) for k in range(40)]
        assert decontaminate.without_leaks(docs, items, p).count() == 0


def test_all_are_found_at_the_limit(spark):
    """Items of every length with just as many edits as are allowed."""
    r = random.Random(8)
    lengths = [n for n in (*range(5, 41), 47, 59, 90) for _ in range(8)]
    items = [(k, " ".join(f"t{r.randrange(5000)}" for _ in range(n))) for k, n in enumerate(lengths)]
    docs = [(k, f"{prose(k, 30)} {' '.join(edited(r, t.split(), len(t.split()) * 20 // 100))} {prose(k + 9000, 30)}") for k, t in items]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r["edits"] for r in found.filter("doc_id = item_id").collect()}
    assert got == {k: least_edits(t.split(), d.split()) for (k, t), (_, d) in zip(items, docs)}


def test_short_items_are_found_by_exact_copies(spark):
    items = [(n, " ".join(f"t{n}w{k}" for k in range(n))) for n in (2, 3, 4)]
    docs = [(n, f"{prose(n, 20)} {t}, {prose(n + 50, 20)}") for n, t in items] + [(10 + n, f"{prose(n, 20)} {t.replace('w1', 'x')}") for n, t in items] + [(20, "t4w0 t4w1 t4w2 between t4w3")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(2, 2, 0), (3, 3, 0), (4, 4, 0)]


def test_scripts_without_spaces(spark):
    items = [(1, "水の沸点は標高によって変わりますか"), (2, "中国的首都是哪一座城市"), (3, "เมืองหลวงของประเทศไทยคือเมืองใด")]
    docs = [(k, f"{'前文' if k < 3 else 'ก่อน'}{t}。{prose(k, 10)}\u3000") for k, t in items] + [(4, "中国的首者是哪一座城市吗"), (5, "中文的首者是那一座城镇吗"), (6, None), (7, "é ß")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 2, 1)]
