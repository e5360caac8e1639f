"""Repaired conversations against all edits of short ones, and against a plain pass over whole tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trackweave.llm import queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost, audit and repaired rows by searching all edits, cheapest first and of equal ones the least audit: (initials so far, next row, what was done)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(out)
        state = (at, initials[-1:] if initials else "")
        if state in done:
            continue
        done.add(state)

        def go(extra, letter, step, new, at=at, cost=cost, audit=audit, initials=initials, out=out):
            whole = initials + (new[0][:1] if new else "")
            if re.fullmatch("(s?(ua)*u?)?", whole) and (not new or new[0][:1] in tuple("sua")):
                heapq.heappush(queue, (cost + extra, audit + letter, at + step, whole, (*out, new) if new else out))

        for role in ("user", "assistant"):
            go(3, "I", 0, (role, ""))
        if at < len(rows):
            role, text, fault = rows[at]
            go(4, "D", 1, None)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(more, "K", 1, (role, text))
                for other in ("user", "assistant"):
                    go(more + 3, "R", 1, (other, text))
    raise AssertionError


def plain(table):
    """The contract, row by row, over (conv_id, turn, role, text)."""
    out = {c: [] for c, *_ in table}
    for c, t, role, text in table:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    result = []
    for c, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, named = [t for t, *_ in rows if t is not None], set(), []
        for _, role, text in rows:
            letters = WORD.findall(text)
            named.append((role, text, "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, fixed = cheapest(named)
        kinds = [f for *_, f in named]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(named, named[1:], strict=False)]
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.append((c, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(result, key=lambda r: (r[0] is not None, r[0] or 0))


def got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_odd_conversations(spark):
    r = random.Random(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "a", "U"], ["Hello.", "Well", None, "", " \n", "Ends here! \t", "a.", "é?", "Hello."]
    table = [(c, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for c in range(300) for _ in range(r.randrange(1, 9))]
    table += [(None, 3, "user", "x."), (None, None, None, None), (-1, 10**12, "assistant", "y."), (-1, 0, "user", "y.")]
    table += table[:40]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("pos", "fault", "step", "audit", "cost", "gone", "digest")})
    assert got(repair.repair(repair.damaged(df))) == plain(table)


def test_long_conversation(spark):
    """Many rows and a very long text in one conversation."""
    r = random.Random(6)
    table = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["One.", f"Text {t}.", f"Text {t}"])) for t in range(3000)] + [(1, 4000, "user", "long " * 200_000 + ".")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert got(repair.repair(repair.damaged(df))) == plain(table)


def test_nothing(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(rows)).collect() == []
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "x.")], rows.schema)
    assert got(repair.repair(repair.damaged(df))) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_undamaged(spark):
    df = spark.createDataFrame([("a", 0, "system", "S."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 0, "assistant", "Ho."), ("b", 1, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in repair.repair(repair.whole(df)).collect()}
    assert (rows["a"]["cost"], rows["a"]["audit"]) == (0, "KKK")
    assert (rows["b"]["cost"], rows["b"]["audit"]) == (6, "IKKI")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    table = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_repair"](spark, path)) == plain(table)
