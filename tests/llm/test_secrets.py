"""Patterns against a plain reading of their definition, Viterbi against all paths, and what the field adds."""

import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from trackweave.llm import secrets
from trackweave.llm.common import flat_words

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "toKen", "token", "=", ": ", '"', "'", " ", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "g", "\n", "é", "\U0001f600", "x" * 7, "+/"]), max_size=25).map("".join))
def test_patterns(text):
    assert secrets.base_spans(text) == base(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        moves = rng.normal(size=(3, 3))
        moves[secrets.OUTSIDE, secrets.INSIDE] = -np.inf
        e = rng.normal(size=(n, 3))
        def score(path, e=e, moves=moves):
            steps = [0, *path, 0]
            return sum(moves[a, b] for a, b in itertools.pairwise(steps)) + sum(e[i, s] for i, s in enumerate(path))
        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tuple(secrets.viterbi(e, moves)) == best


def test_cut_runs_give_the_whole_path():
    """Decoding only what is unsure is decoding all."""
    texts = [f"some words here then key password = hunter{k}Secret9 and so on until token: abcdef{k}12345 ends here plainly " + "and more plain words " * 12 for k in range(40)]
    field = secrets.fit(texts, secrets.SecretParams(epochs=60))
    offsets, index, words = flat_words(pa.array(texts), lower=False)
    e = secrets.emissions(offsets, index, words, field)
    got = secrets.tagged(offsets, index, words, field)
    want = []
    for d in range(len(texts)):
        path, begun = secrets.viterbi(e[offsets[d] : offsets[d + 1]], field.moves), None
        for t, s in enumerate([*path, 0]):
            if s != secrets.INSIDE and begun is not None:
                want.append((int(offsets[d]) + begun, int(offsets[d]) + t - 1))
                begun = None
            if s == secrets.BEGIN:
                begun = t
    assert got == want and got


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r["doc_id"]])
        named = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in b) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("crf:")] == named
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])))
        assert all(0 <= int(x.split(":")[1]) < int(x.split(":")[2]) <= len(texts[r["doc_id"]] or "") for x in spans)


def test_field_finds_what_no_pattern_names():
    texts = [f"plain words of prose number {k} go on\nexport SERVICE_PASSWORD={'aB3xY9' * 3}{k}Q\nthen more plain words follow here until the end of this " + "and more plain words " * 12 for k in range(60)]
    field = secrets.fit(texts, secrets.SecretParams(epochs=120))
    offsets, index, words = flat_words(pa.array(["plain words go on\nexport SERVICE_CREDENTIAL=zT4kW8zT4kW8zT4kW8R\nthen more plain words follow", "plain words go on and on"]), lower=False)
    tokens = [words[i].as_py() for i in index]
    found = secrets.tagged(offsets, index, words, field)
    assert any("CREDENTIAL" in tokens[t] for a, b in found for t in range(a, b + 1))
    assert all(b < offsets[1] for _, b in found)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = secrets.find_secrets(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in rows if r["doc_id"] in (3, 4, 5))
    assert secrets.find_secrets(no_docs).collect() == []
