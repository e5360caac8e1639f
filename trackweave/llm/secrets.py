"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens (between ASCII white space) are tagged as begin, inside or outside of a secret from the shape of the token, the tokens before
and after it and features of the file. The field is trained here, by its log-likelihood, on a bounded sample of documents labelled
by the patterns, and generalises to secrets that no pattern names. Decoding is by Viterbi. The best path goes through `outside` at every
token whose score for it exceeds the others by more than its transitions, and a next token that would have to begin anew, could win back; the text is cut at these tokens,
which leaves the path as it is, and only the short runs between are decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trackweave.llm.common import flat_words, pieces, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
#: Words that announce a secret.
CUE = r"(?i)passw|passwd|pwd|secret|token|api_?key|apikey|credential|auth|bearer|private|access_?key|signature"
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


@dataclass(frozen=True)
class SecretParams:
    """sample: documents that the field is trained on, half of them with a pattern's match if there are as many; longest: their characters at most; stiffness keeps transitions small, so that most tokens are sure. Scanning has no such limits."""

    sample: int = 600
    longest: int = 20_000
    epochs: int = 250
    rate: float = 0.5
    decay: float = 2e-5
    stiffness: float = 0.001


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and without overlap per kind; short ones are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Features of a token, then of its neighbours (the cues and joints of the two before and one after), then of the file.
OWN = ("one", "digit", "upper", "lower", "digits and letters", "mixed case and digits", "hex", "base64", "cue", "joint inside", "ends in joint", "length 8", "length 16", "length 24", "length 40", "many kinds", "quoted", "prefix", "separators", "no vowel run")
NEAR = ("cue 1 before", "joint 1 before", "cue 2 before", "joint 2 before", "cue after")
FILE = ("digits in file", "joints in file", "code in file")


def word_features(words: pa.Array) -> np.ndarray:
    """OWN of each word, by Arrow's regular expressions; the core of a word is what follows `name=` without quotes and brackets around it."""
    has = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False).astype(bool)
    core = pc.replace_substring_regex(pc.replace_substring_regex(words, r"^[\"'`,;()\[\]{}<>]*([A-Za-z_.-]*[:=])?[\"'`(\[{<]*", ""), r"[\"'`,;()\[\]{}<>]+$", "")
    n = pc.utf8_length(core).to_numpy(zero_copy_only=False)
    digit, upper, lower = has(core, "[0-9]"), has(core, "[A-Z]"), has(core, "[a-z]")
    key = has(core, "^[A-Za-z0-9+/_.=-]+$")
    switch = "(?:[0-9][A-Za-z]|[A-Za-z][0-9])"
    columns = [np.ones(len(n)), digit, upper, lower, digit & (upper | lower), digit & upper & lower, has(core, "^[0-9a-fA-F]{8,}$"), key & (n >= 8), has(words, CUE), has(words, ".[:=]."), has(words, "[:=]$"), n >= 8, n >= 16, n >= 24, n >= 40, digit & has(core, f"{switch}.*{switch}.*{switch}"), has(words, "^[\"'`]"), has(core, "^(AKIA|ghp_|gho_|sk-|xox[abp]-|eyJ|AIza)"), has(core, "[-_].*[-_]"), key & (n >= 12) & ~has(core, "[aeiouAEIOU][a-z][a-z]")]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class Field:
    own: np.ndarray  # features x states
    near: np.ndarray
    file: np.ndarray
    moves: np.ndarray  # from x to; the first row also for the start

    def margins(self) -> tuple[float, float]:
        """What a state other than outside can gain by its transitions over outside: before a token that isn't inside, and before one that is and would have to begin anew (but for that token's own scores)."""
        m = self.moves
        gain = max(m[a, s] + m[s, b] - m[a, OUTSIDE] - m[OUTSIDE, b] for a in range(3) for s in (BEGIN, INSIDE) for b in (OUTSIDE, BEGIN))
        anew = max(m[a, s] - m[a, OUTSIDE] + m[s, INSIDE] - m[OUTSIDE, BEGIN] + m[INSIDE, c] - m[BEGIN, c] for a in range(3) for s in (BEGIN, INSIDE) for c in range(3))
        return float(gain), float(anew)


def file_features(offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row per document, from its tokens' features."""
    n = np.maximum(1, np.diff(offsets))
    def share(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(own[:, k])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / n
    digits, joints = share(1), share(9) + share(10)
    return np.stack([np.minimum(1, 10 * digits), np.minimum(1, 10 * joints), (joints > 0.05).astype(float)], 1)


def emissions(offsets: np.ndarray, index: np.ndarray, words: pa.Array, field: Field) -> np.ndarray:
    """Scores (tokens x states). The words' own scores are computed once per distinct word."""
    features = word_features(words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    score = (features @ field.own)[index]
    cue, joint = features[:, 8], np.maximum(features[:, 9], features[:, 10])
    for k, (values, by) in enumerate(((cue, 1), (joint, 1), (cue, 2), (joint, 2), (cue, -1))):
        if len(index) <= abs(by):
            continue
        flag = values[index]
        moved = np.zeros(len(index), bool)
        if by > 0:
            moved[by:] = (flag[:-by] > 0) & (doc[:-by] == doc[by:])
        else:
            moved[:by] = (flag[-by:] > 0) & (doc[:by] == doc[-by:])
        score[moved] += field.near[k]
    score += (file_features(offsets, features[index][:, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]]) @ field.file)[doc] if len(index) else 0
    return score


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """States of the best path that starts and ends outside."""
    best, back = e[0] + moves[OUTSIDE], []
    for row in e[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(0))
        best = through.max(0) + row
    s = int((best + moves[:, OUTSIDE]).argmax())
    path = [s]
    for b in reversed(back):
        s = int(b[s])
        path.append(s)
    return path[::-1]


def tagged(offsets: np.ndarray, index: np.ndarray, words: pa.Array, field: Field) -> list[tuple[int, int]]:
    """(first, last token) of each secret that the field finds."""
    e = emissions(offsets, index, words, field)
    if not len(e):
        return []
    starts = np.zeros(len(e), bool)
    starts[offsets[:-1][offsets[:-1] < len(e)]] = True
    gain, anew = field.margins()
    inside = np.full(len(e), -np.inf)  # what the next token of the text loses if it has to begin anew
    inside[:-1] = np.where(starts[1:], -np.inf, e[1:, INSIDE] - e[1:, BEGIN])
    unsure = e[:, OUTSIDE] - e[:, 1:].max(1) <= np.maximum(gain, anew + inside)
    at = np.flatnonzero(unsure)
    runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | starts[at[1:]]) + 1) if len(at) else []
    out = []
    if runs:
        alone = e[[run[0] for run in runs]] + field.moves[OUTSIDE] + field.moves[:, OUTSIDE]
        single = alone.argmax(1) == OUTSIDE
        runs = [run for run, plain in zip(runs, single, strict=True) if len(run) > 1 or not plain]
    for run in runs:
        begun = None
        for t, s in zip(run, viterbi(e[run], field.moves), strict=True):
            if s != INSIDE and begun is not None:
                out.append((begun, t - 1))
                begun = None
            if s == BEGIN or s == INSIDE and begun is None:
                begun = t
        if begun is not None:
            out.append((begun, run[-1]))
    return [(int(a), int(b)) for a, b in out]


def token_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the tokens of a text start and end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~((c == 32) | ((c >= 9) & (c <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def fit(texts: list[str], p: SecretParams) -> Field:
    """Maximises the log-likelihood of the patterns' labels by gradient steps over lines of tokens."""
    offsets, index, words = flat_words(pa.array(texts, pa.string()), lower=False)
    features = word_features(words)
    labels = np.zeros(len(index), np.int64)
    for d, text in enumerate(texts):
        a, b = token_starts(text)
        for start, _, end in base_spans(text):
            hit = np.flatnonzero((a < end) & (b > start)) + offsets[d]
            labels[hit] = INSIDE
            labels[hit[:1]] = BEGIN
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cue, joint = features[:, 8][index], np.maximum(features[:, 9], features[:, 10])[index]
    near = np.zeros((len(index), len(NEAR)))
    for k, (values, by) in enumerate(((cue, 1), (joint, 1), (cue, 2), (joint, 2), (cue, -1))):
        if len(index) > abs(by):
            if by > 0:
                near[by:, k] = values[:-by] * (doc[:-by] == doc[by:])
            else:
                near[:by, k] = values[-by:] * (doc[:by] == doc[-by:])
    x = np.concatenate([features[index], near, file_features(offsets, features[index])[doc]], 1) if len(index) else np.zeros((0, len(OWN) + len(NEAR) + len(FILE)))
    # sequences: windows of 24 tokens around anything that isn't plain, and one in ten of the rest
    length = 24
    full = np.flatnonzero([(doc[i] == doc[i + length - 1]) for i in range(0, len(index) - length + 1, length)]) * length if len(index) >= length else np.empty(0, np.int64)
    odd = np.array([(labels[i : i + length] > 0).any() or (x[i : i + length, 1] > 0).any() for i in full], bool)
    chosen = np.concatenate([full[odd], full[~odd][::10]]) if len(full) else full
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = -np.inf
    w = np.zeros((x.shape[1], 3))
    w[0] = (18, 0, 0)  # secrets are rare
    if not len(chosen):
        return Field(w[: len(OWN)], w[len(OWN) : len(OWN) + len(NEAR)], w[len(OWN) + len(NEAR) :], moves)
    at = chosen[:, None] + np.arange(length)
    xs, ys = x[at], labels[at]
    ys[:, 0] = np.where(ys[:, 0] == INSIDE, BEGIN, ys[:, 0])
    gold = np.eye(3)[ys]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (np.concatenate([np.zeros((len(ys), 1), int), ys[:, :-1]], 1), ys), 1)
    square_w, square_m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(p.epochs):
        e = xs @ w
        step = np.exp(moves)
        forward = np.zeros((length, len(xs), 3))
        scale = np.zeros((length, len(xs), 1))
        top = e.max(2, keepdims=True)
        emit = np.exp(e - top)
        f = step[OUTSIDE] * emit[:, 0]
        for t in range(length):
            if t:
                f = (forward[t - 1] @ step) * emit[:, t]
            scale[t] = f.sum(1, keepdims=True)
            forward[t] = f / scale[t]
        b = np.ones((len(xs), 3))
        marginal = np.zeros_like(gold)
        expected = np.zeros((3, 3))
        for t in range(length - 1, -1, -1):
            marginal[:, t] = forward[t] * b
            before = forward[t - 1] if t else np.tile([1.0, 0, 0], (len(xs), 1))
            onward = emit[:, t] * b / scale[t]
            expected += step * (before.T @ onward)
            b = onward @ step.T
        marginal /= marginal.sum(2, keepdims=True)
        gradient = np.tensordot(gold - marginal, xs, ((0, 1), (0, 1))).T / len(xs) - p.decay * w
        moved = (gold_moves - expected) / len(xs) - p.stiffness * np.where(np.isfinite(moves), moves, 0)
        square_w += gradient**2
        square_m += moved**2
        w += p.rate * gradient / np.sqrt(square_w)
        moves = np.where(np.isfinite(moves), moves + p.rate * moved / np.sqrt(square_m), moves)
    return Field(w[: len(OWN)], w[len(OWN) : len(OWN) + len(NEAR)], w[len(OWN) + len(NEAR) :], moves)


def train(docs: DataFrame, p: SecretParams = SecretParams()) -> Field:
    """From about `sample` documents, half of them with a match of a pattern if there are as many, chosen by hash of doc_id and text.

    The documents are counted first; then only those whose hash is below a bound that leaves about half as many again as are wanted are collected, so what reaches the driver doesn't grow with the input.
    """
    small = docs.filter(F.col("text").isNotNull() & (F.length("text") <= p.longest)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("_h"), F.xxhash64("text").alias("_t"))
    small = small.withColumn("_m", F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}"))
    n, marked = small.agg(F.count("*"), F.count_if("_m")).first()
    half = p.sample // 2
    bound = lambda total: int(min(1.0, (1.5 * half + 50) / max(1, total)) * (1 << 40))
    taken = small.filter((F.col("_h") < bound(n)) | F.col("_m") & (F.col("_h") < bound(marked))).dropDuplicates(["_h", "_t"]).collect()
    taken = sorted(taken, key=lambda r: (r["_h"], r["_t"]))
    rows = [r for r in taken if r["_m"] and r["_h"] < bound(marked)][:half] + [r for r in taken if r["_h"] < bound(n)][:half]
    return fit(sorted({r["text"] for r in rows}), p)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf of every row; a null text is an empty one.

    Spans are kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex, crf), comma-joined. A secret of
    the field that overlaps a pattern's match adds nothing and is left out. Texts are read whole; repeated rows are repeated.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                offsets, index, words = flat_words(b.column("text"), lower=False)
                more: dict[int, list[tuple[int, int]]] = {}
                for first, last in tagged(offsets, index, words, shared.value):
                    d = int(np.searchsorted(offsets, first, "right")) - 1
                    more.setdefault(d, []).append((first - int(offsets[d]), last - int(offsets[d])))
                rows = []
                for d, text in enumerate(texts):
                    base = base_spans(text)
                    extra = []
                    if d in more:
                        a, z = token_starts(text)
                        for first, last in more[d]:
                            s, e = int(a[first]), int(z[last])
                            while s < e and text[s] in "\"'`(,;":
                                s += 1
                            while e > s and text[e - 1] in "\"'`),;.":
                                e -= 1
                            if s < e and not any(s < y and e > x for x, _, y in base):
                                extra.append((s, 3, e))
                    written = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in (base, base + extra)]
                    n = [sum(k == kind for _, kind, _ in base) for k in range(3)]
                    rows.append((*n, hashlib.sha256(written[0].encode()).hexdigest(), written[1], len(extra)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def find_secrets(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    return scan(docs, train(docs, p))
