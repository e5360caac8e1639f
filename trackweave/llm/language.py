"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams, n = 1 to 3, that both hold at least once, divided by the
root of the product of how many each holds (a blended-spectrum presence kernel). Characters are folded first: a lower-case
letter is one of 127 symbols (a to z their own), anything else a break. Landmark texts give a Nyström map of
the kernel, and kernel ridge regression, one language against the rest, is fitted in it on the driver from a
bounded sample of labelled documents. Texts are scored in batches: the presence matrix of a batch times the landmark
matrix gives the kernel values, these times the weights the scores; the last two matrices are multiplied once, when
the model is made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.llm.common import small_batches

SYMBOLS, WIDTH, N = 128, 7, 3
CODES = SYMBOLS**N
#: Texts are read in pieces of so many characters, overlapping by N - 1.
PIECE = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    """per_language bounds the sample of labelled documents of a label, landmarks how many of these are landmarks. All labels are learned; with many, each has less, so that
    documents stay within all_documents and landmarks within all_landmarks, but for one of each label at least."""

    per_language: int = 200
    landmarks: int = 40
    all_documents: int = 20_000
    all_landmarks: int = 1_000
    ridge: float = 0.2


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, and of others one of the rest by a rule."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return out


def _symbols_of(text: str, symbols: np.ndarray) -> np.ndarray:
    try:  # one byte a character, as in most texts of Latin letters
        return symbols[np.frombuffer(text.encode("latin-1"), np.uint8)].astype(np.int32)
    except UnicodeEncodeError:
        return symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def marked(text: str, symbols: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Distinct n-gram codes of a text, breaks only excepted, ascending, and whether it has a letter. flags isn't needed and stays as it is.

    An n-gram's code is its symbols in base 128; shorter ones start with break symbols, as does one after a break, so that the start of a word counts.
    The longest are taken from the text, the shorter ones from the ends of these and from the text's first symbols.
    """
    found, letters = [], False
    for at in range(0, len(text), PIECE):
        s = _symbols_of(text[max(0, at - N + 1) : at + PIECE], symbols)
        letters = letters or bool(s.any())
        grams = s
        for n in range(2, N + 1):
            found.append(grams[:1])
            if len(s) < n:
                grams = s[:0]
                break
            grams = s[n - 1 :] + (grams[:-1] << WIDTH)
        found.append(_distinct(grams))
    if not found:
        return np.empty(0, np.int32), False
    longest = np.concatenate(found)
    codes = _distinct(np.concatenate([longest & ((1 << WIDTH * n) - 1) for n in range(N, 0, -1)]))
    return codes[codes != 0], letters


#: Codes that are held as a dense block at a time.
BLOCK = 1 << 15


def presence(sets: list[np.ndarray], low: int, high: int) -> np.ndarray:
    """Rows of the n-grams from code low to high, each set divided by the root of its size."""
    out = np.zeros((len(sets), high - low), np.float32)
    for r, s in enumerate(sets):
        out[r, s[np.searchsorted(s, low) : np.searchsorted(s, high)] - low] = 1 / np.sqrt(max(1, len(s)))
    return out


def kernel(a: list[np.ndarray], b: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Kernel values of all pairs, block by block of the codes; vocabulary: that of b."""
    out = np.zeros((len(a), len(b)))
    for low in np.unique(vocabulary // BLOCK) * BLOCK:
        out += presence(a, low, low + BLOCK) @ presence(b, low, low + BLOCK).T
    return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # codes of the landmarks' n-grams
    landmarks: list[np.ndarray]
    weights: np.ndarray  # landmarks x languages
    symbols: np.ndarray

    def __post_init__(self) -> None:
        """Landmarks and weights as one matrix, vocabulary x languages: the product of both is the same for every text."""
        self.place = np.full(CODES, -1, np.int32)
        self.place[self.vocabulary] = np.arange(len(self.vocabulary))
        self.folded = np.zeros((len(self.vocabulary), len(self.languages)), np.float32)
        for low in np.unique(self.vocabulary // BLOCK) * BLOCK:
            rows = slice(*np.searchsorted(self.vocabulary, (low, low + BLOCK)))
            self.folded[rows] = presence(self.landmarks, low, low + BLOCK)[:, self.vocabulary[rows] - low].T @ self.weights

    @property
    def presence(self) -> np.ndarray:
        """Vocabulary x landmarks, dense."""
        return presence(self.landmarks, 0, CODES)[:, self.vocabulary].T

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and which texts have a letter."""
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        sizes, letters = np.ones(len(texts)), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            codes, letters[i] = marked(t or "", self.symbols)
            at = self.place[codes]
            rows[i, at[at >= 0]] = 1
            sizes[i] = max(1, len(codes))
        return (rows @ self.folded) / np.sqrt(sizes)[:, None], letters

    def at_once(self) -> int:
        """Texts that are scored at a time: a block of them holds 32 MB at most."""
        return max(1, min(128, (8 << 20) // max(1, len(self.vocabulary))))


def fit(codes: list[np.ndarray], labels: list[str], p: LanguageParams, symbols: np.ndarray) -> Model:
    """codes: distinct n-grams of each labelled text; the first texts of each language are the landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.empty(0, np.int64), [], np.empty((0, 0)), symbols)
    seen: dict[str, int] = {}
    chosen = []
    each = max(1, min(p.landmarks, p.all_landmarks // len(languages)))
    for i, (c, lab) in enumerate(zip(codes, labels, strict=True)):
        if len(c) and seen.setdefault(lab, 0) < each:
            seen[lab] += 1
            chosen.append(i)
    marks = [codes[i] for i in chosen]
    vocabulary = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.int64)
    values, vectors = np.linalg.eigh(kernel(marks, marks, vocabulary))
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram = np.zeros((root.shape[1], root.shape[1]))
    target = np.zeros((root.shape[1], len(languages)))
    number = {lab: k for k, lab in enumerate(languages)}
    for a in range(0, len(codes), 256):
        mapped = kernel(codes[a : a + 256], marks, vocabulary) @ root
        gram += mapped.T @ mapped
        ones = np.zeros((len(mapped), len(languages)))
        ones[np.arange(len(mapped)), [number[lab] for lab in labels[a : a + 256]]] = 1
        target += mapped.T @ ones
    weights = root @ np.linalg.solve(gram + p.ridge * np.eye(len(gram)), target)
    return Model(languages, vocabulary, marks, weights, symbols)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, p: LanguageParams = LanguageParams()) -> Model:
    """From at most per_language documents of each language that aren't held out, in an order by hash of doc_id; the texts' n-grams are taken on the executors, and of rows of equal doc_id and language one counts."""
    spark = docs.sparkSession
    small_batches(spark)
    symbols = symbol_table()
    ids = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    most = max(1, min(p.per_language, p.all_documents // max(1, ids.select("lang").distinct().count())))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    parts = ids.distinct().withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)))  # the first of each part of a frequent language, then of all parts
    parts = parts.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= most)
    by = W.partitionBy("lang").orderBy(*order)
    chosen = parts.drop("_part").withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= most)
    rank = {(r["doc_id"], r["lang"]): r["_rank"] for r in chosen.collect()}
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted({i for i, _ in rank})], "doc_id long"))
    shared = spark.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [marked(t or "", shared.value)[0].astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([c.tobytes() for c in codes], pa.binary())], ["doc_id", "lang", "codes"])

    rows = docs.select("doc_id", "lang", "text").join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, lang string, codes binary").filter("lang is not null").groupBy("doc_id", "lang").agg(F.min("codes").alias("codes")).collect()
    rows = sorted((r for r in rows if (r["doc_id"], r["lang"]) in rank), key=lambda r: (r["lang"], rank[r["doc_id"], r["lang"]], bytes(r["codes"])))
    return fit([np.frombuffer(r["codes"], np.int32) for r in rows], [r["lang"] for r in rows], p, symbols)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row; `und` and 0 for a null text or one without a letter, or if no language was learned.

    Texts are read whole; an empty text is `und`; of equal scores the first language by name wins; repeated rows are repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        batch = m.at_once()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                names, best = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if m.languages:
                    scores, letters = m.scores(b.column("text").to_pylist())
                    top = scores.argmax(1)
                    names = [m.languages[k] if ok else "und" for k, ok in zip(top, letters, strict=True)]
                    best = np.where(letters, np.clip(scores[np.arange(len(top)), top], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(names), pa.array(best)], [*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs, p)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least: float = 0.1, p: LanguageParams = LanguageParams()) -> DataFrame:
    """The documents whose language is recognised with a score of `least` or more; all columns stay as they are.

    Documents with a null or empty text or without any letter go. If no document has a label to learn from, those with a letter stay. Repeated rows stay or go together; an empty table gives an empty result.
    """
    model = train(docs, p)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        batch = m.at_once()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                scores, letters = m.scores(b.column("text").to_pylist())
                yield b.filter(pa.array(letters & (scores.max(1) >= least) if m.languages else letters))

    return docs.mapInArrow(run, docs.schema)
