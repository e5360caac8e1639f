"""Phrases whose words stand together more often than their parts' frequencies explain, per language.

Four passes over the texts, each of numpy arrays in mapped Arrow batches:
1. Counters: every run of 1 to 4 words adds to two of 2^bits counters of its length, by its hashes; the arrays are summed as a tree. A run that is frequent enough has full counters, and so
   have all runs within it: that makes candidates safe, as no frequent phrase is lost. Longer runs are candidates if those of four words within them are.
2. Candidates: distinct runs with full counters throughout, single words too, each with its text.
3. A minimal perfect hash over the candidates, in shards of about `slots` by hash. Mappers look each run up, compare the stored 128-bit key, bincount by slot, and the arrays are summed as a tree.
4. Cuts: each candidate's own count and those of its first and last words are read by their slots. Counts below `least` end there.
Scores, containment and ranks are columns, in exact decimals.

A word's key is a 128-bit hash of its bytes, a run's key is folded from the language's and its words' keys. A shard and its counts (24 bytes and some bits a slot) are all that is broadcast, `together` shards at
a time, beside 5 * 2^bits bits of full counters; bits grow with the bytes of text up to `most_bits`, and beyond 2^24 counters have a byte each instead of four. Beyond `most_bits` they fill up, so that more
candidates are counted, in more shards, of which `together` are a further pass; results stay whole. What a mapper holds and sends doesn't depend on how much it reads, so mappers are few and long: two a core, or one for 16 splits of the input if these are more.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.llm.common import mixed, pieces, settled, small_batches


@dataclass(frozen=True)
class PhraseParams:
    """least: occurrences of a candidate; longest: its words; absorbed: percent of its occurrences inside one longer candidate from which it goes; top: rows of a language."""

    least: int = 100
    longest: int = 5
    absorbed: int = 100
    top: int = 2000
    slots: int = 1 << 20
    most_bits: int = 26
    sketched: int = 4
    together: int = 4


#: Bytes of text for a counter: about 20 words, a fifth of the usual `least`.
BYTES_A_COUNTER = 128
#: Bits from which counters have a byte each, so that four times as many take the same room.
NARROW = 25
#: A key's shard is told by its second lane without these bits.
SHARD_BITS = 40
#: Splits of the input that a mapper reads where they are many.
SPLITS = 16
#: Counters or slots of an array that is summed at a time, and arrays that a task sums at a time.
BLOCK, FAN = 1 << 15, 64
#: Lower case for A-Z, one sign between pieces (10) and one between words (32).
_SIGNS = bytes(10 if chr(b) in ".,;:!?\n\x0b\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _keys(words: list[bytes]) -> np.ndarray:
    """Two 64-bit lanes of each word's hash."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), np.uint64).reshape(-1, 2)


def _start(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(lang + mixed(word))


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(key * np.uint64(0x9E3779B97F4A7C15) + word)


class Runs:
    """Words of a batch of texts, and the keys of all runs of words within pieces."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        self.langs = pc.fill_null(batch.column("lang"), "und").to_pylist()
        self.text = "\n".join(texts.to_pylist()).encode().translate(_SIGNS) + b"\n"
        signs = np.frombuffer(self.text, np.uint8)
        gap = np.concatenate([[True], (signs == 32) | (signs == 10)])
        self.starts, self.ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        rows = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        self.row = np.searchsorted(rows, self.starts, side="right")
        self.piece = np.searchsorted(np.flatnonzero(signs == 10), self.starts)
        n = len(self.starts)
        if not n:
            self.word = np.zeros((0, 2), np.uint64)
            return
        ends = np.empty(2 * n, np.int64)
        ends[0::2], ends[1::2] = self.starts, self.ends
        spans = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(ends), pa.py_buffer(self.text)])
        coded = spans.take(pa.array(np.arange(0, 2 * n - 1, 2))).dictionary_encode()
        self.word = _keys(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def by_length(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """length, whether a run of it starts at each word, and both lanes of its key (of no meaning where none starts)."""
        names = sorted(set(self.langs))
        place = {lang: k for k, lang in enumerate(names)}
        lang = _keys([x.encode() for x in names])[[place[x] for x in self.langs]][self.row] if names else np.zeros((0, 2), np.uint64)
        lanes = [_start(lang[:, j], self.word[:, j]) for j in (0, 1)]
        within = np.ones(len(self.starts), bool)
        yield 1, within, *lanes
        for n in range(2, longest + 1):
            m = len(self.starts) - n + 1
            if m <= 0:
                return
            within = self.piece[:m] == self.piece[n - 1 :]
            lanes = [_longer(lanes[j][:m], self.word[n - 1 :, j]) for j in (0, 1)]
            yield n, within, *lanes

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.text[a:b] for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)).decode()


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: levels of bits, each set where one key alone falls, a key's slot being its bit's rank; keys are stored by slot and compared."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.sizes: list[int] = []
        bits, todo = [], np.arange(len(hi))
        while len(todo):
            size = -(-len(todo) * 3 // 128) * 64  # one and a half bits a key, in words of 64
            self.sizes.append(size)
            at = self._place(hi[todo], lo[todo], len(self.sizes) - 1)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            todo = todo[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(64, bool)
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(counts) - counts
        self.hi, self.lo = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint64)
        slot = self._slots(hi, lo)
        self.hi[slot], self.lo[slot] = hi, lo

    def __len__(self) -> int:
        return len(self.hi)

    def _place(self, hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        return (mixed(hi ^ (lo * salt)) % np.uint64(self.sizes[level])).astype(np.int64)

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot, todo, base = np.full(len(hi), -1), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(hi[todo], lo[todo], level) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[found] & ((np.uint64(1) << bit[found]) - np.uint64(1)))
            slot[todo[found]] = self.rank[at[found] >> 6] + below
            todo, base = todo[~found], base + size
        return slot

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for those that aren't held."""
        slot = self._slots(hi, lo) if len(self) else np.full(len(hi), -1)
        held = slot >= 0
        held[held] = (self.hi[slot[held]] == hi[held]) & (self.lo[slot[held]] == lo[held])
        return np.where(held, slot, -1)


class Shards:
    """Perfect hashes of some of `number` shards by key, with slots of their own each."""

    def __init__(self, held: dict[int, PerfectHash], number: int) -> None:
        self.held, self.number = held, number

    def __len__(self) -> int:
        return sum(map(len, self.held.values()))

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for those that aren't held."""
        slot, shard, base = np.full(len(hi), -1), (lo >> np.uint64(SHARD_BITS)) % np.uint64(self.number), 0
        for k, perfect in self.held.items():
            at = np.flatnonzero(shard == k)
            found = perfect.find(hi[at], lo[at])
            slot[at] = np.where(found >= 0, found + base, -1)
            base += len(perfect)
        return slot


def _blocks(part: int, counts: np.ndarray) -> Iterator[dict]:
    """An array in packed blocks, without those of zeros only."""
    for b in range(0, len(counts), BLOCK):
        block = counts[b : b + BLOCK]
        if block.any():
            yield {"part": part, "block": b // BLOCK, "task": TaskContext.get().partitionId(), "counts": _packed(block)}


def _packed(block: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(block.max()))
    return kind.char.encode() + zlib.compress(block.astype(kind).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), np.dtype(packed[:1].decode())).astype(np.int64)


_ARRAYS = "part int, block int, task int, counts binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])


def _tree_sum(arrays: DataFrame, tasks: int, most: int | None = None) -> DataFrame:
    """Arrays of equal part and block summed, FAN of them at a time; counts above `most` stand for `most` where it is given."""

    def add(group: pa.Table) -> pa.Table:
        total = _unpacked(group.column("counts")[0].as_py())
        for k in range(1, group.num_rows):
            total = total + _unpacked(group.column("counts")[k].as_py())
        if most is not None:
            total = np.minimum(total, most)
        return pa.Table.from_pylist([{**{c: group.column(c)[0].as_py() for c in ("part", "block", "task")}, "counts": _packed(total)}], _ARROW)

    for _ in range(max(1, math.ceil(math.log(max(tasks, 2), FAN)))):
        arrays = arrays.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("part", "block", "task").applyInArrow(add, _ARRAYS)
    return arrays


def _halves(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two counters, one in each half."""
    drop = np.uint64(65 - bits)
    return (hi >> drop).astype(np.int64), (lo >> drop).astype(np.int64) + (1 << bits - 1)


def _add(counters: np.ndarray, at: np.ndarray, least: int) -> None:
    """One more at each place. Counters of a byte are held to `least` at once, places in order, as each takes what a batch has for it in one step."""
    if counters.dtype != np.uint8:
        np.add.at(counters, at, np.int32(1))  # of the counters' own type, else far slower
        return
    at = np.sort(at.astype(np.uint32))
    last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.zeros(0, int)
    counters[at[last]] = np.minimum(counters[at[last]] + np.diff(last, prepend=-1), least)


def _full_counters(texts: DataFrame, tasks: int, bits: int, p: PhraseParams) -> tuple[np.ndarray, DataFrame]:
    """Which counters of each length are full (bits of sketched x 2^bits), and each language's words: lang, n."""
    lengths, narrow = min(p.sketched, p.longest), bits >= NARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, words = np.zeros((lengths, 1 << bits), np.uint8 if narrow else np.int32), {}
        for batch in batches:
            for piece in pieces(batch):
                runs = Runs(piece)
                for lang, row in zip(runs.langs, np.bincount(runs.row, minlength=len(runs.langs)).tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + row
                for n, within, hi, lo in runs.by_length(lengths):
                    for at in _halves(hi[within], lo[within], bits):
                        _add(counters[n - 1], at, p.least)
            if not narrow:
                np.minimum(counters, p.least, out=counters)  # a batch has too few words for an overflow
        for n in range(lengths):
            for row in _blocks(n + 1, counters[n]):
                yield pa.RecordBatch.from_pylist([{**row, "lang": None, "n": None}], out)
        if words:
            yield pa.RecordBatch.from_pylist([{"part": 0, "block": 0, "task": 0, "counts": None, "lang": k, "n": v} for k, v in words.items()], out)

    out = _ARROW.append(pa.field("lang", pa.string())).append(pa.field("n", pa.int64()))
    mapped = settled(texts.mapInArrow(run, f"{_ARRAYS}, lang string, n bigint"))
    full = np.zeros((lengths, (1 << bits) // 8), np.uint8)
    summed = _tree_sum(mapped.filter("part > 0").select("part", "block", "task", "counts"), tasks, p.least)
    for row in summed.mapInArrow(lambda batches: _bits(batches, p.least), _ARRAYS).toLocalIterator():
        packed = np.frombuffer(row["counts"], np.uint8)
        full[row["part"] - 1, row["block"] * BLOCK // 8 :][: len(packed)] = packed
    return full, mapped.filter("part = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _bits(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pylist([{**r, "counts": np.packbits(_unpacked(r["counts"]) >= least, bitorder="little").tobytes()} for r in rows], _ARROW)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _safe(runs: Runs, full: np.ndarray, bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, places, and keys of the runs that have full counters, as all runs within them have."""
    before = None
    for n, within, hi, lo in runs.by_length(longest):
        ok = within if before is None else within & before[:-1] & before[1:]
        at = np.flatnonzero(ok)
        if n <= len(full):
            first, second = _halves(hi[at], lo[at], bits)
            at = at[_set(full[n - 1], first) & _set(full[n - 1], second)]
        before = np.zeros(len(ok), bool)
        before[at] = True
        yield n, at, hi[at], lo[at]


def _candidates(texts: DataFrame, full: np.ndarray, bits: int, p: PhraseParams) -> DataFrame:
    """hi, lo, lang, words, phrase of each safe run, once."""
    shared = texts.sparkSession.sparkContext.broadcast(full)
    out = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in pieces(batch):
                runs, rows = Runs(piece), []
                for n, at, hi, lo in _safe(runs, shared.value, bits, p.longest):
                    _, first = np.unique(hi, return_index=True)
                    for k, key in zip(at[first].tolist(), zip(hi[first].view(np.int64).tolist(), lo[first].view(np.int64).tolist(), strict=True), strict=True):
                        if key not in sent:
                            sent.add(key)
                            rows.append((*key, runs.langs[runs.row[k]], n, runs.phrase(k, n)))
                if len(sent) > p.slots:  # what is sent again is dropped behind the shuffle
                    sent.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return texts.mapInArrow(run, "hi bigint, lo bigint, lang string, words int, phrase string").groupBy("hi", "lo").agg(*(F.min(c).alias(c) for c in ("lang", "words", "phrase")))


def _shards(candidates: DataFrame) -> DataFrame:
    """shard, hash: a pickled perfect hash of each shard's keys."""

    def build(group: pa.Table) -> pa.Table:
        hi, lo = (group.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "hash": pa.array([pickle.dumps(PerfectHash(hi, lo))], pa.binary())})

    return candidates.select("shard", "hi", "lo").groupBy("shard").applyInArrow(build, "shard bigint, hash binary")


def _counted(texts: DataFrame, tasks: int, held, full, bits: int, p: PhraseParams) -> DataFrame:
    """Blocks of the counts by slot of the shards in `held`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect = held.value
        counts = np.zeros(len(perfect), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for _, _, hi, lo in _safe(Runs(piece), full.value, bits, p.longest):
                    slot = perfect.find(hi, lo)
                    counts += np.bincount(slot[slot >= 0], minlength=len(counts))
        for row in _blocks(0, counts):
            yield pa.RecordBatch.from_pylist([row], _ARROW)

    return _tree_sum(texts.mapInArrow(run, _ARRAYS), tasks)


def _cut_names(longest: int) -> list[str]:
    return ["a", *(f"{side}{k}" for k in range(1, longest) for side in "lr")]


def _cuts(candidates: DataFrame, held, counts, p: PhraseParams) -> DataFrame:
    """Candidates with the counts of themselves and of their first k and last words, where the shards in `held` have them, else null."""
    names = _cut_names(p.longest)
    out = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), *((c, pa.int64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect = held.value
        for batch in batches:
            words = [x.encode().split(b" ") for x in batch.column("phrase").to_pylist()]
            lang = _keys([x.encode() for x in batch.column("lang").to_pylist()])
            size = np.array([len(w) for w in words])
            found = {c: np.full(batch.num_rows, -1) for c in names}
            for n in range(1, p.longest + 1):
                at = np.flatnonzero(size == n)
                if not len(at):
                    continue
                word = _keys([w for k in at for w in words[k]]).reshape(len(at), n, 2)

                def read(a: int, b: int, at=at, word=word) -> np.ndarray:
                    lanes = [_start(lang[at, j], word[:, a, j]) for j in (0, 1)]
                    for k in range(a + 1, b):
                        lanes = [_longer(lanes[j], word[:, k, j]) for j in (0, 1)]
                    slot = perfect.find(*lanes)
                    return np.where(slot >= 0, counts.value[slot], -1) if len(counts.value) else slot

                found["a"][at] = read(0, n)
                for k in range(1, n):
                    found[f"l{k}"][at], found[f"r{k}"][at] = read(0, k), read(k, n)
            yield pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), *(pa.array(v, mask=v < 0) for v in found.values())], schema=out)

    return candidates.select("hi", "lo", "lang", "phrase").mapInArrow(run, f"hi bigint, lo bigint, {', '.join(f'{c} bigint' for c in names)}")


def counted_phrases(docs: DataFrame, p: PhraseParams = PhraseParams()) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, a and the counts l1, r1, ... of the parts at each cut, of all phrases with `least` occurrences (single words have no cuts); and lang, n."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    splits = texts.rdd.getNumPartitions()
    tasks = min(splits, max(2 * spark.sparkContext.defaultParallelism, splits // SPLITS))
    texts = texts.coalesce(tasks) if tasks else texts
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size, 1) / BYTES_A_COUNTER + 1)), BLOCK.bit_length() - 1), p.most_bits if p.least < 256 else min(p.most_bits, NARROW - 1))
    full, words = _full_counters(texts, tasks, bits, p)
    candidates = settled(_candidates(texts, full, bits, p))
    number = -(-candidates.count() // p.slots)
    candidates = candidates.withColumn("shard", F.shiftrightunsigned("lo", SHARD_BITS) % F.lit(max(number, 1)))
    shards = settled(_shards(candidates))
    counters, found = spark.sparkContext.broadcast(full), []
    for first in range(0, number, p.together):
        rows = shards.filter(F.col("shard").between(first, first + p.together - 1)).toLocalIterator()
        perfect = Shards({r["shard"]: pickle.loads(r["hash"]) for r in rows}, number)
        if not len(perfect):
            continue
        held = spark.sparkContext.broadcast(perfect)
        counts = np.zeros(len(perfect), np.int64)
        for row in _counted(texts, tasks, held, counters, bits, p).toLocalIterator():
            block = _unpacked(row["counts"])
            counts[row["block"] * BLOCK :][: len(block)] = block
        slots = spark.sparkContext.broadcast(counts)
        found.append(settled(_cuts(candidates, held, slots, p)))
        held.unpersist()
        slots.unpersist()
    names = _cut_names(p.longest)
    if not found:
        empty = candidates.select("lang", "words", "phrase", *(F.lit(None).cast("bigint").alias(c) for c in names))
        return empty.filter("false"), words
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    whole = parts.groupBy("hi", "lo").agg(*(F.max(c).alias(c) for c in names)).filter(F.col("a") >= p.least)
    return whole.join(candidates, ["hi", "lo"]).select("lang", "words", "phrase", *names), words


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact: products need up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)") * n.cast("decimal(17,0)")), wide(left.cast("decimal(19,0)") * right.cast("decimal(19,0)")))


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, a, both descending, and phrase.

    Texts are lower-cased in A-Z, split at `.,;:!?` and line ends into pieces and these at spaces and tabs into words. n counts a language's words, a a phrase's occurrences within pieces,
    overlaps too, l and r those of its two parts at the cut of the lowest score, of equal ones the first. A phrase goes if a longer candidate holds `absorbed` percent of its occurrences, whatever
    becomes of that one. A null lang is `und`, a null text empty. Whole texts are read, however long; repeated rows count each; an empty table, or one without a phrase of `least`
    occurrences, gives none. Other columns take no part.
    """
    counted, words = counted_phrases(docs, p)
    counted = settled(counted.filter("words > 1"))
    cuts = F.array(*(F.when(F.col("words") > k, F.struct(_score(F.col("a"), F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, p.longest)))
    scored = counted.join(F.broadcast(words) if words.count() <= 100_000 else words, "lang").withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "words", "a", "n", "cut.*")
    split = F.split("phrase", " ")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.concat_ws(" ", F.slice(split, i, n))))))
    longer = counted.filter("words > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < p.absorbed * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= p.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= p.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def collocations_sql(p: PhraseParams = PhraseParams()) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with pieces as (
        select lang, row_number() over () as piece, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as ws
        from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
    ), totals as (
        select lang, cast(sum(len(ws)) as bigint) as n from pieces group by lang
    ), runs as (
        select lang, w as words, array_to_string(list_slice(ws, i, i + w - 1), ' ') as phrase
        from (select lang, ws, w, unnest(range(1, len(ws) - w + 2)) as i from pieces, range(1, {p.longest + 1}) t(w))
    ), f as (
        select lang, words, phrase, string_split(phrase, ' ') as ws, count(*) as f from runs group by lang, words, phrase having count(*) >= {p.least}
    ), cuts as (
        select c.lang, c.phrase, c.words, k, c.f as a, x.f as l, y.f as r, n, cast((1000 * c.f::hugeint * n) // (x.f::hugeint * y.f) as bigint) as score
        from f c join totals using (lang), range(1, {p.longest}) t(k), f x, f y
        where c.words > k and x.lang = c.lang and x.phrase = array_to_string(list_slice(c.ws, 1, k), ' ') and y.lang = c.lang and y.phrase = array_to_string(list_slice(c.ws, k + 1, c.words), ' ')
    ), lowest as (
        select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
    ), inner_runs as (
        select lang, array_to_string(list_slice(ws, i, i + w - 1), ' ') as phrase, max(f) as longer
        from (select lang, ws, f, w, unnest(range(1, words - w + 2)) as i from f, range(2, {p.longest}) t(w) where w < words) group by 1, 2
    ), kept as (
        select lowest.* from lowest left join inner_runs using (lang, phrase) where longer is null or 100 * longer < {p.absorbed} * a
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from kept qualify rank <= {p.top}
    """
