"""Benchmark decontamination: CGK walks, bit-sampling hashes, exact edit distance.

Texts and items are sequences of words (lower case, punctuation removed; in scripts without spaces, of characters). A CGK walk reads a word at each
step and moves on by a random bit of the step and the word, so two sequences within few edits fall into step again and give walks of small
Hamming distance. A band samples some steps of a walk of its own; equal samples make a candidate. Windows start at each word of a text and of an item;
how many steps an item's windows take (never past its end) and how many bands it needs follow from its length: the longest walk and the fewest bands that reach
the target recall on made-up items of that length with as many random edits as are allowed. Items of one or two words are met at each place of theirs.
A text's walk ends at the first sample at which no item's window has begun alike.

Each candidate's place is then checked by exact edit distance of the whole item against the best stretch of the text there, on 64-bit codes of the words.

The benchmark is broadcast in slices of at most `slice_bytes` of text, with one pass over the documents for each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from trackweave.llm.common import flat_words, pieces, small_batches

#: Places of a text whose windows are walked at a time, and candidates that are listed at a time.
AT_ONCE, LISTED = 1 << 17, 1 << 20
#: Characters that are words of their own, in scripts without spaces, and white space beyond ASCII.
ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Z}\x{85}]"


@dataclass(frozen=True)
class LeakParams:
    """A leak is a stretch within percent / 100 * (words of the item) word edits, so at 20 % an item under five words leaks by exact copies. Items under min_words words (a single word) are no evidence of anything and are left out.

    recall: that of the candidates at the limit, for items of any length, measured in so many trials. walks: lengths to choose from. bands: how many there are at most. sampled: share of a walk's steps that a band samples.
    """

    percent: int = 20
    min_words: int = 2
    slice_bytes: int = 16 << 20
    recall: float = 0.998
    trials: int = 600
    walks: tuple = (14, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2)
    bands: int = 10
    sampled: float = 0.7
    seed: int = 11


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and a code of each word; words of punctuation only are left out."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.take(texts, pa.array(np.arange(len(texts))))
    wide = pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts))  # ASCII texts have none of ALONE
    if pc.any(wide).as_py():
        texts = pc.replace_with_mask(texts, wide, pc.replace_substring_regex(texts.filter(wide), ALONE, r" \0 "))
    offsets, index, words = flat_words(texts)
    odd = pc.invert(pc.utf8_is_alnum(words))
    clean = words if not pc.any(odd).as_py() else pc.replace_with_mask(words, odd, pc.replace_substring_regex(words.filter(odd), r"[^\pL\pN]+", ""))
    clean = pc.utf8_lower(clean).to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in clean), np.uint64, len(clean))
    codes = codes[index] if len(index) else np.empty(0, np.uint64)
    keep = codes != 0
    return np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]


@dataclass
class Band:
    """What a band draws: multipliers of each step's bits, and which steps it samples (the first always)."""

    bits: np.ndarray
    samples: np.ndarray


def drawn(p: LeakParams) -> list[Band]:
    r = np.random.default_rng(p.seed)
    longest = max(p.walks)
    out = []
    for _ in range(p.bands):
        bits = r.integers(0, 2**32, longest, dtype=np.uint32) | np.uint32(1)
        samples = r.random(longest) < p.sampled
        samples[0] = True
        out.append(Band(bits, samples))
    return out


def narrow(codes: np.ndarray) -> np.ndarray:
    """The upper halves of words' codes, which walks are made of."""
    return (codes >> np.uint64(32)).astype(np.uint32)


def sampled(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of samples with one more word."""
    h = (h ^ words) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def moved(at: np.ndarray, words: np.ndarray, bit: np.uint32) -> np.ndarray:
    """The walks' next places."""
    return at + ((words * bit) >> np.uint32(31)).astype(at.dtype)


def windows(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, steps: int, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the walks from starts over so many steps, and which of them stay before their ends."""
    at, h, inside = starts.copy(), np.zeros(len(starts), np.uint32), np.ones(len(starts), bool)
    for t in range(steps):
        inside &= at < ends
        w = words[np.minimum(at, len(words) - 1)]
        if band.samples[t]:
            h = sampled(h, w)
        at = moved(at, w, band.bits[t])
    return h, inside


def with_edits(items: np.ndarray, k: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows with k random edits each (a word replaced, put in or taken out), and their lengths; behind them stand other words."""
    rows, n = items.shape
    out, length, at = np.concatenate([items, r.integers(0, 2**32, (rows, k), dtype=np.uint32)], 1), np.full(rows, n), np.arange(rows)
    place = np.arange(n + k)
    for _ in range(k):
        kind, where = r.integers(0, 3, rows), (r.random(rows) * length).astype(np.int64)
        # where each word comes from: one to the left behind a word put in, one to the right behind one taken out
        source = place + ((kind[:, None] == 2) & (place >= where[:, None])) - ((kind[:, None] == 1) & (place > where[:, None]))
        out = np.take_along_axis(out, np.minimum(source, n + k - 1), 1)
        fresh = kind < 2
        out[at[fresh], where[fresh]] = r.integers(0, 2**32, fresh.sum(), dtype=np.uint32)
        length = length + (kind == 1) - (kind == 2)
    return out, length


def recall_at_limit(n: int, steps: int, bands: list[Band], percent: int, trials: int, seed: int = 3) -> np.ndarray:
    """Share of made-up items of n different words that share a window with a copy of n * percent / 100 random edits, by the first 1, 2, ... bands."""
    r = np.random.default_rng(seed + n)
    items = r.integers(0, 2**32, (trials, n), dtype=np.uint32)
    copies, lengths = with_edits(items, n * percent // 100, r)
    texts = np.concatenate([copies, r.integers(0, 2**32, (trials, steps), dtype=np.uint32)], 1)
    row, column = np.divmod(np.arange(items.size), n)
    text_row, text_column = np.divmod(np.arange(texts.size), texts.shape[1])
    of_copy = text_column < lengths[text_row]
    hit = np.zeros((trials, len(bands)), bool)
    for j, band in enumerate(bands):
        a, inside = windows(items.ravel(), (row + 1) * n, np.arange(items.size), steps, band)
        b, _ = windows(texts.ravel(), (text_row[of_copy] + 1) * texts.shape[1], np.flatnonzero(of_copy), steps, band)
        met = np.isin(row[inside] << 32 | a[inside], text_row[of_copy] << 32 | b)
        hit[row[inside][met], j] = True
    return np.maximum.accumulate(hit, axis=1).mean(0)


@functools.lru_cache(maxsize=512)
def plan(n: int, p: LeakParams) -> tuple[int, int]:
    """(steps, bands) for items of n words: the longest walk that reaches the target recall, with twice the fewest bands that do, four at least, as edits needn't be as random as in the trials."""
    bands = drawn(p)
    for steps in p.walks:
        reached = recall_at_limit(n, steps, bands, p.percent, p.trials)
        if reached[-1] >= p.recall:
            return steps, min(p.bands, max(4, 2 * int(np.argmax(reached >= p.recall)) + 2))
    return min(p.walks), p.bands


@dataclass
class Level:
    """Of a band's windows after a step: table: which hashes there are; keys, windows: hashes of those that end here and their (item, offset)."""

    table: np.ndarray
    keys: np.ndarray
    windows: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, keys: np.ndarray, windows: np.ndarray) -> Level:
        """The table has 32 places or more for each hash."""
        table = np.zeros(1 << max(12, (32 * len(h)).bit_length()), bool)
        out = cls(table, keys, windows)
        table[out.places(h)] = True
        return out

    def places(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint32(33 - len(self.table).bit_length())

    def __getstate__(self) -> tuple:
        return len(self.table), np.packbits(self.table), self.keys, self.windows

    def __setstate__(self, state: tuple) -> None:
        n, bits, self.keys, self.windows = state
        self.table = np.unpackbits(bits, count=n).view(bool)


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    bands: list[tuple[Band, list[Level]]]


def build_index(ids: list, texts: list[str | None], p: LeakParams) -> Index:
    """Equal items are one, with all their ids."""
    offsets, codes = coded(pa.array(texts, pa.string()))
    by_words: dict[bytes, list] = {}
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= p.min_words:
            by_words.setdefault(codes[a:b].tobytes(), []).append(ids[k])
    items = [np.frombuffer(w, np.uint64) for w in by_words]
    lengths = np.array([len(w) for w in items], np.int64)
    # from 64 words on, more windows only add to the recall
    plans = np.array([(1, 1) if n <= 2 else plan(min(n, 64), p) for n in lengths.tolist()], np.int64).reshape(-1, 2)
    flat = narrow(np.concatenate([*items, np.zeros(1, np.uint64)]))
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    item = np.repeat(np.arange(len(items)), lengths)
    offset = np.arange(lengths.sum()) - np.repeat(first, lengths)
    bands = []
    for j, band in enumerate(drawn(p)):
        own = plans[item, 1] > j
        k, o = item[own], offset[own]
        steps, at, h, ends = plans[k, 0], first[k] + o, np.zeros(len(k), np.uint32), first[k] + lengths[k]
        levels = []
        for t in range(int(steps.max(initial=0))):
            ok = at < ends
            k, o, steps, at, h, ends = (x[ok] for x in (k, o, steps, at, h, ends))
            w = flat[at]
            if band.samples[t]:
                h = sampled(h, w)
            over = steps == t + 1
            order = np.argsort(h[over], kind="stable")
            levels.append(Level.of(h, h[over][order], np.stack([k[over], o[over]], 1)[order]))
            at = moved(at, w, band.bits[t])
            k, o, steps, at, h, ends = (x[~over] for x in (k, o, steps, at, h, ends))
        bands.append((band, levels))
    return Index(list(by_words.values()), items, bands)


def distances(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between the item and any stretch of each row of texts (0: no word), and where the best stretch ends."""
    m = texts.shape[1]
    ramp = np.arange(m + 1, dtype=np.int32)
    row = np.zeros((len(texts), m + 1), np.int32)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != w), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(1), row.argmin(1)


def leaks(texts: pa.Array, index: Index, p: LeakParams) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, end word) of the best place of each pair within the limit."""
    offsets, codes = coded(texts)
    lengths, found = np.array([len(w) for w in index.items]), np.empty((0, 3), np.int64)
    words = np.concatenate([narrow(codes), np.zeros(max(p.walks), np.uint32)])
    for band, levels in index.bands:
        for a in range(0, len(codes), AT_ONCE):
            start = np.arange(a, min(a + AT_ONCE, len(codes)))
            at, h = start, np.zeros(len(start), np.uint32)
            for t, level in enumerate(levels):
                w = words[at]
                if band.samples[t]:
                    h = sampled(h, w)
                    ok = np.flatnonzero(level.table[level.places(h)])
                    start, at, h, w = start[ok], at[ok], h[ok], w[ok]
                    if not len(at):
                        break
                if len(level.keys):
                    lo, hi = np.searchsorted(level.keys, h, "left"), np.searchsorted(level.keys, h, "right")
                    hit = np.flatnonzero(hi > lo)
                    group = np.cumsum((hi - lo)[hit]) // LISTED
                    for part in np.split(hit, np.flatnonzero(np.diff(group)) + 1) if len(hit) else []:
                        times = (hi - lo)[part]
                        which = np.repeat(lo[part], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        place = np.repeat(start[part], times)
                        item, offset = level.windows[which].T
                        row = np.searchsorted(offsets, place, "right") - 1
                        # places nearer than a quarter of the item are one, as the stretch that is checked is longer by half on both sides
                        near = (place - offset - offsets[row]) // np.maximum(1, lengths[item] // 4)
                        found = np.unique(np.concatenate([found, np.stack([item, row, near], 1)]), axis=0)
                at = moved(at, w, band.bits[t])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for group in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
        item, places = int(group[0, 0]), group[:, 1:]
        w = index.items[item]
        n = len(w)
        margin = n // 2 + 1
        limit = n * p.percent // 100
        for a in range(0, len(places), 512):
            part = places[a : a + 512]
            stretch = np.zeros((len(part), n + max(1, n // 4) + 2 * margin), np.uint64)
            for r, (row, near) in enumerate(part):
                start = near * max(1, n // 4) - margin
                s = codes[offsets[row] + max(0, start) : min(offsets[row + 1], offsets[row] + max(0, start + stretch.shape[1]))]
                stretch[r, : len(s)] = s
            # every word of the item that has no equal in the stretch is an edit
            able = np.isin(stretch, w).sum(1) >= n - limit
            part, stretch = part[able], stretch[able]
            if not len(part):
                continue
            edits, ends = distances(w, stretch)
            for (row, near), d, e in zip(part.tolist(), edits.tolist(), ends.tolist(), strict=True):
                if d <= limit:
                    end = max(0, near * max(1, n // 4) - margin) + e
                    best[row, item] = min(best.get((row, item), (d, end)), (d, end))
    return [(row, item, d, e) for (row, item), (d, e) in sorted(best.items())]


def slices(benchmark: DataFrame, p: LeakParams) -> Iterator[Index]:
    """Indexes over slices of the benchmark, each of about slice_bytes of text at most."""
    small_batches(benchmark.sparkSession)
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-4 * size // p.slice_bytes))
    for k in range(n):
        rows = benchmark.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).select("item_id", "text").distinct().collect()
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows], p)


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, edits, n_words (of the item), end_word (of the best stretch, in words of the text) of every leaking pair.

    Null and empty texts and items leak nothing; of equally good places the first counts; repeated rows give
    repeated pairs; empty tables give no pairs; extra columns are ignored. Texts are searched whole.
    """
    spark = docs.sparkSession
    out = None
    for index in slices(benchmark, p):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for whole in batches:
                for b in pieces(whole):
                    ids = b.column("doc_id").to_pylist()
                    rows = [(ids[r], own, d, len(x.items[i]), e) for r, i, d, e in leaks(b.column("text"), x, p) for own in x.ids[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "item_id", "edits", "n_words", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, n_words long, end_word long")
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """The documents in which no item leaks, all columns as they are; those with a null or empty text stay, as do all if the benchmark is empty. Repeated rows stay or go together."""
    for index in slices(benchmark, p):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole):
                    keep = np.ones(b.num_rows, bool)
                    keep[[r for r, *_ in leaks(b.column("text"), shared.value, p)]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
