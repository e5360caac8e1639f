"""Token counts by a transducer: a piece model compiled, as far as texts need it, to a deterministic machine whose transitions carry the tokens they add.

The machine. A byte-pair encoding is right exactly where each two neighbouring tokens are the encoding of their joined text, as merges on both sides of a place that none crosses don't
touch each other. So the encoding of a text's beginning is that of a shorter beginning and one more token, and a state needs only, for each place from which a piece of the
vocabulary may still be under way: the node of the vocabulary's prefix tree, the token that ends there, and by how many tokens the count there differs from the count here. These sets
are the states; a transition reads one character and adds the change of the count, which is below zero where characters join to a longer piece. States and transitions are made when a
text first needs them and kept by the worker, within `max_transitions`, beyond which the machine starts anew.

The run. Texts are cut into chunks of `chunk` characters, and all chunks of a piece of a batch step together through the transitions, held in a hash table of arrays. A chunk's state map
is first known for one state, that of a text's start; its run from another state ends where it meets a run already known, as both go on alike from there, which after a
space is so for any state. Maps are composed in a scan: what leaves a chunk enters the next, until nothing changes.

Counts are those of the library that owns the model (sentencepiece): a space before the text, spaces as a piece's sign, bytes for characters that no piece has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trackweave.llm.common import pieces, small_batches


@dataclass(frozen=True)
class TokenParams:
    """model: name of a sentencepiece byte-pair model with byte fallback, resolved by public_tokenizers, or its path with a slash; limit: more tokens than this are `over_limit`."""

    model: str = "piece_bpe_32k.model"
    limit: int = 4096
    chunk: int = 256
    max_transitions: int = 1_000_000


SPACE = "▁"
#: Token of a state's place where nothing stands before, or nothing that could join with what follows.
FREE = -1


class Vocabulary:
    """Pieces, their scores, the tree of their prefixes, and which tokens may stand beside each other."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in ids}
        self.score = {t: model.get_score(i) for i, t in self.text.items()}
        self.number = {t: i for i, t in self.text.items()}
        self.joined = {t[k : k + 2] for t in self.score for k in range(len(t) - 1)}
        self.step: list[dict[str, int]] = [{}]
        self.token: list[int] = [FREE]
        self.first: list[str] = [""]
        for i, t in self.text.items():
            node = 0
            for c in t:
                nxt = self.step[node].get(c)
                if nxt is None:
                    nxt = self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.token.append(FREE)
                    self.first.append(t[0])
                node = nxt
            self.token[node] = i if self.encode(t) == [t] else FREE
        self._pairs: dict[tuple[int, int], bool] = {}

    def forget(self) -> None:
        """Drops what was found out about pairs."""
        self._pairs.clear()

    def encode(self, text: str) -> list[str]:
        """Merges by the library's order: the best score first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        got = self._pairs.get((a, b))
        if got is None:
            x, y = self.text[a], self.text[b]
            got = self._pairs[a, b] = x[-1] + y[0] not in self.joined or self.encode(x + y) == [x, y]
        return got


class Machine:
    """The transducer. Characters are numbered: 0 to 3 stand for one that no piece has, by its bytes less one, others follow."""

    def __init__(self, path: str, max_transitions: int) -> None:
        self.words, self.most = Vocabulary(path), max_transitions
        letters = sorted({c for t in self.words.score for c in t})
        self.letters = ["", "", "", "", *letters]
        self.width = len(self.letters)
        code = np.arange(0x110000)
        self.classes = ((code >= 0x80).astype(np.int16) + (code >= 0x800) + (code >= 0x10000)).astype(np.int16)
        for k, c in enumerate(letters, 4):
            if c in self.words.number:
                self.classes[ord(c)] = k
        self.classes[0x20] = self.classes[ord(SPACE)]
        self.reset()

    def refresh(self) -> None:
        """Starts anew once more transitions are held than allowed; not while texts are under way."""
        if self.size > self.most:
            self.reset()

    def reset(self) -> None:
        """No states but that of a text's start."""
        self.words.forget()
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, FREE, 0),)]
        self.index = {self.states[0]: 0}
        self.size = 0
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.keys, self.next, self.delta = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, nxt: np.ndarray, delta: np.ndarray) -> None:
        """New keys; those that meet at a free slot try the following ones."""
        if (self.size + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            held = self.keys[old], self.next[old], self.delta[old]
            self._table(len(self.keys) * 4)
            self.size = 0
            self._put(*held)
        self.size += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.next[at[done]], self.delta[at[done]] = nxt[done], delta[done]
            keys, nxt, delta, at = keys[~done], nxt[~done], delta[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        todo = np.flatnonzero(held != keys)
        while len(todo):
            empty = held[todo] < 0
            at[todo[empty]] = -1
            todo = todo[~empty]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held[todo] = self.keys[at[todo]]
            todo = todo[held[todo] != keys[todo]]
        return at

    def follow(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the counts, for arrays of states and characters' numbers."""
        keys = state.astype(np.int64) * self.width + letter
        at = self._find(keys)
        if (at < 0).any():
            new = np.unique(keys[at < 0])
            made = [self._made(int(k) // self.width, int(k) % self.width) for k in new]
            self._put(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int32))
            at = self._find(keys)
        return self.next[at], self.delta[at]

    def _made(self, state: int, letter: int) -> tuple[int, int]:
        """The transition of one state: which piece ends here is the one that fits the token before it."""
        if letter < 4:
            end, change, held = FREE, letter + 1, []
        else:
            words, c, held, end, change = self.words, self.letters[letter], [], None, 0
            for node, before, less in self.states[state]:
                child = words.step[node].get(c)
                if child is None:
                    continue
                if not node and before != FREE and words.text[before][-1] + c not in words.joined:
                    before = FREE
                held.append((child, before, less))
                token = words.token[child]
                if token != FREE and end is None and (before == FREE or words.fit(before, token)):
                    end, change = token, less + 1
        out = tuple(sorted([(node, before, less - change) for node, before, less in held if self.words.step[node]])) + ((0, end, 0),)
        number = self.index.get(out)
        if number is None:
            number = self.index[out] = len(self.states)
            self.states.append(out)
        return number, change

    def count(self, letters: np.ndarray, starts: np.ndarray, chunk: int) -> np.ndarray:
        """Tokens of texts that lie behind each other in `letters`, each from its start to the next one's."""
        sizes = np.diff(np.append(starts, len(letters)))
        cuts = -(-sizes // chunk)
        text = np.repeat(np.arange(len(starts)), cuts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = starts[text] + number * chunk
        length = np.minimum(chunk, starts[text] + sizes[text] - begin)
        passed = np.zeros(len(letters), np.int32)  # the state after each character, of the last run over it
        change = np.zeros(len(letters), np.int32)
        entry, leave = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        passed = np.zeros(len(letters), np.int32)  # the state after each character, of the last run over it
        change = np.zeros(len(letters), np.int32)
        last, run = begin + length - 1, np.arange(len(text))
        for known in (False, True):  # from a text's start, then from where the chunk before led
            self._run(letters, begin[run], length[run], entry[run], passed, change, known)
            leave[run] = passed[last[run]]
            true = np.where(number > 0, np.concatenate([[0], leave[:-1]]), 0).astype(np.int32) if len(text) else entry
            run, held, entry = np.flatnonzero(true != entry), entry, true
        tokens = np.add.reduceat(change, begin).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        entry[run] = held[run]
        self._composed(run, number, letters, begin, length, entry, leave, tokens, passed, change)
        return np.bincount(text, tokens, len(starts)).astype(np.int64)

    def _composed(self, run: np.ndarray, number: np.ndarray, letters: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray, leave: np.ndarray, tokens: np.ndarray, passed: np.ndarray, change: np.ndarray) -> None:
        """Chunks that the one before still enters elsewhere, as in one letter's repetition: state maps of equal chunks are kept, and composed from left to right until one leads where it did."""
        maps: dict[tuple[bytes, int], tuple[int, int]] = {}
        for k in run.tolist():
            while k < len(number) and number[k] and entry[k] != leave[k - 1]:
                entry[k] = leave[k - 1]
                a, b = int(begin[k]), int(begin[k] + length[k])
                key = letters[a:b].tobytes(), int(entry[k])
                if key not in maps:
                    self._run(letters, begin[k : k + 1], length[k : k + 1], entry[k : k + 1], passed, change, True)
                    maps[key] = int(passed[b - 1]), int(change[a:b].sum())
                leave[k], tokens[k] = maps[key]
                k += 1

    def _run(self, letters: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, passed: np.ndarray, change: np.ndarray, known: bool) -> None:
        """All chunks a character at a time; where another run is known, a chunk is left as soon as both are in the same state."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order]
        live = len(begin)
        for j in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length[:live], -j, side="left"))
            if not live:
                break
            at = begin[:live] + j
            state, add = self.follow(state[:live], letters[at])
            if known:
                apart = passed[at] != state
                passed[at], change[at] = state, add
                if not apart.all():
                    begin, length, state = begin[:live][apart], length[:live][apart], state[apart]
                    live = len(begin)
            else:
                passed[at], change[at] = state, add


_machines: dict[tuple[str, int], Machine] = {}


def _machine(params: TokenParams) -> Machine:
    """The worker's machine for a model; it is kept for later tasks, and starts anew once it holds more transitions than allowed."""
    path = params.model
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    machine = _machines.get((path, params.max_transitions))
    if machine is None:
        machine = _machines[path, params.max_transitions] = Machine(path, params.max_transitions)
    return machine


def counts(texts: pa.Array, params: TokenParams = TokenParams()) -> np.ndarray:
    """Tokens of each text (null: none)."""
    machine = _machine(params)
    machine.refresh()
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.flatnonzero(sizes)
    out = np.zeros(len(texts), np.int64)
    if len(filled):
        whole = " " + " ".join(texts.take(pa.array(filled)).to_pylist())  # the space before each text, which the library puts there
        letters = machine.classes[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        sizes = sizes[filled] + 1
        out[filled] = machine.count(letters, np.cumsum(sizes) - sizes, params.chunk)
    return out


def count_tokens(docs: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit of each row of doc_id and text; other columns take no part.

    Nulls and empty texts have 0 bytes and 0 tokens. Rows of equal or null doc_id each give their own row. A text is never cut: a long one is a piece of its own, with about
    16 bytes of work arrays a character. No shuffle: memory of a worker is the machine's, bounded by `max_transitions`, and a piece's.
    """
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").cast(pa.large_string())
                tokens = counts(texts, params)
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), n_bytes, pa.array(tokens, pa.int64()), pa.array(tokens > params.limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
