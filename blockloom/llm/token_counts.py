"""Numbers of word pieces by a linear longest-match automaton.

Greedy longest-match-first cuts a word into the longest piece that begins it, and again for the rest. The
vocabulary's trie gets failure links: where no edge goes on, a link leads to the state after the pieces that
greedy matching would cut off there, and holds how many they are. So every byte is looked at once, and no piece
is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose numbers a worker remembers at most, and bytes of a word that it remembers: texts without spaces have words of any length.
REMEMBERED, LONGEST = 400_000, 100


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def word_pieces(vocabulary: list[str]) -> tuple[set[bytes], set[bytes]]:
    """Pieces that begin a word (written with a space before them) and pieces that go on in one; every byte is both."""
    alphabet = byte_alphabet()
    raw = [bytes(alphabet[c] for c in token) for token in vocabulary if all(c in alphabet for c in token)]
    single = {bytes([b]) for b in range(256)}
    return {t[1:] for t in raw if t[:1] == b" " and len(t) > 1} | single, {t for t in raw if t[:1] != b" "} | single


class Automaton(dict):
    """The number of pieces of a word, by word: computed where it is missing."""

    def __init__(self, first: set[bytes], rest: set[bytes]) -> None:
        self.edges: dict[int, int] = {}  # state * 256 + byte -> state
        self.fail, self.popped = [-1, -1], [0, 0]
        ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                state = root
                for b in piece:
                    key = state << 8 | b
                    state = self.edges.get(key, -1)
                    if state < 0:
                        state = self.edges[key] = len(ends)
                        ends.append(False)
                ends[state] = True
        self.fail += [-1] * (len(ends) - 2)
        self.popped += [0] * (len(ends) - 2)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.edges.items():
            below.setdefault(key >> 8, []).append((key & 255, state))
        queue = deque([0, 1])
        while queue:
            up = queue.popleft()
            for b, state in below.get(up, []):
                queue.append(state)
                if ends[state]:
                    self.fail[state], self.popped[state] = 1, 1
                    continue
                to, n = self.fail[up], self.popped[up]
                while to >= 0 and (to << 8 | b) not in self.edges:
                    n += self.popped[to]
                    to = self.fail[to]
                if to >= 0:
                    self.fail[state], self.popped[state] = self.edges[to << 8 | b], n

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        state = n = 0
        for b in word:
            to = edges.get(state << 8 | b, -1)
            while to < 0:  # every byte is a piece, so a link leads to an edge at last
                n += popped[state]
                state = fail[state]
                to = edges.get(state << 8 | b, -1)
            state = to
        while state > 1:
            n += popped[state]
            state = fail[state]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


_MADE: dict[int, Automaton] = {}


def _counts(tokens: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(tokens))
        automaton = _MADE.get(key) or _MADE.setdefault(key, Automaton(*word_pieces(tokens)))
        of = automaton.__getitem__
        for batch in batches:
            words, pieces = [], []
            for text in batch.column(1):
                own = text.as_buffer().to_pybytes().split() if text.is_valid else []
                words.append(len(own))
                pieces.append(sum(map(of, own)))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_tokens: the word pieces of each row's text.

    The file is a tokenizer's JSON with a byte-level vocabulary, read by the driver and sent with the tasks (its
    size is that of the vocabulary, not of the data). Words lie between white space; pieces with a leading space in
    the vocabulary begin words, the others go on. Null and blank texts have none. Repeated rows are counted
    each; ids may be null or of any type; other columns are ignored; an empty table gives an empty result.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        tokens = list(json.load(f)["model"]["vocab"])
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counts(tokens), f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
