"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary has failure links and, with each, the number of pieces that the link pops. One pass over a word's
bytes then gives the number of greedy longest-match pieces; no piece is built and no byte is read twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hushframe.llm.common import SPACES, read_documents

#: Distinct words whose counts a worker keeps, and their longest; scripts without spaces have very long ones.
KEPT_WORDS, KEPT_CHARS = 400_000, 48
#: What a word counts for if it can't be cut into pieces.
UNKNOWN_PIECES = 1


class LongestMatch:
    """Counts greedy pieces: the first piece is the longest of initial that starts the word, each later one the longest of inner.

    A word that can't be cut this way counts as UNKNOWN_PIECES pieces.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        # State 0 is the root for a word's start, state 1 the root after a piece.
        self.next: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                if not piece:
                    continue
                at = root
                for byte in piece:
                    to = self.next[at].get(byte)
                    if to is None:
                        to = self.next[at][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] = True
        n = len(self.next)
        #: Where each state fails to, -1 if nowhere, and the pieces that failing pops.
        self.fail, self.popped = [-1] * n, [0] * n
        level = [(0, byte, to) for byte, to in self.next[0].items()] + [(1, byte, to) for byte, to in self.next[1].items()]
        while level:
            below = []
            for parent, byte, state in level:
                if final[state]:
                    self.fail[state], self.popped[state] = 1, 1
                else:
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and byte not in self.next[at]:
                        at, popped = self.fail[at], popped + self.popped[at]
                    if at >= 0:
                        self.fail[state], self.popped[state] = self.next[at][byte], popped
                below.extend((state, b, to) for b, to in self.next[state].items())
            level = below
        #: Pieces still to pop when the word ends in a state, -1 if what is left can't be cut.
        self.rest = [-1] * n
        self.rest[0] = self.rest[1] = 0
        for state in range(n):
            path, at = [], state
            while at >= 0 and self.rest[at] < 0 and at not in (0, 1):
                path.append(at)
                at = self.fail[at]
            for x in reversed(path):
                if at >= 0 and self.rest[at] >= 0:
                    self.rest[x] = self.rest[at] + self.popped[x]
                at = x

    def count(self, word: bytes) -> int:
        state, pieces = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while (to := step[state].get(byte)) is None:
                pieces += popped[state]
                state = fail[state]
                if state < 0:
                    return UNKNOWN_PIECES
            state = to
        return pieces + self.rest[state] if self.rest[state] >= 0 else UNKNOWN_PIECES


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and inner pieces of a byte-level vocabulary: initial ones are written with a leading space, which is taken off."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = [bytes(alphabet[c] for c in piece) for piece in vocabulary if all(c in alphabet for c in piece)]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], pieces


@lru_cache(2)
def automaton(path: str) -> LongestMatch:
    initial, inner = load_vocabulary(path)
    return LongestMatch([*initial, *(p for p in inner if len(p) == 1)], inner)  # any first byte may stand alone


class _Counts(dict):
    """Counts by word, found when first asked for."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self.matcher.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= KEPT_CHARS:
            self[word] = n
        return n


@lru_cache(2)
def _counts(path: str) -> _Counts:
    return _Counts(automaton(path))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_pieces, longest_word (pieces of the word with most).

    Words are the maximal runs of characters other than white space [\\x20\\x09-\\x0D] of the whole text. A null or empty
    text has zeros. Repeated rows are counted each. An empty table gives no rows. Extra columns are ignored. vocabulary:
    path of a byte-level vocabulary file that every executor can read.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_pieces", "longest_word"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(vocabulary).__getitem__
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = _split(text.as_py() or "")
                counts = list(map(known, words))
                out.append((len(words), sum(counts), max(counts, default=0)))
            table = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, k]) for k in range(3))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _split(text: str) -> list[str]:
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in SPACES[1:]:  # str.split() without an argument also splits at characters that are no white space here
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def op4_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
