"""Order-preserving packing by dynamic programming.

Documents are laid end to end in doc_id order as token ids. Windows of at most `limit` tokens are cut at document or
sentence ends so that padding plus truncation penalties are least. As padding is a difference of positions, the best
start of a window is a sliding-window minimum, kept in a monotone queue: the program is linear.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hushframe.llm.common import clean_text, read_documents, slices
from hushframe.llm.token_counts import byte_alphabet

#: Penalties, in padding tokens: a window that ends inside a document at a sentence's end, or inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 64
#: A sentence longer than this may be cut at multiples of it.
LONG_SENTENCE = 128
#: Tokens that are packed at a time; the last window is carried over to the next ones.
CHUNK_TOKENS = 1 << 24
END_ID = 1

#: Fixed value: how byte-level files part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose kinds (letter, number, sign) all versions of Unicode agree: Latin, Greek, Cyrillic, common signs, kana and Han.
_USUAL = "!-~¡-ɏΑ-ΡΣ-ώЀ-ѿ‐-‧‰-⁞€™ぁ-ゖァ-ヺ一-龥"
_RARE = re.compile(rf"[^{_USUAL}\t\n\r ]")
#: Characters of a plain text's longest word or white space.
LONGEST_RUN = 400
_LONG_SPACE = re.compile(rf"[\t\n\r ]{{{LONGEST_RUN + 1}}}")


class Encoder:
    """Ids of texts by a byte-level tokenizers file.

    Plain texts are encoded by the file's vocabulary as ranks, which gives the same ids four times faster; texts with special
    tokens, rare characters or very long words or white space by the file's own tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        pieces, alphabet = self.tokenizer.get_vocab(with_added_tokens=True), byte_alphabet()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        ranks = {bytes(alphabet[c] for c in piece): k for piece, k in pieces.items() if k not in added}
        for raw, k in ranks.items():
            self.ends[k] = raw.rstrip(b"\"') ")[-1:] in (b".", b"!", b"?", b"\n")
        self.quick = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        if any(x in text for x in self.special) or _RARE.search(text):
            return False
        if len(text) <= LONGEST_RUN:
            return True
        words = list(map(len, text.split()))
        spare = len(text) - sum(words) - len(words)  # white space beyond one character a word
        return max(words, default=0) <= LONGEST_RUN and (spare < LONGEST_RUN - 1 or not _LONG_SPACE.search(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = [k for k, t in enumerate(texts) if not self.plain(t)]
        whole = dict(zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False), strict=True))
        return [np.array(whole[k].ids, np.uint32) if k in whole else self.quick.encode_to_numpy(t, disallowed_special=()) for k, t in enumerate(texts)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_places(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where n tokens may be cut, ascending from 0 to n, and the penalty of each."""
    kind = np.zeros(n + 1, np.uint8)
    kind[sentence_ends] = 1
    kind[doc_ends] = 2
    kind[[0, n]] = 2
    natural = np.flatnonzero(kind)
    many = (np.diff(natural) - 1) // LONG_SENTENCE  # cuts inside each stretch
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    kind[np.repeat(natural[:-1], many) + nth * LONG_SENTENCE] = 3
    places = np.flatnonzero(kind)
    return places, np.array([0, SENTENCE_PENALTY, 0, INSIDE_PENALTY])[kind[places]]


def best_windows(places: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Cuts, first and last place included, of least total padding and penalty; no two are more than limit apart.

    Needs neighbouring places at most limit apart. On a tie the longest window wins.
    """
    at, fine = places.tolist(), penalty.tolist()
    if len(at) < 2:
        return at[:1]
    back = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # ascending by cost of being here plus position
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0][1]] > limit:
            queue.popleft()
        low, i = queue[0]
        back[j] = i
        worth = low + limit + fine[j]  # the padding's two positions cancel: cost(j) + at[j] = low + limit + penalty
        while queue and queue[-1][0] > worth:
            queue.pop()
        queue.append((worth, j))
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


class _Packer:
    """Packs one partition's documents, given in order, in chunks."""

    def __init__(self, limit: int, ends: np.ndarray, first_sequence: int):
        self.limit, self.ends, self.sequence = limit, ends, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # doc_id, tokens here, tokens packed before
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.held += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch:
        """Pieces of all windows, but for the last one if more documents follow."""
        ids = np.concatenate(self.ids)
        bounds = np.cumsum([0] + [n for _, n, _ in self.docs])
        sentences = np.flatnonzero(self.ends[ids]) + 1
        cuts = np.array(best_windows(*cut_places(len(ids), bounds[1:], sentences), self.limit))
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]
        stop = cuts[-1]
        edges = np.union1d(cuts, bounds[bounds <= stop])
        starts, lengths = edges[:-1], np.diff(edges)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        window = np.searchsorted(cuts, starts, side="right") - 1
        before = np.array([b for _, _, b in self.docs])
        tokens = np.array([n + b for _, n, b in self.docs])
        raw = memoryview(ids.astype("<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        names = [d for d, _, _ in self.docs]
        out = pa.RecordBatch.from_arrays([
            pa.array([names[k] for k in doc], pa.int64()), pa.array(starts - bounds[doc] + before[doc]), pa.array(lengths), pa.array(sums, pa.int64()),
            pa.array(tokens[doc]), pa.array(window + self.sequence), pa.array(starts - cuts[window]),
        ], names=PIECES.names)
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(bounds, stop, side="right")) - 1
        rest = [(d, n, b) for d, n, b in self.docs[k:]]
        if rest and stop > bounds[k]:
            d, n, b = rest[0]
            rest[0] = (d, n - int(stop - bounds[k]), b + int(stop - bounds[k]))
        self.docs, self.ids, self.held = rest, [ids[stop:]], len(ids) - int(stop)
        return out


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most limit tokens.

    A document is its text's ids and END_ID; a null or empty text has END_ID alone. Documents follow each other by doc_id
    (null first) and text; repeated rows are packed each. Each range of doc_id is packed by itself, which leaves one short
    sequence a range. In a range, padding and penalties are least for each CHUNK_TOKENS tokens, whose last window is left
    to the next ones: at most one window in CHUNK_TOKENS / limit is not the best. sequence_id is the range's number times 2 ** 32 plus
    the window's. An empty table gives no rows. Extra columns are ignored. tokenizer: path of a byte-level tokenizers file
    that every executor can read; its special tokens in a text are special tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(tokenizer)
        packer = _Packer(limit, encoding.ends, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoding.encode(texts), strict=True):
                    packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                    if packer.held >= CHUNK_TOKENS:
                        yield packer.pack(last=False)
        if packer.held:
            yield packer.pack(last=True)

    rows = docs.select("doc_id", clean_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie").mapInArrow(run, PIECES)


def op6_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
