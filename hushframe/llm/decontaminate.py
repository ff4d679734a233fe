"""Benchmark decontamination: rare word-pair seeds join passages to test items, Smith-Waterman alignment scores them.

Seeds are pairs of item words that stand next to each other or one word apart. An alignment that scores enough keeps a known
number of them, whatever its edits, so that an item's most frequent seeds can be left out by the pigeonhole principle and no
passage is missed. Where enough seeds of an item stand close together, the words around them are aligned to it locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import LOWER_TABLE, byte_class, gram_hashes, mix, read_documents, slices, span_hashes, text_bytes, word_bounds

#: Words from which an item is found by seeds; a shorter one only as a whole.
SEED_WORDS = 4
#: Alignment scores of an equal word, another word and a gap.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Score over the item's words from which a passage counts as a copy.
COPY = 0.5
#: Words of the items, each with two seeds, that are held in memory together; a larger benchmark is done in blocks of this size.
BLOCK_WORDS = 500_000

#: All ASCII but digits and letters.
SEPARATORS = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and all beyond ASCII; A-Z lower-cased) of all texts, and the text of each."""
    data, offsets = text_bytes(texts)
    data = LOWER_TABLE[data]
    starts, ends, owner = word_bounds(data, offsets, SEPARATORS)
    return span_hashes(data, starts, ends), owner


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word arrays, and the passage place where that alignment ends (exclusive)."""
    ramp = np.arange(len(item) + 1) * GAP
    row, best, end = np.zeros(len(item) + 1), 0.0, 0
    for k, word in enumerate(passage):
        step = np.maximum(row[1:] + GAP, row[:-1] + np.where(item == word, MATCH, MISMATCH))
        row = np.concatenate(([0.0], np.maximum(step, 0.0)))
        row = np.maximum.accumulate(row - ramp) + ramp  # gaps in the passage
        if (top := row.max()) > best:
            best, end = float(top), k + 1
    return best, end


def count_passages(passage: np.ndarray, item: np.ndarray, least: float) -> int:
    """Disjoint parts of passage that score least or more, from left to right; each ends where it scores best."""
    ramp = np.arange(len(item) + 1) * GAP
    found = k = end = 0
    row, best = np.zeros(len(item) + 1), 0.0
    while k < len(passage):
        step = np.maximum(row[1:] + GAP, row[:-1] + np.where(item == passage[k], MATCH, MISMATCH))
        row = np.concatenate(([0.0], np.maximum(step, 0.0)))
        row = np.maximum.accumulate(row - ramp) + ramp
        k += 1
        if (top := row.max()) > best:
            best, end = float(top), k
        if best >= least and (top <= 2 * best - len(item) or k == len(passage)):  # the item's other words can't make up for the fall
            found, k, best, row = found + 1, end, 0.0, np.zeros(len(item) + 1)
    return found


def pair_hashes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each two words of one text that are one or two places apart, and the place of the first."""
    pairs = []
    for apart in (1, 2):
        at = np.flatnonzero(owner[:-apart] == owner[apart:])
        pairs.append((mix(words[at] * np.uint64(0xD6E8FEB86659FD93) + words[at + apart]), at))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


class Seeds:
    """Items of one block and an index from seed hash to (item, place in the item).

    Two matches that follow each other in an alignment with one edit between them at most are a seed: their words are one or
    two places apart on both sides. A score of copy a word leaves 2 * matches - 2 * copy * words edits, so copy * words - 1
    seeds of different places at least, spread over (3 - 2 * copy) * words words of the document.
    """

    def __init__(self, items: list[tuple[object, str]], copy: float = COPY):
        self.names = [k for k, _ in items]
        words, owner = lower_words(pa.array([t for _, t in items], pa.string()))
        edges = np.searchsorted(owner, np.arange(len(items) + 1))
        self.words = [words[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.size = np.diff(edges)
        self.span = np.ceil((3 - 2 * copy) * self.size).astype(np.int64) + 1
        self.sure = np.maximum(np.ceil(copy * self.size - 1e-9).astype(np.int64) - 1, 1)
        #: Hits that make a candidate; half of those that are sure, so that frequent seeds can be dropped.
        self.need = (self.sure + 1) // 2
        grams, at = pair_hashes(words, owner)
        self.item = owner[at]
        self.place = at - edges[self.item]
        order = np.argsort(grams, kind="stable")
        order = order[self.size[self.item[order]] >= SEED_WORDS]
        self.grams, self.item, self.place = grams[order], self.item[order], self.place[order]
        #: (words, sorted hashes, items) of the items without seeds.
        self.short = []
        for n in range(1, SEED_WORDS):
            grams, at = gram_hashes(words, owner, n)
            whole = np.flatnonzero(self.size[owner[at]] == n)
            whole = whole[np.argsort(grams[whole], kind="stable")]
            if len(whole):
                self.short.append((n, grams[whole], owner[at[whole]]))

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Drop, for each item, the seeds of its most frequent places, as many as leave need of the sure ones in any passage."""
        often = np.array([counts.get(int(g), 0) for g in self.grams.view(np.int64)], np.int64)
        first = np.cumsum(self.size) - self.size
        places = np.bincount(first[self.item] + self.place, often, self.size.sum()) if len(often) else np.zeros(self.size.sum())
        owner = np.repeat(np.arange(len(self.size)), self.size)
        last = np.zeros(len(owner), bool)
        last[(first + self.size - 1)[self.size > 0]] = True  # no seed begins at an item's last word
        order = np.lexsort((places, last, owner))
        rank = np.empty(len(owner), np.int64)
        rank[order] = np.arange(len(owner)) - first[owner[order]]
        rare = (rank < (self.size - 1 - self.sure + self.need)[owner])[first[self.item] + self.place]
        self.grams, self.item, self.place = self.grams[rare], self.item[rare], self.place[rare]

    def table(self) -> np.ndarray:
        """A bit for each value of a hash's low 20 bits, set if a seed has it."""
        out = np.zeros(1 << 20, bool)
        out[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def hits(self, grams: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Places in grams of the hashes that are seeds."""
        near = np.flatnonzero(table[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.grams, grams[near])
        return near[self.grams[np.minimum(k, len(self.grams) - 1)] == grams[near]] if len(self.grams) else near[:0]


def _count(batches: Iterator[pa.RecordBatch], seeds: Seeds) -> Iterator[pa.RecordBatch]:
    table = seeds.table()
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for part in slices(batch):
            grams, _ = pair_hashes(*lower_words(part.column("text")))
            found.append(grams[seeds.hits(grams, table)])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["gram", "n"])


LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_places", T.LongType()), T.StructField("last_word", T.LongType())])


def _leaks_of(part: pa.RecordBatch, seeds: Seeds, table: np.ndarray, copy: float) -> dict[tuple[int, int], list]:
    """[score, places, last word] of each row and item with a passage that scores copy or more."""
    words, owner = lower_words(part.column("text"))
    edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
    best: dict[tuple[int, int], list] = {}
    for n, known, items in seeds.short:
        grams, at = gram_hashes(words, owner, n)
        low, high = np.searchsorted(known, grams), np.searchsorted(known, grams, side="right")
        for k in np.flatnonzero(low < high):
            for i in items[low[k] : high[k]].tolist():
                d = int(owner[at[k]])
                best.setdefault((d, i), [1.0, 0, int(at[k] + n - edges[d])])[1] += 1
    grams, at = pair_hashes(words, owner)
    hit = seeds.hits(grams, table)
    low, high = np.searchsorted(seeds.grams, grams[hit]), np.searchsorted(seeds.grams, grams[hit], side="right")
    many = high - low
    at = np.repeat(at[hit], many)
    item = seeds.item[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    order = np.lexsort((at, item, owner[at]))
    at, item = at[order], item[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (item[1:] != item[:-1])
    at, item = at[new], item[new]
    doc, span = owner[at], seeds.span[item]
    to = np.arange(len(at)) + seeds.need[item] - 1
    end = np.minimum(to, len(at) - 1)
    dense = np.flatnonzero((to < len(at)) & (doc[end] == doc) & (item[end] == item) & (at[end] - at < span))
    end = end[dense]
    doc, item, lo, hi = doc[dense], item[dense], np.maximum(edges[doc[dense]], at[end] + 1 - span[dense]), np.minimum(edges[doc[dense] + 1], at[dense] + span[dense])
    new = np.ones(len(dense), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] >= hi[:-1])
    firsts = np.flatnonzero(new)
    for a, b in zip(firsts, np.append(firsts, len(dense))[1:], strict=True):
        d, i, passage = int(doc[a]), int(item[a]), words[lo[a] : hi[b - 1]]
        score, stop = align(passage, seeds.words[i])
        score /= seeds.size[i]
        if score >= copy:
            entry = best.setdefault((d, i), [0.0, 0, 0])
            entry[1] += count_passages(passage, seeds.words[i], copy * seeds.size[i])
            if score > entry[0]:
                entry[0], entry[2] = float(score), int(lo[a] + stop - edges[d])
    return best


def _verify(batches: Iterator[pa.RecordBatch], seeds: Seeds, copy: float) -> Iterator[pa.RecordBatch]:
    table = seeds.table()
    for batch in batches:
        out = []
        for part in slices(batch):
            ids = part.column("doc_id")
            out += [(ids[d].as_py(), seeds.names[i], round(s, 6), n, e) for (d, i), (s, n, e) in _leaks_of(part, seeds, table, copy).items()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=LEAKS.names)


def _clean(batches: Iterator[pa.RecordBatch], seeds: Seeds, copy: float) -> Iterator[pa.RecordBatch]:
    table = seeds.table()
    for batch in batches:
        for part in slices(batch):
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, _ in _leaks_of(part, seeds, table, copy)]] = False
            yield part.filter(pa.array(keep))


def seed_blocks(docs: DataFrame, benchmark: DataFrame, copy: float) -> Iterator[Broadcast]:
    """The seeds of the benchmark's items that are rare in docs, block by block."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // (5 * BLOCK_WORDS)))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        seeds = Seeds([(r.item_id, r.text) for r in block.collect()], copy)  # BLOCK_WORDS words
        shared = spark.sparkContext.broadcast(seeds)
        counts = docs.select("text").mapInArrow(lambda b, s=shared: _count(b, s.value), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        seeds.keep_rare({r.gram: r.n for r in counts.collect()})  # a row for each seed of the block
        yield spark.sparkContext.broadcast(seeds)


def find_leaks(docs: DataFrame, benchmark: DataFrame, copy: float = COPY) -> DataFrame:
    """(doc_id, item_id, score, n_places, last_word) of each document and item with a passage that scores copy or more.

    score: the best passage's alignment score over the item's number of words, 1 for a verbatim copy. n_places: passages
    of the item in the document; last_word: where the best ends, in words. Null texts are empty; items of fewer than
    SEED_WORDS words are found where they stand whole, items without words never. Repeated rows of docs give repeated rows, those of
    benchmark count once. Items of one text are each found. Empty tables give no rows. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = [docs.mapInArrow(lambda b, s=seeds: _verify(b, s.value, copy), LEAKS) for seeds in seed_blocks(docs, benchmark, copy)]
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, copy: float = COPY) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage which find_leaks would report."""
    for seeds in list(seed_blocks(docs, benchmark, copy)):
        docs = docs.mapInArrow(lambda b, s=seeds: _clean(b, s.value, copy), docs.schema)
    return docs


def op9_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
