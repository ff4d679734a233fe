"""Maximal periodic runs of words.

For each period p the places that are multiples of p form a grid; a run of three periods covers a grid place x from which the
words agree with those p further on. How far they agree, forwards and backwards, is a longest common extension. It is
answered from the suffixes at the places of a difference cover alone: any two places reach such a pair after a few words,
which are compared one by one, and a sparse table over the common prefixes of the sorted cover suffixes gives the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import SPACES, read_documents, slices

MIN_WORDS, MIN_PERIODS = 24, 3
#: A difference cover: each number modulo CYCLE is a difference of two of COVER. Fixed values.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Grid places that are looked at together.
GRID = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def _first_sync() -> np.ndarray:
    """How many words from places i and j modulo CYCLE the first pair of cover places is."""
    inside = np.isin(np.arange(CYCLE), COVER)
    out = np.zeros((CYCLE, CYCLE), np.int64)
    for i in range(CYCLE):
        for j in range(CYCLE):
            out[i, j] = next(d for d in range(CYCLE) if inside[(i + d) % CYCLE] and inside[(j + d) % CYCLE])
    return out


SYNC = _first_sync()


class Extensions:
    """Longest common extensions of an array of word numbers (from 0)."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.words = np.concatenate([words, np.full(CYCLE, -1, words.dtype)])
        self.at = np.flatnonzero(np.isin(np.arange(n) % CYCLE, COVER))  # cover places in text order
        place = np.full(n + 1, -1, np.int64)
        place[self.at] = np.arange(len(self.at))
        levels = self._levels(place)
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[self.at[order]] = np.arange(len(order))
        self.table = [self._neighbours(self.at[order], place, levels)]
        step = 1
        while 2 * step <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _levels(self, place: np.ndarray) -> list[np.ndarray]:
        """Ranks of the cover suffixes by their first CYCLE * 2 ** k words, until all differ."""
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, CYCLE)[self.at].astype(np.int32))
        levels = [np.unique(windows.view(f"V{4 * CYCLE}").ravel(), return_inverse=True)[1].astype(np.int64)] if len(self.at) else [np.zeros(0, np.int64)]
        step = CYCLE
        while len(self.at) and levels[-1].max() + 1 < len(self.at):
            after = place[np.minimum(self.at + step, self.n)]
            second = np.where(after < 0, 0, levels[-1][after] + 1)
            levels.append(np.unique(levels[-1] * (len(self.at) + 1) + second, return_inverse=True)[1])
            step *= 2
        return levels

    def _neighbours(self, order: np.ndarray, place: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each cover suffix and the next one in order."""
        x, y = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            px, py = place[np.minimum(x, self.n)], place[np.minimum(y, self.n)]
            same = (px >= 0) & (py >= 0) & (levels[k][px] == levels[k][py])
            x[same] += CYCLE << k
            y[same] += CYCLE << k
        return x - order[:-1] + self._by_words(x, y, np.full(len(x), CYCLE))

    def _by_words(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from x and y, at most so many each, compared one by one."""
        out, left = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        for k in range(int(most.max()) if len(most) else 0):
            a, b = x[left] + k, y[left] + k
            left = left[(np.maximum(a, b) < self.n) & (self.words[np.minimum(a, self.n)] == self.words[np.minimum(b, self.n)])]
            out[left] = k + 1
            left = left[most[left] > k + 1]
            if not len(left):
                break
        return out

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words from x and from y on, x != y; none from a place outside."""
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < self.n)
        most = np.where(inside, SYNC[x % CYCLE, y % CYCLE], 0)
        out = self._by_words(x, y, most)
        go = np.flatnonzero(inside & (out == most) & (np.maximum(x, y) + most < self.n))
        if len(go):
            a, b = self.rank[x[go] + most[go]], self.rank[y[go] + most[go]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                out[go[own]] += np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return out


def _candidates(words: np.ndarray, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places and periods at which a run of min_periods (2 or more) may be: some words that the run would repeat are equal."""
    n, out = len(words), []
    sizes = (n - 1) // np.arange(1, n // min_periods + 1) - (min_periods > 2)  # grid places x of period p with x + p < n, or x + 2 * p < n
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + GRID, side="right")))
        p = np.repeat(np.arange(first + 1, last + 1), sizes[first:last])
        x = (np.arange(len(p)) - np.repeat(ends[first:last] - sizes[first:last] - before, sizes[first:last])) * p
        for shift in ((lambda p: 0), (lambda p: 1), (lambda p: p // 2)) if min_periods > 2 else ((lambda p: 0),):
            at = x + shift(p)
            good = words[at] == words[np.minimum(at + p, n - 1)]
            x, p = x[good], p[good]
        out.append((x, p))
        first = last
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of the maximal runs of an array of word numbers, by start, then period.

    A run is found under multiples of its smallest period as well; of equal stretches the smallest period stays.
    """
    none = np.zeros((0, 3), np.int64)
    if len(words) < max(min_words, min_periods):
        return none
    x, p = _candidates(words, min_periods)
    if not len(x):
        return none
    forward, backward, found = Extensions(words), Extensions(words[::-1]), []
    n = len(words)
    for k in range(0, len(x), GRID):
        a, q = x[k : k + GRID], p[k : k + GRID]
        ahead = forward(a, a + q)
        start = a - backward(n - a, n - a - q)
        length = a + ahead + q - start
        good = length >= np.maximum(min_words, min_periods * q)
        found.append(np.unique(np.stack([start, length, q], 1)[good], axis=0))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])] if len(found) else none


def _rows(batches: Iterator[pa.RecordBatch], column: str, min_words: int, min_periods: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, column):
            runs, collapsed = [], []
            for text in part.column(column):
                words = (text.as_py() or "").encode().split()  # bytes split at \x20 and \x09-\x0D alone
                numbers: dict[bytes, int] = {}
                found = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), min_words, min_periods)
                if len(found):
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, found[:, 0] + found[:, 2], 1)
                    np.add.at(steps, found[:, 0] + found[:, 1], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                runs.append(found)
                collapsed.append(b" ".join(words).decode())
            whole = np.concatenate(runs)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(whole[:, k])) for k in range(3)], fields=list(_ARROW_RUN)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(collapsed, pa.string())], names=[*part.schema.names, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, column: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """docs with runs (array of start, length, period in words, by start, then period) and collapsed: the words that no run
    repeats, joined by one space.

    A run is a stretch of words with a smallest period q, min_words long and min_periods * q long, that cannot be
    extended. Words are parted by [\\x20\\x09-\\x0D]. A null or empty text has no runs and collapses to an empty text. Rows are handled
    alone, so that repeated rows stay and null ids do not matter; an empty table gives no rows. Columns of docs named runs or
    collapsed are replaced; all others are kept. One row is one task's whole work at most: a text is never cut.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.drop("runs", "collapsed")
    out = T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(RUN, containsNull=True)), T.StructField("collapsed", T.StringType())])
    return docs.mapInArrow(lambda b: _rows(b, column, min_words, min_periods), out)


def with_repetition(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the ids (by crc32) its words from a place on repeat what stands there, joined by spaces."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(place, lambda i: F.get(words, i)), " ")

    once = F.transform(F.array(words), repeated)[0]  # the words are split once
    return F.when((h % 10 == 0) & (F.btrim(text, F.lit(SPACES)) != ""), once).otherwise(text)


def longest_run(runs: Column) -> Column:
    """The run of greatest length / period, of these the first; null if there is none."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op12_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", with_repetition(F.col("doc_id"), F.col("text")).alias("text"))).drop("text")
    best = longest_run(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
