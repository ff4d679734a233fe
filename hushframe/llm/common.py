"""Lineage cuts, Arrow batches and vectorised byte, word and n-gram hashing shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time; a longer text is handled alone and whole.
SLICE_BYTES = 2 << 20

#: Rows of an Arrow batch that carries texts.
ROWS_PER_BATCH = 1000

#: [\x20\x09-\x0D]
SPACES = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """df written once to the cluster's shared checkpoint folder, so that a lost executor costs no upstream work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named in spark.checkpoint.dir holds; one of our own is set only where there is none and Spark is one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents; Arrow batches of whole texts are kept short, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for working columns that no column of df has, compared without regard to case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in wanted:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def clean_text(name: str = "text"):
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows whose texts have about limit bytes together."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values end to end, and each value's offset with the total last; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """A lookup table that is true at the given byte values."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


SPACE_TABLE = byte_class(SPACES.encode())
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value number of each maximal run of bytes that are no separators, within each value."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    gap = separators[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; tables up to a slice's size are kept by the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts])


def gram_hashes(words: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words of one value, and the run's first word's place in words."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _GRAM + words[k : k + m]
    at = np.flatnonzero(values[:m] == values[n - 1 :])
    return mix(out[at]), at


def first_places(values: np.ndarray, n: int) -> np.ndarray:
    """Place of each value's first word in an array of words sorted by value; n + 1 entries."""
    return np.searchsorted(values, np.arange(n + 1))
