"""Line deduplication through a sharded minimal perfect hash.

Distinct keys of repeated lines are dealt to shards; each shard holds a minimal perfect hash with compact arrays of
fingerprints, counts and last documents. Line references probe the arrays of their shard, in parts of bounded size; no line
text is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import SPACES, clean_text, cut, fresh, mix, read_documents

#: Distinct keys in one shard's arrays.
SHARD_KEYS = 50_000
#: References that probe one copy of a shard's arrays; a shard has as many copies as its references need, so that neither a
#: large corpus nor one very common line makes a large group.
PART_ROWS = 200_000

_STRIP = SPACES.encode()
REFERENCES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])


def line_key(line: str) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACES).encode().lower()


def _references(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key").to_numpy()
        rows, numbers, digests = [], [], []
        for k, text in enumerate(batch.column("text")):
            for no, line in enumerate((text.as_py() or "").split("\n")):
                if len(line) >= min_chars and len(line := line.strip(SPACES)) >= min_chars:
                    rows.append(k)
                    numbers.append(no)
                    digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
        at = np.array(rows, np.int64)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys[at]), pa.array(numbers, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "text_key", "line_no", "lo", "hi"])


def _seed(level: int) -> np.uint64:
    return np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, and each key's number from 0.

    At each level a key goes to the bit that its hash names, if no other key left at this level does.
    """
    levels, left, place, number = [], np.arange(len(keys)), np.zeros(len(keys), np.int64), 0
    while len(left):
        size = max(64, 2 * len(left))
        spot = (mix(keys[left].view(np.uint64) + _seed(len(levels))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        fits = alone[spot]
        rank = np.cumsum(alone) - 1
        place[left[fits]] = rank[spot[fits]] + number
        number += int(alone.sum())
        levels.append(alone)
        left = left[~fits]
    return levels, place


def probe_hash(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key; any number or -1 for a key that the hash was not built on."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        spot = (mix(keys[left].view(np.uint64) + _seed(k)) % np.uint64(len(bits))).astype(np.int64)
        found = bits[spot]
        rank = np.cumsum(bits) - 1
        out[left[found]] = rank[spot[found]] + before
        before += int(bits.sum())
        left = left[~found]
    return out


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("lo")  # the second of two keys with one low half would not be separable; 2 ** -64 a pair
    levels, place = build_hash(pdf["lo"].to_numpy())
    order = np.argsort(place)
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])],
        "sizes": [np.array([len(x) for x in levels], np.int64).tobytes()],
        "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
        "fingerprints": [pdf["hi"].to_numpy()[order].tobytes()],
        "counts": [pdf["n_docs"].to_numpy()[order].tobytes()],
        "last": [pdf["last_doc"].to_numpy()[order].tobytes()],
    })


ARRAYS = "shard int, sizes binary, bits binary, fingerprints binary, counts binary, last binary"


def _levels(sizes: bytes, bits: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for n in np.frombuffer(sizes, np.int64):
        stop = at + (n + 7) // 8
        out.append(np.unpackbits(np.frombuffer(bits[at:stop], np.uint8), count=n).astype(bool))
        at = stop
    return out


def _probe(references: pa.Table, arrays: pa.Table, min_docs: int) -> pa.Table:
    """The references whose line goes. Ids stay 64-bit integers, so that none is rounded beside a null."""
    out = references.select(["doc_id", "text_key", "line_no"])
    if not references.num_rows or not arrays.num_rows:
        return out.slice(0, 0)
    row = arrays.slice(0, 1).to_pylist()[0]
    fingerprints, counts, last = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "counts", "last"))
    place = probe_hash(_levels(row["sizes"], row["bits"]), references.column("lo").to_numpy())
    at = np.maximum(place, 0)
    known = (place >= 0) & (fingerprints[at] == references.column("hi").to_numpy()) & (counts[at] >= min_docs)
    ids = references.column("doc_id")
    kept = (ids.fill_null(0).to_numpy() == last[at]) & ids.is_valid().to_numpy()
    return out.filter(pa.array(known & ~kept))


def _rewrite(batches: Iterator[pa.RecordBatch], gone_lines: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, gone in zip(batch.column("text"), batch.column(gone_lines), strict=True):
            text, gone = text.as_py(), gone.as_py()
            lines.append(text.count("\n") + 1 if text else 1)
            if gone:
                out = set(gone)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)
                dropped.append(len(out))
            else:
                dropped.append(0)
            kept.append(text)
        names = [n for n in batch.schema.names if n != gone_lines]
        columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])


def frequent_arrays(references: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """ARRAYS of the keys that stand in min_docs documents, a row a shard, and the number of shards."""
    frequent = references.groupBy("lo", "hi").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs)
    frequent = cut(frequent)
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    return frequent.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInPandas(_shard, ARRAYS), shards


def _shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("lo", "hi"), F.lit(shards)).cast("int")


def repeated_lines(references: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, text_key, line_no) of the references whose line goes."""
    arrays, shards = frequent_arrays(references, min_docs)
    probes = references.withColumn("shard", _shard_of(shards))
    load = cut(probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")))  # a row a shard
    arrays = arrays.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probes = probes.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", "line_no"), F.col("parts")).cast("int")).drop("parts")
    return probes.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(lambda a, b: _probe(a, b, min_docs), "doc_id long, text_key long, line_no int")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines (before) and n_dropped.

    A line whose key has min_chars code points and stands in min_docs documents (distinct doc_id) stays only in the
    largest doc_id that holds it, there at every place. A null text stays null and counts as one empty line; so does an
    empty one. A row without doc_id counts as no document and keeps no repeated line. Repeated rows are treated alike. An
    empty table gives no rows. Columns of docs named n_lines or n_dropped are replaced; all others are kept.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names, key = fresh(docs, "gone_id", "gone_key", "row_key", "gone_lines"), F.xxhash64(clean_text())
    gone_id, gone_key, row_key, gone_lines = names.values()
    references = cut(docs.select("doc_id", key.alias("text_key"), clean_text().alias("text")).mapInArrow(lambda b: _references(b, min_chars), REFERENCES))
    gone = repeated_lines(references, min_docs)
    gone = gone.groupBy(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).agg(F.collect_set("line_no").alias(gone_lines))
    joined = docs.withColumn(row_key, key).join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(row_key) == F.col(gone_key)), "left").drop(gone_id, gone_key, row_key)
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(lambda b: _rewrite(b, gone_lines), out)


def op10_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(clean_text(), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents
), keyed AS (
  SELECT doc_id, line, line_no, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.line_no, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
