"""Removal of repeated byte strings through a logarithmic family of suffix arrays.

Distinct texts are dealt to batches. A string of MATCH bytes always holds the smallest hash of its HEAD-byte strings at one
place, its anchor, which depends on the string alone. Batches first tell each other which anchors stand in several texts;
only strings at such anchors can repeat, and only their suffixes are indexed. Each batch gets a suffix array of them, in byte
order, cut by ranges of anchors. In each range the arrays enter a family of levels one after the other: a batch is
merge-scanned against the levels, neighbours whose longest common prefix reaches MATCH are one string, and levels of one
size merge. Suffixes that a smaller document holds leave the family and are the places to be removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import clean_text, mix, read_documents, text_bytes

#: Bytes of a match, and of the heads among which anchors are chosen.
MATCH, HEAD = 50, 16
#: Heads in a string of MATCH bytes, bytes of a string before its anchor at most, and bytes around an anchor that its strings reach.
WIDTH, LEAD, CONTEXT = MATCH - HEAD + 1, MATCH - HEAD, 2 * MATCH - HEAD
#: A string begins SIDE bytes or more before its anchor, or ends MATCH - SIDE + 1 or more after it.
SIDE = 16
#: Bytes of text in a batch and in the share of the corpus that one range of anchors holds; batches and ranges that there are at least.
BATCH_BYTES, RANGE_BYTES, PARTS = 8 << 20, 8 << 20, 128
#: An anchor with more different surroundings than this has no range of its own: each of its strings goes to a range by itself.
HOT = 50_000
#: Bytes whose anchors are sought at a time.
STEP_BYTES = 1 << 20

_B = 0xC6A4A7935BD1E995
_WORDS = -(-(CONTEXT + 2) // 8)
_WEIGHTS = mix(np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = np.uint64(0xFFFFFFFF)


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the HEAD bytes that begin at each place."""
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, _B
    while n < HEAD:
        h = h[:-n] * np.uint64(power & 0xFFFFFFFFFFFFFFFF) + h[n:]
        n, power = 2 * n, power * power & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest (upper half of a) value among the width values from each place on."""
    low, n = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64), 1
    while n < width:
        d = min(n, width - n)
        low = np.minimum(low[d:], low[:-d])
        n += d
    return (low & _PLACE).astype(np.int64)


ENTRY = np.dtype([("value", "<u8"), ("text", "<i4"), ("at", "<i4"), ("back", "u1"), ("front", "u1")])


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ENTRY rows of all texts: value (hash of the anchor and a byte for the bytes on either side), text, the anchor's place
    in it, and how far before the anchor its first and last string begin."""
    if len(data) < MATCH:
        return np.zeros(0, ENTRY)
    heads = head_hashes(data)
    inside = np.ones(len(data) - MATCH + 1, bool)  # strings that do not cross a text's end
    tails = (offsets[1:, None] - np.arange(1, MATCH)).ravel()
    inside[tails[(tails >= 0) & (tails < len(inside)) & (tails >= np.repeat(offsets[:-1], MATCH - 1))]] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return np.zeros(0, ENTRY)
    anchor = smallest_places(heads, WIDTH)[start]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(first[1:], len(start)) - 1
    at, begin, end = anchor[first], start[first], start[last]
    before = heads[np.maximum(at - SIDE, 0)]
    n = len(heads) - 1
    after = mix(heads[np.minimum(at + HEAD, n)] * np.uint64(3) + heads[np.minimum(at + MATCH - SIDE + 1 - HEAD, n)])
    out = np.zeros(len(first), ENTRY)
    out["value"] = (mix(heads[at]) & ~np.uint64(0xFFFF)) | (mix(before) & np.uint64(0xFF)) << np.uint64(8) | (after & np.uint64(0xFF))
    out["text"] = np.searchsorted(offsets, begin, side="right") - 1
    out["at"] = at - offsets[out["text"]]
    out["back"], out["front"] = at - begin, at - end
    return out


def shared_by_several(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether another owner has the same anchor with the same bytes on one side at least."""
    out = np.zeros(len(values), bool)
    for key in (values >> np.uint64(8), (values & ~np.uint64(0xFFFF)) | (values & np.uint64(0xFF))):
        order = np.argsort(key, kind="stable")
        k, o = key[order], owner[order]
        if len(k):
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
            out[order] |= np.repeat(several, np.diff(np.append(first, len(k))))
    return out


def range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Batch:
    """The distinct texts of a batch in the order of their keys, each with the smallest doc_id that holds it."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        self.k1, self.k2, self.low = k1[first], k2[first], table.column("doc_id").to_numpy()[first]
        texts = table.column("text").take(pa.array(self._held(table.column("text"), first, len(new)))).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.data, self.offsets = text_bytes(texts)

    @staticmethod
    def _held(texts: pa.ChunkedArray, first: np.ndarray, n: int) -> np.ndarray:
        """For each key the first of its rows that has the text."""
        full = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.arange(n), n)
        return np.minimum.reduceat(full, first) if n else first

    def entries(self) -> np.ndarray:
        """The anchors of all texts."""
        out, k = [np.zeros(0, ENTRY)], 0
        while k < len(self.low):
            stop = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + STEP_BYTES, side="right")) - 1)
            found = anchors(self.data[self.offsets[k] : self.offsets[stop]], self.offsets[k : stop + 1] - self.offsets[k])
            found["text"] += k
            out.append(found)
            k = stop
        return np.concatenate(out)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each as its bytes' planes, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), [], 0
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).ravel())
        at += n * wide
    return out


#: Anchors of a batch that fall in a range (values ascending, as differences, and how many different surroundings each has).
HEADS = "part int, batch int, n int, data binary"
#: Bits for each of them: whether another batch has it, and whether it is HOT.
MARKS = "batch int, part int, shared binary, hot binary"
#: kind 0: suffixes of a batch that fall in a range; kind 1: places of the batch that go.
RUNS = "part int, kind int, batch int, n int, data binary"
PLACES = "batch int, n int, data binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _heads(key: tuple, table: pa.Table, ranges: int) -> pa.Table:
    values, counts = np.unique(Batch(table).entries()["value"], return_counts=True)
    edges = np.searchsorted(range_of(values, ranges), np.arange(ranges + 1))
    rows = []
    for part in np.flatnonzero(np.diff(edges)).tolist():
        v, c = values[edges[part] : edges[part + 1]], counts[edges[part] : edges[part + 1]]
        rows.append((part, key[0].as_py(), len(v), _pack(np.diff(v, prepend=np.uint64(0)), np.minimum(c, 255).astype(np.uint8))))
    return _table(rows, HEADS)


def _marks(key: tuple, table: pa.Table, hot: int) -> pa.Table:
    runs = [_unpack(blob, n, "<u8", "u1") for n, blob in zip(table.column("n").to_pylist(), table.column("data").to_pylist(), strict=True)]
    values, counts = np.concatenate([np.cumsum(v) for v, _ in runs]), np.concatenate([c for _, c in runs])
    batches, sizes = table.column("batch").to_numpy(), [len(v) for v, _ in runs]
    shared = shared_by_several(values, np.repeat(batches, sizes))
    _, head = np.unique(values >> np.uint64(16), return_inverse=True)
    often = (np.bincount(head, counts) > hot)[head]
    edges = np.cumsum([0, *sizes])
    return _table([(int(b), key[0].as_py(), np.packbits(shared[x:y]).tobytes(), np.packbits(often[x:y]).tobytes()) for b, x, y in zip(batches, edges[:-1], edges[1:], strict=True)], MARKS)


def _contexts(batch: Batch, rows: np.ndarray) -> np.ndarray:
    """back, front, and the CONTEXT bytes around each anchor, of which those that no string of it holds are 255, padded to whole words."""
    out = np.full((len(rows), _WORDS * 8), 255, np.uint8)
    out[:, 0], out[:, 1] = rows["back"], rows["front"]
    reach = np.arange(CONTEXT)
    for k in range(0, len(rows), 1 << 15):
        some = rows[k : k + (1 << 15)]
        place = (batch.offsets[some["text"]] + some["at"])[:, None] + (reach - LEAD)
        held = (reach >= LEAD - some["back"].astype(np.int64)[:, None]) & (reach < LEAD - some["front"].astype(np.int64)[:, None] + MATCH)
        out[k : k + len(some), 2 : 2 + CONTEXT] = np.where(held, batch.data[np.clip(place, 0, len(batch.data) - 1)], 255)
    return out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    return mix((mix(rows.view(np.uint64).reshape(len(rows), _WORDS)) * _WEIGHTS).sum(axis=1, dtype=np.uint64)) if len(rows) else np.zeros(0, np.uint64)


def _smaller_elsewhere(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a row with the same key has a smaller document."""
    order = np.argsort(keys, kind="stable")
    k, d, out = keys[order], docs[order], np.zeros(len(keys), bool)
    if len(k):
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        out[order] = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(k))))
    return out


def _suffix_runs(key: tuple, texts: pa.Table, marks: pa.Table, ranges: int) -> pa.Table:
    """The suffixes of a batch's shared anchors by range, and the strings that a smaller document of the batch holds."""
    if not texts.num_rows:
        return _table([], RUNS)
    batch, number = Batch(texts), key[0].as_py()
    rows = batch.entries()
    values, inverse = np.unique(rows["value"], return_inverse=True)
    edges = np.searchsorted(range_of(values, ranges), np.arange(ranges + 1))
    shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for part, a, b in zip(*(marks.column(c).to_pylist() for c in ("part", "shared", "hot")), strict=True):
        n = edges[part + 1] - edges[part]
        shared[edges[part] : edges[part + 1]] = np.unpackbits(np.frombuffer(a, np.uint8), count=n)
        hot[edges[part] : edges[part + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
    wanted = shared_by_several(rows["value"], rows["text"]) | shared[inverse]
    rows, hot = rows[wanted], hot[inverse[wanted]]
    many = np.where(hot, rows["back"].astype(np.int64) - rows["front"] + 1, 1)  # a hot anchor's strings part
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rows, hot = np.repeat(rows, many), np.repeat(hot, many)
    rows["back"][hot] -= nth[hot].astype(np.uint8)
    rows["front"][hot] = rows["back"][hot]
    around = _contexts(batch, rows)
    same = _row_hashes(around)
    docs = batch.low[rows["text"]]
    gone = _smaller_elsewhere(same, docs)
    part = np.where(hot, range_of(same, ranges), range_of(rows["value"], ranges))
    out = []
    if gone.any():
        spans = joined(np.full(int(gone.sum()), number), rows["text"][gone], rows["at"][gone] - rows["back"][gone].astype(np.int32), rows["at"][gone] - rows["front"][gone].astype(np.int32))
        out.append((number % ranges, 1, number, len(spans[0]), _pack(*spans[1:])))
    left = np.flatnonzero(~gone)
    left = left[np.lexsort((same[left], part[left]))]
    cuts = np.searchsorted(part[left], np.arange(ranges + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        at = left[cuts[p] : cuts[p + 1]]
        blob = zstandard.ZstdCompressor(level=3).compress(around[at, : 2 + CONTEXT].tobytes())
        small = _pack(docs[at], rows["text"][at], rows["at"][at])
        out.append((p, 0, number, len(at), len(small).to_bytes(8, "little") + small + blob))
    return _table(out, RUNS)


def joined(batch: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Spans of string places (batch, text, first, last) in order, with touching ones joined."""
    order = np.lexsort((first, text, batch))
    batch, text, first, last = (x[order].astype(np.int32) for x in (batch, text, first, last))
    if not len(batch):
        return [batch, text, first, last]
    whose = np.concatenate(([0], np.cumsum((batch[1:] != batch[:-1]) | (text[1:] != text[:-1])))) << np.int64(32)
    reach = np.maximum.accumulate(whose + last)  # spans of the texts before end lower
    new = np.concatenate(([True], whose[1:] + first[1:] > reach[:-1] + 1))
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(new)) - 1
    return [batch[at], text[at], first[at], (reach[stop] - whose[stop]).astype(np.int32)]


SUFFIX = np.dtype([("string", f"S{MATCH}"), ("doc", "<i8"), ("batch", "<i4"), ("text", "<i4"), ("place", "<i4")])


def suffix_array(around: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """SUFFIX rows of all strings at the anchors, in byte order; rows has batch, doc, text and at of each anchor."""
    back, front = around[:, 0].astype(np.int64), around[:, 1].astype(np.int64)
    many = back - front + 1
    node = np.repeat(np.arange(len(many)), many)
    before = back[node] - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    out = np.zeros(len(node), SUFFIX)
    if len(node):
        strings = np.lib.stride_tricks.sliding_window_view(around[:, 2 : 2 + CONTEXT], MATCH, axis=1)[node, LEAD - before]
        out["string"] = np.ascontiguousarray(strings).view(f"S{MATCH}").ravel()
    for c in ("doc", "batch", "text"):
        out[c] = rows[c][node]
    out["place"] = rows["at"][node] - before
    return out[np.argsort(out["string"], kind="stable")]


def merge(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One suffix array, and the suffixes whose first MATCH bytes a smaller document has.

    The arrays are in byte order, so that equal strings are neighbours; neighbours with a longest common prefix of MATCH
    bytes or more are one string. Of each string the suffixes of the smallest document stay.
    """
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows["string"], kind="stable")]  # merges the ordered parts
    if not len(rows):
        return rows, rows
    prefix = rows["string"]  # of full width, so that equality is that of all MATCH bytes
    first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    low = np.repeat(np.minimum.reduceat(rows["doc"], first), np.diff(np.append(first, len(rows))))
    later = rows["doc"] > low
    return rows[~later], rows[later]


class Levels:
    """Suffix arrays by size: a new one is merged with the smallest level as long as that is no larger than twice itself."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> Iterator[np.ndarray]:
        """Enter a batch's array; yields suffixes of strings that a smaller document holds."""
        run, later = merge([run])
        yield later
        while self.levels and len(self.levels[-1]) <= 2 * len(run):
            run, later = merge([self.levels.pop(), run])
            yield later
        self.levels.append(run)

    def close(self) -> Iterator[np.ndarray]:
        """Scan what is left of the levels against each other, the smallest first."""
        while len(self.levels) > 1:
            run, later = merge([self.levels.pop(), self.levels.pop()])
            yield later
            self.levels.append(run)


NODE = np.dtype([("doc", "<i8"), ("batch", "<i4"), ("text", "<i4"), ("at", "<i4")])


def _scan(key: tuple, table: pa.Table) -> pa.Table:
    """Pass the batches of one range through a family of levels; the places that go, by batch."""
    nodes, arounds, out = [np.zeros(0, NODE)], [np.zeros((0, 2 + CONTEXT), np.uint8)], []
    for kind, batch, n, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "batch", "n", "data")), strict=True):
        if kind:
            out.append((batch, n, blob))
            continue
        size = int.from_bytes(blob[:8], "little")
        rows = np.zeros(n, NODE)
        rows["batch"] = batch
        rows["doc"], rows["text"], rows["at"] = _unpack(blob[8 : 8 + size], n, "<i8", "<i4", "<i4")
        nodes.append(rows)
        arounds.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + size :]), np.uint8).reshape(n, 2 + CONTEXT))
    rows, around = np.concatenate(nodes), np.concatenate(arounds)
    padded = np.full((len(rows), _WORDS * 8), 255, np.uint8)
    padded[:, : 2 + CONTEXT] = around
    equal = _smaller_elsewhere(_row_hashes(padded), rows["doc"])  # all strings of the anchor are those of a smaller document
    back, front = around[:, 0].astype(np.int32), around[:, 1].astype(np.int32)
    gone = [(rows["batch"][equal], rows["text"][equal], rows["at"][equal] - back[equal], rows["at"][equal] - front[equal])]
    rows, around = rows[~equal], around[~equal]
    order = np.argsort(rows["batch"], kind="stable")
    levels, cuts = Levels(), np.flatnonzero(np.concatenate(([True], np.diff(rows["batch"][order]) != 0, [True]))) if len(rows) else [0]

    def note(later: np.ndarray) -> None:
        if len(later):
            gone.append((later["batch"], later["text"], later["place"], later["place"]))

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for later in levels.add(suffix_array(around[order[a:b]], rows[order[a:b]])):
            note(later)
    for later in levels.close():
        note(later)
    spans = joined(*(np.concatenate(c) for c in zip(*gone, strict=True)))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(spans[0]) != 0, [True]))) if len(spans[0]) else [0]
    out += [(int(spans[0][a]), int(b - a), _pack(*(c[a:b] for c in spans[1:]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _table(out, PLACES)


RESULTS = "k1 long, k2 long, low long, removed long, spans long, whole string, left string, kept binary"


def _apply(texts: pa.Table, places: pa.Table, keep_bytes: bool) -> pa.Table:
    """What is left of each distinct text of a batch."""
    if not texts.num_rows:
        return _table([], RESULTS)
    batch = Batch(texts)
    parts = [_unpack(blob, n, "<i4", "<i4", "<i4") for n, blob in zip(places.column("n").to_pylist(), places.column("data").to_pylist(), strict=True)]
    change = np.zeros(len(batch.data) + 1, np.int32)
    if parts:
        text, first, last = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
        np.add.at(change, batch.offsets[text] + first, 1)
        np.add.at(change, batch.offsets[text] + last + MATCH, -1)
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    for k, (a, b) in enumerate(zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist(), strict=True)):
        raw, out = batch.data[a:b], gone[a:b]
        whole = hashlib.sha256(raw).hexdigest()
        if out.any():
            spans, left = int(out[0]) + int((out[1:] & ~out[:-1]).sum()), raw[~out].tobytes()
            rows.append((int(batch.k1[k]), int(batch.k2[k]), int(batch.low[k]), len(raw) - len(left), spans, whole, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
        else:
            rows.append((int(batch.k1[k]), int(batch.k2[k]), int(batch.low[k]), 0, 0, whole, whole, raw.tobytes() if keep_bytes else None))
    return _table(rows, RESULTS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a partition; its later rows only if their doc_id is smaller, and without the text."""
    low: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep, light = [], []
        for i, (doc, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), strict=True)):
            have = low.get((a, b))
            if have is None or doc < have:
                low[a, b] = doc
                keep.append(i)
                light.append(have is not None)
        some = batch.take(pa.array(keep, pa.int64()))
        text = pc.if_else(pa.array(light, pa.bool_()), pa.scalar(None, pa.string()), some.column("text"))
        yield pa.RecordBatch.from_arrays([some.column("batch"), some.column("k1"), some.column("k2"), some.column("doc_id"), text], names=["batch", "k1", "k2", "doc_id", "text"])


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null unless keep_bytes).

    Each byte covered by a string of MATCH bytes that also begins in a document with a smaller doc_id goes; strings are
    judged on the input. A null text is empty. A row without doc_id is compared to nothing and stays whole. Rows of one
    doc_id are judged each by its own text and never against each other; repeated rows are treated alike. An empty table
    gives no rows. Extra columns are ignored. Texts cross the network once; a text that many documents share is indexed once.
    """
    texts = docs.select("doc_id", clean_text().alias("text"))
    known = texts.where("doc_id is not null").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    total = known.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    batches, ranges, hot = PARTS + total // BATCH_BYTES, PARTS + total // RANGE_BYTES, HOT
    dealt = known.withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int")).mapInArrow(_once, "batch int, k1 long, k2 long, doc_id long, text string")
    marks = dealt.groupBy("batch").applyInArrow(lambda k, t: _heads(k, t, ranges), HEADS).groupBy("part").applyInArrow(lambda k, t: _marks(k, t, hot), MARKS)
    runs = dealt.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(lambda k, t, m: _suffix_runs(k, t, m, ranges), RUNS)
    places = runs.groupBy("part").applyInArrow(_scan, PLACES)
    found = dealt.groupBy("batch").cogroup(places.groupBy("batch")).applyInArrow(lambda k, t, p: _apply(t, p, keep_bytes), RESULTS)
    rows = known.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes")).join(found, ["k1", "k2"])
    own = F.col("doc_id") == F.col("low")
    copy = ~own & (F.col("n_bytes") >= MATCH)  # the whole text is a smaller document's
    rows = rows.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).when(own, F.col("removed")).otherwise(0).alias("n_removed"), F.when(copy, 1).when(own, F.col("spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).when(own, F.col("left")).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(F.lit(not keep_bytes), F.lit(None).cast("binary")).when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    zero, raw = F.lit(0).cast("long"), F.encode("text", "UTF-8")
    alone = texts.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), F.when(F.lit(keep_bytes), raw).alias("kept"),
    )
    return rows.unionByName(alone)


def op7_logarithmic_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir, "doc_id", "text"), keep_bytes=False).drop("kept")


ORACLE = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS place FROM texts),
strings AS (SELECT doc_id, place, md5(b[place + 1 : place + 50]) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT t.doc_id, t.place FROM strings t JOIN firsts f ON t.s = f.s WHERE t.doc_id > f.low),
runs AS (
  SELECT doc_id, place, place > lag(place) OVER w + 50 OR lag(place) OVER w IS NULL AS opens
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), numbered AS (SELECT doc_id, place, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM runs),
spans AS (SELECT doc_id, run, min(place) AS a, max(place) + 50 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, b AS from_byte, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_byte FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT c.doc_id, string_agg(hex(t.b[c.from_byte + 1 : coalesce(c.to_byte, octet_length(t.b))]), '' ORDER BY c.from_byte) AS h
  FROM cuts c JOIN texts t ON c.doc_id = t.doc_id WHERE coalesce(c.to_byte, octet_length(t.b)) > c.from_byte GROUP BY c.doc_id
), sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(t.b) AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN s.doc_id IS NULL THEN sha256(t.b) ELSE sha256(unhex(coalesce(k.h, ''))) END AS kept_sha256
FROM texts t LEFT JOIN sums s ON t.doc_id = s.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
