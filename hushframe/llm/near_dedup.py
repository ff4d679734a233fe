"""Near-duplicate classes by Order MinHash.

Each repetition samples the ORDER smallest occurrence-labelled word shingles of a text under its own hash and keeps them in
text order, so that texts meet if they share shingles in the same order. Texts that meet are compared to two hubs of their
bucket by a banded alignment of their shingle sequences. Where a bucket still holds several classes, its texts also meet on
their rarest shingles: two texts similar enough share one of those (prefix filter), so that no link among them is lost, and
texts that have only a common passage in common do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import LOWER_TABLE, clean_text, cut, fresh, gram_hashes, mix, read_documents, slices, span_hashes, text_bytes, word_bounds

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Shingles of a sketch, and repetitions. At similarity 0.8 a pair meets in no bucket with chance 2e-4.
ORDER, REPETITIONS = 3, 12
#: Rows of one hub or one shingle that are joined in one piece; more are dealt to several.
PIECE = 2048
#: Edges that a task contracts in memory.
FOREST_EDGES = 500_000
#: Bins in which shingles are counted to tell rare from frequent ones; any order of shingles gives the same links.
BINS = 1 << 18
#: One-bit minima of a text's signature, and how many may differ before a pair is aligned. At similarity 0.8 one in ten
#: differs; more than ALIKE do with chance 3e-7.
SIGNS, ALIKE = 128, 30
#: Words of 64 bits of a text's parity map: each shingle flips one bit, so that two maps differ in no more bits than their texts in shingles.
PARITY = 8
#: What is known of a text besides its hash: its number of shingles, its signature and its parity map.
MARKS = ["n", "s1", "s2", *(f"q{k}" for k in range(PARITY))]

_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's begin (one entry more than texts).

    Words are runs of characters other than white space [\\x20\\x09-\\x0D], A-Z lower-cased. A text of fewer than SHINGLE_WORDS
    words has one shingle, all its words.
    """
    data, offsets = text_bytes(texts)
    data = LOWER_TABLE[data]
    starts, ends, owner = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    grams, at = gram_hashes(words, owner, SHINGLE_WORDS)
    counts = np.bincount(owner[at], minlength=len(texts))
    if (short := np.flatnonzero(counts == 0)).size:
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        out, begins = [], np.concatenate(([0], np.cumsum(counts)))
        for k in range(len(texts)):
            if counts[k]:
                out.append(grams[begins[k] : begins[k + 1]])
            else:
                h = np.uint64(edges[k + 1] - edges[k] + 1)
                for w in words[edges[k] : edges[k + 1]]:
                    h = mix(np.array([h ^ w]))[0]
                out.append(np.array([h], np.uint64))
        counts[short] = 1
        grams = np.concatenate(out) if out else grams
    return grams, np.concatenate(([0], np.cumsum(counts)))


def occurrence_labelled(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of each shingle with the number of equal ones before it in its text."""
    same = mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rank = np.argsort(same, kind="stable")
    repeat = np.concatenate(([False], same[rank][1:] == same[rank][:-1]))
    place = np.arange(len(rank))
    occurrence = np.empty(len(rank), np.uint64)
    occurrence[rank] = (place - np.maximum.accumulate(np.where(repeat, 0, place))).astype(np.uint64)
    return mix(grams + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SIGNS one-bit minimum hashes of each text, as two 64-bit columns; two texts' bits agree as often as half of 1 + similarity."""
    n = len(begins) - 1
    out = np.zeros((n, 2), np.uint64)
    if n:
        labelled = occurrence_labelled(grams, np.repeat(np.arange(n), np.diff(begins)))
        seeds = mix(np.arange(1, 2 * SIGNS + 1, dtype=np.uint64) + np.uint64(77 << 40)).reshape(SIGNS, 2) | np.uint64(1)
        for r in range(SIGNS):
            low = np.minimum.reduceat((labelled ^ seeds[r, 0]) * seeds[r, 1], begins[:-1])
            out[:, r // 64] |= (low >> np.uint64(30) & np.uint64(1)) << np.uint64(r % 64)
    return out


def parities(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The parity map of each text, as PARITY 64-bit columns."""
    n, bits = len(begins) - 1, 64 * PARITY
    owner = np.repeat(np.arange(n), np.diff(begins))
    spot = (occurrence_labelled(grams, owner) >> np.uint64(40)).astype(np.int64) % bits
    odd = np.bincount(owner * bits + spot, minlength=n * bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(n, PARITY)


def sketches(grams: np.ndarray, begins: np.ndarray, order: int, repetitions: int) -> np.ndarray:
    """Order MinHash keys, one row a text and one column a repetition."""
    n = len(begins) - 1
    out = np.zeros((n, repetitions), np.uint64)
    if not n:
        return out
    owner = np.repeat(np.arange(n), np.diff(begins))
    labelled = occurrence_labelled(grams, owner)
    seeds = mix(np.arange(1, 2 * repetitions + 1, dtype=np.uint64) + np.uint64(order << 32)).reshape(repetitions, 2) | np.uint64(1)
    for r in range(repetitions):
        value = (labelled ^ seeds[r, 0]) * seeds[r, 1]
        value ^= value >> np.uint64(32)
        picked = np.zeros((order, n), np.int64)
        for k in range(order):
            low = np.minimum.reduceat(value, begins[:-1])
            hit = np.flatnonzero(value == low[owner])
            first = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
            picked[k] = first
            value[first] = _FAR
        picked.sort(axis=0)
        key = np.full(n, r + 1, np.uint64)
        for row in picked:
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + grams[row])
        out[:, r] = key
    return out


def ordered_overlap(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences: L / (len(a) + len(b) - L) for their longest common subsequence L; 0 if below least.

    L comes from an alignment within the band that a similarity of least allows. Common ends are taken off first; where the
    shingles are distinct and the common ones stand in one order, L is their number.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    if min(n, m) < need:
        return 0.0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if differ.size else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
    tail = int(differ[0]) if differ.size else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    length = head + tail
    if len(a) and len(b):
        common, at, to = np.intersect1d(a, b, return_indices=True)
        plain = len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b)
        if plain and length + len(common) < need:
            return 0.0
        if plain and (np.diff(to[np.argsort(at)]) > 0).all():
            length += len(common)
        else:
            length += banded_subsequence(a, b, n + m - 2 * need)
    return length / (n + m - length) if length >= need else 0.0


def banded_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matched places differ by band at most.

    The alignment's rows are bit vectors over the places of b within the band, one for each place of a: a zero marks a place
    at which the length grows. A row takes time in proportion to band / 64.
    """
    m = len(b)
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(codes[len(a) :], kind="stable")
    edges = np.searchsorted(codes[len(a) :][order], np.arange(len(names) + 1))
    often: dict[int, int] = {}  # all places of the few names that stand at many, as bits
    for c in np.flatnonzero(np.diff(edges) > max(8, m // 1000)).tolist():
        bits = np.zeros(m, bool)
        bits[order[edges[c] : edges[c + 1]]] = True
        often[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    row, lo, hi, length = 0, 0, 0, 0
    for i, c in enumerate(codes[: len(a)].tolist()):
        if (low := min(max(0, i - band), m)) > lo:
            length += low - lo - (row & ((1 << (low - lo)) - 1)).bit_count()
            row >>= low - lo
            lo = low
        if (high := min(m, i + band + 1)) > hi:
            row |= ((1 << (high - hi)) - 1) << (hi - lo)
            hi = high
        if lo >= hi:
            continue
        inside = (1 << (hi - lo)) - 1
        if c in often:
            match = often[c] >> lo & inside
        else:
            match = 0
            for j in order[edges[c] : edges[c + 1]].tolist():
                if lo <= j < hi:
                    match |= 1 << (j - lo)
        row = (row + (row & match) | row & ~match) & inside
    return length + hi - lo - row.bit_count()


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            grams, begins = shingles(part.column("text"))
            keys = sketches(grams, begins, ORDER, REPETITIONS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, REPETITIONS), pa.int32()), pa.array(keys.ravel()))
            signs = signatures(grams, begins).view(np.int64)
            marks = [np.diff(begins), *signs.T, *parities(grams, begins).T]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), *(pa.array(np.ascontiguousarray(m)) for m in marks), lists], names=["doc_id", "node", *MARKS, "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for half in slices(batch, "text_a"):
            for part in slices(half, "text_b"):
                (a, at), (b, bt) = shingles(part.column("text_a")), shingles(part.column("text_b"))
                good = [k for k in range(part.num_rows) if ordered_overlap(a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]])]
                yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose similarity is SIMILARITY or more; texts has node and text.

    b may be one node in very many pairs: its text is repeated for each PIECE of them, so that they are dealt to several tasks.
    """
    pieces = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(pieces, "b").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    first = pairs.join(pieces, "b").withColumn("piece", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int")).drop("pieces")
    first = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return first.join(second, ["b", "piece"]).select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    tops = [(find(x), x) for x in list(root)]
    tops = np.array([t for t in tops if t[0] != t[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(tops[:, 0]), pa.array(tops[:, 1])], names=["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: of each FOREST_EDGES or so, one from each node to the smallest node it is linked to."""
    edges = cut(edges.select("a", "b"))
    return cut(edges.coalesce(max(1, -(-edges.count() // FOREST_EDGES))).mapInArrow(_forest, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the smallest node that paths lead to.

    Labels spread along edges and jump to their label's label until none changes; each round is written before the next.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("b"), "label")
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        new = labels.join(near, "node").select("node", F.least("label", "low").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("label"))
        new = cut(new.join(jump, "to").select("node", "label", (F.col("label") < F.col("old")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _need(other: str) -> Column:
    """Shingles that two rows, the second's columns named with a prefix, share at least if they are linked."""
    return F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("n") + F.col(f"{other}n")) - 1e-9)


def _may_link(other: str) -> Column:
    """Whether two rows, the second's columns named with a prefix, are of different nodes and within the bounds of a link."""
    def differ(columns: list[str]) -> Column:
        return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}{c}"))) for c in columns), F.lit(0))

    near = (F.least("n", f"{other}n") >= SIMILARITY * F.greatest("n", f"{other}n")) & (differ(MARKS[1:3]) <= ALIKE)
    return (F.col("node") != F.col(f"{other}node")) & near & (differ(MARKS[3:]) <= F.col("n") + F.col(f"{other}n") - 2 * _need(other))


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, hub b) of each bucket's members with its hubs that may be links.

    The first hub is the member that meets most others in all repetitions, as the original of many copies does: each copy
    shares more with it than with the other copies. The second is the shortest.
    """
    rest = ["node", *MARKS]
    ranked = {"x": F.max(F.struct("weight", *rest)), "y": F.min(F.struct(F.col("n").alias("size"), *rest))}
    hubs = buckets.groupBy("rep", "key").agg(*[v.alias(k) for k, v in ranked.items()])
    each = F.explode(F.array(*[F.struct(*[F.col(k)[c].alias(f"hub_{c}") for c in rest]) for k in ranked]))
    hubs = hubs.select("rep", "key", each.alias("h")).select("rep", "key", "h.*").distinct()
    met = buckets.join(hubs, ["rep", "key"]).where(_may_link("hub_"))
    return met.select(F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct()


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        for part in slices(batch):
            grams, begins = shingles(part.column("text"))
            labelled = occurrence_labelled(grams, np.repeat(np.arange(part.num_rows), np.diff(begins)))
            counts += np.bincount((labelled & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bin", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each text, as many as a link needs to be found by, with their rank from 1."""
    rest = ["node", "label", *MARKS]
    for batch in batches:
        for part in slices(batch):
            grams, begins = shingles(part.column("text"))
            size = np.diff(begins)
            owner = np.repeat(np.arange(part.num_rows), size)
            labelled = occurrence_labelled(grams, owner)
            order = np.lexsort((labelled, counts[(labelled & np.uint64(BINS - 1)).astype(np.int64)], owner))
            rank = np.arange(len(order)) - begins[owner] + 1
            keep = rank <= (size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1)[owner]
            rows = part.select(rest).take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(labelled[order][keep].view(np.int64)), pa.array(rank[keep].astype(np.int32)), *rows.columns], names=["shingle", "rank", *rest])


def _rare_pairs(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of all nodes (node, label, MARKS) of different labels that may be links.

    A link's shingle multisets share need = 0.8 / 1.8 * (n + m) or more, so that the n - need + 1 and m - need + 1 rarest of
    the two have one in common. At a shingle only those that are not of its most frequent label look for others.
    """
    counts = np.zeros(BINS, np.int64)
    bins = texts.mapInArrow(_bin_counts, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # BINS rows
    counts[bins["bin"]] = bins["n"]
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    kind = f"shingle long, rank int, node long, label long, {', '.join(f'{c} long' for c in MARKS)}"
    rows = cut(texts.join(nodes, "node").select("node", "label", *MARKS, "text").mapInArrow(lambda b: _rarest(b, shared.value), kind))
    often = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.count(F.lit(1)).alias("labels"), F.sum("k").alias("rows"), F.max_by("label", F.struct("k", "label")).alias("major"))
    often = often.where("labels > 1").select("shingle", "major", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces"))
    met = cut(rows.join(often, "shingle"))
    first = met.where("label <> major").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "major")
    second = met.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    second = second.select("shingle", "piece", *[F.col(c).alias(f"other_{c}") for c in ("rank", "node", "label", *MARKS, "major")])
    need = _need("other_")
    once = (F.col("other_label") == F.col("other_major")) | (F.col("node") < F.col("other_node"))
    near = (F.col("label") != F.col("other_label")) & (F.col("rank") <= F.col("n") - need + 1) & (F.col("other_rank") <= F.col("other_n") - need + 1)
    met = first.join(second, ["shingle", "piece"]).where(once & near & _may_link("other_"))
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def _classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, node (hash of the text), n, class (node's, null without doc_id)."""
    texts = docs.select("doc_id", clean_text().alias("text")).withColumn("node", F.xxhash64("text"))
    rows = cut(texts.mapInArrow(_sketch_rows, f"doc_id long, node long, {', '.join(f'{c} long' for c in MARKS)}, keys array<long>"))
    known = rows.where("doc_id is not null")
    nodes = cut(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in (*MARKS, "keys")]))
    buckets = nodes.select("node", F.posexplode("keys").alias("rep", "key"))
    shared = buckets.groupBy("rep", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut(buckets.join(shared, ["rep", "key"]))
    met = cut(buckets.groupBy("node").agg(F.sum("size").alias("weight")).join(nodes.drop("keys"), "node"))
    wanted = texts.join(met.select("node", "doc_id"), ["node", "doc_id"], "left_semi")
    wanted = cut(wanted.dropDuplicates(["node", "doc_id"]).select("node", "text"))
    pairs = cut(_hub_pairs(buckets.join(met, "node")))
    edges = contracted(links(wanted, pairs))
    labels = _labels(met, edges)
    mixed = buckets.select("rep", "key", "node").join(labels, "node").groupBy("rep", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    unsure = buckets.join(mixed, ["rep", "key"], "left_semi").select("node").distinct()
    more = cut(_rare_pairs(wanted, met.join(labels, "node").join(unsure, "node", "left_semi").select("node", "label", *MARKS)))
    if not more.isEmpty():
        labels = _labels(met, contracted(edges.union(links(wanted, more))))
    members = rows.select("doc_id", "node", "n").join(labels, "node", "left")
    return members.select("doc_id", "node", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("class"))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes."""
    found = components(edges).withColumnRenamed("label", "to")
    return cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("to", "node").alias("label")))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_shingles. class_id is the smallest doc_id of the near-duplicate class.

    Documents are linked if the longest common subsequence L of their 5-word shingles gives L / (n + m - L) of 0.8 or more;
    classes are the connected components, equal texts included. A null text is an empty one; all empty texts are equal.
    Rows without doc_id have a null class and link nothing. Rows of one doc_id belong to the class of their own text;
    repeated rows stay rows. An empty table gives no rows. Extra columns are ignored.
    """
    rows = cut(_classes(docs))
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "class", "left").select("doc_id", "class_id", F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, of several texts with that doc_id the one of smallest
    hash, of repeated rows one. Rows without doc_id stay."""
    rows = cut(_classes(docs).where("doc_id is not null").select("doc_id", "node", "class"))
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    gone = rows.join(first, "class").where(F.struct("doc_id", "node") != F.col("first")).select("doc_id", "node")  # nothing after this join asks for a class in one task
    twice = rows.groupBy("doc_id", "node").count().where("count > 1").isEmpty()
    key = fresh(docs, "near_node", "gone_id", "gone_node")
    node, gone_id, gone_node = key["near_node"], key["gone_id"], key["gone_node"]
    left = docs.withColumn(node, F.xxhash64(clean_text()))
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node))
    left = left.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(node) == F.col(gone_node)), "left_anti")
    if not twice:
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", node]))
    return left.select(docs.columns)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_documents(spark, sf_dir, "doc_id", "text")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
