"""Near-duplicate vectors by a tiled comparison in the order of principal components.

Distinct vectors are turned so that their leading dimensions hold most of what they have, ordered along a curve through these
and packed into leaves of LEAF vectors, leaves into bands. A leaf goes to the bands that it may hold a link with, by the box
of their leading dimensions and the lengths of what is left (suffix norms). Where two bands meet, the products of their leaves
are summed block of dimensions by block: a pair stops as soon as its sum plus the product of its suffix norms cannot reach the
threshold. Sums that rounding leaves in doubt are taken anew in double precision from the vectors as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, fresh
from hushframe.llm.near_dedup import components, contracted

COSINE = 0.9
#: Vectors of a leaf, and bytes of a band's turned vectors: two bands and their vectors as they came are one task's memory.
LEAF, BAND_BYTES = 1024, 16 << 20
#: Bands there are at least, so that small inputs keep several tasks busy.
MIN_BANDS = 8
#: Dimensions whose products are summed before a pair is looked at again.
BLOCK = 16
#: Leading dimensions of a leaf's box, and those that order the vectors, each by so many bits.
BOX, CURVE, CURVE_BITS = 8, 4, 4
#: Of a leaf pair's products, the share from which the rest is summed for all of them.
DENSE = 0.05

LEAVES = "band int, dim int, lo array<double>, hi array<double>, rest double, nodes binary, copies binary, turned binary, raw binary, norms binary"


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, shorter ones with zeros after them, and each one's length."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out, sizes


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; very large and very small ones are scaled first."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    for batch in batches:
        if batch.num_rows:
            units = _units(_matrix(batch.column("vector"), width)[0])
            total += units.T @ units
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "v"])


def principal_axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes as columns, that of the largest share first, and what each holds of a unit vector on average (root mean square).

    All vectors count; width ** 2 sums come to the driver. Any rotation gives the same links, a good one gives them sooner.
    """
    sums = vectors.mapInArrow(lambda b: _moments(b, width), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((width, width))
    total[sums["i"], sums["j"]] = sums["v"]
    values, axes = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1]), np.sqrt(np.maximum(values[::-1], 0) / max(np.trace(total), 1e-300))


def _turn(batches: Iterator[pa.RecordBatch], axes: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the turned unit vector and its place along a curve that goes through the cells of the leading dimensions."""
    width, lead = len(axes), min(CURVE, len(axes))
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, sizes = _matrix(batch.column("vector"), width)
        turned = _units(vectors) @ axes
        cells = np.clip((turned[:, :lead] / np.maximum(spread[:lead], 1e-12) + 2) / 4 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
        place = np.zeros(len(cells), np.int64)
        for bit in range(CURVE_BITS - 1, -1, -1):
            for k in range(lead):
                place = place << 1 | cells[:, k] >> bit & 1
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, turned.size + 1, width), pa.int32()), pa.array(turned.astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([*batch.select(["node", "copies", "vector"]).columns, pa.array(sizes.astype(np.int32)), pa.array(place), rows], names=["node", "copies", "vector", "dim", "place", "turned"])


def _leaf(band: int, dim: int, nodes: np.ndarray, copies: np.ndarray, turned: np.ndarray, raw: np.ndarray) -> dict:
    lead = turned[:, :BOX].astype(float)
    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])  # by powers of two: no product overflows, no digit is lost
    return {
        "band": band, "dim": dim, "lo": lead.min(axis=0).tolist(), "hi": lead.max(axis=0).tolist(), "rest": float(np.linalg.norm(turned[:, BOX:].astype(float), axis=1).max()),
        "nodes": nodes.tobytes(), "copies": copies.tobytes(), "turned": turned.tobytes(), "raw": scaled.tobytes(), "norms": np.sqrt((scaled * scaled).sum(axis=1)).tobytes(),
    }


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Leaves of rows that come in order; a leaf's vectors are of one band and one length."""
    schema = pa.schema([("band", pa.int32()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("rest", pa.float64()), *((n, pa.binary()) for n in ("nodes", "copies", "turned", "raw", "norms"))])
    held: list[tuple] = []
    size, key = 0, None

    def out() -> pa.RecordBatch:
        parts = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_pylist([_leaf(*key, parts[0], parts[1], parts[2], parts[3][:, : key[1]])], schema)

    for batch in batches:
        bands, dims = batch.column("band").to_numpy(), batch.column("dim").to_numpy()
        edges = np.flatnonzero(np.diff(bands) | np.diff(dims)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            while start < stop:
                if size and key != (int(bands[start]), int(dims[start])) or size >= LEAF:
                    yield out()
                    held, size = [], 0
                key = int(bands[start]), int(dims[start])
                part = batch.slice(start, min(stop - start, LEAF - size))
                turned = part.column("turned").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                held.append((part.column("node").to_numpy(), part.column("copies").to_numpy(), turned, _matrix(part.column("vector"), width)[0]))
                size += part.num_rows
                start += part.num_rows
    if size:
        yield out()


def _margin(width: int) -> float:
    """What rounding to single precision can change of a product of two unit vectors, and as much again."""
    return 1e-6 + 2.4e-7 * width


class _Leaf:
    """A leaf with its suffix norms at the ends of the blocks and its vectors' places among those of the task."""

    def __init__(self, row: dict, first: int):
        self.nodes, self.copies, self.norms = (np.frombuffer(row[c], t) for c, t in (("nodes", np.int64), ("copies", np.int64), ("norms", float)))
        n = len(self.nodes)
        self.turned, self.raw = np.frombuffer(row["turned"], np.float32).reshape(n, -1), np.frombuffer(row["raw"], float).reshape(n, -1)
        self.lo, self.hi, self.rest, self.dim, self.band = np.array(row["lo"]), np.array(row["hi"]), row["rest"], row["dim"], row["band"]
        squares = self.turned.astype(float) ** 2
        after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        self.after = [np.sqrt(after[:, k]).astype(np.float32) if k < after.shape[1] else np.zeros(n, np.float32) for k in range(BLOCK, after.shape[1] + BLOCK, BLOCK)]
        self.places = np.arange(first, first + n)


def _box_bound(a: _Leaf, b: _Leaf) -> float:
    return float(np.max([a.lo * b.lo, a.lo * b.hi, a.hi * b.lo, a.hi * b.hi], axis=0).sum() + a.rest * b.rest)


def linked(a: _Leaf, b: _Leaf, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs whose cosine is least or more; a leaf with itself gives each pair once."""
    width = a.turned.shape[1]
    margin, low = _margin(width), np.float32(least - _margin(width))
    sums = a.turned[:, :BLOCK] @ b.turned[:, :BLOCK].T
    may = sums + a.after[0][:, None] * b.after[0] >= low
    if a is b:
        may &= np.tri(len(a.nodes), k=-1, dtype=bool).T
    if np.count_nonzero(may) > DENSE * may.size:
        sums = a.turned @ b.turned.T
        may &= sums >= low
        x, y = np.nonzero(may)
        sums = sums[x, y]
    else:
        x, y = np.nonzero(may)
        sums = sums[x, y]
        for k in range(1, len(a.after)):
            if not len(x):
                break
            block = slice(k * BLOCK, (k + 1) * BLOCK)
            sums = sums + np.einsum("ij,ij->i", a.turned[x, block], b.turned[y, block])
            may = sums + a.after[k][x] * b.after[k][y] >= low
            x, y, sums = x[may], y[may], sums[may]
    doubt = np.flatnonzero(sums < least + margin)
    if len(doubt):
        good = np.ones(len(x), bool)
        for k in range(0, len(doubt), 1 << 16):
            p, q = x[doubt[k : k + (1 << 16)]], y[doubt[k : k + (1 << 16)]]
            good[doubt[k : k + (1 << 16)]] = (a.raw[p] * b.raw[q]).sum(axis=1) / (a.norms[p] * b.norms[q]) >= least
        x, y = x[good], y[good]
    return x, y


def _join(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Labels (each vector's is the smallest place of its tree) after the trees of x and y have been joined."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(labels, up := labels[labels]):
            labels[:] = up


def _compare(table: pa.Table, least: float) -> pa.Table:
    """Of one pair of bands: (a, null, n) for n linked vectors of node a, and (a, b, null) for a forest of the linked nodes."""
    leaves, first = [], 0
    for row in table.to_pylist():
        leaves.append((row["i"], row["j"], _Leaf(row, first)))
        first += len(leaves[-1][2].nodes)
    labels, counts = np.arange(first), np.zeros(first, np.int64)
    nodes = np.concatenate([leaf.nodes for _, _, leaf in leaves])
    for k, (i, j, a) in enumerate(leaves):
        for _, _, b in leaves[k if i == j else k + 1 :]:
            if a.dim == b.dim and (i == j or a.band != b.band) and _box_bound(a, b) >= least - _margin(a.turned.shape[1]):
                x, y = linked(a, b, least)
                if len(x):
                    counts += np.bincount(a.places[x], b.copies[y], first).astype(np.int64) + np.bincount(b.places[y], a.copies[x], first).astype(np.int64)
                    _join(labels, a.places[x], b.places[y])
    some, child = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(first))
    none = pa.nulls(len(some), pa.int64()), pa.nulls(len(child), pa.int64())
    return pa.table({
        "a": pa.chunked_array([pa.array(nodes[some]), pa.array(nodes[labels[child]])], pa.int64()), "b": pa.chunked_array([none[0], pa.array(nodes[child])], pa.int64()),
        "n": pa.chunked_array([pa.array(counts[some]), none[1]], pa.int64()),
    })


def _meetings(leaves: DataFrame, bands: int, least: float, width: int) -> DataFrame:
    """Each leaf for each pair of bands (i <= j) in which it may hold a link: with its own band, and with those its box allows."""
    def widest(c: str, of) -> Column:
        return F.array(*[of(F.col(c)[k]) for k in range(min(BOX, width))])

    boxes = leaves.groupBy(F.col("band").alias("other"), "dim").agg(widest("lo", F.min).alias("other_lo"), widest("hi", F.max).alias("other_hi"), F.max("rest").alias("other_rest"))
    products = [F.greatest(*[F.col(x)[k] * F.col(y)[k] for x in ("lo", "hi") for y in ("other_lo", "other_hi")]) for k in range(min(BOX, width))]
    bound = sum(products, F.lit(0.0)) + F.col("rest") * F.col("other_rest")
    each = leaves.withColumn("leaf", F.monotonically_increasing_id())
    near = each.select("leaf", "band", "dim", "lo", "hi", "rest", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other")).join(boxes, ["other", "dim"])
    near = near.where((F.col("band") == F.col("other")) | (bound >= least - _margin(width)))
    near = near.select("leaf", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j"))
    return near.join(each, "leaf").select("i", "j", *leaves.columns)


def _sound(vector: Column) -> Column:
    """Whether a vector has a direction: it is not null, and its components are finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_links(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = COSINE) -> DataFrame:
    """One row per row of vectors: its id, n_links (other rows with a cosine of least or more), component (smallest id that links lead to, its own included).

    Vectors of different lengths are not linked. A null vector, one of zeros, an empty one and one with null or non-finite
    components link with nothing; so do rows without id, whose component is null. Repeated rows are rows of their own and link with each other.
    Equal vectors are compared once (they are told by 128 bits of hash). An empty table gives no rows; other columns are ignored. least is over 0.
    """
    spark = vectors.sparkSession
    doubles = F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), doubles.alias("vector"))
    rows = rows.withColumn("sound", _sound(F.col("vector")) & F.col("id").isNotNull())
    keys = F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("vector"), "vector").alias("k2")
    known = rows.where("sound").select("id", *keys, "vector")
    nodes = known.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    total, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    alone = rows.where(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if not total:
        return alone
    axes, spread = principal_axes(nodes.select("vector"), width)
    shared = spark.sparkContext.broadcast((axes, spread))  # width ** 2 numbers
    bands = max(MIN_BANDS, -(-total * width * 4 // BAND_BYTES))
    turned = nodes.select("node", "copies", "vector").mapInArrow(lambda b: _turn(b, *shared.value), "node long, copies long, vector array<double>, dim int, place long, turned array<float>")
    turned = turned.repartitionByRange(bands, "dim", "place", F.xxhash64("node")).sortWithinPartitions("dim", "place").withColumn("band", F.spark_partition_id())
    leaves = cut(turned.mapInArrow(lambda b: _pack(b, width), LEAVES))
    most = leaves.agg(F.max("band")).first()[0]
    met = _meetings(leaves, most + 1, least, width).groupBy("i", "j").applyInArrow(lambda t: _compare(t, least), "a long, b long, n long")
    met = cut(met)
    counts = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(contracted(met.where("b is not null")))
    found = nodes.select("k1", "k2", "node", "id", "copies").join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = cut(found)
    smallest = found.groupBy("label").agg(F.min("id").alias("component"))
    found = found.join(smallest, "label").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    return known.select("id", "k1", "k2").join(found, ["k1", "k2"]).select("id", "n_links", "component").unionByName(alone)


def keep_one_vector(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = COSINE) -> DataFrame:
    """The rows of vectors whose id is the smallest of their component; rows without id stay."""
    ids = vector_links(vectors, id_column, column, least).where("id = component").select(F.col("id").alias("kept_id")).distinct()
    key = fresh(vectors, "kept_id")["kept_id"]
    return vectors.where(F.col(id_column).isNull()).unionByName(vectors.join(ids.withColumnRenamed("kept_id", key), F.col(id_column) == F.col(key), "left_semi"))


def op11_tiled_principal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT l.vec_id, (SELECT count(*) FROM links k WHERE k.a = l.vec_id) AS n_links, component_id, l.vec_id = component_id AS kept FROM least l
"""
