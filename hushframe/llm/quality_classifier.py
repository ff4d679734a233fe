"""Quality classifier by co-training.

Two logistic models see a document from two sides: its words and characters, and its page metadata. In rounds each one
scores all documents and labels those it is surest of for the other's training set. Both are then calibrated on held-out
labels and their log-odds are added to score all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import LOWER_TABLE, byte_class, mix, read_documents, slices, span_hashes, text_bytes, word_bounds

#: Bound of the labelled documents that the models are fitted on, of which every HELD_OUT-th calibrates.
LABELLED, HELD_OUT = 4000, 4
#: Rounds of exchange, and pseudo-labels that a model gives in each, split between the classes as the labels are.
ROUNDS, GIVEN = 3, 200
#: A pseudo-label must be at least this sure.
SURE = 0.9
#: Hashed words, languages and sources.
WORD_BINS, LANG_BINS, SOURCE_BINS = 512, 8, 32
RIDGE = 1e-2

_CLASSES = [byte_class(bytes(range(65, 91))), byte_class(bytes(range(48, 58))), byte_class(b"#*$%&|<>@=+_/\\^~[]{}`"), byte_class(b".,;:'\"?!()-"), byte_class(b" \t\r\x0b\x0c"), byte_class(b"\n"), byte_class(bytes(range(128, 256)))]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_view(texts: pa.Array) -> np.ndarray:
    """Normalised hashed word counts, the share of distinct words, mean word length and shares of character classes."""
    data, offsets = text_bytes(texts)
    starts, ends, owner = word_bounds(data, offsets)
    words = span_hashes(LOWER_TABLE[data], starts, ends)
    n = len(texts)
    count = np.bincount(owner, minlength=n)
    bins = np.bincount(owner * WORD_BINS + (words & np.uint64(WORD_BINS - 1)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    bins = np.log1p(bins)
    bins /= np.maximum(np.linalg.norm(bins, axis=1, keepdims=True), 1e-9)
    kinds = np.bincount(_distinct(words, owner), minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    shares = [_per_text(c[data], offsets) / size for c in _CLASSES]
    return np.column_stack([bins, kinds / np.maximum(count, 1), np.bincount(owner, ends - starts, n) / np.maximum(count, 1) / 10, *shares]).astype(np.float32)


def _distinct(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The owners of the distinct words, one entry for each."""
    _, first = np.unique(mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return owner[first]


def _hashed(values: pa.Array, bins: int) -> np.ndarray:
    place = np.array([zlib.crc32((v.as_py() or "").encode()) % bins for v in values], np.int64)
    return np.eye(bins, dtype=np.float32)[place]


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """Language and source, hashed, and the page's size, line count and mean line length."""
    data, offsets = text_bytes(batch.column("text"))
    lines = _per_text(data == 10, offsets) + 1
    declared = np.array([v.as_py() or 0 for v in batch.column("n_chars")], float)
    size = np.diff(offsets)
    numbers = np.column_stack([np.log1p(np.maximum(declared, 0)), np.log1p(size), np.log(lines), np.log1p(size / lines)]) / 10
    return np.column_stack([_hashed(batch.column("lang"), LANG_BINS), _hashed(batch.column("source"), SOURCE_BINS), numbers, numbers**2]).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE * len(x) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        curve[np.diag_indices(len(w))] += penalty
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of both views, each view's calibration (slope, shift), and the log-odds of the labels."""

    weights: list[np.ndarray]
    calibration: list[tuple[float, float]]
    prior: float

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated log-odds of each view."""
        return [a * log_odds(x, w) + b for x, w, (a, b) in zip(views, self.weights, self.calibration, strict=True)]

    def combined(self, views: list[np.ndarray]) -> np.ndarray:
        """Probability of good quality: the views' evidence beyond the prior adds up."""
        return sigmoid(sum(self.scores(views)) - self.prior)


@dataclass
class Training:
    """The growing training sets of both views."""

    x: list[list[np.ndarray]]
    y: list[list[np.ndarray]]

    def fit(self) -> list[np.ndarray]:
        return [fit_logistic(np.concatenate(self.x[v]), np.concatenate(self.y[v])) for v in range(2)]

    def give(self, view: int, x: np.ndarray, label: int) -> None:
        if len(x):
            self.x[view].append(x)
            self.y[view].append(np.full(len(x), label, float))


def calibrated(weights: list[np.ndarray], labelled: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> Model:
    """The views' model, calibrated on the held-out labels."""
    share, calibration = np.clip(y.mean(), 0.02, 0.98), []
    for v in range(2):
        if len({*y[held]}) < 2:  # too few labels to hold any out
            calibration.append((1.0, 0.0))
            continue
        a, b = fit_logistic(log_odds(labelled[v][held], weights[v])[:, None], y[held])
        calibration.append((max(a, 0.0), b))
    return Model(weights, calibration, float(np.log(share / (1 - share))))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [text_view(batch.column("text")), metadata_view(batch)]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            a, b = _views(part)
            yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("doc_id"), pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())], names=["quality", "doc_id", "a", "b"])


SUREST = "doc_id long, view int, label int, sure double"


def _sure(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each view and label that the view is SURE of in a document with an id."""
    for batch in batches:
        for part in slices(batch):
            named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for v, x in enumerate(_views(part)):
                p = sigmoid(log_odds(x, weights[v])).astype(float)
                for label, sure in enumerate((1 - p, p)):
                    at = np.flatnonzero((sure >= SURE) & named)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(sure[at])], names=["doc_id", "view", "label", "sure"])


def surest(docs: DataFrame, known: DataFrame, weights: list[np.ndarray], used: list[set[int]], wanted: list[int]) -> list[tuple[int, int, int]]:
    """(view, label, doc_id) that each view is surest of, wanted of each label at most.

    Documents with a label in known, and those of which the other view has been told before, are left out before any is
    ranked; a document counts once, however often it is repeated, by what the view is least sure of in its texts.
    """
    rows = docs.select(*COLUMNS).mapInArrow(lambda b: _sure(b, weights), SUREST).join(known.select("doc_id"), "doc_id", "left_anti")
    told = [(d, 1 - v) for v, ids in enumerate(used) for d in sorted(ids)]  # ROUNDS * GIVEN for a view at most
    if told:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(told, "doc_id long, view int")), ["doc_id", "view"], "left_anti")
    rows = rows.groupBy("doc_id", "view", "label").agg(F.min("sure").alias("sure")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    most = F.when(F.col("label") == 1, wanted[1]).otherwise(wanted[0])
    for key in (["view", "label", "part"], ["view", "label"]):  # the parts' best before the best of all
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("sure").desc(), "doc_id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return sorted((r.view, r.label, r.doc_id) for r in rows.select("view", "label", "doc_id").collect())  # 2 * GIVEN rows or so


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in _views(part))], names=["doc_id", "a", "b"])


def exchange(docs: DataFrame, known: DataFrame, weights: list[np.ndarray], used: list[set[int]], share: float) -> list[tuple[int, int, int, np.ndarray]]:
    """(view, label, doc_id, features in that view) of the documents that the other view is surest of among all without a label."""
    wanted = [max(round(GIVEN * (1 - share)), 1), max(round(GIVEN * share), 1)]
    chosen = surest(docs, known, weights, used, wanted)
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted({d for _, _, d in chosen})], "doc_id long")
    rows = docs.select(*COLUMNS).join(F.broadcast(ids), "doc_id").mapInArrow(_view_rows, "doc_id long, a binary, b binary").groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x"))
    features = {r.doc_id: r.x for r in rows.collect()}  # a row for each id chosen
    return [(1 - v, label, d, np.frombuffer(features[d]["ab"[1 - v]], np.float32)) for v, label, d in chosen]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model fitted on LABELLED labelled documents, those of smallest hashed doc_id, and on the pseudo-labels that the views
    exchange over all documents; None without labels of both kinds. Of several texts with one doc_id the one of smallest
    features counts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(LABELLED)
    picked = [(r.doc_id, r.quality) for r in chosen.collect()]  # LABELLED rows
    if len({q for _, q in picked}) < 2:
        return None
    picked = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    sample = docs.select(*COLUMNS).join(F.broadcast(picked), "doc_id")
    rows = sample.mapInArrow(_sample_rows, "quality int, doc_id long, a binary, b binary").groupBy("doc_id", "quality").agg(F.min(F.struct("a", "b")).alias("x"))
    rows = rows.orderBy("doc_id").collect()  # LABELLED rows, however often a document is repeated
    y = np.array([r.quality for r in rows], float)
    views = [np.stack([np.frombuffer(r.x[c], np.float32) for r in rows]) for c in "ab"]
    held = np.zeros(len(y), bool)
    for label in (0, 1):  # every HELD_OUT-th of each class
        held[np.flatnonzero(y == label)[HELD_OUT - 1 :: HELD_OUT]] = True
    if len({*y[~held]}) < 2:
        held[:] = False
    training = Training([[x[~held]] for x in views], [[y[~held]] for _ in views])
    weights, used, share = training.fit(), [set(), set()], float(np.clip(y.mean(), 0.02, 0.98))
    for _ in range(ROUNDS):
        given = exchange(docs, known, weights, used, share)
        for v in range(2):
            for label in (0, 1):
                training.give(v, np.array([x for w, k, _, x in given if (w, k) == (v, label)]), label)
            used[v] |= {d for w, _, d, _ in given if w == v}
        weights = training.fit()
    return calibrated(weights, views, y, held)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, text_score, metadata_score, score (probabilities of good quality), kept (score >= threshold).

    Null texts count as empty, null languages and sources as empty names, a null n_chars as 0. Labels other than 0 and 1
    are left out; of several for one document the largest holds. Without labels of both kinds all scores are null and
    every document is kept. Repeated rows are scored each, alike. An empty table gives no rows. Extra columns are ignored.
    """
    model = fit(docs, labels)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.DoubleType()) for n in ("text_score", "metadata_score", "score"))])
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("text_score"), none.alias("metadata_score"), none.alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                views = _views(part)
                each = [sigmoid(z) for z in shared.value.scores(views)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.round(x.astype(np.float64), 6)) for x in (*each, shared.value.combined(views)))], names=schema.names)

    return docs.select(*COLUMNS).mapInArrow(run, schema).withColumn("kept", F.col("score") >= threshold)


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir, *COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
