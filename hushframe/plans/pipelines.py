"""Whole pipelines: page sanitising, request admission, run audits, detector reports and frame merging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.functions import text as X
from hushframe.operators import boxes as B
from hushframe.operators import frames as J
from hushframe.operators import page_rows as W
from hushframe.operators import pages as P
from hushframe.operators import rank as R
from hushframe.operators import requests as Q
from hushframe.operators import runs as L
from hushframe.sources import html as H


def parsed_once(pages: DataFrame) -> DataFrame:
    """Rows of H.parse_pages, parsed once for all that reads them: written to the checkpoint folder where one is set, else kept by the executors."""
    parsed = H.parse_pages(pages)
    if pages.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return parsed.persist(StorageLevel.MEMORY_AND_DISK)
    return parsed.checkpoint()


@dataclass
class SanitizedPages:
    """nodes: ranked and sanitised nodes, of which those marked kept may leave; regions: what is to be painted over, screenshot
    pixels; leaks: (page_id, agent_id) whose raw value still stands in its page's outgoing nodes, none if all is well;
    unplaced: (page_id, selector, type) of what ought to be painted over but has no place: the screenshots of these pages must
    not leave; counts: one row of named counts for each page. Each is planned where it is asked for; rows has all of them at once."""

    ranked: DataFrame
    scroll: tuple[float, float]
    dpr: float

    @cached_property
    def rows(self) -> DataFrame:
        return W.finished_rows(self.ranked, self.scroll, self.dpr)

    @property
    def nodes(self) -> DataFrame:
        return W.sent_nodes(W.with_sent(self.ranked))

    @property
    def regions(self) -> DataFrame:
        return W.region_rows(W.with_regions(self.ranked, self.scroll, self.dpr))

    @property
    def leaks(self) -> DataFrame:
        return self.rows.select("page_id", F.explode("leaks").alias("agent_id"))

    @property
    def unplaced(self) -> DataFrame:
        return self.rows.select("page_id", F.explode("unplaced").alias("u")).select("page_id", "u.selector", "u.type")

    @property
    def counts(self) -> DataFrame:
        return self.rows.select("page_id", "error", "counts.*")


def sanitize_pages(
    pages: DataFrame, goal: str, max_elements: int = R.MAX_ELEMENTS, layout: DataFrame | Column | None = None, acted: DataFrame | Column | None = None, boxes: DataFrame | None = None,
    scroll: tuple[float, float] = (0.0, 0.0), dpr: float = 1.0, reports: DataFrame | None = None, tokens: DataFrame | None = None, iframes: DataFrame | None = None,
) -> SanitizedPages:
    """Pages (page_id, html) scanned, flagged, merged with their frames, ranked and sanitised: one exchange by page for all tables, none without any.

    layout: page_id, node_idx, x, y, w, h of elements in CSS pixels of the window; acted: page_id, agent_id of nodes used
    already, which go; either may be a column of the page's row (W.page_rows) instead; boxes: image_id (the page), box_idx, label, score and corners in screenshot pixels; scroll: the
    window's place in the document; dpr: screenshot pixels per CSS pixel. Frames: reports, rows of W.INPUTS' kind; tokens:
    page_id, token, dx, dy, connected; iframes: page_id, token, x, y, w, h. A frame that is not merged is painted over whole, and so
    is a closed shadow root's host; what has no layout is told in unplaced.
    """
    boxes = None if boxes is None else boxes.withColumnRenamed("image_id", "page_id")
    rows = W.page_rows(H.parse_pages(pages), layout=layout, acted=acted, boxes=boxes, reports=reports, tokens=tokens, iframes=iframes)
    if not 0 < dpr < float("inf"):
        raise ValueError("dpr must be finite and above 0")
    return SanitizedPages(W.ranked_rows(rows, goal, max_elements, frames=any(x is not None for x in (reports, tokens, iframes))), scroll, dpr)


def admit_requests(requests: DataFrame) -> DataFrame:
    """The admission decision of each request (request_id, body)."""
    return Q.admit(requests)


def audit_runs(actions: DataFrame, nodes: DataFrame, profiles: DataFrame, risk, marks: DataFrame) -> DataFrame:
    """(run_id, n_actions, n_invalid, n_blocked, stall_step, stall_period, outcome) of each run's log, and the summary of its marks."""
    checked = Q.validate_actions(actions)
    guarded = J.guard_actions(checked.drop("error_code"), nodes, profiles, risk)
    stalls = L.detect_stalls(checked.where("error_code is null"))
    steps = checked.select("run_id", "step", "error_code", "action").join(guarded.select("run_id", "step", "verdict"), ["run_id", "step"])
    stall = stalls.select("run_id", F.col("step").alias("stall_step"), F.col("period").alias("stall_period"))
    outcome = F.when(F.col("error_code").isNotNull(), "analyze_failed").when(F.col("verdict") != "ok", "blocked").when(F.col("action") == "done", "done")
    ended = L.run_outcomes(steps.select("run_id", "step", F.lit(0).alias("stage_rank"), outcome.alias("outcome")).unionByName(stalls.select("run_id", "step", F.lit(1).alias("stage_rank"), F.lit("stalled").alias("outcome"))))
    counts = L.count_kinds(steps, ["run_id"], {"n_actions": F.lit(True), "n_invalid": F.col("error_code").isNotNull(), "n_blocked": F.col("verdict") != "ok"})
    return counts.join(stall, "run_id", "left").join(ended.select("run_id", "outcome"), "run_id", "left").join(L.run_summary(marks), "run_id", "left")


@dataclass
class DetectorReport:
    """images: (image_id, total, after_class, after_nms, after_cap) and the image's latency (cold_ms, warm_runs, warm_median_ms, within_gate);
    sweep: (threshold, label, before, after) over all images."""

    images: DataFrame
    sweep: DataFrame


def detector_report(anchors: DataFrame, images: DataFrame, timings: DataFrame, classes: list[str], threshold: float, thresholds: list[float]) -> DetectorReport:
    """What a detector's raw output comes to, filter by filter.

    anchors: image_id, anchor_idx, cx, cy, w, h and scores (an array) in letterboxed pixels; images: image_id, width, height,
    pad_x, pad_y, ratio, by which boxes go back to image pixels; timings: image_id, seq, ms. An image without timings has a
    null latency, and is not within the gate.
    """
    raw = B.decode_predictions(anchors, classes, threshold)
    fit = images.select("image_id", "pad_x", "pad_y", "ratio")
    corners = {c: G.unletterbox(F.col(c), F.col("pad_x" if c[0] == "x" else "pad_y"), F.col("ratio")) for c in ("xmin", "ymin", "xmax", "ymax")}
    boxes = raw.join(fit, "image_id").withColumns(corners).select(raw.columns)
    privacy = B.keep_privacy_labels(boxes)
    single = B.nms(privacy)
    capped = B.area_cap(single, images)
    stages = [df.select("image_id", F.lit(k).alias("stage")) for k, df in enumerate((boxes, privacy, single, capped))]
    names = ("total", "after_class", "after_nms", "after_cap")
    out = reduce(DataFrame.unionByName, stages).groupBy("image_id").agg(*[F.count_if(F.col("stage") == k).alias(n) for k, n in enumerate(names)])
    out = out.join(L.latency_summary(timings.select("image_id", "seq", "ms"), "image_id"), "image_id", "left").withColumn("within_gate", F.coalesce("within_gate", F.lit(False)))
    return DetectorReport(out, B.threshold_sweep(boxes, thresholds))


def merge_subframes(reports: DataFrame, tokens: DataFrame, iframes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moved rows, defensive regions, counts) of frame reports."""
    moved, _ = J.merge_frames(reports, tokens)
    return moved, J.defensive_regions(iframes, moved), J.frame_counts(iframes, reports, moved)


def redact(boxes: DataFrame, flagged: DataFrame, nodes: DataFrame, dpr: float) -> tuple[DataFrame, DataFrame]:
    """Regions first, then sanitised nodes; both must be written before anything else is."""
    return B.build_regions(boxes, flagged, dpr), Q.sanitize_nodes(nodes)


def pii_of_documents(docs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of documents with each kind of personal data."""
    return P.pii_profile(docs.withColumn("pii_types", X.text_pii_types(F.col("text"))), by)


