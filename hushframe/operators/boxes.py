"""Detector boxes, redaction regions and page tiling. Boxes: image_id, box_idx, label, score, xmin, ymin, xmax, ymax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.functions import text as X

SINGLE_CAP, COMBINED_CAP = 0.5, 0.65
NMS_OVERLAP = 0.45
TILES = 5


def keep_privacy_labels(boxes: DataFrame) -> DataFrame:
    return boxes.where(X.is_privacy_label(F.col("label")))


def box_area(df: str = "") -> Column:
    """Area of the corners, 0 if one is not finite."""
    c = {n: F.col(df + n) for n in ("xmin", "ymin", "xmax", "ymax")}
    w, h = c["xmax"] - c["xmin"], c["ymax"] - c["ymin"]
    return F.when(G.is_finite(w, h), F.abs(w) * F.abs(h)).otherwise(0.0)


def area_cap(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes of at most half an image whose areas, smallest first, add up to at most 65 % of it.

    images: image_id, width, height; without usable dimensions all boxes of an image stay.
    """
    area = F.col("width") * F.col("height")
    usable = G.is_finite(F.col("width"), F.col("height")) & (F.col("width") > 0) & (F.col("height") > 0)
    df = boxes.join(images.select("image_id", "width", "height"), "image_id", "left").withColumn("_usable", usable).withColumn("_area", box_area())
    df = df.where(~F.col("_usable") | (F.col("_area") / area <= SINGLE_CAP))
    ahead = Window.partitionBy("image_id").orderBy("_area", "box_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_total", F.sum("_area").over(ahead))
    return df.where(~F.col("_usable") | (F.col("_total") / area <= COMBINED_CAP)).select(boxes.columns)


def nms(boxes: DataFrame, overlap: float = NMS_OVERLAP, by: tuple[str, ...] = ("image_id", "label")) -> DataFrame:
    """Boxes that overlap no better one of their group by more than overlap; score descending, box_idx breaks ties.

    One group's boxes are folded in one row: they are one detector's output for one image.
    """
    def corners(b: Column) -> G.Box:
        return b["xmin"], b["ymin"], b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]

    rest = [c for c in boxes.columns if c not in by]
    row = F.struct((-F.col("score")).alias("_rank"), *[F.col(c) for c in ["box_idx", *[c for c in rest if c != "box_idx"]]])
    grouped = boxes.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: G.iou(corners(k), corners(b)) > overlap), acc).otherwise(F.concat(acc, F.array(b))))
    return grouped.select(*by, F.explode(kept).alias("b")).select(*by, *[F.col("b")[c].alias(c) for c in rest]).select(boxes.columns)


def decode_predictions(anchors: DataFrame, classes: list[str], threshold: float) -> DataFrame:
    """Boxes from anchor rows (image_id, anchor_idx, cx, cy, w, h, scores array): best class, the first one on a tie."""
    best = F.array_max("scores")
    label = F.coalesce(F.get(F.array(*[F.lit(c) for c in classes]), F.col("class_id")), F.concat(F.lit("class_"), F.col("class_id")))
    df = anchors.withColumn("score", best).where(F.col("score") >= threshold).withColumn("class_id", (F.array_position("scores", F.col("score")) - 1).cast("int"))
    half = [F.col(c) / 2 for c in "wh"]
    return df.select(
        "image_id", F.col("anchor_idx").alias("box_idx"), label.alias("label"), "score",
        (F.col("cx") - half[0]).alias("xmin"), (F.col("cy") - half[1]).alias("ymin"), (F.col("cx") + half[0]).alias("xmax"), (F.col("cy") + half[1]).alias("ymax"),
    )


def threshold_sweep(boxes: DataFrame, thresholds: list[float], overlap: float = NMS_OVERLAP) -> DataFrame:
    """(threshold, label, before, after): boxes at or above each threshold, and those that remain after nms."""
    grid = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("score") >= t)).alias("threshold")
    many = boxes.select("*", grid)
    before = many.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("before"))
    after = nms(many, overlap, ("threshold", "image_id", "label")).groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, ["threshold", "label"])


def class_coverage(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """(label, n, present) for each of the classes."""
    wanted = boxes.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    counts = boxes.where(F.col("label").isin(classes)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def detection_diff(a: DataFrame, b: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(image_id, label, matched, missing, extra, max_drift, max_score_delta) of two detectors' boxes.

    Boxes match that are each other's best by IoU, at least overlap; lower box_idx wins ties.
    """
    names = ["box_idx", "score", "xmin", "ymin", "xmax", "ymax"]
    left = a.select("image_id", "label", *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select("image_id", "label", *[F.col(c).alias(f"b_{c}") for c in names])

    def box(p: str) -> G.Box:
        return F.col(p + "xmin"), F.col(p + "ymin"), F.col(p + "xmax") - F.col(p + "xmin"), F.col(p + "ymax") - F.col(p + "ymin")

    pairs = left.join(right, ["image_id", "label"]).withColumn("iou", G.iou(box("a_"), box("b_"))).where(F.col("iou") >= overlap)
    for side in "ab":
        other = "b" if side == "a" else "a"
        w = Window.partitionBy("image_id", "label", f"{side}_box_idx").orderBy(F.col("iou").desc(), f"{other}_box_idx")
        pairs = pairs.withColumn(f"{side}_rank", F.row_number().over(w))
    drift = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names[2:]])
    matched = pairs.where("a_rank = 1 and b_rank = 1").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("matched"), F.max(drift).alias("max_drift"), F.max(F.abs(F.col("a_score") - F.col("b_score"))).alias("max_score_delta"))
    counts = [d.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "n_a"), (b, "n_b"))]
    every = counts[0].join(counts[1], ["image_id", "label"], "full").join(matched, ["image_id", "label"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b", "matched")}
    return every.select("image_id", "label", n["matched"].alias("matched"), (n["n_a"] - n["matched"]).alias("missing"), (n["n_b"] - n["matched"]).alias("extra"), "max_drift", "max_score_delta")


def build_regions(boxes: DataFrame, flagged: DataFrame, dpr: float) -> DataFrame:
    """Redaction regions of boxes (screenshot pixels, unscaled) and flagged nodes (CSS pixels, times dpr), in that order.

    flagged: image_id, seq, pii_type, x, y, w, h, agent_id. Malformed boxes and nodes are left out; nothing is merged.
    """
    if not 0 < dpr < float("inf"):
        raise ValueError("dpr must be finite and above 0")
    x, y, w, h = G.from_corners(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    kind, raw = X.normal_pii_type(F.col("label"))
    vision = boxes.select("image_id", F.lit(0).alias("part"), F.col("box_idx").cast("long").alias("seq"), kind.alias("type"), raw.alias("raw_type"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.lit(None).cast("string").alias("agent_id"), F.lit("vision").alias("source"))
    kind, raw = X.normal_pii_type(F.col("pii_type"))
    x, y, w, h = G.scale(tuple(F.when(G.is_finite(*G.columns()), c) for c in G.columns()), F.lit(float(dpr)))
    dom = flagged.select("image_id", F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), kind.alias("type"), raw.alias("raw_type"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "agent_id", F.lit("dom").alias("source"))
    both = vision.unionByName(dom).where("x is not null")
    return both.withColumn("region_idx", F.row_number().over(Window.partitionBy("image_id").orderBy("part", "seq")) - 1).drop("part", "seq")


def scroll_targets(pages: DataFrame, viewport: float, tiles: int = TILES) -> DataFrame:
    """(page_id, slice_idx, scroll_y, truncated, needed) for pages (page_id, height): top-down tiles of the viewport's height."""
    needed = F.greatest(F.ceil(F.col("height") / viewport), F.lit(1)).cast("int")
    last = F.greatest(F.col("height") - viewport, F.lit(0.0))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(needed, F.lit(tiles)) - 1), lambda i: F.least(i * F.lit(float(viewport)), last)))
    df = pages.select("page_id", "height", needed.alias("needed"), F.posexplode(spots).alias("slice_idx", "scroll_y"))
    return df.select("page_id", "slice_idx", "scroll_y", (F.col("needed") > tiles).alias("truncated"), "needed")


def stitch_layout(slices: DataFrame, dpr: float) -> tuple[DataFrame, DataFrame]:
    """(placed slices with draw_y, canvas size per page) of slices (page_id, slice_idx, scroll_y, width_px, height_px)."""
    placed = slices.withColumn("draw_y", G.js_round(F.col("scroll_y") * dpr))
    canvas = placed.groupBy("page_id").agg(F.max("width_px").alias("canvas_w"), F.max(F.col("draw_y") + F.col("height_px")).alias("canvas_h"))
    return placed, canvas
