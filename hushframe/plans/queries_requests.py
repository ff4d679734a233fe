"""Queries of boxes, regions, requests and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import boxes as B
from hushframe.operators import frames as J
from hushframe.operators import requests as Q
from hushframe.plans import pipelines
from hushframe.views import view, with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_AREA = "(xmax - xmin) * (ymax - ymin)"


def of(name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: build(view(spark, sf, name))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "regions").withColumn("source", Q.infer_source(F.col("given"), F.col("agent_id")))


QUERIES["c19_privacy_labels"] = (of("boxes", B.keep_privacy_labels), f"{with_views('boxes')} SELECT * FROM boxes WHERE lower(label) IN ('person', 'book')")
_CAPPED = f"""b AS (SELECT b.*, {_AREA} AS area, i.width * i.height AS total FROM boxes b LEFT JOIN images i ON b.image_id = i.image_id),
f AS (SELECT * FROM b WHERE total IS NULL OR area / total <= 0.5),
s AS (SELECT *, sum(area) OVER (PARTITION BY image_id ORDER BY area, box_idx ROWS UNBOUNDED PRECEDING) AS running FROM f)"""
QUERIES["a2_area_cap"] = (lambda spark, sf: B.area_cap(view(spark, sf, "boxes"), view(spark, sf, "images")), f"{with_views('boxes', 'images')}, {_CAPPED} SELECT image_id, box_idx, label, score, xmin, ymin, xmax, ymax FROM s WHERE total IS NULL OR running / total <= 0.65")

_NMS = """r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, box_idx) AS n FROM boxes),
fold(image_id, label, n, kept) AS (
  SELECT image_id, label, n, [struct_pack(i := box_idx, a := xmin, b := ymin, c := xmax, d := ymax)] FROM r WHERE n = 1
  UNION ALL
  SELECT r.image_id, r.label, r.n, CASE WHEN len(list_filter(f.kept, lambda k: greatest(0, least(k.c, r.xmax) - greatest(k.a, r.xmin)) * greatest(0, least(k.d, r.ymax) - greatest(k.b, r.ymin))
    / ((k.c - k.a) * (k.d - k.b) + (r.xmax - r.xmin) * (r.ymax - r.ymin) - greatest(0, least(k.c, r.xmax) - greatest(k.a, r.xmin)) * greatest(0, least(k.d, r.ymax) - greatest(k.b, r.ymin)) + 1e-9) > 0.45)) > 0
    THEN f.kept ELSE list_append(f.kept, struct_pack(i := r.box_idx, a := r.xmin, b := r.ymin, c := r.xmax, d := r.ymax)) END
  FROM fold f JOIN r ON f.image_id = r.image_id AND f.label = r.label AND r.n = f.n + 1
), last AS (SELECT image_id, label, arg_max(kept, n) AS kept FROM fold GROUP BY image_id, label)"""
QUERIES["r9_nms"] = (of("boxes", lambda df: B.nms(df).select("image_id", "label", "box_idx")), f"{with_views('boxes').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_NMS} SELECT image_id, label, k.i AS box_idx FROM (SELECT image_id, label, unnest(kept) AS k FROM last)")
_SWEPT = _NMS.replace("FROM boxes)", "FROM many)").replace("PARTITION BY image_id, label", "PARTITION BY t, image_id, label").replace("fold(image_id,", "fold(t, image_id,").replace("SELECT image_id, label, n, [", "SELECT t, image_id, label, n, [").replace("SELECT r.image_id,", "SELECT r.t, r.image_id,").replace("ON f.image_id", "ON f.t = r.t AND f.image_id").replace("last AS (SELECT image_id, label, arg_max(kept, n) AS kept FROM fold GROUP BY image_id, label)", "last AS (SELECT t, image_id, label, arg_max(kept, n) AS kept FROM fold GROUP BY t, image_id, label)")
QUERIES["a6_threshold_sweep"] = (of("boxes", lambda df: B.threshold_sweep(df, [0.3, 0.5, 0.7])), f"""{with_views('boxes').replace('WITH ', 'WITH RECURSIVE ', 1)}, many AS (SELECT t, b.* FROM boxes b, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(t) WHERE score >= t), {_SWEPT}
SELECT a.t AS threshold, a.label, a.n AS before, b.n AS after FROM (SELECT t, label, count(*) AS n FROM many GROUP BY t, label) a JOIN (SELECT t, label, CAST(sum(len(kept)) AS BIGINT) AS n FROM last GROUP BY t, label) b ON a.t = b.t AND a.label = b.label""")
QUERIES["a7_class_coverage"] = (of("boxes", lambda df: B.class_coverage(df, ["person", "Book", "chair"])), f"{with_views('boxes')} SELECT c.label, count(b.label) AS n, count(b.label) > 0 AS present FROM (VALUES ('person'), ('Book'), ('chair')) c(label) LEFT JOIN boxes b ON c.label = b.label GROUP BY c.label")


def _decode(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    box = [(F.get("embedding", F.lit(k)).cast("double") * 100).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))]
    anchors = v.select(F.col("label").alias("image_id"), F.col("vec_id").alias("anchor_idx"), *box, F.transform(F.slice("embedding", 5, 6), lambda x: x.cast("double")).alias("scores"))
    return B.decode_predictions(anchors, ["button", "field", "link"], 0.1)


_S = "list_transform(embedding[5:10], lambda x: CAST(x AS DOUBLE))"
_COORD = {c: f"CAST(embedding[{k}] AS DOUBLE) * 100" for k, c in enumerate(("cx", "cy", "w", "h"), 1)}
QUERIES["g8_decode_predictions"] = (_decode, f"""WITH t AS (SELECT label AS image_id, vec_id AS box_idx, list_max({_S}) AS score, list_position({_S}, list_max({_S})) - 1 AS k, {', '.join(f'{e} AS {c}' for c, e in _COORD.items())} FROM embeddings)
SELECT image_id, box_idx, CASE k WHEN 0 THEN 'button' WHEN 1 THEN 'field' WHEN 2 THEN 'link' ELSE 'class_' || k END AS label, score, cx - w / 2 AS xmin, cy - h / 2 AS ymin, cx + w / 2 AS xmax, cy + h / 2 AS ymax FROM t WHERE score >= 0.1""")


def _scroll(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return B.scroll_targets(docs.select(F.col("doc_id").alias("page_id"), F.col("n_chars").cast("double").alias("height")), 800.0)


QUERIES["g9_scroll_targets"] = (_scroll, """WITH p AS (SELECT doc_id AS page_id, CAST(n_chars AS DOUBLE) AS height, CAST(greatest(ceil(n_chars / 800.0), 1) AS INT) AS needed FROM documents),
t AS (SELECT page_id, needed, height, unnest(range(0, least(needed, 5))) AS slice_idx FROM p)
SELECT page_id, CAST(slice_idx AS INT) AS slice_idx, least(slice_idx * 800.0, greatest(height - 800, 0)) AS scroll_y, needed > 5 AS truncated, needed FROM t""")


def _stitch(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS page_id", "l_linenumber AS slice_idx", "CAST(l_quantity * 13 AS DOUBLE) AS scroll_y", "CAST(l_partkey AS DOUBLE) AS width_px", "CAST(l_suppkey AS DOUBLE) AS height_px")
    return B.stitch_layout(s, 1.5)[1]


QUERIES["g10_stitch_layout"] = (_stitch, "SELECT l_orderkey AS page_id, max(CAST(l_partkey AS DOUBLE)) AS canvas_w, max(floor(l_quantity * 13 * 1.5 + 0.5) + l_suppkey) AS canvas_h FROM lineitem GROUP BY l_orderkey")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    flagged = view(spark, sf, "nodes").where("sensitive").select(F.col("page_id").alias("image_id"), F.col("node_idx").alias("seq"), F.expr("CASE WHEN node_idx % 2 = 0 THEN 'tel' ELSE 'iban' END").alias("pii_type"), *"xywh", "agent_id")
    return B.build_regions(view(spark, sf, "boxes"), flagged, 2.0)


QUERIES["a1_build_regions"] = (_regions, f"""{with_views('boxes', 'nodes')}, u AS (
SELECT image_id, 0 AS part, box_idx AS seq, 'other' AS type, label AS raw_type, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, CAST(NULL AS VARCHAR) AS agent_id, 'vision' AS source FROM boxes
UNION ALL SELECT page_id, 1, node_idx, CASE WHEN node_idx % 2 = 0 THEN 'tel' ELSE 'other' END, CASE WHEN node_idx % 2 = 1 THEN 'iban' END, x * 2, y * 2, w * 2, h * 2, agent_id, 'dom' FROM nodes WHERE sensitive AND x IS NOT NULL)
SELECT image_id, type, raw_type, x, y, w, h, agent_id, source, CAST(row_number() OVER (PARTITION BY image_id ORDER BY part, seq) - 1 AS INT) AS region_idx FROM u""")


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    """All boxes against a second detector's: moved a little, some far away, scores halved."""
    b = view(spark, sf, "boxes")
    return B.detection_diff(b, b.withColumn("xmin", F.expr(_MOVED.format("xmin"))).withColumn("xmax", F.expr(_MOVED.format("xmax"))).withColumn("score", F.col("score") / 2), 0.8)


_MOVED = "{0} + CASE WHEN box_idx % 5 = 0 THEN 5000 ELSE box_idx % 4 END"
_INTER = "greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
QUERIES["j11_detection_diff"] = (_diff, f"""{with_views('boxes')}, other AS (SELECT image_id, box_idx, label, score / 2 AS score, {_MOVED.format('xmin')} AS xmin, ymin, {_MOVED.format('xmax')} AS xmax, ymax FROM boxes),
i AS (SELECT a.image_id, a.label, a.box_idx AS ai, b.box_idx AS bi, {_INTER} AS inter, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS one, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS two,
  greatest(abs(a.xmin - b.xmin), abs(a.ymin - b.ymin), abs(a.xmax - b.xmax), abs(a.ymax - b.ymax)) AS drift, abs(a.score - b.score) AS delta FROM boxes a JOIN other b ON a.image_id = b.image_id AND a.label = b.label),
p AS (SELECT *, inter / (one + two - inter + 1e-9) AS iou FROM i), g AS (SELECT *, row_number() OVER (PARTITION BY image_id, label, ai ORDER BY iou DESC, bi) AS ra, row_number() OVER (PARTITION BY image_id, label, bi ORDER BY iou DESC, ai) AS rb FROM p WHERE iou >= 0.8),
m AS (SELECT image_id, label, count(*) AS matched, max(drift) AS max_drift, max(delta) AS max_score_delta FROM g WHERE ra = 1 AND rb = 1 GROUP BY image_id, label), n AS (SELECT image_id, label, count(*) AS n FROM boxes GROUP BY image_id, label)
SELECT n.image_id, n.label, coalesce(matched, 0) AS matched, n - coalesce(matched, 0) AS missing, n - coalesce(matched, 0) AS extra, max_drift, max_score_delta FROM n LEFT JOIN m ON n.image_id = m.image_id AND n.label = m.label""")
_SINGLE = _NMS.replace("FROM boxes)", "FROM boxes WHERE lower(label) IN ('person', 'book'))")


def _report(spark: SparkSession, sf: str) -> pipelines.DetectorReport:
    """The boxes as a detector's anchors in letterboxed pixels, one class score each."""
    labels = ["person", "Book", "laptop"]
    half = [f"({a} + {b}) / 2 * 0.5 + {pad}" for a, b, pad in (("xmin", "xmax", 8), ("ymin", "ymax", 16))]
    scores = F.array(*[F.when(F.col("label") == c, F.col("score")).otherwise(0.0) for c in labels])
    anchors = view(spark, sf, "boxes").select("image_id", F.col("box_idx").alias("anchor_idx"), F.expr(half[0]).alias("cx"), F.expr(half[1]).alias("cy"), F.expr("(xmax - xmin) * 0.5").alias("w"), F.expr("(ymax - ymin) * 0.5").alias("h"), scores.alias("scores"))
    images = view(spark, sf, "images").select("*", F.lit(8.0).alias("pad_x"), F.lit(16.0).alias("pad_y"), F.lit(0.5).alias("ratio"))
    timings = view(spark, sf, "boxes").where("image_id % 5 <> 0").select("image_id", F.col("box_idx").alias("seq"), (F.col("score") * 2000).alias("ms"))
    return pipelines.detector_report(anchors, images, timings, labels, 0.1, [0.3, 0.5, 0.7])


_SOUND = f"""{with_views('boxes', 'images').replace('WITH ', 'WITH RECURSIVE ', 1).replace('boxes AS', 'every AS')}, boxes AS (SELECT * FROM every WHERE score >= 0.1 AND image_id IN (SELECT image_id FROM images))"""
QUERIES["p4_detector_report"] = (lambda spark, sf: _report(spark, sf).images, f"""{_SOUND}, {_SINGLE}, single AS (SELECT b.* FROM (SELECT unnest(kept) AS k FROM last) x JOIN boxes b ON b.box_idx = x.k.i),
{_CAPPED.replace('FROM boxes b', 'FROM single b')}, cap AS (SELECT image_id, count(*) AS n FROM s WHERE total IS NULL OR running / total <= 0.65 GROUP BY image_id),
t AS (SELECT image_id, score * 2000 AS ms, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) AS n FROM every WHERE image_id % 5 <> 0),
l AS (SELECT image_id, max(ms) FILTER (WHERE n = 1) AS cold_ms, count(*) FILTER (WHERE n > 1) AS warm_runs, median(ms) FILTER (WHERE n > 1) AS warm_median_ms FROM t GROUP BY image_id)
SELECT a.image_id, a.total, a.after_class, coalesce(c.n, 0) AS after_nms, coalesce(d.n, 0) AS after_cap, l.cold_ms, l.warm_runs, l.warm_median_ms, coalesce(l.warm_median_ms < 1000, false) AS within_gate FROM (SELECT image_id, count(*) AS total, count(*) FILTER (WHERE lower(label) IN ('person', 'book')) AS after_class FROM boxes GROUP BY image_id) a
LEFT JOIN (SELECT image_id, count(*) AS n FROM single GROUP BY image_id) c ON a.image_id = c.image_id LEFT JOIN cap d ON a.image_id = d.image_id LEFT JOIN l ON a.image_id = l.image_id""")
QUERIES["p4_threshold_sweep"] = (lambda spark, sf: _report(spark, sf).sweep, QUERIES["a6_threshold_sweep"][1])

_RAW = "text IS NOT NULL AND trim(text) <> ''"
_LEAKS = f"""rg AS (SELECT *, coalesce(given, CASE WHEN agent_id IS NOT NULL THEN 'dom' ELSE 'vision' END) AS source FROM regions),
found AS (
  SELECT n.request_id, n.agent_id, r.region_idx, 1 AS strategy, n.node_idx FROM nodes n JOIN rg r ON n.request_id = r.request_id AND n.agent_id = r.agent_id WHERE {_RAW.replace('text', 'n.text')}
  UNION ALL SELECT n.request_id, n.agent_id, r.region_idx, 2, n.node_idx FROM nodes n JOIN rg r ON n.request_id = r.request_id WHERE r.source = 'dom' AND n.x IS NOT NULL AND n.w > 0 AND n.h > 0 AND {_RAW.replace('text', 'n.text')}
    AND greatest(0, least(r.x + r.w, n.x + n.w) - greatest(r.x, n.x)) * greatest(0, least(r.y + r.h, n.y + n.h) - greatest(r.y, n.y)) / (n.w * n.h) > 0.5
  UNION ALL SELECT request_id, agent_id, NULL, 3, node_idx FROM nodes WHERE sensitive AND {_RAW}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, agent_id ORDER BY region_idx NULLS LAST, strategy, node_idx) AS n FROM found)"""
QUERIES["j3_find_leaks"] = (lambda spark, sf: Q.find_leaks(view(spark, sf, "nodes"), regions(spark, sf)), f"{with_views('nodes', 'regions')}, {_LEAKS} SELECT request_id, agent_id, region_idx, strategy FROM ranked WHERE n = 1")
QUERIES["v4_infer_source"] = (lambda spark, sf: regions(spark, sf).select("request_id", "region_idx", "source"), f"{with_views('regions')} SELECT request_id, region_idx, coalesce(given, CASE WHEN agent_id IS NOT NULL THEN 'dom' ELSE 'vision' END) AS source FROM regions")
QUERIES["v1_sanitize_nodes"] = (of("nodes", lambda df: Q.sanitize_nodes(df.withColumn("pii", F.expr("CASE WHEN node_idx % 17 = 0 THEN 'email' WHEN node_idx % 17 = 1 THEN '' END")), "pii").select("node_idx", "text", "sensitive")), f"{with_views('nodes')} SELECT node_idx, CASE WHEN NOT (sensitive OR node_idx % 17 = 0) THEN text END AS text, sensitive OR node_idx % 17 = 0 AS sensitive FROM nodes")


def _egress(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "nodes")
    sent = F.expr("CASE WHEN node_idx % 4 = 0 THEN text ELSE substr(text, 3) END")
    payloads = nodes.groupBy("request_id").agg(F.concat_ws("|", F.sort_array(F.collect_set(sent))).alias("payload"))
    return Q.egress_check(payloads, nodes.where("sensitive").select("request_id", "agent_id", F.lit(None).cast("string").alias("value"), "text"))


QUERIES["j4_egress_check"] = (_egress, f"""{with_views('nodes')}, s AS (SELECT request_id, CASE WHEN node_idx % 4 = 0 THEN text ELSE substr(text, 3) END AS sent FROM nodes), p AS (SELECT request_id, string_agg(DISTINCT sent, '|') AS payload FROM s GROUP BY request_id)
SELECT DISTINCT n.request_id, n.agent_id FROM nodes n JOIN p ON n.request_id = p.request_id WHERE n.sensitive AND length(trim(n.text)) >= 3 AND contains(p.payload, trim(n.text))""")

QUERIES["v5_validate_actions"] = (of("actions", lambda df: Q.validate_actions(df).select("step", "error_code", "value")), f"""{with_views('actions')} SELECT step, CASE WHEN action = 'fill_profile' AND value IS NOT NULL THEN 'MODEL_SUPPLIED_PROFILE_VALUE' WHEN action = 'hover' OR target_id = '' OR (action = 'fill_profile') <> (profile_field IS NOT NULL) THEN 'VLM_RESPONSE_SCHEMA_INVALID' END AS error_code, CASE WHEN action <> 'fill_profile' THEN value END AS value FROM actions""")
QUERIES["v7_drop_model_value"] = (of("actions", lambda df: Q.drop_model_value(df).select("step", "value")), f"{with_views('actions')} SELECT step, CASE WHEN action <> 'fill_profile' THEN value END AS value FROM actions")


def _first(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with nodes, and as many without any."""
    nodes = view(spark, sf, "nodes")
    every = nodes.select(F.explode(F.array("request_id", -F.col("request_id"))).alias("request_id")).distinct()
    return Q.first_safe_target(every, nodes, view(spark, sf, "regions"))


_FIELD = "CASE WHEN type = 'email' THEN CASE WHEN text IS NULL OR trim(text) = '' THEN 'email' END WHEN type = 'tel' THEN CASE WHEN text IS NULL OR trim(text) = '' THEN 'phone' END WHEN regexp_matches(lower(coalesce(text, '')), '\\bname\\b') AND text NOT LIKE '%user%' THEN 'full_name' END"
QUERIES["r12_first_safe_target"] = (_first, f"""{with_views('nodes', 'regions')}, s AS (SELECT *, {_FIELD} AS field FROM nodes n WHERE NOT sensitive AND NOT EXISTS (SELECT 1 FROM regions r WHERE r.request_id = n.request_id AND r.agent_id = n.agent_id)),
k AS (SELECT *, CASE WHEN field IS NOT NULL THEN 1 WHEN type IN ('text', 'email', 'tel', 'search', 'password') THEN 2 ELSE 3 END AS rule FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rule, node_idx) AS n FROM k)
SELECT q.request_id, CASE rule WHEN 1 THEN 'fill_profile' WHEN 2 THEN 'type' WHEN 3 THEN 'click' ELSE 'done' END AS action, coalesce(f.agent_id, 'page') AS target_id, f.field AS profile_field FROM (SELECT request_id FROM nodes UNION SELECT -request_id FROM nodes) q LEFT JOIN f ON q.request_id = f.request_id AND f.n = 1""")

#: Frames made from suppliers (reports) and customers (tokens).
_REPORTS = {"page_id": "s_nationkey", "frame_id": "s_suppkey", "token": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE concat('t', CAST(s_suppkey % 40 AS STRING)) END", "ok": "s_suppkey % 8 <> 0", "agent_id": "concat('agent-f', CAST(s_suppkey AS STRING), '-1')", "x": "CAST(s_suppkey AS DOUBLE)", "y": "CAST(2 * s_suppkey AS DOUBLE)", "w": "CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE CAST(30 AS DOUBLE) END", "h": "CAST(10 AS DOUBLE)"}
_GRID = "FROM nation, (SELECT DISTINCT s_suppkey % 40 AS k FROM supplier)"
_TOKENS = {"page_id": "n_nationkey", "token": "concat('t', CAST(k AS STRING))", "dx": "CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k * 10 AS DOUBLE) END", "dy": "CAST(n_nationkey AS DOUBLE)", "connected": "k % 6 <> 0"}


def _frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    reports = supplier.selectExpr(*[f"{e} AS {c}" for c, e in _REPORTS.items()])
    known = supplier.selectExpr("s_suppkey % 40 AS k").distinct()
    tokens = spark.read.parquet(f"{sf}/nation.parquet").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))).join(known, "k", "left_semi").selectExpr(*[f"{e} AS {c}" for c, e in _TOKENS.items()])
    iframes = tokens.select("page_id", "token", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), (F.col("page_id") % 3 * 1.0).alias("w"), F.lit(5.0).alias("h"))
    return reports, tokens, iframes


_SQL_FRAMES = f"WITH reports AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _REPORTS.items())} FROM supplier), tokens AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _TOKENS.items())} {_GRID}), iframes AS (SELECT page_id, token, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, CAST(page_id % 3 AS DOUBLE) AS w, 5.0::DOUBLE AS h FROM tokens), moved AS (SELECT r.page_id, r.frame_id, r.token, r.agent_id, r.x + t.dx AS x, r.y + t.dy AS y, r.w, r.h FROM reports r JOIN tokens t ON r.page_id = t.page_id AND r.token = t.token WHERE r.ok AND t.connected AND t.dx IS NOT NULL AND r.w IS NOT NULL), whole AS (SELECT i.* FROM iframes i WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.page_id = i.page_id AND m.token = i.token))"
QUERIES["j5_merge_frames"] = (lambda spark, sf: pipelines.merge_subframes(*_frames(spark, sf))[0], f"{_SQL_FRAMES} SELECT * FROM moved")
QUERIES["j5_dropped_frames"] = (lambda spark, sf: J.merge_frames(*_frames(spark, sf)[:2])[1], f"""{_SQL_FRAMES} SELECT r.page_id, r.frame_id, r.token, r.agent_id, CASE WHEN NOT r.ok THEN 'report_failed' WHEN r.token IS NULL THEN 'no_token' WHEN NOT coalesce(t.connected, false) THEN 'token_not_connected' WHEN t.dx IS NULL THEN 'offset_unresolved' ELSE 'bbox_not_finite' END AS reason
FROM reports r LEFT JOIN tokens t ON r.page_id = t.page_id AND r.token = t.token WHERE NOT (r.ok AND coalesce(t.connected, false) AND t.dx IS NOT NULL AND r.w IS NOT NULL)""")
QUERIES["j6_defensive_regions"] = (lambda spark, sf: pipelines.merge_subframes(*_frames(spark, sf))[1], f"{_SQL_FRAMES} SELECT * FROM whole")
QUERIES["a10_frame_counts"] = (lambda spark, sf: pipelines.merge_subframes(*_frames(spark, sf))[2], f"""{_SQL_FRAMES}, a AS (SELECT page_id, count(DISTINCT frame_id) AS reported FROM reports GROUP BY page_id), b AS (SELECT page_id, count(DISTINCT frame_id) AS merged FROM moved GROUP BY page_id), c AS (SELECT page_id, count(*) AS defensive FROM whole GROUP BY page_id)
SELECT coalesce(a.page_id, c.page_id) AS page_id, coalesce(reported, 0) AS reported, coalesce(merged, 0) AS merged, coalesce(reported, 0) - coalesce(merged, 0) AS dropped, coalesce(defensive, 0) AS defensive FROM a FULL JOIN c ON a.page_id = c.page_id LEFT JOIN b ON a.page_id = b.page_id""")


def _redact(spark: SparkSession, sf: str) -> DataFrame:
    """Both outputs in one table: regions, then nodes."""
    nodes = view(spark, sf, "nodes")
    flagged = nodes.where("sensitive").select(F.col("page_id").alias("image_id"), F.col("node_idx").alias("seq"), F.lit("email").alias("pii_type"), *"xywh", "agent_id")
    regions, clean = pipelines.redact(view(spark, sf, "boxes"), flagged, nodes, 1.0)
    regions = regions.select(F.lit("region").alias("part"), "image_id", F.col("region_idx").cast("long").alias("idx"), F.concat_ws("|", "type", "source", "x", "y", "w", "h").alias("body"), F.lit(True).alias("sensitive"))
    return regions.unionByName(clean.select(F.lit("node").alias("part"), F.col("page_id").alias("image_id"), F.col("node_idx").cast("long").alias("idx"), F.col("text").alias("body"), "sensitive"))


QUERIES["v2_redact"] = (_redact, f"""{with_views('boxes', 'nodes')}, u AS (
SELECT image_id, 0 AS part, box_idx AS seq, 'other' AS type, 'vision' AS source, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h FROM boxes
UNION ALL SELECT page_id, 1, node_idx, 'email', 'dom', x, y, w, h FROM nodes WHERE sensitive AND x IS NOT NULL)
SELECT 'region' AS part, image_id, row_number() OVER (PARTITION BY image_id ORDER BY part, seq) - 1 AS idx, concat_ws('|', type, source, x, y, w, h) AS body, true AS sensitive FROM u
UNION ALL SELECT 'node', page_id, node_idx, CASE WHEN NOT sensitive THEN text END, sensitive FROM nodes""")
QUERIES["u1_union_nodes"] = (lambda spark, sf: view(spark, sf, "nodes").select("page_id", "agent_id").unionByName(_frames(spark, sf)[0].select("page_id", "agent_id")), f"{_SQL_FRAMES}, {with_views('nodes')[5:]} SELECT CAST(page_id AS BIGINT) AS page_id, agent_id FROM nodes UNION ALL SELECT page_id, agent_id FROM reports")

