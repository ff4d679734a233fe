"""Queries of run logs, actions, profiles and ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import text as X
from hushframe.operators import frames as J
from hushframe.operators import rank as R
from hushframe.operators import runs as L
from hushframe.plans import pipelines
from hushframe.views import view, with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def of(name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: build(view(spark, sf, name))


_W = "OVER (PARTITION BY run_id ORDER BY seq)"
QUERIES["r6_stage_deltas"] = (of("marks", lambda df: L.stage_deltas(df).select("seq", "delta_ms", "since_start_ms")), f"{with_views('marks')} SELECT seq, floor((ts_ms - lag(ts_ms) {_W}) * 10 + 0.5) / 10 AS delta_ms, floor((ts_ms - first_value(ts_ms) {_W}) * 10 + 0.5) / 10 AS since_start_ms FROM marks")
_KINDS = ["error", "click", "view", "purchase", "signup", "scroll"]
QUERIES["a4_stage_counts"] = (of("marks", lambda df: L.count_kinds(df, ["run_id", "step"], {f"n_{k}": F.col("stage") == k for k in _KINDS})), f"{with_views('marks')} SELECT run_id, step, {', '.join(f'count(*) FILTER (WHERE stage = {k!r}) AS n_{k}' for k in _KINDS)} FROM marks GROUP BY run_id, step")
QUERIES["a5_latency_summary"] = (of("marks", lambda df: L.latency_summary(df.where("heap_mb is not null").select("run_id", "seq", (F.col("heap_mb") * 100).alias("ms")))), f"{with_views('marks')}, t AS (SELECT run_id, heap_mb * 100 AS ms, row_number() {_W} AS n FROM marks WHERE heap_mb IS NOT NULL) SELECT run_id, max(ms) FILTER (WHERE n = 1) AS cold_ms, count(*) FILTER (WHERE n > 1) AS warm_runs, median(ms) FILTER (WHERE n > 1) AS warm_median_ms, coalesce(median(ms) FILTER (WHERE n > 1) < 1000, false) AS within_gate FROM t GROUP BY run_id")
_SIG = "concat(action, ':', target_id, ':', coalesce(value, ''))"
QUERIES["r7_action_signature"] = (of("actions", lambda df: df.select("step", L.action_signature(F.col("action"), F.col("target_id"), F.col("value")).alias("signature"))), f"{with_views('actions')} SELECT step, {_SIG} AS signature FROM actions")
_LAGS = ", ".join(f"lag(sig, {k}) OVER w AS s{k}" for k in range(1, 6))
QUERIES["r8_detect_stalls"] = (of("actions", L.detect_stalls), f"""{with_views('actions')}, t AS (SELECT run_id, step, {_SIG} AS sig FROM actions WHERE action <> 'done'),
l AS (SELECT run_id, step, sig AS s0, {_LAGS} FROM t WINDOW w AS (PARTITION BY run_id ORDER BY step)),
p AS (SELECT run_id, step, CASE WHEN s0 = s1 AND s1 = s2 THEN 1 WHEN s0 = s2 AND s1 = s3 THEN 2 WHEN s0 = s3 AND s1 = s4 AND s2 = s5 THEN 3 END AS period FROM l)
SELECT run_id, min(step) AS step, CAST(arg_min(period, step) AS INT) AS period FROM p WHERE period IS NOT NULL GROUP BY run_id""")
QUERIES["k3_recent_signatures"] = (of("actions", lambda df: L.recent_signatures(df).select("step", F.array_join("recent", "|").alias("recent"))), f"{with_views('actions')} SELECT step, array_to_string(list({_SIG}) OVER (PARTITION BY run_id ORDER BY step ROWS 5 PRECEDING), '|') AS recent FROM actions")
QUERIES["r13_rate_limit_audit"] = (of("marks", lambda df: L.rate_limit_audit(df.select("run_id", "seq", "ts_ms"), 5000).select("seq", F.col("wait_ms").cast("double").alias("wait_ms"), "violation")), f"{with_views('marks')}, t AS (SELECT seq, coalesce(greatest(0, 5000 - (ts_ms - lag(ts_ms) OVER (PARTITION BY run_id ORDER BY ts_ms))), 0) AS wait_ms FROM marks) SELECT seq, CAST(wait_ms AS DOUBLE) AS wait_ms, wait_ms > 0 AS violation FROM t")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    w = "row_number() OVER (PARTITION BY run_id, step ORDER BY attempt_at)"
    return L.attempt_stats(view(spark, sf, "sends").withColumn("attempt", F.expr(f"CAST({w} AS INT)")).withColumn("ts_ms", F.col("ts_ms") / 10))


QUERIES["r14_attempt_stats"] = (_attempts, f"""{with_views('sends')}, t AS (SELECT run_id, step, error_class, retryable, ts_ms / 10 AS ts, CAST(row_number() OVER (PARTITION BY run_id, step ORDER BY attempt_at) AS INT) AS attempt FROM sends),
g AS (SELECT *, ts - lag(ts) OVER w AS gap, lead(attempt) OVER w AS later, 1000 * pow(2, attempt - 2) AS policy FROM t WINDOW w AS (PARTITION BY run_id, step ORDER BY attempt))
SELECT run_id, step, max(attempt) AS attempts, arg_max_null(error_class, attempt) AS last_class, count(*) FILTER (WHERE gap IS NOT NULL AND NOT gap BETWEEN policy * 0.7 AND policy * 1.3) AS off_policy,
max(attempt) >= 3 AND arg_max(error_class IS NOT NULL, attempt) AS gave_up, bool_or(later IS NOT NULL AND error_class IS NOT NULL AND NOT retryable) AS retried_final FROM g GROUP BY run_id, step""")


_ENDED = "CASE WHEN run_id % 3 = 1 THEN NULL WHEN stage = 'error' AND seq % 3 = 0 THEN 'act_failed' WHEN stage = 'purchase' AND seq % 5 = 0 THEN 'done' END"
_STEP = "CASE WHEN run_id % 2 = 0 THEN step + 1 ELSE least(step, 20) END"


def _outcomes(df: DataFrame) -> DataFrame:
    return L.run_outcomes(df.select("run_id", F.expr(_STEP).alias("step"), (F.col("seq") % 4).alias("stage_rank"), F.expr(_ENDED).alias("outcome")))


QUERIES["r15_run_outcomes"] = (of("marks", _outcomes), f"""{with_views('marks')}, t AS (SELECT run_id, {_STEP} AS step, seq % 4 AS stage_rank, {_ENDED} AS outcome FROM marks),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, stage_rank, outcome) AS n FROM t WHERE outcome IS NOT NULL), m AS (SELECT run_id, max(step) AS last FROM t GROUP BY run_id)
SELECT m.run_id, coalesce(r.outcome, CASE WHEN last >= 25 THEN 'max_steps_reached' END) AS outcome, coalesce(r.step, last) AS step FROM m LEFT JOIN r ON m.run_id = r.run_id AND r.n = 1""")
_R15 = QUERIES["r15_run_outcomes"][1]
QUERIES["a3_run_summary"] = (
    of("marks", lambda df: L.run_summary(df, _outcomes(df)).withColumn("stages", F.array_join("stages", ","))),
    f"""WITH ended AS ({_R15}), {with_views('marks')[5:]}, a AS (SELECT run_id, max(ts_ms) - min(ts_ms) AS total_ms, max(step) AS total_steps, max(heap_mb) AS peak_heap_mb, count(heap_mb) > 0 AS memory_known, string_agg(stage, ',' ORDER BY seq) AS stages FROM marks GROUP BY run_id)
SELECT a.*, e.outcome FROM a LEFT JOIN ended e ON a.run_id = e.run_id""",
)
_PATCH = "concat('{\"stage\":\"', event_type, '\"', CASE event_id % 4 WHEN 0 THEN ',\"lastError\":null' WHEN 1 THEN concat(',\"lastError\":\"e', CAST(event_id AS STRING), '\"') ELSE '' END, '}')"


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(_PATCH).alias("patch"))


QUERIES["t2_fold_patches"] = (lambda spark, sf: L.fold_patches(_patches(spark, sf)), """WITH t AS (SELECT user_id AS run_id, event_id AS seq, 'stage' AS field, event_type AS value FROM events UNION ALL SELECT user_id, event_id, 'lastError', CASE WHEN event_id % 4 = 1 THEN 'e' || event_id END FROM events WHERE event_id % 4 < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY seq DESC) AS n FROM t) SELECT run_id, field, value FROM r WHERE n = 1""")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run and agent id."""
    return view(spark, sf, "run_nodes").groupBy("run_id", "agent_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", "agent_id", (F.col("n") % 7 != 0).alias("connected"), (F.col("n") % 5 == 0).alias("sensitive"), F.expr("CASE WHEN n % 4 = 1 THEN 'Buy now' ELSE 'Home' END").alias("text"))


_SQL_NODES = "rn AS (SELECT run_id, agent_id, count(*) % 7 <> 0 AS connected, count(*) % 5 = 0 AS sensitive, CASE WHEN count(*) % 4 = 1 THEN 'Buy now' ELSE 'Home' END AS text FROM run_nodes GROUP BY run_id, agent_id)"
QUERIES["j1_flag_sensitive"] = (lambda spark, sf: J.flag_sensitive(view(spark, sf, "nodes"), view(spark, sf, "regions").withColumnRenamed("request_id", "page_id")).select("page_id", "agent_id", "sensitive"), f"{with_views('nodes', 'regions')} SELECT page_id, agent_id, sensitive OR EXISTS (SELECT 1 FROM regions r WHERE r.request_id = n.page_id AND r.agent_id = n.agent_id) AS sensitive FROM nodes n")


def _unacted(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that marks name, but for those that a run has clicked or typed into."""
    nodes = view(spark, sf, "marks").select("run_id", F.expr("concat('agent-', CAST(seq % 61 AS STRING))").alias("agent_id")).distinct()
    return J.drop_acted(nodes, view(spark, sf, "actions").withColumn("target_id", F.expr("concat('agent-', CAST(step % 61 AS STRING))"))).select("run_id", "agent_id")


QUERIES["j2_drop_acted"] = (_unacted, f"{with_views('marks', 'actions')}, m AS (SELECT DISTINCT run_id, concat('agent-', seq % 61) AS agent_id FROM marks) SELECT run_id, agent_id FROM m WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.run_id = m.run_id AND concat('agent-', a.step % 61) = m.agent_id AND a.action IN ('click', 'type'))")
QUERIES["j7_resolve_targets"] = (lambda spark, sf: J.resolve_targets(view(spark, sf, "actions"), _nodes(spark, sf)).select("run_id", "step", "resolution"), f"{with_views('run_nodes', 'actions')}, {_SQL_NODES} SELECT a.run_id, a.step, CASE WHEN rn.agent_id IS NULL THEN 'TARGET_NOT_FOUND' WHEN NOT rn.connected THEN 'TARGET_DETACHED' END AS resolution FROM actions a LEFT JOIN rn ON a.run_id = rn.run_id AND a.target_id = rn.agent_id")


def risk() -> Column:
    return X.risk_reasons({"text": F.col("n_text")}, F.col("action"), F.col("value"))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return J.long_profiles(view(spark, sf, "profiles"))


def _guarded(spark: SparkSession, sf: str) -> DataFrame:
    profiles = _profiles(spark, sf).withColumnRenamed("user_id", "run_id")
    return J.guard_actions(view(spark, sf, "actions"), _nodes(spark, sf), profiles, risk).select("run_id", "step", "verdict")


_LONG = "pr AS (SELECT user_id, 'full_name' AS field, nullif(trim(full_name), '') AS value FROM profiles UNION ALL SELECT user_id, 'email', nullif(trim(email), '') FROM profiles UNION ALL SELECT user_id, 'phone', nullif(trim(phone), '') FROM profiles)"
_VERDICTS = """SELECT a.run_id, a.step, CASE WHEN action = 'hover' THEN 'UNKNOWN_ACTION' WHEN target_id = '' THEN 'MISSING_TARGET_ID' WHEN target_id = 'page' AND action NOT IN ('scroll', 'done') THEN 'INVALID_TARGET_FOR_ACTION'
WHEN action = 'fill_profile' AND profile_field IS NULL THEN 'INVALID_PROFILE_FIELD' WHEN target_id = 'page' THEN 'ok' WHEN rn.agent_id IS NULL THEN 'TARGET_NOT_FOUND' WHEN NOT rn.connected THEN 'TARGET_DETACHED'
WHEN rn.sensitive AND action <> 'fill_profile' THEN 'SENSITIVE_TARGET_BLOCKED' WHEN action IN ('click', 'type') AND rn.text = 'Buy now' THEN 'IRREVERSIBLE_ACTION_BLOCKED'
WHEN action = 'fill_profile' AND pr.value IS NULL THEN 'PROFILE_FIELD_EMPTY' ELSE 'ok' END AS verdict
FROM actions a LEFT JOIN rn ON a.run_id = rn.run_id AND a.target_id = rn.agent_id LEFT JOIN pr ON pr.user_id = a.run_id AND pr.field = a.profile_field"""
QUERIES["j8_guard_actions"] = (_guarded, f"""{with_views('run_nodes', 'actions', 'profiles')}, {_SQL_NODES}, {_LONG}
{_VERDICTS}""")
QUERIES["j9_fill_profile"] = (lambda spark, sf: J.fill_profile(view(spark, sf, "actions"), _profiles(spark, sf)).select("step", "status", "value_length"), f"{with_views('actions', 'profiles')}, {_LONG} SELECT a.step, CASE WHEN pr.value IS NULL THEN 'PROFILE_FIELD_EMPTY' ELSE 'filled' END AS status, CAST(coalesce(length(pr.value), 0) AS INT) AS value_length FROM actions a LEFT JOIN pr ON pr.user_id = a.user_id AND pr.field = a.profile_field WHERE a.action = 'fill_profile'")
_CODE = "CASE WHEN action = 'fill_profile' AND value IS NOT NULL THEN 'MODEL_SUPPLIED_PROFILE_VALUE' WHEN action = 'hover' OR target_id = '' OR (action = 'fill_profile') <> (profile_field IS NOT NULL) THEN 'VLM_RESPONSE_SCHEMA_INVALID' END"
QUERIES["p3_audit_runs"] = (lambda spark, sf: pipelines.audit_runs(view(spark, sf, "actions"), _nodes(spark, sf), _profiles(spark, sf).withColumnRenamed("user_id", "run_id"), risk, view(spark, sf, "marks")).withColumn("stages", F.array_join("stages", ",")), f"""{with_views('run_nodes', 'actions', 'profiles', 'marks')}, {_SQL_NODES}, {_LONG}, verdicts AS ({_VERDICTS}),
c AS (SELECT run_id, step, action, {_CODE} AS code, concat(action, ':', target_id, ':', CASE WHEN action <> 'fill_profile' THEN coalesce(value, '') ELSE '' END) AS sig FROM actions),
t AS (SELECT run_id, step, sig FROM c WHERE code IS NULL AND action <> 'done'), l AS (SELECT run_id, step, sig AS s0, {_LAGS} FROM t WINDOW w AS (PARTITION BY run_id ORDER BY step)),
p AS (SELECT run_id, step, CASE WHEN s0 = s1 AND s1 = s2 THEN 1 WHEN s0 = s2 AND s1 = s3 THEN 2 WHEN s0 = s3 AND s1 = s4 AND s2 = s5 THEN 3 END AS period FROM l),
st AS (SELECT run_id, min(step) AS stall_step, CAST(arg_min(period, step) AS INT) AS stall_period FROM p WHERE period IS NOT NULL GROUP BY run_id),
e AS (SELECT c.run_id, c.step, 0 AS rank, CASE WHEN code IS NOT NULL THEN 'analyze_failed' WHEN verdict <> 'ok' THEN 'blocked' WHEN action = 'done' THEN 'done' END AS outcome FROM c JOIN verdicts v ON c.run_id = v.run_id AND c.step = v.step UNION ALL SELECT run_id, stall_step, 1, 'stalled' FROM st),
o AS (SELECT run_id, arg_min(outcome, step * 2 + rank) AS outcome FROM e WHERE outcome IS NOT NULL GROUP BY run_id), n AS (SELECT run_id, max(step) AS last FROM e GROUP BY run_id),
k AS (SELECT c.run_id, count(*) AS n_actions, count(*) FILTER (WHERE code IS NOT NULL) AS n_invalid, count(*) FILTER (WHERE verdict <> 'ok') AS n_blocked FROM c JOIN verdicts v ON c.run_id = v.run_id AND c.step = v.step GROUP BY c.run_id),
m AS (SELECT run_id, max(ts_ms) - min(ts_ms) AS total_ms, max(step) AS total_steps, max(heap_mb) AS peak_heap_mb, count(heap_mb) > 0 AS memory_known, string_agg(stage, ',' ORDER BY seq) AS stages FROM marks GROUP BY run_id)
SELECT k.*, stall_step, stall_period, coalesce(o.outcome, CASE WHEN last >= 25 THEN 'max_steps_reached' END) AS outcome, total_ms, total_steps, peak_heap_mb, memory_known, stages
FROM k LEFT JOIN st ON k.run_id = st.run_id LEFT JOIN o ON k.run_id = o.run_id LEFT JOIN n ON k.run_id = n.run_id LEFT JOIN m ON k.run_id = m.run_id""")

GOAL = ["red", "widget", "button"]
_TERMS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', nullif(text, ''), nullif(role, ''), nullif(type, ''))), '[^a-z0-9]+'), lambda x: length(x) > 1)"
_GOAL = "[" + ", ".join(f"'{g}'" for g in GOAL) + "]"
_SCORES = f"""sc AS (SELECT *, {_TERMS} AS terms FROM nodes), base AS (SELECT *,
CASE WHEN len(terms) = 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform({_GOAL}, lambda g: CASE WHEN list_contains(terms, g) THEN 1.0 WHEN len(list_filter(terms, lambda t: length(t) > 2 AND (contains(t, g) OR contains(g, t)))) > 0 THEN 0.5 ELSE 0.0 END)) / 3) END AS text_s,
CASE WHEN tag IN ('input', 'select', 'button') THEN 1.0 WHEN role IN ('button', 'textbox') THEN 0.9 WHEN tag = 'a' OR role = 'link' THEN 0.5 ELSE 0.35 END AS kind_s,
CASE WHEN x IS NULL THEN 0.4 WHEN w <= 0 OR h <= 0 THEN 0.05 WHEN greatest(0, least(x + w, 1280) - x) * greatest(0, least(y + h, 800) - y) <= 0 THEN 0.1 ELSE 0.2 + 0.8 * least(1, greatest(0, least(x + w, 1280) - x) * greatest(0, least(y + h, 800) - y) / (w * h)) END AS view_s,
CASE WHEN x IS NULL THEN 0.5 ELSE least(1.0, sqrt(w * h / 6400)) END AS size_s FROM sc)"""
QUERIES["r2_r3_scores"] = (of("nodes", lambda df: df.select("node_idx", F.round(R.text_score(F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("role", F.lit("")), F.nullif("type", F.lit(""))), F.array(*map(F.lit, GOAL))), 6).alias("text_score"), R.kind_score(F.col("tag"), F.col("role")).alias("kind_score"), F.round(R.viewport_score(tuple(map(F.col, "xywh")), 1280, 800), 6).alias("viewport_score"), F.round(R.size_score(F.col("w"), F.col("h")), 6).alias("size_score"))), f"{with_views('nodes')}, {_SCORES} SELECT node_idx, round(CAST(text_s AS DOUBLE), 6) AS text_score, CAST(kind_s AS DOUBLE) AS kind_score, round(CAST(view_s AS DOUBLE), 6) AS viewport_score, round(CAST(size_s AS DOUBLE), 6) AS size_score FROM base")
_RANKED = f"""{_SCORES}, sized AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, CAST(0.4 AS DOUBLE) * text_s + CAST(0.25 AS DOUBLE) * kind_s + CAST(0.15 AS DOUBLE) * view_s + CAST(0.1 AS DOUBLE) * size_s AS b FROM base),
many AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(b, 9) DESC, node_idx) AS place FROM sized WHERE n > 40),
near AS (SELECT m.page_id, m.node_idx, min(sqrt(pow(m.x + m.w / 2 - a.x - a.w / 2, 2) + pow(m.y + m.h / 2 - a.y - a.h / 2, 2))) AS d FROM many m JOIN many a ON m.page_id = a.page_id AND a.place <= greatest(3, ceil(a.n * 0.2)) AND a.node_idx <> m.node_idx AND a.x IS NOT NULL AND m.x IS NOT NULL GROUP BY m.page_id, m.node_idx)"""


def _rounded(df: DataFrame) -> DataFrame:
    scored = R.base_scores(df, F.array(*map(F.lit, GOAL))).withColumn("base", F.round("base", 9))
    return R.proximity(scored).select("page_id", "node_idx", F.round("proximity", 6).alias("proximity"))


QUERIES["r4_proximity"] = (of("nodes", _rounded), f"{with_views('nodes')}, {_RANKED.replace('WHERE n > 40', '')} SELECT m.page_id, m.node_idx, round(CASE WHEN m.x IS NULL THEN 0.4 ELSE coalesce(1 / (1 + d / 150), 0) END, 6) AS proximity FROM many m LEFT JOIN near ON m.page_id = near.page_id AND m.node_idx = near.node_idx")
_KEPT = f"""{_RANKED.replace('round(b, 9)', 'b')}, scored AS (SELECT m.*, b + CAST(0.1 AS DOUBLE) * CASE WHEN m.x IS NULL THEN CAST(0.4 AS DOUBLE) ELSE coalesce(1 / (1 + d / 150), 0) END AS whole FROM many m LEFT JOIN near ON m.page_id = near.page_id AND m.node_idx = near.node_idx),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id, sensitive ORDER BY whole DESC, node_idx) AS rn, count(*) FILTER (WHERE sensitive) OVER (PARTITION BY page_id) AS held FROM scored),
chosen AS (SELECT page_id, node_idx, agent_id, sensitive OR rn <= greatest(0, 40 - held) AS kept, floor(whole * 10000 + 0.5) / 10000 AS score FROM placed UNION ALL SELECT page_id, node_idx, agent_id, true, NULL FROM sized WHERE n <= 40)"""
QUERIES["r5_rank_elements"] = (of("nodes", lambda df: R.rank_elements(df, F.array(*map(F.lit, GOAL))).select("page_id", "node_idx", "kept", "dropped", "score")), f"{with_views('nodes')}, {_KEPT} SELECT page_id, node_idx, kept, count(*) FILTER (WHERE NOT kept) OVER (PARTITION BY page_id) AS dropped, score FROM chosen")
QUERIES["k2_score_listing"] = (of("nodes", lambda df: R.rank_elements(df, F.array(*map(F.lit, GOAL))).select("page_id", "agent_id", "score", "kept").orderBy(F.col("score").desc(), "agent_id")), f"{with_views('nodes')}, {_KEPT} SELECT page_id, agent_id, score, kept FROM chosen ORDER BY score DESC, agent_id")
QUERIES["u3_unmatched_ids"] = (lambda spark, sf: view(spark, sf, "nodes").select("page_id", "agent_id").join(view(spark, sf, "regions").select(F.col("request_id").alias("page_id"), "agent_id"), ["page_id", "agent_id"], "left_anti"), f"{with_views('nodes', 'regions')} SELECT page_id, agent_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.request_id = n.page_id AND r.agent_id = n.agent_id)")
