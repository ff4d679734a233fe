"""Queries of the text and field classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import vocab
from hushframe.functions import geometry as G
from hushframe.functions import text as X
from hushframe.plans import pipelines
from hushframe.views import view, with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


def add(name: str, source: Callable[[SparkSession, str], DataFrame], build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (lambda spark, sf: build(source(spark, sf)), sql)


def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: view(spark, sf, name)


def values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


EMAIL = r"(?i)[a-z0-9!#$%&''*+/=?^_`{|}~-]@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.[a-z0-9]"
AADHAAR = r"\b\d{4}[\s-]\d{4}[\s-]\d{4}\b|\b\d{12}\b"
PAN = r"(?i)\b[a-z]{5}[0-9]{4}[a-z]\b"
PHONE = r"\b[6-9]\d{9}\b|\+\d{1,3}[\s-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b"
RULES = {"email": EMAIL, "pan": PAN, "aadhaar": AADHAAR, "tel": PHONE}


def has(kind: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '{RULES[kind]}')"


#: Autocomplete attributes and input types made from part rows, the same in both dialects.
FIELD = {
    "id": "p_partkey",
    "auto": "CASE p_partkey % 8 WHEN 0 THEN 'section-a current-password' WHEN 1 THEN 'CC-Number' WHEN 2 THEN 'billing cc-csc' WHEN 3 THEN 'tel-local' WHEN 4 THEN 'off' WHEN 5 THEN ' email ' WHEN 6 THEN 'new-password' END",
    "kind": "CASE p_size % 6 WHEN 0 THEN 'Password' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'tel' WHEN 3 THEN 'text' WHEN 4 THEN 'checkbox' END",
    "tag": "CASE p_size % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'Button' WHEN 2 THEN 'a' WHEN 3 THEN 'select' ELSE 'div' END",
    "role": "CASE p_partkey % 5 WHEN 0 THEN 'tab' WHEN 1 THEN '' END",
    "href": "CASE WHEN p_partkey % 3 = 0 THEN '/x' END",
    "label": "p_name",
}


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*[f"{e} AS {c}" for c, e in FIELD.items()])


FIELDS = f"WITH fields AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FIELD.items())} FROM part)"
_LAST = "regexp_extract(lower(trim(auto)), '[^ ]+$')"
_BY_TOKEN = f"CASE {' '.join(f'WHEN {_LAST} = {k!r} THEN {v!r}' for k, v in vocab.AUTOCOMPLETE_TYPES.items())} WHEN {_LAST} IN ({', '.join(map(repr, vocab.AUTOCOMPLETE_OTHER))}) THEN 'other' END"
_BY_TYPE = "CASE WHEN lower(kind) IN ('password', 'email', 'tel') THEN lower(kind) END"

add("c1_classify_autocomplete", fields, lambda df: df.select("id", X.classify_autocomplete(F.col("auto")).alias("pii_type")), f"{FIELDS} SELECT id, {_BY_TOKEN} AS pii_type FROM fields")
add("c2_classify_input_type", fields, lambda df: df.select("id", X.classify_input_type(F.col("kind")).alias("pii_type")), f"{FIELDS} SELECT id, {_BY_TYPE} AS pii_type FROM fields")
add("c3_classify_field", fields, lambda df: df.select("id", X.classify_field(F.col("auto"), F.col("kind")).alias("pii_type")), f"{FIELDS}, t AS (SELECT id, {_BY_TOKEN} AS a, {_BY_TYPE} AS b FROM fields) SELECT id, CASE WHEN a IS NOT NULL AND a <> 'other' THEN a WHEN b IS NOT NULL THEN b ELSE a END AS pii_type FROM t")
for _n, _k, _f in (("c4_is_email", "email", X.is_email), ("c5_is_aadhaar", "aadhaar", X.is_aadhaar), ("c6_is_pan", "pan", X.is_pan), ("c7_is_phone", "tel", X.is_phone)):
    add(_n, table("documents"), lambda df, f=_f: df.select("doc_id", f(F.col("text")).alias("hit")), f"SELECT doc_id, {has(_k)} AS hit FROM documents")
_LIST = f"list_filter([{', '.join(f'CASE WHEN {has(k)} THEN {k!r} END' for k in RULES)}], lambda x: x IS NOT NULL)"
add("c8_text_pii_types", table("documents"), lambda df: df.select("doc_id", F.array_join(X.text_pii_types(F.col("text")), ",").alias("types")), f"SELECT doc_id, array_to_string({_LIST}, ',') AS types FROM documents")
#: Some turns end with an address or a number of the speaker.
_TOLD = "concat(coalesce(text, ''), CASE turn % 4 WHEN 0 THEN concat(' write to u', CAST(conv_id AS STRING), '@example.org') WHEN 1 THEN concat(' call +91 98765', CAST(43000 + conv_id % 1000 AS STRING)) WHEN 2 THEN concat(' my card is ABCDE', CAST(1000 + conv_id % 9000 AS STRING), 'F') ELSE '' END)"
add("c8_conversation_pii", table("conversations"), lambda df: df.select("conv_id", "turn", F.expr(_TOLD).alias("told")).select("conv_id", "turn", F.explode(X.text_pii_types(F.col("told"))).alias("pii_type")), f"WITH t AS (SELECT conv_id, turn, {_TOLD} AS told FROM conversations) SELECT conv_id, turn, unnest({_LIST.replace('regexp_matches(text', 'regexp_matches(told')}) AS pii_type FROM t")

_ROLE = "CASE WHEN role <> '' THEN role WHEN tag = 'a' THEN CASE WHEN href IS NOT NULL THEN 'link' END WHEN tag = 'input' THEN CASE WHEN lower(coalesce(kind, 'text')) = 'checkbox' THEN 'checkbox' ELSE 'textbox' END WHEN lower(tag) = 'button' THEN 'button' WHEN tag = 'select' THEN 'combobox' END"
add("c14_implicit_role", fields, lambda df: df.select("id", X.implicit_role(*map(F.col, ("tag", "role", "href", "kind"))).alias("role")), f"{FIELDS} SELECT id, {_ROLE} AS role FROM fields")
add("c15_semantic_type", fields, lambda df: df.select("id", X.semantic_type(F.col("tag"), F.col("kind")).alias("type")), f"{FIELDS} SELECT id, CASE WHEN tag = 'input' THEN lower(coalesce(kind, 'text')) WHEN lower(tag) = 'button' THEN lower(coalesce(kind, 'button')) END AS type FROM fields")
add("c18_normal_pii_type", fields, lambda df: df.select("id", *[c.alias(n) for c, n in zip(X.normal_pii_type(F.col("kind")), ("type", "raw_type"), strict=True)]), f"{FIELDS} SELECT id, CASE WHEN kind IN ({', '.join(map(repr, vocab.PII_TYPES))}) THEN kind ELSE 'other' END AS type, CASE WHEN kind NOT IN ({', '.join(map(repr, vocab.PII_TYPES))}) THEN kind END AS raw_type FROM fields")
add("c20_decompose_identifier", fields, lambda df: df.select("id", X.decompose_identifier(F.concat(F.lit("delAccount--"), F.replace("label", F.lit(" "), F.lit("_X")))).alias("words")), f"{FIELDS} SELECT id, lower(regexp_replace(regexp_replace('delAccount--' || replace(label, ' ', '_X'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_]+', ' ', 'g')) AS words FROM fields")


def _first_phrase(column: str) -> str:
    low = f"lower(regexp_replace(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_]+', ' ', 'g'))"
    whens = " ".join(f"WHEN regexp_matches({low}, '\\b{'[[:space:]]+'.join(re.escape(w) for w in p.split())}\\b') THEN '{p}'" for p in X.phrase_order(vocab.RISK_PHRASES))
    return f"CASE {whens} END"


_LABELS = {"id": "event_id", "label": "concat(CASE event_id % 7 WHEN 0 THEN 'Place Order ' WHEN 1 THEN 'deleteAccount' WHEN 2 THEN 'pay_now' WHEN 3 THEN 'Confirmation' WHEN 4 THEN 'Check out' ELSE '' END, event_type)", "action": "CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'type' ELSE 'scroll' END", "typed": "CASE WHEN event_id % 4 = 0 THEN 'buy' WHEN event_id % 4 = 1 THEN '  ' END"}
_SQL_LABELS = f"WITH labels_ AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _LABELS.items())} FROM events)"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in _LABELS.items()])


def _risk(df: DataFrame) -> DataFrame:
    reasons = X.risk_reasons({"text": F.col("label")}, F.col("action"), F.col("typed"))
    return df.select("id", X.action_risk(reasons).alias("risk"), F.array_join(reasons, "; ").alias("reasons"))


add("c21_match_risk_phrase", labels, lambda df: df.select("id", X.match_risk_phrase(F.col("label")).alias("phrase")), f"{_SQL_LABELS} SELECT id, {_first_phrase('label')} AS phrase FROM labels_")
add("c22_action_risk", labels, _risk, f"""{_SQL_LABELS}, t AS (SELECT id, action, {_first_phrase('label')} AS a, CASE WHEN action = 'type' AND typed = 'buy' THEN 'buy' END AS b FROM labels_),
r AS (SELECT id, CASE WHEN action = 'scroll' THEN '' ELSE concat_ws('; ', 'text matches destructive-intent keyword "' || a || '"', 'typed value matches destructive-intent keyword "' || b || '"') END AS reasons FROM t)
SELECT id, CASE WHEN reasons <> '' THEN 'irreversible' ELSE 'safe' END AS risk, reasons FROM r""")

PATTERNS = ["http://thre.example.com/*", "https://www.example.org/*", "http://tionsh.example.net/*"]
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
_SCHEME = "lower(regexp_extract(url, '^([a-zA-Z]+)://', 1))"
_ALLOWED = "(" + " OR ".join(f"({_SCHEME} = '{s}' AND {_HOST} = '{h}')" for s, h in (p[:-2].split("://") for p in PATTERNS)) + ")"
add("c23_host_allowed", table("pages"), lambda df: df.select("page_id", X.host_allowed(F.col("url"), PATTERNS).alias("allowed")), f"SELECT page_id, {_ALLOWED} AS allowed FROM pages")


def _urls(df: DataFrame) -> DataFrame:
    raw = F.expr("CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'not a url' ELSE concat(url, '//') END")
    reason, value = X.check_url(raw, PATTERNS)
    return df.select("page_id", reason.alias("reason"), value.alias("value"))


add("c24_check_url", table("pages"), _urls, f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 5 = 1 THEN 'malformed' WHEN NOT {_ALLOWED} THEN 'host_not_permitted' END AS reason, CASE WHEN page_id % 5 > 1 AND {_ALLOWED} THEN regexp_replace(url, '/+$', '') END AS value FROM pages")

_ANSWERS = {"id": "event_id", "answered": "event_id % 11 <> 0", "status": "CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 422 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 200 END", "code": "CASE WHEN event_id % 8 = 3 THEN 'STOPPED' WHEN event_id % 8 = 5 THEN 'VLM_BACKEND_CALL_FAILED' END", "message": "CASE event_id % 4 WHEN 0 THEN 'GeminiRateLimited' WHEN 1 THEN 'OllamaConnectionError' WHEN 2 THEN 'odd' END"}
_SQL_ANSWERS = f"WITH answers AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _ANSWERS.items())} FROM events)"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in _ANSWERS.items()])


_HTTP = "'http_' || CAST(status AS VARCHAR)"
_CLASS = f"CASE WHEN NOT answered THEN 'no_response' WHEN code IS NOT NULL THEN code WHEN status = 0 THEN 'network_error' WHEN status IS NOT NULL THEN {_HTTP} ELSE 'unknown' END"
add("c25_api_error_class", answers, lambda df: df.select("id", X.api_error_class(*map(F.col, ("answered", "status", "code"))).alias("api_class"), X.loop_error_class(*map(F.col, ("answered", "status", "code"))).alias("loop_class")), f"{_SQL_ANSWERS} SELECT id, {_CLASS} AS api_class, CASE WHEN NOT answered THEN 'no_response' WHEN status = 0 THEN 'network_error' WHEN code IS NOT NULL THEN code WHEN status IS NOT NULL THEN {_HTTP} ELSE 'unknown' END AS loop_class FROM answers")


def _messages(df: DataFrame) -> DataFrame:
    summary, detail, actionable = X.error_message(X.api_error_class(F.col("answered"), F.col("status"), F.col("code")), F.col("message"), "http://localhost:8000")
    return df.select("id", summary.alias("summary"), detail.alias("detail"), actionable.alias("actionable"))


_BACKEND = "CASE WHEN contains(raw, 'Gemini') THEN 'Gemini' WHEN contains(raw, 'Claude') THEN 'Claude' WHEN contains(raw, 'Ollama') THEN 'Ollama' ELSE 'backend' END"
add("c26_error_message", answers, _messages, f"""{_SQL_ANSWERS}, t AS (SELECT id, {_CLASS} AS cls, coalesce(message, '') AS raw FROM answers), u AS (SELECT *, {_BACKEND} AS backend FROM t)
SELECT id, CASE cls WHEN 'no_response' THEN 'nothing answered' WHEN 'network_error' THEN 'http://localhost:8000 cannot be reached' WHEN 'STOPPED' THEN 'stopped on request' WHEN 'PII_LEAK_DETECTED' THEN 'refused: personal data left in the request'
WHEN 'SERVER_URL_NOT_PERMITTED' THEN coalesce(nullif(raw, ''), 'http://localhost:8000 is not an allowed host') WHEN 'VLM_RESPONSE_SCHEMA_INVALID' THEN 'the model''s answer has the wrong form' WHEN 'http_422' THEN 'refused: malformed request (422)'
WHEN 'VLM_BACKEND_CALL_FAILED' THEN backend || ': ' || CASE WHEN contains(raw, 'RateLimited') THEN 'too many calls, try again later or use another key' WHEN contains(raw, 'CredentialsMissing') THEN 'no key is set on the server' WHEN contains(raw, 'ModelNotFound') THEN 'the model''s name is not known there'
  WHEN contains(raw, 'ConnectionError') THEN 'the server cannot reach it' WHEN contains(raw, 'APIError') THEN 'it reported an error of its own' ELSE 'the call failed' END
ELSE CASE WHEN cls LIKE 'http\\_%' ESCAPE '\\' THEN 'unexpected answer, HTTP status ' || substr(cls, 6) ELSE 'unknown error: ' || coalesce(nullif(raw, ''), 'no message') END END AS summary,
CASE WHEN cls = 'network_error' AND raw = '' THEN 'no connection' ELSE raw END AS detail, cls IN ('network_error', 'SERVER_URL_NOT_PERMITTED', 'VLM_BACKEND_CALL_FAILED') AS actionable FROM u""")
add("c27_is_retryable", answers, lambda df: df.select("id", X.is_retryable(F.col("status"), F.col("code")).alias("again")), f"{_SQL_ANSWERS} SELECT id, coalesce(status IN (0, 429) OR status BETWEEN 500 AND 599, false) AND coalesce(code, '') <> 'STOPPED' AS again FROM answers")


def _describe(spark: SparkSession, sf: str) -> DataFrame:
    actions, nodes = view(spark, sf, "actions"), view(spark, sf, "nodes")
    named = nodes.select(F.col("agent_id").alias("target_id"), X.node_label(F.concat("text", F.lit(" of a long, long label for a control")), F.col("role"), F.col("tag")).alias("label"))
    df = actions.join(named, "target_id", "left")
    return df.select("step", X.describe_action(F.col("action"), F.col("target_id"), F.col("profile_field"), F.col("label")).alias("sentence"))


_LABEL = "CASE WHEN text IS NOT NULL AND trim(text || ' of a long, long label for a control') <> '' THEN CASE WHEN length(trim(text || ' of a long, long label for a control')) > 40 THEN substr(trim(text || ' of a long, long label for a control'), 1, 37) || '...' ELSE trim(text || ' of a long, long label for a control') END WHEN role IS NOT NULL THEN role ELSE tag END"
QUERIES["c28_describe_action"] = (_describe, f"""{with_views('actions', 'nodes')}, t AS (SELECT a.step, a.action, a.profile_field, coalesce(CASE WHEN n.agent_id IS NOT NULL THEN {_LABEL} END, CASE WHEN a.target_id NOT IN ('page', '') THEN a.target_id END) AS label FROM actions a LEFT JOIN nodes n ON a.target_id = n.agent_id)
SELECT step, CASE action WHEN 'type' THEN coalesce('typed into ' || label, 'typed into a field') WHEN 'fill_profile' THEN 'filled ' || CASE profile_field WHEN 'full_name' THEN 'full name' WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' ELSE 'a field' END || ' from your profile'
WHEN 'click' THEN coalesce('clicked ' || label, 'clicked an element') WHEN 'scroll' THEN 'scrolled the page' WHEN 'done' THEN 'marked the task as done' ELSE coalesce(action || ' on ' || label, 'performed ' || action) END AS sentence FROM t""")

_OUTCOME = "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(vocab.OUTCOMES)) + " WHEN 10 THEN 'odd_one' END"
add("c29_describe_outcome", table("events"), lambda df: df.select("event_id", *[c.alias(n) for c, n in zip(X.describe_outcome(F.expr(_OUTCOME)), ("label", "tone"), strict=True)]), "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{a}'" for k, (a, _) in enumerate(vocab.OUTCOMES.values())) + " WHEN 10 THEN 'odd_one' ELSE 'In progress' END AS label, CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in enumerate(vocab.OUTCOMES.values())) + " ELSE 'neutral' END AS tone FROM events")
add("c30_profile_field_for", of("nodes"), lambda df: df.select("node_idx", X.profile_field_for(F.col("type"), F.concat("text", F.lit(" Name"))).alias("field")), f"{with_views('nodes')} SELECT node_idx, CASE WHEN type = 'email' THEN CASE WHEN text IS NULL THEN 'email' END WHEN type = 'tel' THEN CASE WHEN text IS NULL THEN 'phone' END WHEN text IS NOT NULL AND regexp_matches(lower(text || ' Name'), '\\bname\\b') AND lower(text) NOT LIKE '%user%' THEN 'full_name' END AS field FROM nodes")
add("c31_sanitize_profile", of("profiles"), lambda df: df.select("user_id", *[X.blank_to_null(F.col(c)).alias(c) for c in vocab.PROFILE_FIELDS]), f"{with_views('profiles')} SELECT user_id, " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in vocab.PROFILE_FIELDS) + " FROM profiles")
add("c32_frame_id", table("events"), lambda df: df.select("event_id", X.frame_id_of(F.expr("CASE WHEN event_id % 3 = 0 THEN concat('agent-f', CAST(event_id % 40 AS STRING), '-7') WHEN event_id % 3 = 1 THEN concat('agent-', CAST(event_id AS STRING)) END")).alias("frame_id")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 40 AS INT) END AS frame_id FROM events")
add("r1_tokenize", table("documents"), lambda df: df.select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("n_terms"), F.array_join(F.slice(X.tokenize(F.col("text")), 1, 5), " ").alias("head")), f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(map(repr, vocab.STOPWORDS))})) AS terms FROM documents) SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, array_to_string(terms[1:5], ' ') AS head FROM t")
_N = {k: f"sum(CASE WHEN {has(k)} THEN 1 ELSE 0 END)" for k in RULES}
add("a8_pii_profile", table("documents"), lambda df: pipelines.pii_of_documents(df, ["lang", "source"]), "SELECT lang, source, " + ", ".join(f"CAST({e} AS BIGINT) AS n_{k}" for k, e in _N.items()) + f", CAST(sum(CASE WHEN {' OR '.join(has(k) for k in RULES)} THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, count(*) AS n_rows FROM documents GROUP BY lang, source")


def _geometry(df: DataFrame) -> DataFrame:
    box = G.columns()
    moved = G.translate(box, F.lit(12.5), F.lit(-3.0))
    scaled = G.scale(moved, F.lit(2.0))
    return df.select("node_idx", *[c.alias(f"doc_{n}") for c, n in zip(moved, "xywh", strict=True)], *[c.alias(f"px_{n}") for c, n in zip(scaled, "xywh", strict=True)])


add("g1_g3_translate_and_scale", of("nodes"), _geometry, f"{with_views('nodes')} SELECT node_idx, x + 12.5 AS doc_x, y - 3 AS doc_y, w AS doc_w, h AS doc_h, (x + 12.5) * 2 AS px_x, (y - 3) * 2 AS px_y, w * 2 AS px_w, h * 2 AS px_h FROM nodes")
add("g2_document_offset", of("nodes"), lambda df: df.select("node_idx", *[c.alias(f"doc_{n}") for c, n in zip(G.translate(G.columns(), F.lit(0.0), F.col("page_id") * 100.0), "xywh", strict=True)]), f"{with_views('nodes')} SELECT node_idx, x AS doc_x, y + page_id * 100.0 AS doc_y, w AS doc_w, h AS doc_h FROM nodes")
add("g4_from_corners", of("boxes"), lambda df: df.select("box_idx", *[c.alias(n) for c, n in zip(G.from_corners(*map(F.col, ("xmax", "ymin", "xmin", "ymax"))), "xywh", strict=True)]), f"{with_views('boxes')} SELECT box_idx, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h FROM boxes")


def _overlaps(df: DataFrame) -> DataFrame:
    other: tuple[Column, ...] = (F.lit(100.0), F.lit(100.0), F.lit(400.0), F.lit(300.0))
    box = G.from_corners(*map(F.col, ("xmin", "ymin", "xmax", "ymax")))
    return df.select("box_idx", F.round(G.overlap_ratio(other, box), 6).alias("covered"), F.round(G.iou(box, other), 6).alias("iou"), F.round(G.unletterbox(F.col("xmin"), F.lit(8.0), F.lit(0.5)), 6).alias("x_image"))


_INTER = "greatest(0, least(xmax, 500) - greatest(xmin, 100)) * greatest(0, least(ymax, 400) - greatest(ymin, 100))"
add("g5_g7_overlap_iou_unletterbox", of("boxes"), _overlaps, f"{with_views('boxes')} SELECT box_idx, round({_INTER} / ((xmax - xmin) * (ymax - ymin)), 6) AS covered, round({_INTER} / ((xmax - xmin) * (ymax - ymin) + 120000 - {_INTER} + 1e-9), 6) AS iou, round((xmin - 8) / 0.5, 6) AS x_image FROM boxes")
