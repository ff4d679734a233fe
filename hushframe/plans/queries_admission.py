"""Queries of request validation, admission and prompts, with the rules on the JSON itself as their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import requests as Q
from hushframe.plans import pipelines
from hushframe.views import spread

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Requests made from orders: most sound, some with leaks of each kind, and by o_orderkey % 37 some with a fault of their own.
_FAULTS = {
    "image": {12: '"image":"",', 13: '"image":7,', 25: ""}, "goal": {0: "", 14: '"taskGoal":null,', 26: '"taskGoal":["x"],'}, "extra": {1: '"extra":1,'},
    "agent": {7: "7", 22: '""'}, "tag": {22: '""', 27: "null"}, "role": {19: "5", 20: '"textbox"'},
    "box": {2: '{"x":10,"y":10,"w":100}', 3: '{"x":10,"y":10,"w":100,"h":20,"q":1}', 15: '{"x":"abc","y":10,"w":100,"h":20}', 16: '{"x":"10","y":10.0,"w":1e2,"h":20}', 28: "null"},
    "sensitive": {17: '"yes"', 18: "null", 21: '"maybe"', 23: "0"}, "more": {8: ",5", 30: ',{"agentId":"agent-1","tag":"p","text":" "}'}, "nodes": {4: "", 6: '"domSnapshot":null,'}, "regions": {5: ""},
    "region": {9: '{"type":"weird","agentId":"agent-2","bbox":{"x":0,"y":0,"w":5,"h":5}}', 10: '{"type":"tel","source":"sky","bbox":{"x":0,"y":0,"w":5,"h":5}}', 11: '{"type":"tel"}', 24: '{"bbox":{"x":0,"y":0,"w":5,"h":5}}', 29: '{"type":"tel","rawType":3,"bbox":{"x":0,"y":0,"w":5,"h":5},"z":0}'},
    "open": {31: "[1,", 32: ""}, "close": {31: "1]"},
}


def _text(value: str) -> str:
    return f"'{value}'"


def _fault(name: str, sound: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in _FAULTS[name].items())
    return f"CASE o_orderkey % 37 {whens} ELSE {sound} END"


def _join(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


_NODES = _join(
    _text('"domSnapshot":[{"agentId":'), _fault("agent", _text('"agent-1"')), _text(',"tag":'), _fault("tag", _text('"input"')), _text(',"role":'), _fault("role", _text("null")),
    _text(',"text":'), f"CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE {_text(chr(34) + 'x y' + chr(34))} END", _text(',"bbox":'), _fault("box", _text('{"x":10,"y":10,"w":100,"h":20}')),
    _text(',"sensitive":'), _fault("sensitive", "CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END"), _text('},{"agentId":"agent-2","tag":"a","text":"Home"}'), _fault("more", "''"), _text("],"),
)
_KINDS = {0: '{"type":"email","agentId":"agent-1","bbox":{"x":0,"y":0,"w":5,"h":5}}', 1: '{"type":"tel","source":"dom","bbox":{"x":0,"y":0,"w":200,"h":200}}', 2: '{"type":"person","bbox":{"x":0,"y":0,"w":200,"h":200}}'}
_SOME = f"CASE o_orderkey % 4 {' '.join(f'WHEN {k} THEN {_text(v)}' for k, v in _KINDS.items())} ELSE '' END"
_REGIONS = _join(_text('"redactedRegions":['), _fault("region", _SOME), _text("],"))
_GOAL = _join(_text('"taskGoal":"'), "o_orderpriority", _text('",'))
_WHOLE = _join(_fault("open", _text("{")), _fault("image", _text('"image":"aGk=",')), _fault("goal", _GOAL), _fault("extra", "''"), _fault("nodes", _NODES), _fault("regions", _REGIONS), _fault("close", _text("}")))
BODY = f"replace({_WHOLE}, ',}}', '}}')"


#: Requests of one task.
ROWS = 100_000


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority"), ROWS).select(F.col("o_orderkey").alias("request_id"), F.expr(BODY).alias("body"))


_BAD_SIDE = " OR ".join(f"NOT coalesce(json_type(v, '$.bbox.{c}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') OR json_type(v, '$.bbox.{c}') = 'VARCHAR' AND TRY_CAST(v ->> '$.bbox.{c}' AS DOUBLE) IS NOT NULL, false)" for c in "xywh")
_BAD_BOX = f"coalesce(json_type(v, '$.bbox') <> 'OBJECT', true) OR len(json_keys(v, '$.bbox')) <> 4 OR {_BAD_SIDE}"
_FLAGS = ", ".join(map(_text, [*Q.TRUE, *Q.FALSE, "0.0", "1.0"]))


def _ill(*keys: str) -> str:
    return " OR ".join(f"coalesce(json_type(v, '$.{k}') NOT IN ('VARCHAR', 'NULL'), false)" for k in keys)


def _unknown(of: str, keys: list[str]) -> str:
    return f"len(list_filter(json_keys({of}), lambda k: NOT list_contains({keys}, k))) > 0"


def _text_rules(key: str) -> dict[str, str]:
    missing = f"coalesce(json_type(b, '$.{key}') = 'NULL', true) OR json_type(b, '$.{key}') = 'VARCHAR' AND b ->> '$.{key}' = ''"
    return {f"{key}: required": missing, f"{key}: not text": f"json_type(b, '$.{key}') NOT IN ('VARCHAR', 'NULL')"}


_OBJECT = "json_type(v) = 'OBJECT'"
_BODY_RULES = {**_text_rules("image"), **_text_rules("taskGoal"), **{f"{k}: not a list": f"json_type(b, '$.{k}') <> 'ARRAY'" for k in Q.LISTS}, "body: extra key": _unknown("b", Q.KEYS["request"])}
_NODE_RULES = {
    "domSnapshot: not an object": "json_type(v) <> 'OBJECT'", "domSnapshot: extra key": f"{_OBJECT} AND {_unknown('v', Q.KEYS['node'])}",
    **{f"domSnapshot.{k}: required": f"{_OBJECT} AND (coalesce(json_type(v, '$.{k}') <> 'VARCHAR', true) OR v ->> '$.{k}' = '')" for k in ("agentId", "tag")},
    "domSnapshot: not text": _ill("role", "type", "text"), "domSnapshot.bbox: not a box": f"coalesce(json_type(v, '$.bbox') <> 'NULL', false) AND ({_BAD_BOX})",
    "domSnapshot.sensitive: not a flag": f"json_type(v, '$.sensitive') IS NOT NULL AND NOT coalesce(lower(v ->> '$.sensitive') IN ({_FLAGS}), false)",
}
_REGION_RULES = {
    "redactedRegions: not an object": "json_type(v) <> 'OBJECT'", "redactedRegions: extra key": f"{_OBJECT} AND {_unknown('v', Q.KEYS['region'])}",
    "redactedRegions.type: required": f"{_OBJECT} AND coalesce(json_type(v, '$.type') <> 'VARCHAR', true)", "redactedRegions: not text": _ill("rawType", "agentId"),
    "redactedRegions.bbox: not a box": f"{_OBJECT} AND ({_BAD_BOX})", "redactedRegions.source: not a source": "coalesce(json_type(v, '$.source') <> 'NULL', false) AND (json_type(v, '$.source') <> 'VARCHAR' OR v ->> '$.source' NOT IN ('dom', 'vision'))",
}


def _each(rules: dict[str, str], name: str) -> str:
    return ", ".join(f"bool_or(coalesce({t}, false)) AS {name}{k}" for k, t in enumerate(rules.values()))


def _found() -> str:
    whens = [f"CASE WHEN {t} THEN '{n}' END" for n, t in _BODY_RULES.items()]
    whens += [f"CASE WHEN {name}{k} THEN '{n}' END" for name, rules in (("n", _NODE_RULES), ("r", _REGION_RULES)) for k, n in enumerate(rules)]
    return f"concat_ws('; ', {', '.join(whens)})"


_SIDES = ", ".join(f"TRY_CAST(v ->> '$.bbox.{c}' AS DOUBLE) AS {c}" for c in "xywh")
_TRUE = ", ".join(map(_text, [*Q.TRUE, "1.0"]))
#: From q (id, body): errors, nodes and regions of sound requests, leaks and decisions.
CHECKED = f"""o AS (SELECT id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN CAST(body AS JSON) END AS b FROM q),
nn AS (SELECT id, unnest(json_extract(b, '$.domSnapshot[*]')) AS v, unnest(range(CAST(json_array_length(b, '$.domSnapshot') AS BIGINT))) AS i FROM o WHERE json_type(b, '$.domSnapshot') = 'ARRAY'),
rr AS (SELECT id, unnest(json_extract(b, '$.redactedRegions[*]')) AS v, unnest(range(CAST(json_array_length(b, '$.redactedRegions') AS BIGINT))) AS i FROM o WHERE json_type(b, '$.redactedRegions') = 'ARRAY'),
ne AS (SELECT id, {_each(_NODE_RULES, 'n')} FROM nn GROUP BY id), re AS (SELECT id, {_each(_REGION_RULES, 'r')} FROM rr GROUP BY id),
checked AS (SELECT o.id, CASE WHEN o.b IS NULL THEN 'body: not an object' ELSE {_found()} END AS errors FROM o LEFT JOIN ne ON o.id = ne.id LEFT JOIN re ON o.id = re.id),
gn AS (SELECT n.id, n.i, n.v ->> '$.agentId' AS agent, n.v ->> '$.text' AS text, lower(coalesce(n.v ->> '$.sensitive', '')) IN ({_TRUE}) AS sensitive, coalesce(json_type(n.v, '$.bbox') = 'OBJECT', false) AS boxed, {_SIDES}, n.v FROM nn n JOIN checked c ON n.id = c.id AND c.errors = ''),
gr AS (SELECT r.id, r.i, r.v ->> '$.agentId' AS agent, coalesce(r.v ->> '$.source', CASE WHEN r.v ->> '$.agentId' IS NOT NULL THEN 'dom' ELSE 'vision' END) AS source, {_SIDES}, r.v FROM rr r JOIN checked c ON r.id = c.id AND c.errors = ''),
hits AS (
  SELECT n.id, n.agent FROM gn n JOIN gr r ON r.id = n.id AND r.agent = n.agent LEFT JOIN gn m ON m.id = n.id AND m.agent = n.agent AND m.i > n.i WHERE trim(n.text) <> '' AND m.id IS NULL
  UNION SELECT n.id, n.agent FROM gn n JOIN gr r ON r.id = n.id WHERE trim(n.text) <> '' AND r.source = 'dom' AND n.boxed AND n.w > 0 AND n.h > 0
    AND greatest(0, least(r.x + r.w, n.x + n.w) - greatest(r.x, n.x)) * greatest(0, least(r.y + r.h, n.y + n.h) - greatest(r.y, n.y)) / (n.w * n.h) > 0.5
  UNION SELECT id, agent FROM gn WHERE trim(text) <> '' AND sensitive
), leak AS (SELECT id, string_agg(agent, ',' ORDER BY agent) AS leaked FROM hits GROUP BY id),
decided AS (SELECT c.id AS request_id, CASE WHEN errors <> '' THEN 422 WHEN l.id IS NOT NULL THEN 400 ELSE 200 END AS status, CASE WHEN errors <> '' THEN 'REQUEST_INVALID' WHEN l.id IS NOT NULL THEN 'PII_LEAK_DETECTED' END AS error_code, coalesce(leaked, '') AS leaked
  FROM checked c LEFT JOIN leak l ON c.id = l.id)"""
SQL_REQUESTS = f"WITH q AS (SELECT o_orderkey AS id, {BODY} AS body FROM orders), {CHECKED}"
DECISIONS = f"{SQL_REQUESTS} SELECT request_id, status, error_code, leaked FROM decided"


def decisions(requests: DataFrame) -> DataFrame:
    return Q.admit(requests).select("request_id", "status", "error_code", F.array_join("leaked", ",").alias("leaked"))


def _errors(df: DataFrame) -> DataFrame:
    return Q.validate_requests(df).select("request_id", F.array_join("errors", "; ").alias("errors"))


QUERIES["v3_validate_requests"] = (lambda spark, sf: _errors(requests(spark, sf)), f"{SQL_REQUESTS} SELECT id AS request_id, errors FROM checked")
QUERIES["v6_admit"] = (lambda spark, sf: pipelines.admit_requests(requests(spark, sf)).select("request_id", "status", "error_code", F.array_join("leaked", ",").alias("leaked")), DECISIONS)
QUERIES["s4_event_payloads"] = (
    lambda spark, sf: _errors(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("props").alias("body"))),
    f"WITH q AS (SELECT event_id AS id, props AS body FROM events), {CHECKED} SELECT id AS request_id, errors FROM checked",
)

_OPENING, _NOTICE, _CLOSING = "You choose one browser action.", "The regions below are hidden on purpose; do not guess what they hold.", "Answer with one JSON object."


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.build_prompts(Q.sound(Q.validate_requests(requests(spark, sf))), _OPENING, _NOTICE, _CLOSING)


_KNOWN = "v ->> '$.type' IN ('password', 'cc-number', 'current-password', 'email', 'tel', 'aadhaar', 'pan', 'other')"
_REGION_LINE = f"""'  - type=' || CASE WHEN {_KNOWN} THEN v ->> '$.type' ELSE 'other' END || coalesce(' (rawType=' || coalesce(v ->> '$.rawType', CASE WHEN NOT ({_KNOWN}) THEN v ->> '$.type' END) || ')', '')
  || coalesce(', agentId=' || agent, '') || ', bbox=(x=' || x || ', y=' || y || ', w=' || w || ', h=' || h || ')'"""
_NODE_LINE = "'  - agentId=' || agent || ', tag=' || (v ->> '$.tag') || coalesce(', role=' || (v ->> '$.role'), '') || coalesce(concat(', text=', chr(39), text, chr(39)), '') || CASE WHEN sensitive THEN ', sensitive=true' ELSE '' END"
QUERIES["a9_build_prompts"] = (_prompts, f"""{SQL_REQUESTS}, rl AS (SELECT id, count(*) AS n, string_agg({_REGION_LINE}, chr(10) ORDER BY i) AS lines FROM gr GROUP BY id),
nl AS (SELECT id, count(*) AS n, string_agg({_NODE_LINE.replace("concat(', text=', chr(39), text, chr(39))", "', text=' || chr(39) || text || chr(39)")}, chr(10) ORDER BY i) AS lines FROM gn GROUP BY id)
SELECT o.id AS request_id, concat_ws(chr(10), '{_OPENING}', '', 'TASK GOAL: ' || (b ->> '$.taskGoal'), '', CASE WHEN rl.n > 0 THEN concat_ws(chr(10), '{_NOTICE}', '', 'REDACTED REGIONS (' || rl.n || ' total, do not guess their contents):', rl.lines) ELSE 'No regions were redacted in this screenshot.' END,
  '', 'DOM SNAPSHOT (' || coalesce(nl.n, 0) || ' nodes):', coalesce(nl.lines, '  (empty)'), '', '{_CLOSING}') AS prompt FROM o JOIN checked c ON o.id = c.id AND c.errors = '' LEFT JOIN rl ON o.id = rl.id LEFT JOIN nl ON o.id = nl.id""")
