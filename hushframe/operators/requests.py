"""Request validation, leak search, admission, model responses and prompts.

Nodes of requests: request_id, node_idx, agent_id, tag, role, type, text, x, y, w, h, sensitive. Regions: request_id,
region_idx, type, raw_type, x, y, w, h, agent_id, source. Outputs name places and kinds, never the values found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import vocab
from hushframe.functions import geometry as G
from hushframe.functions import text as X

COVERED = 0.5
#: Side of the cells in which nodes and regions meet, the regions of a cell that its nodes try first, the cells of a region at most, and coordinates within which cells are counted.
CELL, FIRST, WIDE, FAR = 64.0, 32, 1024, 1e9
#: Raw values shorter than this are too common to look for.
MIN_VALUE = 3


def has_text(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False))


def infer_source(source: Column, agent_id: Column) -> Column:
    """An explicit source, else dom for regions with an agent id and vision for others."""
    return F.coalesce(source, F.when(agent_id.isNotNull(), "dom").otherwise("vision"))


def find_leaks(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """(request_id, agent_id, region_idx, strategy): nodes that carry text although they should not.

    Strategy 1: a region names the node's agent id (the last node of that id counts). 2: a dom region covers more than half
    of the node. 3: the node is marked sensitive. One row per agent id: the first by region, strategy and node.
    """
    raw = nodes.where(has_text(F.col("text")))
    order = F.struct(F.col("node_idx").alias("at"), has_text(F.col("text")).alias("told"))
    last = nodes.groupBy("request_id", "agent_id").agg(F.max(order).alias("l")).where("l.told")
    named = last.join(regions.groupBy("request_id", "agent_id").agg(F.min("region_idx").alias("region_idx")), ["request_id", "agent_id"])
    marked = raw.where("sensitive")
    found = (
        named.select("request_id", "agent_id", "region_idx", F.lit(1).alias("strategy"), F.col("l.at").alias("node_idx"))
        .unionByName(_covered(raw, regions.where("source = 'dom'")).select("request_id", "agent_id", "region_idx", F.lit(2).alias("strategy"), "node_idx"))
        .unionByName(marked.select("request_id", "agent_id", F.lit(None).cast(regions.schema["region_idx"].dataType).alias("region_idx"), F.lit(3).alias("strategy"), "node_idx"))
    )
    first = found.groupBy("request_id", "agent_id").agg(F.min(F.struct(F.col("region_idx").isNull().alias("none"), "region_idx", "strategy", "node_idx")).alias("f"))
    return first.select("request_id", "agent_id", "f.region_idx", "f.strategy")


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor((low - 1) / CELL).cast("long"), F.floor((high + 1) / CELL).cast("long"))


def _covered(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """nodes with region_idx, the first region of their request that covers more than half of them; others are left out.

    A region that covers more than half of a node holds its centre, so that the two meet in the centre's cell. A node tries the FIRST regions
    of its cell; only one that none of them covers tries the cell's others. Boxes beyond FAR, and regions over more than WIDE cells, are
    compared with the whole request. Equal boxes are compared once.
    """
    box, own = G.columns(), [F.col("n_" + c) for c in "xywh"]
    held = nodes.where(G.is_finite(*box) & (F.col("w") > 0) & (F.col("h") > 0))
    sizes = held.select("request_id", *[F.col(c).alias("n_" + c) for c in "xywh"]).distinct()
    x, y, w, h = own
    cx, cy = x + w / 2, y + h / 2
    near = (F.abs(cx) < FAR) & (F.abs(cy) < FAR)
    sizes = sizes.withColumn("cell", F.when(near, F.struct(F.floor(cx / CELL).cast("long").alias("i"), F.floor(cy / CELL).cast("long").alias("j"))))
    area = regions.where((F.col("w") > 0) & (F.col("h") > 0)).groupBy("request_id", *"xywh").agg(F.min("region_idx").alias("region_idx"))
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    small = (F.abs("x") < FAR) & (F.abs("y") < FAR) & (right < FAR) & (low < FAR) & ((F.col("w") / CELL + 2) * (F.col("h") / CELL + 2) <= WIDE)
    area = area.select("request_id", "region_idx", *[F.col(c).alias("r_" + c) for c in "xywh"], F.when(small, F.flatten(F.transform(_cells(F.col("x"), right), lambda i: F.transform(_cells(F.col("y"), low), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("cells"))
    placed = area.where("cells is not null").withColumn("cell", F.explode("cells")).drop("cells")
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", "cell").orderBy(F.col("region_idx").asc_nulls_last())))
    key = ["request_id", *["n_" + c for c in "xywh"]]

    def hits(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on).where(G.overlap_ratio(G.columns("r_"), tuple(own)) > COVERED).groupBy(*key).agg(F.min("region_idx").alias("region_idx"))

    on = ["request_id", "cell"]
    tried = hits(sizes, placed.where(F.col("_n") <= FIRST), on)
    others = hits(sizes.join(tried, key, "left_anti"), placed.where(F.col("_n") > FIRST), on)
    wide = hits(sizes, area.where("cells is null"), ["request_id"])
    best = tried.unionByName(others).unionByName(wide).groupBy(*key).agg(F.min("region_idx").alias("region_idx"))
    return held.join(best.toDF("request_id", *"xywh", "region_idx"), ["request_id", *"xywh"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(request_id, agent_id) of the values that stand in their row's payload: one automaton of a request's values goes over its payload once."""
    for batch in batches:
        ids, agents = [], []
        for request_id, payload, values in zip(batch.column("request_id"), batch.column("payload"), batch.column("held"), strict=True):
            owners: dict[str, set[str | None]] = {}
            for v in values.as_py():
                for form in (v["raw"], v["escaped"]):
                    owners.setdefault(form, set()).add(v["agent_id"])
            automaton, found = ahocorasick.Automaton(), set()
            for form, own in owners.items():
                automaton.add_word(form, own)
            automaton.make_automaton()
            left = set().union(*owners.values())
            for _, own in automaton.iter(payload.as_py()):
                found |= own
                if found == left:
                    break
            ids += [request_id.as_py()] * len(found)
            agents += sorted(found, key=str)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("request_id").type), pa.array(agents, pa.string())], names=["request_id", "agent_id"])


def egress_check(payloads: DataFrame, values: DataFrame) -> DataFrame:
    """(request_id, agent_id) of raw values that stand in their request's payload, plainly or as JSON escapes them.

    payloads: request_id, payload. values: request_id, agent_id, value, text; the trimmed text counts where there is no value.
    A payload is read once, however many values its request has.
    """
    raw = F.coalesce(F.nullif(F.col("value"), F.lit("")), X.blank_to_null(F.col("text")))
    escaped = F.regexp_extract(F.to_json(F.struct(F.col("raw").alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    wanted = values.select("request_id", "agent_id", raw.alias("raw")).where(F.length("raw") >= MIN_VALUE).withColumn("escaped", escaped)
    held = wanted.groupBy("request_id").agg(F.collect_set(F.struct("agent_id", "raw", "escaped")).alias("held"))  # one request's nodes
    rows = payloads.where("payload is not null").select("request_id", "payload").join(held, "request_id")
    kind = T.StructType([T.StructField("request_id", payloads.schema["request_id"].dataType), T.StructField("agent_id", T.StringType())])
    return rows.mapInArrow(_found, kind).distinct()


def sanitize_nodes(nodes: DataFrame, pii_type: str | None = None) -> DataFrame:
    """nodes with the text of sensitive ones, or of those with a PII type in the named column, null and sensitive set."""
    hide = F.coalesce(F.col("sensitive"), F.lit(False))
    if pii_type:
        hide = hide | F.coalesce(F.col(pii_type) != "", F.lit(False))
    return nodes.withColumn("_hide", hide).withColumn("text", F.when(~F.col("_hide"), F.col("text"))).withColumn("sensitive", F.coalesce("sensitive", F.lit(False)) | F.col("_hide")).drop("_hide")


BBOX = "struct<x:double,y:double,w:double,h:double>"
NODE = f"struct<agentId:string,tag:string,role:string,type:string,text:string,bbox:{BBOX},sensitive:boolean>"
REGION = f"struct<type:string,rawType:string,bbox:{BBOX},agentId:string,source:string>"
KEYS = {"request": ["image", "domSnapshot", "redactedRegions", "taskGoal"], "node": ["agentId", "tag", "role", "type", "text", "bbox", "sensitive"], "region": ["type", "rawType", "bbox", "agentId", "source"]}
LISTS = {"domSnapshot": "_nodes", "redactedRegions": "_regions"}
_TEXT, _NUMBER = "(STRING|VOID)", r"(BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|BOOLEAN)"
_BOX = f"OBJECT<{', '.join(f'{c}: {_NUMBER}' for c in 'hwxy')}>"
#: Schemas, keys in order, of nodes and regions whose kinds are all as they should be, so that only some texts are left to look at.
PLAIN = {
    "domSnapshot": f"^OBJECT<agentId: STRING(, bbox: (VOID|{_BOX}))?(, role: {_TEXT})?(, sensitive: BOOLEAN)?, tag: STRING(, text: {_TEXT})?(, type: {_TEXT})?>$",
    "redactedRegions": f"^OBJECT<(agentId: {_TEXT}, )?bbox: {_BOX}(, rawType: {_TEXT})?(, source: {_TEXT})?, type: STRING>$",
}
#: Texts and numbers that stand for a flag.
TRUE, FALSE = ["true", "t", "yes", "y", "on", "1"], ["false", "f", "no", "n", "off", "0"]


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """build of a value that is computed once, however often build names it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _given(value: Column) -> Column:
    """Whether a value is there and not null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _filled(value: Column) -> Column:
    return (F.coalesce(_as(value, "string"), F.lit("")) != "") & _is_text(value)


def _extra(keys: Column, known: list[str]) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0


def _is_box(value: Column) -> Column:
    """An object of x, y, w and h alone, each a number, a flag or a number's text."""
    def whole(box: Column) -> Column:
        sides = (F.size(box) == 4) & box.isNotNull()
        for c in "xywh":
            sides = sides & _as(box[c], "double").isNotNull()
        return F.coalesce(sides, F.lit(False))

    return _bound(_as(value, "map<string,variant>"), whole)


def _flag(value: Column) -> Column:
    """Lower-cased text of a value that may stand for a flag."""
    return F.regexp_replace(F.lower(_as(value, "string")), r"^([01])\.0*$", "$1")


def _node(m: Column) -> Column:
    texts = [_as(m[k], "string").alias(k) for k in KEYS["node"][:5]]
    return F.struct(*texts, _as(m["bbox"], BBOX).alias("bbox"), F.coalesce(_flag(m["sensitive"]).isin(TRUE), F.lit(False)).alias("sensitive"))


def _region(m: Column) -> Column:
    return F.struct(*[_as(m[k], BBOX if k == "bbox" else "string").alias(k) for k in KEYS["region"]])


def _entry(value: Column, key: str, kind: str, sound: Callable[[Column], Column], whole: Callable[[Column], Column]) -> Column:
    """A list's value as t, its fields by one cast if it is plain and sound, else as m, the map that the rules are tried on; both null if it is no object."""
    cast = F.when(F.schema_of_variant(value).rlike(PLAIN[key]), _as(value, kind))

    def chosen(t: Column) -> Column:
        ok = F.coalesce(sound(t), F.lit(False))
        return F.struct(F.when(ok, whole(t)).alias("t"), F.when(~ok, _as(value, "map<string,variant>")).alias("m"))

    return _bound(cast, chosen)


def _sound_node(t: Column) -> Column:
    return (t["agentId"] != "") & (t["tag"] != "")


def _whole_node(t: Column) -> Column:
    return F.struct(*[t[k] for k in KEYS["node"][:6]], F.coalesce(t["sensitive"], F.lit(False)).alias("sensitive"))


def _sound_region(t: Column) -> Column:
    return t["type"].isNotNull() & F.coalesce(t["source"].isin("dom", "vision"), F.lit(True))


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests (request_id, body) with parsed (null if malformed) and errors, an array of "place: rule" that names no value.

    image and taskGoal are texts of one character at least; absent lists are empty ones, null ones are errors; no object has
    other keys than those named; a box has x, y, w and h and nothing else; numbers may be written as texts, flags as 0, 1 or
    yes and no. A region's type may be any text. parsed holds domSnapshot, redactedRegions and taskGoal; the body is read once.
    """
    df = requests.withColumn("_root", _as(F.try_parse_json("body"), "map<string,variant>"))
    root = F.col("_root")
    forms = [(NODE, _sound_node, _whole_node, _node), (REGION, _sound_region, lambda t: t, _region)]

    def entries(key: str, kind: str, sound, whole, _) -> Column:
        return F.transform(_as(root[key], "array<variant>"), lambda v: _entry(v, key, kind, sound, whole))

    df = df.withColumns({name: entries(key, *form) for (key, name), form in zip(LISTS.items(), forms, strict=True)})
    odd = {name: f"{name}_odd" for name in LISTS.values()}
    df = df.withColumns({rest: F.transform(F.filter(name, lambda e: e["t"].isNull()), lambda e: e["m"]) for name, rest in odd.items()})

    def some(name: str, test) -> Column:
        return F.coalesce(F.exists(odd[name], lambda m: F.coalesce(test(m), F.lit(False))), F.lit(False))

    def not_text(m: Column, *keys: str) -> Column:
        return reduce(Column.__or__, [_given(m[k]) & ~_is_text(m[k]) for k in keys])

    def text_rules(key: str) -> list[tuple[str, Column]]:
        there = _given(root[key]) & (F.coalesce(_as(root[key], "string"), F.lit("x")) != "")
        return [(f"{key}: required", ~there), (f"{key}: not text", there & ~_is_text(root[key]))]

    rules = [
        *text_rules("image"), *text_rules("taskGoal"),
        *[(f"{key}: not a list", root[key].isNotNull() & F.col(name).isNull()) for key, name in LISTS.items()],
        ("body: extra key", _extra(F.map_keys(root), KEYS["request"])),
        ("domSnapshot: not an object", some("_nodes", lambda m: m.isNull())),
        ("domSnapshot: extra key", some("_nodes", lambda m: _extra(F.map_keys(m), KEYS["node"]))),
        ("domSnapshot.agentId: required", some("_nodes", lambda m: m.isNotNull() & ~_filled(m["agentId"]))),
        ("domSnapshot.tag: required", some("_nodes", lambda m: m.isNotNull() & ~_filled(m["tag"]))),
        ("domSnapshot: not text", some("_nodes", lambda m: not_text(m, "role", "type", "text"))),
        ("domSnapshot.bbox: not a box", some("_nodes", lambda m: _given(m["bbox"]) & ~_is_box(m["bbox"]))),
        ("domSnapshot.sensitive: not a flag", some("_nodes", lambda m: m["sensitive"].isNotNull() & ~F.coalesce(_flag(m["sensitive"]).isin(TRUE + FALSE), F.lit(False)))),
        ("redactedRegions: not an object", some("_regions", lambda m: m.isNull())),
        ("redactedRegions: extra key", some("_regions", lambda m: _extra(F.map_keys(m), KEYS["region"]))),
        ("redactedRegions.type: required", some("_regions", lambda m: m.isNotNull() & ~_is_text(m["type"]))),
        ("redactedRegions: not text", some("_regions", lambda m: not_text(m, "rawType", "agentId"))),
        ("redactedRegions.bbox: not a box", some("_regions", lambda m: m.isNotNull() & ~_is_box(m["bbox"]))),
        ("redactedRegions.source: not a source", some("_regions", lambda m: _given(m["source"]) & ~F.coalesce(_is_text(m["source"]) & _as(m["source"], "string").isin("dom", "vision"), F.lit(False)))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    errors = F.when(root.isNull(), F.array(F.lit("body: not an object"))).otherwise(found)

    def read(name: str, kind: str, build) -> Column:
        return F.coalesce(F.transform(name, lambda e: F.when(e["t"].isNull(), build(e["m"])).otherwise(e["t"])), F.array().cast(f"array<{kind}>"))

    lists = [read(name, kind, build).alias(key) for (key, name), (kind, *_, build) in zip(LISTS.items(), forms, strict=True)]
    parsed = F.when(root.isNotNull(), F.struct(*lists, _as(root["taskGoal"], "string").alias("taskGoal")))
    return df.withColumn("errors", errors).withColumn("parsed", parsed).drop("_root", *LISTS.values(), *odd.values())


def sound(validated: DataFrame) -> DataFrame:
    """(request_id, parsed) of validated requests without errors.

    The rows are taken by exploding a list that is empty for the others: a condition would be moved down to the body and there
    be written out with all rules in full, each of which would read the body again.
    """
    return validated.select("request_id", F.explode(F.when(F.size("errors") == 0, F.array("parsed"))).alias("parsed"))


def request_nodes(parsed: DataFrame) -> DataFrame:
    """Node rows of parsed requests."""
    n = parsed.select("request_id", F.posexplode("parsed.domSnapshot").alias("node_idx", "n"))
    box = [F.col("n.bbox")[c].alias(c) for c in "xywh"]
    return n.select("request_id", "node_idx", F.col("n.agentId").alias("agent_id"), "n.tag", "n.role", "n.type", "n.text", *box, "n.sensitive")


def request_regions(parsed: DataFrame) -> DataFrame:
    r = parsed.select("request_id", F.posexplode("parsed.redactedRegions").alias("region_idx", "r"))
    kind, raw = X.normal_pii_type(F.col("r.type"))
    box = [F.col("r.bbox")[c].alias(c) for c in "xywh"]
    return r.select("request_id", "region_idx", kind.alias("type"), F.coalesce("r.rawType", raw).alias("raw_type"), *box, F.col("r.agentId").alias("agent_id"), infer_source(F.col("r.source"), F.col("r.agentId")).alias("source"))


def admit(requests: DataFrame, keep_body: bool = False) -> DataFrame:
    """(request_id, status, error_code, errors, leaked), and body if it is kept: 422 for malformed requests, 400 for leaking ones, else 200.

    leaked names the agent ids that find_leaks would, in order. A request's arrays are searched inside its row, without a shuffle.
    """
    df = validate_requests(requests)
    regions = F.transform("parsed.redactedRegions", lambda r: F.struct(r["agentId"].alias("id"), infer_source(r["source"], r["agentId"]).alias("source"), r["bbox"].alias("b")))
    df = df.withColumn("_regions", regions).withColumn("_nodes", F.col("parsed.domSnapshot"))

    def box(b: Column) -> G.Box:
        return b["x"], b["y"], b["w"], b["h"]

    def leaks(n: Column, i: Column) -> Column:
        named = F.exists("_regions", lambda r: r["id"] == n["agentId"]) & ~F.exists(F.slice("_nodes", i + 2, F.greatest(F.size("_nodes"), F.lit(1))), lambda m: m["agentId"] == n["agentId"])
        covered = F.exists("_regions", lambda r: (r["source"] == "dom") & n["bbox"].isNotNull() & (G.overlap_ratio(box(r["b"]), box(n["bbox"])) > COVERED))
        bad = F.coalesce(named, F.lit(False)) | F.coalesce(covered, F.lit(False)) | F.coalesce(n["sensitive"], F.lit(False))
        return F.when(has_text(n["text"]) & bad, n["agentId"])

    none = F.array().cast("array<string>")
    leaked = F.array_sort(F.array_distinct(F.array_compact(F.transform("_nodes", leaks))))
    df = df.withColumn("leaked", F.when(F.size("errors") > 0, none).otherwise(leaked))
    status = F.when(F.size("errors") > 0, 422).when(F.size("leaked") > 0, 400).otherwise(200)
    code = F.when(F.size("errors") > 0, "REQUEST_INVALID").when(F.size("leaked") > 0, "PII_LEAK_DETECTED")
    return df.select("request_id", status.alias("status"), code.alias("error_code"), "errors", "leaked", *["body"] * keep_body)


def validate_actions(actions: DataFrame) -> DataFrame:
    """actions with error_code (null if valid) and a null value where the model must not give one."""
    fill = F.col("action") == "fill_profile"
    code = (
        F.when(fill & F.col("value").isNotNull(), "MODEL_SUPPLIED_PROFILE_VALUE")
        .when(~F.coalesce(F.col("action").isin(vocab.ACTION_TYPES), F.lit(False)), "VLM_RESPONSE_SCHEMA_INVALID")
        .when(F.coalesce(F.col("target_id"), F.lit("")) == "", "VLM_RESPONSE_SCHEMA_INVALID")
        .when(fill & ~F.coalesce(F.col("profile_field").isin(vocab.PROFILE_FIELDS), F.lit(False)), "VLM_RESPONSE_SCHEMA_INVALID")
        .when(~fill & F.col("profile_field").isNotNull(), "VLM_RESPONSE_SCHEMA_INVALID")
    )
    return drop_model_value(actions.withColumn("error_code", code))


def drop_model_value(actions: DataFrame) -> DataFrame:
    return actions.withColumn("value", F.when(F.col("action") != "fill_profile", F.col("value")))


def first_safe_target(requests: DataFrame, nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """(request_id, action, target_id, profile_field): fill a profile field, type, click, or be done, on the first safe node that allows it."""
    hidden = regions.where("agent_id is not null").select("request_id", "agent_id").distinct()
    safe = nodes.where(~F.coalesce("sensitive", F.lit(False))).join(hidden, ["request_id", "agent_id"], "left_anti")
    field = X.profile_field_for(F.col("type"), F.col("text"))
    kinds = ["text", "email", "tel", "search", "password"]
    safe = safe.withColumn("profile_field", field).withColumn("rule", F.when(F.col("profile_field").isNotNull(), 1).when(F.col("type").isin(kinds), 2).otherwise(3))
    first = safe.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("rule", "node_idx"))).where("_n = 1")
    df = requests.select("request_id").distinct().join(first.select("request_id", "rule", F.col("agent_id").alias("target_id"), "profile_field"), "request_id", "left")
    action = F.when(F.col("rule") == 1, "fill_profile").when(F.col("rule") == 2, "type").when(F.col("rule") == 3, "click").otherwise("done")
    return df.select("request_id", action.alias("action"), F.coalesce("target_id", F.lit(vocab.PAGE_TARGET)).alias("target_id"), F.when(F.col("rule") == 1, F.col("profile_field")).alias("profile_field"))


def quoted(text: Column) -> Column:
    """The text in quotes on one line: quotes, backslashes and characters that do not print are escaped, so that no text can
    end its quotes or begin a line."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    double = text.contains("'") & ~text.contains('"')
    plain = F.when(double, plain).otherwise(F.replace(plain, F.lit("'"), F.lit("\\'")))
    odd = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Co}\p{Cn}\p{Zs}&&[^ ]]"

    def escaped(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        wide = F.when(F.length(code) <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))).when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
        return F.when(c.rlike(odd), wide.otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))).otherwise(c)

    plain = _bound(plain, lambda p: F.when(p.rlike(odd), F.array_join(F.transform(F.split(p, ""), escaped), "")).otherwise(p))
    mark = F.when(double, '"').otherwise("'")
    return F.concat(mark, plain, mark)


# Labels of a prompt's parts.
LABELS = {
    "goal": "TASK GOAL: ", "regions": "REDACTED REGIONS (", "regions_end": " total, do not guess their contents):", "no_regions": "No regions were redacted in this screenshot.",
    "nodes": "DOM SNAPSHOT (", "nodes_end": " nodes):", "no_nodes": "  (empty)", "type": "  - type=", "raw": " (rawType=", "agent": ", agentId=", "node": "  - agentId=", "tag": ", tag=", "role": ", role=", "kind": ", type=", "text": ", text=", "sensitive": ", sensitive=true",
}


def build_prompts(parsed: DataFrame, opening: str, privacy_notice: str, closing: str) -> DataFrame:
    """(request_id, prompt) from parsed requests: goal, privacy notice and regions if any, nodes in order, instructions."""
    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(LABELS[label]), value)).otherwise("")

    def region_line(r: Column) -> Column:
        kind, raw = X.normal_pii_type(r["type"])
        raw, b = F.coalesce(r["rawType"], raw), r["bbox"]
        sides = [x for c in "xywh" for x in (F.lit(f"{', ' * (c != 'x')}{c}="), b[c])]
        raw = F.when(F.coalesce(raw, F.lit("")) != "", F.concat(F.lit(LABELS["raw"]), raw, F.lit(")"))).otherwise("")
        return F.concat(F.lit(LABELS["type"]), kind, raw, part("agent", r["agentId"]), F.lit(", bbox=("), *sides, F.lit(")"))

    def node_line(n: Column) -> Column:
        shown = F.when(F.coalesce(n["text"], F.lit("")) != "", F.concat(F.lit(LABELS["text"]), quoted(n["text"]))).otherwise("")
        return F.concat(F.lit(LABELS["node"]), n["agentId"], F.lit(LABELS["tag"]), n["tag"], part("role", n["role"]), part("kind", n["type"]), shown, F.when(n["sensitive"], LABELS["sensitive"]).otherwise(""))

    n, m = F.size("parsed.redactedRegions"), F.size("parsed.domSnapshot")
    hidden = F.concat(F.array(F.lit(privacy_notice), F.lit(""), F.concat(F.lit(LABELS["regions"]), n, F.lit(LABELS["regions_end"]))), F.transform("parsed.redactedRegions", region_line))
    regions = F.when(n > 0, hidden).otherwise(F.array(F.lit(LABELS["no_regions"])))
    nodes = F.when(m > 0, F.transform("parsed.domSnapshot", node_line)).otherwise(F.array(F.lit(LABELS["no_nodes"])))
    head = F.array(F.lit(opening), F.lit(""), F.concat(F.lit(LABELS["goal"]), F.col("parsed.taskGoal")), F.lit(""))
    count = F.array(F.lit(""), F.concat(F.lit(LABELS["nodes"]), m, F.lit(LABELS["nodes_end"])))
    return parsed.select("request_id", F.array_join(F.concat(head, regions, count, nodes, F.array(F.lit(""), F.lit(closing))), "\n").alias("prompt"))
