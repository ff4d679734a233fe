"""Whole pages, each sanitised inside its row: no exchange, no state, so that a batch and a stream are one plan.

A page row has what the parser gives (sources.html.PAGE) and arrays of what is known of it besides: INPUTS. Every step is a
Column expression over these arrays; sorts stand in for windows, so that a page of n elements takes n log n steps, but for
the ranking's nearness to a fifth of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.functions import text as X
from hushframe.operators import rank as R
from hushframe.operators.requests import MIN_VALUE
from hushframe.sources import html as H

_BOX = "x: double, y: double, w: double, h: double"
#: What a page's row may have besides: places of elements, ids used before, detector boxes, and the frames' tokens, rectangles and reports.
INPUTS = {
    "layout": f"struct<node_idx: int, {_BOX}>",
    "acted": "struct<agent_id: string>",
    "boxes": "struct<box_idx: bigint, label: string, xmin: double, ymin: double, xmax: double, ymax: double>",
    "tokens": "struct<token: string, dx: double, dy: double, connected: boolean>",
    "iframes": f"struct<token: string, {_BOX}>",
    "reports": f"struct<frame_id: bigint, token: string, ok: boolean, part: string, agent_id: string, tag: string, role: string, type: string, text: string, pii_type: string, selector: string, {_BOX}>",
}
#: Parts of a frame's report: a node of its snapshot, a flagged node, a region that it cannot see into. A row of no part only says that the frame answered.
PARTS = ("node", "sensitive", "unscannable")


def page_rows(parsed: DataFrame, **inputs: DataFrame | Column | None) -> DataFrame:
    """parsed with an array column for each of INPUTS, empty where nothing is given.

    An input is a table, or a column that takes the array from the page's own row. One exchange, by page, takes all tables; without
    them there is none. Tables have page_id and the fields of INPUTS; missing fields are null. Rows of a page_id that parsed has
    not are left out; pages without id, and repeated ones, stay pages of their own.
    """
    given = {k: v for k, v in inputs.items() if isinstance(v, DataFrame)}
    own = {k: F.coalesce(v.cast(f"array<{INPUTS[k]}>"), F.array().cast(f"array<{INPUTS[k]}>")) for k, v in inputs.items() if isinstance(v, Column)}
    none = {k: F.array().cast(f"array<{INPUTS[k]}>") for k in INPUTS}

    def taken(df: DataFrame) -> DataFrame:
        """df with what comes from the page's own row, and with empty arrays for what nothing is known of."""
        parts = [x for k, v in own.items() for x in (k, v)]
        df = df.withColumns({k: v for k, v in none.items() if k not in own and k not in df.columns})
        return (df.transform(_put, *parts) if parts else df).select(*parsed.columns, *INPUTS)

    if not given:
        return taken(parsed)
    page = [c for c in parsed.columns if c != "page_id"]
    kinds = {"page": parsed.select(F.struct(*page).alias("v")).schema["v"].dataType.simpleString(), **{k: INPUTS[k] for k in given}}

    def one(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.select("page_id", *[(value if k == name else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])

    def fields(name: str, df: DataFrame) -> Column:
        wanted = [f.split(":")[0].strip() for f in INPUTS[name][7:-1].split(",")]
        return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in wanted])

    rows = [one("page", parsed.where("page_id is not null"), F.struct(*page)), *[one(k, df.where("page_id is not null"), fields(k, df)) for k, df in given.items()]]
    together = reduce(DataFrame.unionByName, rows).groupBy("page_id").agg(*[F.collect_list(k).alias(k) for k in kinds])
    known = together.withColumn("page", F.explode("page")).select("page_id", "page.*", *given)
    return taken(known).unionByName(taken(parsed.where("page_id is null")))


def _put(df: DataFrame, name: str, value: Column, *more: str | Column) -> DataFrame:
    """df with a column, and further ones as name and value in turn, that are taken once for each row.

    The optimizer moves an expression of one use to where it is used, even into a lambda, which then takes it anew for each
    element; it leaves one alone that names its partition.
    """
    parts = [name, value, *more]
    return df.withColumns({n: F.when(F.spark_partition_id() >= 0, v) for n, v in zip(parts[::2], parts[1::2], strict=True)})


def _box(n: Column) -> G.Box:
    return n["x"], n["y"], n["w"], n["h"]


def _changes(items: str, *keys: str) -> Column:
    """The entries of a sorted array that differ from the one before them in a key."""
    def new(e: Column, k: Column) -> Column:
        before = F.get(F.col(items), k - 1)
        return (k == 0) | reduce(Column.__or__, [~e[c].eqNullSafe(before[c]) for c in keys])

    return F.filter(items, new)


def with_ids(rows: DataFrame) -> DataFrame:
    """rows with ids (by element, null for those that have none), last_ids (numbers of the elements that are the last of their id), n_ids (the largest number).

    Actionable elements keep an id agent-N as it is written; the others of them get the numbers after the page's largest.
    """
    def own(e: Column) -> Column:
        written, acts = e["attrs"]["data-agent-id"], X.is_actionable(e["tag"], e["attrs"])
        number = F.when(acts, F.nullif(F.regexp_extract(F.coalesce(written, F.lit("")), r"^agent-([0-9]+)$", 1), F.lit("")).cast("decimal(38,0)"))
        return F.struct(e["node_idx"].alias("idx"), F.when(number.isNotNull(), written).alias("id"), number.alias("n"), (acts & number.isNull()).alias("new"))

    df = rows.transform(_put, "_own", F.transform("elements", own)).transform(_put, "_top", F.coalesce(F.array_max(F.transform("_own", lambda m: m["n"])), F.lit(0)))
    new = F.transform(F.filter("_own", lambda m: m["new"]), lambda m, k: F.struct(m["idx"].alias("idx"), F.concat(F.lit("agent-"), (F.col("_top") + k + 1).cast("string")).alias("id")))
    old = F.transform(F.filter("_own", lambda m: ~m["new"]), lambda m: F.struct(m["idx"].alias("idx"), m["id"].alias("id")))
    df = df.transform(_put, "_new", new).transform(_put, "_all", F.sort_array(F.concat(old, F.col("_new"))))
    df = df.transform(_put, "_by_id", F.sort_array(F.transform(F.filter("_all", lambda m: m["id"].isNotNull()), lambda m: F.struct(m["id"].alias("id"), (-m["idx"]).alias("back")))))
    last = F.sort_array(F.transform(_changes("_by_id", "id"), lambda m: -m["back"]))
    return df.transform(_put, "last_ids", last, "ids", F.transform("_all", lambda m: m["id"]), "n_ids", F.col("_top") + F.size("_new")).drop("_own", "_top", "_new", "_all", "_by_id")


def with_written_ids(rows: DataFrame, start: int | None = None) -> DataFrame:
    """rows with ids as elements have them written; flags of others get the numbers after start, or none without it."""
    return rows.transform(_put, "ids", F.transform("elements", lambda e: e["attrs"]["data-agent-id"]), "n_ids", F.lit(start).cast("int"))


def with_flags(rows: DataFrame) -> DataFrame:
    """rows (with ids and n_ids) and flags: an array of (o1..o4, selector, type, element, agent_id), in this order, as operators.pages.scan_pii and scanner_ordinals give."""
    none = F.array().cast("array<struct<o1: int, o2: int, o3: int, o4: int, type: string, element: int>>")

    def hits(types: Column, leg: int, at: Column, pos: Column, element: Column) -> Column:
        return F.transform(types, lambda t, k: F.struct(F.lit(leg).alias("o1"), at.alias("o2"), pos.alias("o3"), k.alias("o4"), t.alias("type"), element.alias("element")))

    def of_field(e: Column) -> Column:
        kind = F.array_compact(F.array(X.classify_field(e["attrs"]["autocomplete"], e["attrs"]["type"])))
        values = F.flatten(F.transform(H.field_values(F.col("body"), e), lambda v, p: hits(X.text_pii_types(v), 0, e["node_idx"], p + 1, e["node_idx"])))
        return F.concat(hits(kind, 0, e["node_idx"], F.lit(0), e["node_idx"]), values)

    def of_text(t: Column, k: Column) -> Column:
        shown = F.get(F.col("elements"), t["parent_idx"])["visible"]
        return F.when(shown, hits(X.text_pii_types(H.body_text(F.col("body"), t["start"], t["stop"])), 1, k, F.lit(0), t["parent_idx"])).otherwise(none)

    fields = F.filter("elements", lambda e: F.lower(e["tag"]).isin("input", "textarea", "select"))
    df = rows.transform(_put, "_hits", F.flatten(F.concat(F.transform(fields, of_field), F.transform("texts", of_text))))

    def named(h: Column) -> Column:
        selector = H.selector_of(F.col("pieces"), F.col("overs"), h["element"], F.get(F.col("elements"), h["element"])["steps"])
        return F.struct(selector.alias("selector"), *[h[c].alias(c) for c in ("type", "o1", "o2", "o3", "o4", "element")])

    df = df.transform(_put, "_named", F.sort_array(F.transform("_hits", named)))
    order = ("o1", "o2", "o3", "o4", "selector", "type", "element")
    df = df.transform(_put, "_first", F.sort_array(F.transform(_changes("_named", "selector", "type"), lambda h: F.struct(*[h[c].alias(c) for c in order], F.get(F.col("ids"), h["element"]).alias("agent_id")))))
    old = F.filter("_first", lambda h: h["agent_id"].isNotNull())
    new = F.transform(F.filter("_first", lambda h: h["agent_id"].isNull()), lambda h, k: F.struct(*[h[c].alias(c) for c in order], F.concat(F.lit("agent-"), (F.col("n_ids") + k + 1).cast("string")).alias("agent_id")))
    return df.transform(_put, "flags", F.sort_array(F.concat(old, new))).drop("_hits", "_named", "_first")


def with_places(rows: DataFrame) -> DataFrame:
    """rows with places: the box of each element by its number, null sides where layout has none."""
    known = F.transform("layout", lambda p: F.struct(p["node_idx"].alias("i"), F.lit(0).alias("missing"), *[p[c].alias(c) for c in "xywh"]))
    blank = F.transform("elements", lambda e: F.struct(e["node_idx"].alias("i"), F.lit(1).alias("missing"), *[F.lit(None).cast("double").alias(c) for c in "xywh"]))
    df = rows.transform(_put, "_all", F.sort_array(F.filter(F.concat(known, blank), lambda p: (p["i"] >= 0) & (p["i"] < F.size("elements")))))
    return df.transform(_put, "places", _changes("_all", "i")).drop("_all")


def with_frames(rows: DataFrame) -> DataFrame:
    """rows with moved (report rows in top-frame coordinates), merged (tokens of the frames that stand for their iframe) and blind (iframes with area that none stands for).

    A frame is merged if its report is ok, its token belongs to a connected iframe with a finite offset, and all its rows have
    finite boxes: else none of its rows counts and its whole rectangle is blind.
    """
    def offset(token: Column) -> Column:
        return F.get(F.filter("tokens", lambda t: t["token"] == token), F.lit(0))

    def ok(r: Column) -> Column:
        o = offset(r["token"])
        fine = F.coalesce(r["ok"] & o["connected"], F.lit(False)) & G.is_finite(o["dx"], o["dy"])
        return fine & (r["part"].isNull() | G.is_finite(*_box(r)))

    df = rows.transform(_put, "_bad", F.array_distinct(F.transform(F.filter("reports", lambda r: ~ok(r)), lambda r: F.struct(r["frame_id"].alias("frame_id"), r["token"].alias("token")))))
    good = F.filter("reports", lambda r: ok(r) & ~F.exists("_bad", lambda b: b["frame_id"].eqNullSafe(r["frame_id"]) & b["token"].eqNullSafe(r["token"])))
    rest = ("frame_id", "token", "part", "agent_id", "tag", "role", "type", "text", "pii_type", "selector")

    def moved(r: Column) -> Column:
        o = offset(r["token"])
        return F.struct(*[r[c].alias(c) for c in rest], *[b.alias(c) for b, c in zip(G.translate(_box(r), o["dx"], o["dy"]), "xywh", strict=True)])

    df = df.transform(_put, "moved", F.transform(good, moved)).transform(_put, "merged", F.array_distinct(F.transform("moved", lambda r: r["token"])))
    blind = F.filter("iframes", lambda f: (f["w"] > 0) & (f["h"] > 0) & ~F.coalesce(F.array_contains(F.col("merged"), f["token"]), F.lit(False)))
    return df.transform(_put, "blind", blind).drop("_bad")


def without_frames(rows: DataFrame) -> DataFrame:
    """rows of pages whose frames nothing is known of, with the columns of with_frames."""
    moved = f"array<struct<frame_id: bigint, token: string, part: string, agent_id: string, tag: string, role: string, type: string, text: string, pii_type: string, selector: string, {_BOX}>>"
    return rows.withColumns({"moved": F.array().cast(moved), "merged": F.array().cast("array<string>"), "blind": F.array().cast(f"array<{INPUTS['iframes']}>")})


def with_nodes(rows: DataFrame) -> DataFrame:
    """rows with nodes: the snapshot that may be sent, raw, without nodes used before; sensitive is set where a flag names the node."""
    def node(idx: Column) -> Column:
        e, p = F.get(F.col("elements"), idx), F.get(F.col("places"), idx)
        a = e["attrs"]
        text = X.accessible_text(e["tag"], a["value"], a["aria-label"], a["placeholder"], H.chosen_text(F.col("body"), e), H.body_text(F.col("body"), e["start"], e["stop"]))
        return _node(e["node_idx"], F.get(F.col("ids"), idx), e["tag"], X.implicit_role(e["tag"], a["role"], a["href"], a["type"]), X.semantic_type(e["tag"], a["type"]), text, p)

    def _node(idx: Column, agent_id: Column, tag: Column, role: Column, kind: Column, text: Column, box: Column) -> Column:
        sensitive = F.coalesce(F.array_contains("_flagged", agent_id), F.lit(False))
        return F.struct(idx.cast("int").alias("node_idx"), agent_id.alias("agent_id"), tag.alias("tag"), role.alias("role"), kind.alias("type"), text.alias("text"), sensitive.alias("sensitive"), *[box[c].alias(c) for c in "xywh"])

    def of_frame(r: Column, k: Column) -> Column:
        return _node(F.size("elements") + k, r["agent_id"], r["tag"], r["role"], r["type"], r["text"], r)

    theirs = F.transform(F.filter("moved", lambda r: r["part"] == "sensitive"), lambda r: r["agent_id"])
    df = rows.transform(_put, "_flagged", F.array_compact(F.concat(F.transform("flags", lambda f: f["agent_id"]), theirs)), "_used", F.array_compact(F.transform("acted", lambda a: a["agent_id"])))
    every = F.concat(F.transform("last_ids", node), F.transform(F.filter("moved", lambda r: r["part"] == "node"), of_frame))
    return df.transform(_put, "nodes", F.filter(every, lambda n: ~F.coalesce(F.array_contains("_used", n["agent_id"]), F.lit(False)))).drop("_flagged", "_used")


def with_ranks(rows: DataFrame, goal: Column, max_elements: int = R.MAX_ELEMENTS, weights: dict[str, float] = R.WEIGHTS, viewport: tuple[float, float] = R.VIEWPORT) -> DataFrame:
    """rows with scores and kept, arrays by node: operators.rank.rank_elements inside the row, by folds and sorts of the page's nodes."""
    def base(n: Column) -> Column:
        surface = F.concat_ws(" ", F.nullif(n["text"], F.lit("")), F.nullif(n["role"], F.lit("")), F.nullif(n["type"], F.lit("")))
        parts = {"text": R.text_score(surface, goal), "kind": R.kind_score(n["tag"], n["role"]), "viewport": R.viewport_score(_box(n), *viewport), "size": R.size_score(n["w"], n["h"])}
        return sum((weights[k] * v for k, v in parts.items()), F.lit(0.0))

    def centre(n: Column) -> tuple[Column, Column]:
        return n["x"] + F.coalesce(n["w"], F.lit(0.0)) / 2, n["y"] + F.coalesce(n["h"], F.lit(0.0)) / 2

    many, size = F.size("nodes") > max_elements, F.size("nodes")
    df = rows.transform(_put, "_base", F.when(many, F.transform("nodes", base)))
    df = df.transform(_put, "_order", F.sort_array(F.transform("nodes", lambda n, k: F.struct((-F.get(F.col("_base"), k)).alias("less"), n["node_idx"].alias("idx"), centre(n)[0].alias("cx"), centre(n)[1].alias("cy")))))
    count = F.greatest(F.lit(R.MIN_ANCHORS), F.ceil(size * R.ANCHOR_SHARE)).cast("int")
    df = df.transform(_put, "_anchors", F.when(many, F.filter(F.slice("_order", F.lit(1), count), lambda a: a["cx"].isNotNull() & a["cy"].isNotNull())))

    def score(n: Column, k: Column) -> Column:
        cx, cy = centre(n)
        near = F.aggregate("_anchors", F.lit(None).cast("double"), lambda d, a: F.when(a["idx"] != n["node_idx"], F.least(d, F.hypot(cx - a["cx"], cy - a["cy"]))).otherwise(d))
        proximity = F.when(cx.isNull() | cy.isNull(), 0.4).otherwise(F.coalesce(1 / (1 + near / R.RADIUS), F.lit(0.0)))
        return F.get(F.col("_base"), k) + weights["proximity"] * proximity

    df = df.transform(_put, "_scores", F.when(many, F.transform("nodes", score)))
    held = F.size(F.filter("nodes", lambda n: n["sensitive"]))
    free = F.filter(F.transform("nodes", lambda n, k: F.struct((-F.get(F.col("_scores"), k)).alias("less"), n["node_idx"].alias("idx"), n["sensitive"].alias("sensitive"))), lambda s: ~s["sensitive"])
    best = F.transform(F.slice(F.sort_array(free), F.lit(1), F.greatest(F.lit(0), max_elements - held)), lambda s: s["idx"])
    df = df.transform(_put, "_best", F.when(many, best))
    kept = F.transform("nodes", lambda n: ~many | n["sensitive"] | F.coalesce(F.array_contains("_best", n["node_idx"]), F.lit(False)))
    return df.transform(_put, "kept", kept, "scores", F.transform("nodes", lambda n, k: G.js_round(F.get(F.col("_scores"), k), 4))).drop("_base", "_order", "_anchors", "_scores", "_best")


def with_regions(rows: DataFrame, scroll: tuple[float, float], dpr: float) -> DataFrame:
    """rows with regions (screenshot pixels: detector boxes, flagged nodes, then what cannot be seen into) and unplaced (selector, type) of what has no finite place to paint over."""
    if not 0 < dpr < float("inf"):
        raise ValueError("dpr must be finite and above 0")

    def dom(kind: Column, agent_id: Column, selector: Column, box: Column) -> Column:
        return F.struct(kind.alias("kind"), agent_id.alias("agent_id"), selector.alias("selector"), *[box[c].alias(c) for c in "xywh"])

    none, other = F.lit(None).cast("string"), F.lit("other")
    flagged = F.transform("flags", lambda f: dom(f["type"], f["agent_id"], f["selector"], F.get(F.col("places"), f["element"])))
    theirs = F.transform(F.filter("moved", lambda r: r["part"] == "sensitive"), lambda r: dom(r["pii_type"], r["agent_id"], r["selector"], r))
    hosts = F.filter("elements", lambda e: e["attrs"][H.CLOSED_HOST].isNotNull())
    hosts = F.transform(hosts, lambda e: dom(other, none, H.selector_of(F.col("pieces"), F.col("overs"), e["node_idx"], e["steps"]), F.get(F.col("places"), e["node_idx"])))
    unseen = F.transform(F.filter("moved", lambda r: r["part"] == "unscannable"), lambda r: dom(other, none, r["selector"], r))
    frames = F.transform("blind", lambda f: dom(other, none, F.concat(F.lit("iframe "), F.coalesce(f["token"], F.lit(""))), f))
    df = rows.transform(_put, "_dom", F.concat(flagged, theirs, hosts, unseen, frames))

    def region(kind: Column, box: G.Box, agent_id: Column, source: str) -> Column:
        known, raw = X.normal_pii_type(kind)
        return F.struct(known.alias("type"), raw.alias("raw_type"), *[b.alias(c) for b, c in zip(box, "xywh", strict=True)], agent_id.alias("agent_id"), F.lit(source).alias("source"))

    def vision(b: Column) -> Column:
        return region(b["label"], G.from_corners(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), none, "vision")

    def painted(d: Column) -> Column:
        moved = G.translate(_box(d), F.lit(float(scroll[0])), F.lit(float(scroll[1])))
        return region(d["kind"], G.scale(moved, F.lit(float(dpr))), d["agent_id"], "dom")

    every = F.concat(F.transform(F.sort_array("boxes"), vision), F.transform("_dom", painted))
    gone = F.filter("_dom", lambda d: ~G.is_finite(*_box(d)))
    return df.transform(_put, "regions", F.filter(every, lambda r: r["x"].isNotNull()), "unplaced", F.transform(gone, lambda d: F.struct(d["selector"].alias("selector"), d["kind"].alias("type")))).drop("_dom")


def with_sent(rows: DataFrame) -> DataFrame:
    """rows with sent: the sanitised nodes, text null where sensitive, and whether each is kept."""
    def clean(n: Column, k: Column) -> Column:
        text = F.when(~n["sensitive"], n["text"])
        return F.struct(*[n[c].alias(c) for c in ("node_idx", "agent_id", "tag", "role", "type")], text.alias("text"), n["sensitive"].alias("sensitive"), F.get(F.col("kept"), k).alias("kept"), F.get(F.col("scores"), k).alias("score"))

    return rows.transform(_put, "sent", F.transform("nodes", clean))


def with_leaks(rows: DataFrame) -> DataFrame:
    """rows with leaks: agent ids whose raw text still stands in what is kept of sent."""
    df = rows.transform(_put, "_payload", F.to_json(F.transform(F.filter("sent", lambda n: n["kept"]), lambda n: F.struct(*[n[c].alias(c) for c in ("agent_id", "tag", "role", "type", "text")]))))
    held = F.transform(F.filter("nodes", lambda n: n["sensitive"]), lambda n: F.struct(n["agent_id"].alias("id"), X.js_trim(n["text"]).alias("raw")))

    def out(v: Column) -> Column:
        escaped = F.regexp_extract(F.to_json(F.struct(v["raw"].alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
        return (F.length(v["raw"]) >= MIN_VALUE) & (F.contains(F.col("_payload"), v["raw"]) | F.contains(F.col("_payload"), escaped))

    return df.transform(_put, "leaks", F.array_distinct(F.transform(F.filter(held, out), lambda v: v["id"]))).drop("_payload")


def counted(rows: DataFrame) -> Column:
    """The step's counts by name, zeros included."""
    def n(items: str | Column) -> Column:
        return F.size(items).cast("long")

    def frames(items: str, which=lambda r: F.lit(True)) -> Column:
        return n(F.array_distinct(F.transform(F.filter(items, which), lambda r: r["frame_id"])))

    hosts = n(F.filter("elements", lambda e: e["attrs"][H.CLOSED_HOST].isNotNull()))
    return F.struct(
        n("last_ids").alias("actionable_nodes"), n("flags").alias("sensitive_nodes"), frames("reports").alias("frames_reported"), frames("moved").alias("frames_merged"), (frames("reports") - frames("moved")).alias("frames_dropped"),
        n(F.filter("moved", lambda r: r["part"] == "sensitive")).alias("subframe_sensitive_nodes"), n(F.filter("moved", lambda r: r["part"] == "node")).alias("subframe_actionable_nodes"),
        (hosts + n(F.filter("moved", lambda r: r["part"] == "unscannable")) + n("blind")).alias("unscannable_regions"), n("nodes").alias("candidates"), n(F.filter("kept", lambda k: k)).alias("selected"),
        n(F.filter("kept", lambda k: ~k)).alias("dropped"), n("regions").alias("regions"), n("boxes").alias("vision_boxes"), n("unplaced").alias("unplaced"), n("leaks").alias("leaks"),
    )


def ranked_rows(rows: DataFrame, goal: str, max_elements: int = R.MAX_ELEMENTS, viewport: tuple[float, float] = R.VIEWPORT, weights: dict[str, float] = R.WEIGHTS, frames: bool = True) -> DataFrame:
    """Page rows scanned, flagged, merged with their frames and ranked. Without frames the rows' reports and iframes are known to be empty."""
    df = with_places(with_flags(with_ids(rows)))
    df = with_nodes(with_frames(df) if frames else without_frames(df))
    return with_ranks(df, F.array_distinct(X.tokenize(F.lit(goal))), max_elements, weights, viewport)


def finished_rows(ranked: DataFrame, scroll: tuple[float, float] = (0.0, 0.0), dpr: float = 1.0) -> DataFrame:
    """(page_id, error, sent, regions, unplaced, leaks, counts) of ranked rows.

    Nodes of merged frames come after the page's own; what a frame's report could not be merged for, and what no scan can see into, becomes a
    region of type other. A page that could not be parsed has its error and nothing else: nothing of it is sent.
    """
    df = with_leaks(with_sent(with_regions(ranked, scroll, dpr)))
    return df.select("page_id", "error", "sent", "regions", "unplaced", "leaks", counted(df).alias("counts"))


def sent_nodes(rows: DataFrame) -> DataFrame:
    """Node rows of pages with sent: what is kept may leave; the rest shows what was dropped, dropped its number on the page."""
    dropped = F.size(F.filter("sent", lambda n: ~n["kept"])).cast("long")
    return rows.select("page_id", dropped.alias("dropped"), F.explode("sent").alias("n")).select("page_id", *[F.col(f"n.{c}").alias(c) for c in ("node_idx", "agent_id", "tag", "role", "type", "text", "sensitive", "kept")], "dropped")


def flag_rows(rows: DataFrame) -> DataFrame:
    """(page_id, seq, node_idx, selector, pii_type, agent_id) of rows with flags. Pages without id, and repeated ones, are counted each for itself."""
    return rows.select("page_id", F.posexplode("flags").alias("seq", "f")).select("page_id", "seq", F.col("f.element").alias("node_idx"), "f.selector", F.col("f.type").alias("pii_type"), "f.agent_id")


def region_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("page_id").alias("image_id"), F.posexplode("regions").alias("region_idx", "r")).select("image_id", *[F.col(f"r.{c}").alias(c) for c in ("type", "raw_type", "x", "y", "w", "h", "agent_id", "source")], "region_idx")
