"""Whole pages: what cannot be seen into is painted over, frames are merged or blind, and rows equal the table operators."""

import time

import pytest
from pyspark.sql import functions as F

from hushframe.functions import text as X
from hushframe.operators import frames as J
from hushframe.operators import page_rows as W
from hushframe.operators import pages as P
from hushframe.operators import rank as R
from hushframe.plans import pipelines
from hushframe.sources import html as H

HTML = """<html><body><input id="mail" type="email" value="me@example.org"><a href="/a">Home</a><div class="c"><template shadowrootmode="closed"><p>x</p></template></div>
<p>call 9876543210</p><iframe id="f1"></iframe><iframe id="f2"></iframe><button>Send the form</button></body></html>"""
PLACE = "page_id long, token string, x double, y double, w double, h double"
REPORT = "page_id long, frame_id long, token string, ok boolean, part string, agent_id string, tag string, text string, pii_type string, selector string, x double, y double, w double, h double"


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, HTML)], "page_id long, html string")


@pytest.fixture(scope="module")
def layout(spark):
    return spark.createDataFrame([(1, k, 10.0 * k, 20.0, 30.0, 5.0) for k in range(12)], "page_id long, node_idx int, x double, y double, w double, h double")


def frames(spark, **other):
    rows = [(1, 5, "a", True, "node", "agent-f5-1", "button", "Pay", None, None, 1.0, 2.0, 3.0, 4.0), (1, 5, "a", True, "node", "agent-f5-2", "input", "secret", None, None, 5.0, 2.0, 3.0, 4.0), (1, 5, "a", True, "sensitive", "agent-f5-2", None, None, "password", "#pw", 5.0, 2.0, 3.0, 4.0), (1, 5, "a", True, "unscannable", None, None, None, None, "#host", 7.0, 7.0, 1.0, 1.0)]
    rows += [(1, 6, "b", False, None, None, None, None, None, None, None, None, None, None)]
    tokens = [(1, "a", 100.0, 200.0, True), (1, "b", 0.0, 300.0, True)]
    iframes = [(1, "a", 100.0, 200.0, 50.0, 50.0), (1, "b", 0.0, 300.0, 50.0, 50.0), (1, None, 0.0, 400.0, 9.0, 9.0), (1, "z", 0.0, 0.0, 0.0, 9.0)]
    given = {"reports": (rows, REPORT), "tokens": (tokens, "page_id long, token string, dx double, dy double, connected boolean"), "iframes": (iframes, PLACE)}
    return {k: spark.createDataFrame(other.get(k, v), kind) for k, (v, kind) in given.items()}


def test_closed_roots_and_silent_frames_are_painted_over(spark, page, layout):
    out = pipelines.sanitize_pages(page, "send", layout=layout, scroll=(0.0, 100.0), dpr=2.0, **frames(spark))
    regions = [(r.type, r.agent_id, r.x, r.y) for r in out.regions.orderBy("region_idx").collect()]
    assert regions == [
        ("email", "agent-1", 40.0, 240.0), ("tel", "agent-4", 100.0, 240.0), ("password", "agent-f5-2", 210.0, 604.0), ("other", None, 80.0, 240.0),
        ("other", None, 214.0, 614.0), ("other", None, 0.0, 800.0), ("other", None, 0.0, 1000.0),
    ]
    nodes = {r.agent_id: (r.node_idx, r.text, r.sensitive) for r in out.nodes.collect()}
    assert nodes == {"agent-1": (2, None, True), "agent-2": (3, "Home", False), "agent-3": (8, "Send the form", False), "agent-f5-1": (9, "Pay", False), "agent-f5-2": (10, None, True)}
    assert out.unplaced.count() == 0 and out.leaks.count() == 0
    c = out.counts.first()
    assert (c.actionable_nodes, c.sensitive_nodes, c.frames_reported, c.frames_merged, c.frames_dropped, c.subframe_sensitive_nodes, c.subframe_actionable_nodes, c.unscannable_regions, c.selected, c.dropped, c.regions) == (3, 2, 2, 1, 1, 1, 2, 4, 5, 0, 7)


def test_what_has_no_place_is_told(spark, page):
    out = pipelines.sanitize_pages(page, "send")
    assert {(r.selector, r.type) for r in out.unplaced.collect()} == {("#mail", "email"), ("body > p", "tel"), ("body > div", "other")} and out.regions.count() == 0


@pytest.mark.parametrize("change", ["detached", "no offset", "bad box", "no token", "unknown token"])
def test_frames_that_cannot_be_placed_are_blind(spark, page, layout, change):
    token = {"no token": None, "unknown token": "q"}.get(change, "a")
    box = (float("nan") if change == "bad box" else 1.0, 2.0, 3.0, 4.0)
    rows = [(1, 5, token, True, "node", "agent-f5-1", "button", "Pay", None, None, *box), (1, 5, token, True, "node", "agent-f5-2", "button", "Go", None, None, 1.0, 2.0, 3.0, 4.0)]
    tokens = [(1, "a", None if change == "no offset" else 1.0, 2.0, change != "detached")]
    out = pipelines.sanitize_pages(page, "send", layout=layout, **frames(spark, reports=rows, tokens=tokens, iframes=[(1, "a", 0.0, 0.0, 5.0, 5.0)]))
    assert not [r for r in out.nodes.collect() if r.agent_id.startswith("agent-f")] and [r.w for r in out.regions.where("w = h").collect()] == [5.0]


def test_rows_equal_table_operators(spark, sf_dir):
    """Flags, ids and ranks taken inside the row are those of the operators on element tables."""
    parsed = H.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).cache()
    rows = W.with_flags(W.with_ids(W.page_rows(parsed))).cache()
    elements, texts = P.assign_ids(H.extract_elements(parsed)), H.extract_text_nodes(parsed)
    ids = rows.select("page_id", F.posexplode("ids").alias("node_idx", "agent_id"))
    assert sorted(map(tuple, ids.collect()), key=str) == sorted(map(tuple, elements.select("page_id", "node_idx", "agent_id").collect()), key=str)
    owners = elements.select("page_id", F.col("node_idx").alias("parent_idx"), F.col("agent_id").alias("owner"))
    texts = texts.join(owners, ["page_id", "parent_idx"], "left").withColumn("agent_id", F.col("owner"))
    flagged = P.scanner_ordinals(P.scan_pii(elements, texts), P.highest_ids(elements)).select("page_id", "seq", "node_idx", "selector", "pii_type", "agent_id")
    flags = rows.select("page_id", F.posexplode("flags").alias("seq", "f")).select("page_id", "seq", "f.element", "f.selector", "f.type", "f.agent_id")
    assert sorted(map(tuple, flags.collect()), key=str) == sorted(map(tuple, flagged.collect()), key=str)
    goal = "open the article about the and of"
    a = F.col("attrs")
    nodes = elements.where("kept_last").select(
        "page_id", "node_idx", "agent_id", "tag", X.implicit_role(F.col("tag"), a["role"], a["href"], a["type"]).alias("role"), X.semantic_type(F.col("tag"), a["type"]).alias("type"),
        X.accessible_text(F.col("tag"), a["value"], a["aria-label"], a["placeholder"], F.col("selected"), F.col("text")).alias("text"), F.lit(False).alias("sensitive"), *[((F.col("node_idx") * k) % 900).cast("double").alias(c) for k, c in ((37, "x"), (53, "y"), (7, "w"), (11, "h"))],
    )
    nodes = J.flag_sensitive(nodes, flagged)
    wanted = R.rank_elements(nodes, F.array_distinct(X.tokenize(F.lit(goal))), 5).select("page_id", "node_idx", "agent_id", "kept", "score", "dropped")
    layout = elements.select("page_id", "node_idx", *[((F.col("node_idx") * k) % 900).cast("double").alias(c) for k, c in ((37, "x"), (53, "y"), (7, "w"), (11, "h"))])
    got = W.with_sent(W.ranked_rows(W.page_rows(parsed, layout=layout), goal, 5))
    got = got.select("page_id", F.size(F.filter("sent", lambda n: ~n["kept"])).cast("long").alias("dropped"), F.explode("sent").alias("n")).select("page_id", "n.node_idx", "n.agent_id", "n.kept", "n.score", "dropped")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_pages_without_id_and_repeated_pages(spark, layout):
    pages = spark.createDataFrame([(1, "<a href=x>one</a>"), (1, "<a href=x>two</a>"), (None, "<a href=x>three</a>"), (None, None), (2, "")], "page_id long, html string")
    for inputs in ({}, {"layout": layout, "acted": spark.createDataFrame([(2, None), (None, "agent-1")], "page_id long, agent_id string")}):
        out = pipelines.sanitize_pages(pages, "go", **inputs)
        assert sorted((str(r.page_id), r.text) for r in out.nodes.collect()) == [("1", "one"), ("1", "two"), ("None", "three")] and out.counts.count() == 5
    assert pipelines.sanitize_pages(pages.where("false"), "go").nodes.count() == 0


def test_one_exchange_takes_all_inputs(spark, page, layout):
    boxes = spark.createDataFrame([(1, 0, "person", 0.5, 1.0, 1.0, 9.0, 9.0)], "image_id long, box_idx long, label string, score double, xmin double, ymin double, xmax double, ymax double")
    acted = spark.createDataFrame([(1, "agent-2")], "page_id long, agent_id string")
    rows = pipelines.sanitize_pages(page, "send", layout=layout, boxes=boxes, acted=acted, **frames(spark)).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 1 and "Window" not in plan and "Join" not in plan
    assert rows.first().regions[0].raw_type == "person"


@pytest.mark.parametrize("html", ["<b>" * 150_000 + "</i>" * 150_000, "<div>" * 50_000 + "deep a@example.com", "<p>a@example.com</p>" * 20_000, "<template>" * 20_000 + "</template>" * 20_000])
def test_large_odd_pages_take_seconds(html):
    began, rows = time.time(), H._Rows()
    rows.add(1, html)
    assert rows.batch().nbytes < 20 * len(html) + 10_000 and time.time() - began < 30


def test_style_and_hidden_marks(spark):
    html = '<body><p style="DISPLAY :\tnone">a</p><p aria-hidden="TRUE">b</p><div hidden><p>c</p></div><p style="visibility:hidden">d</p><p>e</p></body>'
    rows = H.extract_text_nodes(H.parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()
    assert {r.text: r.visible for r in rows} == {"a": False, "b": False, "c": False, "d": False, "e": True}


WELL_FORMED = [
    "<html><body><p>a <b>b <i>c</i></b> d</p><ul><li>1</li><li>2<br>3</li></ul></body></html>", "<div><div><div>x</div>y</div>z</div>", "<p>caf&eacute; &amp;copy; &#65;&amp;#66; &copy;</p>", "<div>a<span>b</div>c<div>d<b>e<i>f</div>",
    "</p></b><p>stray</p></p>", "<div hidden><p>a</p></div><p>b</p><div style='display:none'><div><p>c</p></div></div><p>d</p>", "<!-- <p>no</p> --><p>x<!-- y -->z</p><script>if (a<b) { '</p>' }</script><style>p{}</style><title>t</title>", "<p/>tail<br/>", "plain", "",
    "<body><p>1<p2>deep</p2></p><input type=hidden value=a><p aria-hidden=true>h</p>", "<b><b><b>x</b></b></b>", "<a><b></a><a></b></a>",
]


@pytest.mark.parametrize("html", WELL_FORMED)
def test_tokens_give_what_the_parser_gives(spark, html):
    from hushframe.sources import tokens as K

    pages = spark.createDataFrame([(1, html), (2, "<p>other</p>"), (3, None)], "page_id long, html string")
    parsed = H.parse_pages(pages)
    if html == WELL_FORMED[-1]:  # crossing end tags are told
        assert K.nested(pages).where("crossed").select("page_id").distinct().collect() == [(1,)]
        return
    elements = H.extract_elements(parsed).select("page_id", "node_idx", "parent_idx", "tag", "visible")
    assert sorted(map(str, K.native_elements(pages).collect())) == sorted(map(str, elements.collect()))
    texts = H.extract_text_nodes(parsed).select("page_id", "text_idx", "parent_idx", "visible", "text")
    assert sorted(map(str, K.native_text_nodes(pages).collect())) == sorted(map(str, texts.collect()))


def test_tokens_take_one_exchange(spark, page):
    from hushframe.sources import tokens as K

    plan = K.native_text_nodes(page)._jdf.queryExecution().sparkPlan()
    physical = K.native_text_nodes(page)._jdf.queryExecution().executedPlan().toString()
    assert plan and physical.count("+- Exchange") == 1
