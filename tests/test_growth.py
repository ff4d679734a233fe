"""Steps whose cost must not grow faster than their input."""

import json

import pytest

from hushframe import views
from hushframe.operators import requests as Q
from hushframe.plans import queries_admission as A
from hushframe.plans import queries_logs as QL
from hushframe.plans import queries_pages as QP


def test_sound_requests_are_not_found_by_a_condition_on_the_body(spark, sf_dir):
    plan = A._prompts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "variant" in line]


def test_large_tables_are_dealt_to_more_tasks_than_there_are_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert views.spread(spark.read.parquet(f"{tmp_path}/t"), 50).rdd.getNumPartitions() == 20
    assert views.spread(spark.read.parquet(f"{tmp_path}/t"), 500).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_plain_and_odd_values_of_one_list_are_read_alike(spark):
    node = {"agentId": "a", "tag": "p", "text": None, "sensitive": True, "bbox": {"x": 1, "y": 2.5, "w": True, "h": 1e2}}
    odd = {**node, "sensitive": "yes", "bbox": {"x": "1", "y": "2.5", "w": "1", "h": "100"}}
    region = {"type": "", "bbox": node["bbox"], "source": None}
    rows = [
        (1, {"domSnapshot": [node, odd], "redactedRegions": [region, {**region, "bbox": odd["bbox"]}]}, []),
        (2, {"domSnapshot": [node, {**node, "agentId": ""}, None]}, ["domSnapshot: not an object", "domSnapshot.agentId: required"]),
        (3, {"domSnapshot": [{**node, "bbox": {"x": 1}}], "redactedRegions": [{**region, "source": "sky"}]}, ["domSnapshot.bbox: not a box", "redactedRegions.source: not a source"]),
        (4, {"domSnapshot": None, "redactedRegions": {}}, ["domSnapshot: not a list", "redactedRegions: not a list"]),
    ]
    df = spark.createDataFrame([(k, json.dumps({"image": "i", "taskGoal": "g", **b})) for k, b, _ in rows], "request_id long, body string")
    out = {r.request_id: r for r in Q.validate_requests(df).collect()}
    assert [out[k].errors for k, _, _ in rows] == [e for _, _, e in rows]
    first, second = out[1].parsed.domSnapshot
    assert first == second and first.sensitive and tuple(first.bbox) == (1.0, 2.5, 1.0, 100.0)
    assert out[1].parsed.redactedRegions[0] == out[1].parsed.redactedRegions[1]


def test_covered_nodes_in_cells_are_those_of_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from hushframe.functions import geometry as G

    rng = random.Random(5)
    sizes = [0.0, 1.0, 7.5, 40.0, 130.0, 3000.0]

    def box(far):
        at = [rng.choice([0.0, -300.0, 64.0, rng.uniform(-200, 900), 3e9 if far else 5.0]) for _ in range(2)]
        return (*at, rng.choice(sizes), rng.choice(sizes))

    nodes = spark.createDataFrame([(k % 2, k, f"a{k}", "t", *box(k % 10 == 0), False) for k in range(400)], "request_id long, node_idx int, agent_id string, text string, x double, y double, w double, h double, sensitive boolean")
    regions = [(k % 2, k, *box(k % 7 == 0), None, "dom") for k in range(400)] + [(0, 900, 0.0, 0.0, float("inf"), 50.0, None, "dom")]
    regions = spark.createDataFrame(regions, "request_id long, region_idx int, x double, y double, w double, h double, agent_id string, source string")
    r = regions.select("request_id", "region_idx", *[F.col(c).alias("r_" + c) for c in "xywh"])
    pairs = nodes.join(r, "request_id").where(G.overlap_ratio(G.columns("r_"), G.columns()) > Q.COVERED).groupBy("request_id", "agent_id").agg(F.min("region_idx").alias("region_idx")).collect()
    assert len(pairs) > 100
    assert {(x.request_id, x.agent_id, x.region_idx) for x in Q.find_leaks(nodes, regions).collect()} == {(x.request_id, x.agent_id, x.region_idx) for x in pairs}


def _made(plan_of):
    """Rows that the joins of an executed plan made, by the places that the stages finished at."""
    out, stack = 0, [plan_of]
    while stack:
        p = stack.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            stack.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out += p.metrics().apply("numOutputRows").value()
        children = p.children()
        stack += [children.apply(k) for k in range(children.size())]
    return out


def test_leaks_of_a_large_request_do_not_compare_all_pairs(spark):
    n = 4000
    nodes = spark.range(n).selectExpr("0L AS request_id", "CAST(id AS INT) AS node_idx", "concat('a', id) AS agent_id", "'t' AS text", "id % 80 * 30D AS x", "floor(id / 80) * 20D AS y", "25D AS w", "15D AS h", "false AS sensitive")
    regions = nodes.selectExpr("request_id", "node_idx AS region_idx", "x", "y", "w", "h", "CAST(NULL AS STRING) AS agent_id", "'dom' AS source")
    df = Q.find_leaks(nodes, regions)
    assert df.where("CAST(substr(agent_id, 2) AS INT) = region_idx").count() == n
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan and _made(df._jdf.queryExecution().executedPlan()) < n * n / 10


def test_nearest_anchors_are_those_of_all_pairs(spark):
    import math
    import random

    from hushframe.operators import rank as R

    rng = random.Random(3)
    places = [(p, k, rng.choice([5.0, rng.uniform(-50, 1600), 1e7, rng.uniform(0, 9)]), rng.choice([5.0, rng.uniform(-50, 1200), rng.uniform(0, 9)])) for p in range(3) for k in range(300)] + [(7, 0, 1.0, 1.0), (8, 0, 1.0, 1.0), (8, 1, 9e6, 4.0)]
    points = spark.createDataFrame(places, "page_id long, node_idx int, _cx double, _cy double")
    anchors = points.where("node_idx % 5 = 0 or page_id > 6").toDF("page_id", "_a", "_ax", "_ay")
    held = [t for t in places if t[1] % 5 == 0 or t[0] > 6]
    wanted = {}
    for p, k, x, y in places:
        d = [math.hypot(x - a, y - b) for q, m, a, b in held if q == p and m != k]
        if d:
            wanted[p, k] = min(d)
    got = {(r.page_id, r.node_idx): r._d for r in R.nearest(points, anchors).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) <= 1e-9 * (1 + wanted[k]) for k in got)


def test_nearest_anchors_of_a_large_page_do_not_compare_all_pairs(spark):
    from hushframe.operators import rank as R

    n = 4000
    points = spark.range(n).selectExpr("0L AS page_id", "CAST(id AS INT) AS node_idx", "id % 80 * 20D AS _cx", "floor(id / 80) * 20D AS _cy")
    df = R.nearest(points, points.toDF("page_id", "_a", "_ax", "_ay"))
    assert {r._d for r in df.collect()} == {20.0}
    assert _made(df._jdf.queryExecution().executedPlan()) < n * n / 20


@pytest.mark.parametrize("name", ["r4_proximity", "r5_rank_elements", "k2_score_listing"])
def test_cells_of_nodes_do_not_pass_through_the_driver(spark, sf_dir, name):
    df = QL.QUERIES[name][0](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tokens_of_many_pages_are_dealt_to_as_many_tasks_as_the_pages(spark):
    from hushframe.sources import tokens as K

    pages = spark.range(100).selectExpr("id AS page_id", "'<p>x</p>' AS html").repartition(37)
    assert K.native_elements(pages).rdd.getNumPartitions() == 37


@pytest.mark.parametrize("name", ["a4_page_counts", "p1_page_regions"])
def test_what_comes_from_the_page_itself_is_not_joined_to_it(spark, sf_dir, name):
    plan = QP.QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan


def test_inputs_by_table_and_by_column_are_alike(spark):
    from pyspark.sql import functions as F

    from hushframe.plans import pipelines

    html = "<body><a href=x>one</a><input type=email value=a@example.org><p>b@example.org</p><div><template shadowrootmode=closed></template></div></body>"
    pages = spark.createDataFrame([(1, html), (2, html), (None, html), (3, None), (3, "<p>c@example.org</p>")], "page_id long, html string")
    box = "struct<node_idx: int, x: double, y: double, w: double, h: double>"
    column = F.transform("elements", lambda e: F.struct(e["node_idx"].alias("node_idx"), *[(e["node_idx"] * k).cast("double").alias(c) for k, c in enumerate("xywh", 1)]))
    table = spark.range(1, 4).select(F.col("id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("node_idx")).select("page_id", "node_idx", *[(F.col("node_idx") * k).cast("double").alias(c) for k, c in enumerate("xywh", 1)])
    acted = spark.createDataFrame([(1, "agent-1")], "page_id long, agent_id string")
    by_row = F.when(F.col("page_id") == 1, F.array(F.struct(F.lit("agent-1").alias("agent_id"))))
    known = pages.where("page_id is not null")
    outs = [pipelines.sanitize_pages(known, "go", layout=a, acted=b) for a, b in ((table, acted), (column, by_row), (table, by_row), (column, acted))]
    for part in ("regions", "nodes", "unplaced", "counts"):
        first, *rest = (sorted(map(str, getattr(out, part).collect())) for out in outs)
        assert first and all(x == first for x in rest) or part == "unplaced" and not any([first, *rest])
    alone = pipelines.sanitize_pages(pages, "go", layout=F.array().cast(f"array<{box}>"), acted=by_row)
    assert alone.counts.count() == 5 and alone.regions.count() == 0


def test_rules_find_in_odd_texts_what_they_find_alone(spark):
    import random

    from pyspark.sql import functions as F

    from hushframe.functions import text as X

    rng = random.Random(7)
    parts = ["a", "Ab", "@", ".", "+", "-", "(", ")", " ", " ", "١٢٣", "＠", "1", "91", "987", "9876", "98765", "ABCDE", "1234F", "x.co"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20000)] + ["+1 22 333 4444", "+1(22)3334444", "+122333444", "ABCDE1234F", "1234-5678-9012", "a@b.c", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = {"email": X.is_email, "pan": X.is_pan, "aadhaar": X.is_aadhaar, "tel": X.is_phone}
    plain = F.array_compact(F.array(*[F.when(rule(F.col("t")), F.lit(k)) for k, rule in rules.items()]))
    out = df.select(X.text_pii_types(F.col("t")).alias("got"), plain.alias("wanted")).collect()
    assert all(r.got == r.wanted for r in out) and {k for r in out for k in r.got} == set(rules)
    assert "[0-9]{3}" in df.select(X.text_pii_types(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r11_scanner_ordinals", "c13_unscannable", "c12_scan_pii"])
def test_pages_are_parsed_once_and_not_dealt_again(spark, sf_dir, name):
    plan = QP.QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan and "Window" not in plan


def test_scans_in_the_row_equal_those_of_tables(spark, sf_dir):
    from hushframe.operators import page_rows as W
    from hushframe.operators import pages as P
    from hushframe.sources import html as H

    odd = [
        '<body><input id=a data-agent-id="agent-7" type=email value="x@example.org 9876543210"><input id=a type=email value="y@example.org"><p data-agent-id="own">a@example.org</p><p>ABCDE1234F b@example.org</p></body>',
        "<form><input type=hidden value=c@example.org><textarea autocomplete='cc-number'>1234 5678 9012</textarea><SELECT><option>none<option selected>+91 98765 43210</select></form><p hidden>d@example.org</p>",
        "<div>  e@example.org  <template shadowrootmode=open><p>9876543210</p><input type=tel></template><b>f@example.org</b> 1234 5678 9012</div>", "", "<p>plain 123", None,
    ]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id + 100 AS page_id", f"{QP.FORMS} AS html"))
    parsed = H.parse_pages(pages).cache()
    table = P.scan_pii(H.extract_elements(parsed), H.extract_text_nodes(parsed))
    for start, wanted in ((None, table), (100, P.scanner_ordinals(table, 100)), (0, P.scanner_ordinals(table))):
        got = QP._scanned(parsed, start)
        assert got.columns == wanted.columns
        rows = sorted(map(str, got.collect()))
        assert rows == sorted(map(str, wanted.collect())) and len(rows) > 10
    assert {r.agent_id for r in QP._scanned(parsed, 5).where("page_id = 0").collect()} >= {"agent-7", "own", "agent-6"}
    assert W.flag_rows(W.with_flags(W.with_written_ids(parsed.where("false")))).count() == 0
