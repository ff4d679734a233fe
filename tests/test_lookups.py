"""Risk phrases and leaked values found in one pass, against searches one by one; table functions in SQL."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hushframe import vocab
from hushframe.functions import tables
from hushframe.functions import text as X
from hushframe.operators import requests as Q

SPACE = "[\t\n\x0b\f\r    -     　﻿]+"


def by_patterns(text, phrases):
    if text is None:
        return None
    low = re.sub("[-_]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)).lower()
    return next((p for p in X.phrase_order(phrases) if re.search("(?<![0-9A-Za-z_])" + SPACE.join(map(re.escape, p.split())) + "(?![0-9A-Za-z_])", low)), None)


@pytest.mark.parametrize("phrases", [vocab.RISK_PHRASES, ["buy", "buy now", "(now)", "c++ now", "now c++", "a b c", "b c", "c"], ["&", "* buy"]])
def test_phrases_equal_patterns_one_by_one(spark, phrases):
    rng = random.Random(1)
    words = sorted({w for p in phrases for w in p.split()}) + ["the", "x", "é", "&", "", "1", "Now!", "(buy", "confirmation", "deleteAccount", "pay_now", "check-out", "BUY"]
    texts = [None, "", " ", *["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " ", ".", "-", "", "_", "! ", " ("]) for _ in range(rng.randrange(1, 7))) for _ in range(600)], *phrases, *[f"x{p}" for p in phrases], *[f"({p})!" for p in phrases]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", X.match_risk_phrase(F.col("t"), phrases).alias("p")).collect()
    assert [r.p for r in sorted(rows)] == [by_patterns(t, phrases) for t in texts] and any(r.p for r in rows)


def test_values_are_found_as_one_by_one(spark):
    rng = random.Random(4)
    payloads, values, wanted = [], [], set()
    for k in range(40):
        payload = json.dumps({"t": "".join(rng.choice('abc "\\\n') for _ in range(rng.randrange(0, 200)))}) if k else None
        payloads.append((k, payload))
        for n in range(rng.randrange(0, 12)):
            raw = "".join(rng.choice('abc "\\\n') for _ in range(rng.randrange(0, 7)))
            values.append((k, f"agent-{n}", None if n % 3 else raw, raw if n % 3 else None))
            own = (raw if n % 3 == 0 and raw else None) or (raw.strip() if n % 3 else "")
            if payload is not None and len(own) >= Q.MIN_VALUE and (own in payload or json.dumps(own)[1:-1] in payload):
                wanted.add((k, f"agent-{n}"))
    got = Q.egress_check(spark.createDataFrame(payloads, "request_id long, payload string"), spark.createDataFrame(values, "request_id long, agent_id string, value string, text string"))
    assert {tuple(r) for r in got.collect()} == wanted and wanted


def test_many_values_cost_no_more_than_the_payload(spark):
    payload = "x".join(f"value{k}" for k in range(0, 20_000, 2))
    values = [(1, f"a{k}", f"value{k}x", None) for k in range(20_000)]
    got = Q.egress_check(spark.createDataFrame([(1, payload)], "request_id long, payload string"), spark.createDataFrame(values, "request_id long, agent_id string, value string, text string"))
    assert got.count() == 9_999  # the last value has no x after it


def test_table_functions(spark):
    tables.register(spark)
    pages = spark.createDataFrame([(1, "<p>a <b>b</b></p>"), (2, None), (3, "")], "page_id long, html string")
    rows = spark.sql("SELECT p.page_id, t.* FROM {p} p, LATERAL page_texts(p.html) t ORDER BY page_id, text_idx", p=pages).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, True, "a"), (1, 1, 1, True, "b")]
    assert spark.sql("SELECT e.tag, e.attrs FROM {p} p, LATERAL page_elements(p.html) e", p=pages).count() == 2
    assert [tuple(r) for r in spark.sql("SELECT * FROM page_tiles(2500D, 800D)").collect()] == [(0, 0.0, False, 4), (1, 800.0, False, 4), (2, 1600.0, False, 4), (3, 1700.0, False, 4)]
    assert spark.sql("SELECT * FROM page_tiles(CAST(NULL AS DOUBLE), 800D)").count() == 0
