"""Character references are read alike by the parser, by the windows over tokens and by their SQL."""

from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from hushframe.sources import tokens as K

TEXTS = ["and&amp", "a &lt b &ampx &notit; &quot", "&#x27 &#39x &#X41;&#x2 &#65", "&amp;amp &amp;lt; &#38;lt; &#38;amp;", "&#0; &#128; &#xD800; &#1114112; &#65534;", "&copy2 &copy;2 &am &# &#x &;", "&#3 &#39 &#390;", "plain", ""]


def test_references_without_semicolons(spark):
    out = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", K.decoded(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in out} == {t: unescape(t) for t in TEXTS}


@pytest.mark.parametrize("text", TEXTS)
def test_references_in_sql(text):
    assert duckdb.execute(f"SELECT {K.sql_decoded('t')} FROM (SELECT ? AS t)", [text]).fetchall() == [(unescape(text),)]
