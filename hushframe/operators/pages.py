"""PII scan of page elements: element and text-node tables in, sensitive nodes out.

Elements: page_id, node_idx, parent_idx, tag, attrs (map), visible, selector, field_values (array). Text nodes: page_id,
text_idx, parent_idx, selector, visible, text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import text as X
from hushframe.sources.html import CLOSED_HOST


def scan_pii(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, seq, node_idx, selector, pii_type, agent_id) of flagged elements: by their kind, then their values, then visible text.

    Hidden fields are flagged too, hidden text is not. One row per selector and type, the first.
    """
    def attr(name: str) -> Column:
        return F.col("attrs")[name]

    field = elements.where(F.lower("tag").isin("input", "textarea", "select"))
    own = F.col("agent_id") if "agent_id" in elements.columns else attr("data-agent-id")
    kinds = field.select("page_id", F.col("node_idx").alias("element"), "node_idx", F.lit(0).alias("leg"), F.lit(0).alias("pos"), "selector", F.array_compact(F.array(X.classify_field(attr("autocomplete"), attr("type")))).alias("types"), own.alias("agent_id"))
    values = field.select("page_id", "node_idx", "selector", own.alias("agent_id"), F.posexplode("field_values").alias("pos", "value"))
    values = values.select("page_id", "node_idx", "node_idx", F.lit(1).alias("leg"), F.col("pos") + 1, "selector", X.text_pii_types(F.col("value")).alias("types"), "agent_id").toDF(*kinds.columns)
    shown = texts.where("visible").select("page_id", F.col("parent_idx").alias("element"), F.col("text_idx").alias("node_idx"), F.lit(2).alias("leg"), F.lit(0).alias("pos"), "selector", X.text_pii_types(F.col("text")).alias("types"), "agent_id")
    hits = kinds.unionByName(values).unionByName(shown).select("*", F.posexplode("types").alias("type_idx", "pii_type"))
    order = [F.when(F.col("leg") == 2, 1).otherwise(0), F.col("node_idx"), F.col("pos"), F.col("type_idx")]
    hits = hits.withColumn("_first", F.row_number().over(Window.partitionBy("page_id", "selector", "pii_type").orderBy(*order))).where("_first = 1")
    return hits.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1).select("page_id", "seq", F.col("element").alias("node_idx"), "selector", "pii_type", "agent_id")


def unscannable_regions(elements: DataFrame) -> DataFrame:
    """(page_id, selector, reason) of elements that no scan can see into."""
    return elements.where(F.col("attrs")[CLOSED_HOST].isNotNull()).select("page_id", "selector", F.lit("closed-shadow-root").alias("reason"))


def as_redaction_inputs(unscannable: DataFrame) -> DataFrame:
    """Unscannable regions as sensitive nodes of type other."""
    return unscannable.select("page_id", "selector", F.lit("other").alias("pii_type"))


def sibling_index(elements: DataFrame) -> DataFrame:
    """elements with nth (among siblings of one tag, from 1) and same_tag (their number)."""
    w = Window.partitionBy("page_id", "parent_idx", "tag")
    return elements.withColumn("nth", F.row_number().over(w.orderBy("node_idx"))).withColumn("same_tag", F.count(F.lit(1)).over(w))


def assign_ids(elements: DataFrame, prefix: str = "") -> DataFrame:
    """elements with agent_id: actionable ones keep an id of the form agent-<prefix>N as it is written, the others of them get
    the numbers after the page's largest N in document order; elements that are not actionable have none.

    An id that stands at several elements stays at all of them; kept_last tells the last of each id, which is the one meant by it.
    """
    pattern = f"^agent-{re.escape(prefix)}([0-9]+)$"
    own, acts = F.col("attrs")["data-agent-id"], X.is_actionable(F.col("tag"), F.col("attrs"))
    number = F.when(acts, F.nullif(F.regexp_extract(F.coalesce(own, F.lit("")), pattern, 1), F.lit("")).cast("decimal(38,0)"))
    page = Window.partitionBy("page_id")
    df = elements.withColumn("_n", number).withColumn("_acts", acts).withColumn("_max", F.coalesce(F.max("_n").over(page), F.lit(0)))
    new = F.sum(F.when(F.col("_acts") & F.col("_n").isNull(), 1).otherwise(0)).over(page.orderBy("node_idx").rowsBetween(Window.unboundedPreceding, 0))
    agent_id = F.when(F.col("_n").isNotNull(), own).when(F.col("_acts"), F.concat(F.lit(f"agent-{prefix}"), (F.col("_max") + new).cast("string")))
    df = df.withColumn("agent_id", agent_id)
    last = F.max("node_idx").over(Window.partitionBy("page_id", "agent_id"))
    return df.withColumn("kept_last", F.col("agent_id").isNotNull() & (F.col("node_idx") == last)).drop("_n", "_max", "_acts")


def highest_ids(elements: DataFrame, prefix: str = "") -> DataFrame:
    """(page_id, start): the largest N of each page's ids agent-<prefix>N, of elements with agent_id."""
    number = F.nullif(F.regexp_extract(F.coalesce("agent_id", F.lit("")), f"^agent-{re.escape(prefix)}([0-9]+)$", 1), F.lit("")).cast("decimal(38,0)")
    return elements.groupBy("page_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("start"))


def scanner_ordinals(flagged: DataFrame, start: int | DataFrame = 0) -> DataFrame:
    """flagged (page_id, seq, agent_id) with ids for entries without one: a counter over such entries after start, a number or one for each page (page_id, start)."""
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = flagged.withColumn("start", F.lit(start)) if isinstance(start, int) else flagged.join(start, "page_id", "left")
    n = F.sum(F.when(F.col("agent_id").isNull(), 1).otherwise(0)).over(w) + F.coalesce("start", F.lit(0))
    return df.withColumn("_n", n).withColumn("agent_id", F.coalesce("agent_id", F.concat(F.lit("agent-"), F.col("_n").cast("string")))).drop("_n", "start")


def pii_profile(hits: DataFrame, by: list[str], types: str = "pii_types") -> DataFrame:
    """Rows of each group that have each text type, from rows with an array of types."""
    kinds = ["email", "pan", "aadhaar", "tel"]
    return hits.groupBy(*by).agg(*[F.count_if(F.array_contains(types, k)).alias(f"n_{k}") for k in kinds], F.count_if(F.size(types) > 0).alias("n_flagged"), F.count(F.lit(1)).alias("n_rows"))
