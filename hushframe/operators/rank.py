"""Task ranking of page elements under a budget that sensitive ones never fall to.

Nodes: page_id, node_idx, agent_id, tag, role, type, text, x, y, w, h, sensitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe import vocab
from hushframe.functions import geometry as G
from hushframe.functions import text as X

WEIGHTS = {"text": 0.40, "kind": 0.25, "viewport": 0.15, "size": 0.10, "proximity": 0.10}
VIEWPORT = (1280, 800)
MAX_ELEMENTS = 40
ANCHOR_SHARE, MIN_ANCHORS, RADIUS = 0.2, 3, 150.0
TYPICAL_AREA = 6400.0
#: Sides of the cells in which anchors are sought, each twice the one before.
SIDES = [2.0**k for k in range(1, 13)]


def text_score(surface: Column, goal: Column) -> Column:
    """Share of the goal's terms that the surface has, half for partial ones; 0.5 without goal terms, 0 without own terms."""
    terms, own = F.array_distinct(goal), X.tokenize(surface)

    def worth(t: Column) -> Column:
        partial = F.exists(own, lambda n: (F.length(n) > 2) & (F.length(t) > 2) & (F.contains(n, t) | F.contains(t, n)))
        return F.when(F.array_contains(own, t), 1.0).when(partial, 0.5).otherwise(0.0)

    hits = F.aggregate(terms, F.lit(0.0), lambda a, t: a + worth(t))
    return F.when(F.size(terms) == 0, 0.5).when(F.size(own) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.size(terms)))


def kind_score(tag: Column, role: Column) -> Column:
    tag, role = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    return F.when(tag.isin("input", "textarea", "select", "button"), 1.0).when(role.isin(vocab.HIGH_VALUE_ROLES), 0.9).when((tag == "a") | (role == "link"), 0.5).otherwise(0.35)


def viewport_score(box: G.Box, width: float, height: float) -> Column:
    x, y, w, h = box
    flat = (F.coalesce(w, F.lit(0.0)) <= 0) | (F.coalesce(h, F.lit(0.0)) <= 0)
    shown = G.intersection((F.lit(0.0), F.lit(0.0), F.lit(float(width)), F.lit(float(height))), box)
    return F.when(x.isNull() | y.isNull(), 0.4).when(flat, 0.05).when(shown <= 0, 0.1).otherwise(0.2 + 0.8 * F.least(F.lit(1.0), shown / (w * h)))


def size_score(w: Column, h: Column) -> Column:
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when(w.isNull() | h.isNull(), 0.5).when(area <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(area / TYPICAL_AREA)))


def base_scores(nodes: DataFrame, goal: Column, weights: dict[str, float] = WEIGHTS, viewport: tuple[float, float] = VIEWPORT) -> DataFrame:
    """nodes with base, the weighted sum of all scores but proximity. goal: an array of terms."""
    surface = F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("role", F.lit("")), F.nullif("type", F.lit("")))
    parts = {"text": text_score(surface, goal), "kind": kind_score(F.col("tag"), F.col("role")), "viewport": viewport_score(G.columns(), *viewport), "size": size_score(F.col("w"), F.col("h"))}
    return nodes.withColumn("base", sum((weights[k] * v for k, v in parts.items()), F.lit(0.0)))


def _levels(x: Column, y: Column) -> Column:
    """The cell of a place at each level: its level, 0 the finest, and its numbers; the last level has one cell."""
    cells = [(F.lit(k), F.floor(x / side).cast("double"), F.floor(y / side).cast("double")) for k, side in enumerate(SIDES)] + [(F.lit(len(SIDES)), F.lit(0.0), F.lit(0.0))]
    return F.explode(F.array(*[F.struct(k.alias("k"), i.alias("i"), j.alias("j")) for k, i, j in cells])).alias("c")


def nearest(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_id, node_idx, _d): the distance from each point (page_id, node_idx, _cx, _cy) to the nearest anchor (page_id, _a, _ax, _ay) of its page that is not itself.

    The finest cell that holds a point and another anchor bounds the distance by its diagonal; all anchors as near as that stand in the few cells around the
    point that are twice as wide. What is compared follows how dense the anchors are around a point, not how many a page has. Anchors at one place count once.
    The joins are told to merge: their sides are sized by the files, without what explode adds, and a broadcast would pass all cells through the driver.
    """
    cell, other = ["page_id", "k", "i", "j"], (F.col("_first") != F.col("node_idx")) | (F.col("_last") != F.col("node_idx"))
    places = anchors.groupBy("page_id", "_ax", "_ay").agg(F.min("_a").alias("_first"), F.max("_a").alias("_last"))
    placed = places.select("*", _levels(F.col("_ax"), F.col("_ay"))).select("page_id", "_ax", "_ay", "_first", "_last", "c.*")
    taken = placed.groupBy(*cell).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    known = points.select("*", _levels(F.col("_cx"), F.col("_cy"))).select("page_id", "node_idx", "_cx", "_cy", "c.*").join(taken.hint("merge"), cell).where(other)
    known = known.groupBy("page_id", "node_idx", "_cx", "_cy").agg(F.min("k").alias("_k"))
    side = F.get(F.array(*map(F.lit, SIDES)), F.col("_k"))
    k = F.when(F.col("_k") >= len(SIDES) - 1, len(SIDES)).otherwise(F.col("_k") + 1)

    def around(c: Column) -> Column:
        cells = F.array_distinct(F.transform(F.array(F.lit(-1.4143), F.lit(0.0), F.lit(1.4143)), lambda r: F.floor((c + r * side) / (2 * side)).cast("double")))
        return F.when(k == len(SIDES), F.array(F.lit(0.0))).otherwise(cells)

    sought = known.select("page_id", "node_idx", "_cx", "_cy", k.alias("k"), F.explode(around(F.col("_cx"))).alias("i"), around(F.col("_cy")).alias("js"))
    sought = sought.select("page_id", "node_idx", "_cx", "_cy", "k", "i", F.explode("js").alias("j")).join(placed.hint("merge"), cell).where(other)
    return sought.groupBy("page_id", "node_idx").agg(F.min(F.hypot(F.col("_cx") - F.col("_ax"), F.col("_cy") - F.col("_ay"))).alias("_d"))


def proximity(scored: DataFrame) -> DataFrame:
    """scored (with base) and proximity: nearness to the closest other anchor; anchors are a page's best fifth, three at least."""
    w = Window.partitionBy("page_id")
    ranked = scored.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.col("base").desc(), "node_idx")))
    cx, cy = F.col("x") + F.coalesce("w", F.lit(0.0)) / 2, F.col("y") + F.coalesce("h", F.lit(0.0)) / 2
    ranked = ranked.withColumn("_cx", cx).withColumn("_cy", cy)
    count = F.greatest(F.lit(MIN_ANCHORS), F.ceil(F.col("_n") * ANCHOR_SHARE))
    anchors = ranked.where((F.col("_rank") <= count) & F.col("_cx").isNotNull()).select("page_id", F.col("node_idx").alias("_a"), F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"))
    points = ranked.select("page_id", "node_idx", "_cx", "_cy").where("_cx is not null")
    near = nearest(points, anchors)
    df = ranked.join(near.hint("merge"), ["page_id", "node_idx"], "left")
    score = F.when(F.col("_cx").isNull(), 0.4).otherwise(F.coalesce(1 / (1 + F.col("_d") / RADIUS), F.lit(0.0)))
    return df.withColumn("proximity", score).drop("_n", "_rank", "_cx", "_cy", "_d")


def rank_elements(nodes: DataFrame, goal: Column, max_elements: int = MAX_ELEMENTS, weights: dict[str, float] = WEIGHTS, viewport: tuple[float, float] = VIEWPORT) -> DataFrame:
    """nodes with score (null on pages within the budget, whose nodes all pass), kept and dropped, the page's number of others.

    All sensitive nodes are kept; the best others fill what is left of the budget.
    """
    page = Window.partitionBy("page_id")
    sized = nodes.withColumn("_size", F.count(F.lit(1)).over(page))
    few = sized.where(F.col("_size") <= max_elements).drop("_size").withColumn("score", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    many = proximity(base_scores(sized.where(F.col("_size") > max_elements).drop("_size"), goal, weights, viewport))
    safe = ~F.coalesce(F.col("sensitive"), F.lit(False))
    many = many.withColumn("score", F.col("base") + weights["proximity"] * F.col("proximity")).withColumn("_safe", safe)
    order = Window.partitionBy("page_id", "_safe").orderBy(F.col("score").desc(), "node_idx")
    many = many.withColumn("_rn", F.row_number().over(order)).withColumn("_held", F.count_if(~F.col("_safe")).over(page))
    kept = ~F.col("_safe") | (F.col("_rn") <= F.greatest(F.lit(0), max_elements - F.col("_held")))
    many = many.withColumn("kept", kept).withColumn("score", G.js_round(F.col("score"), 4)).drop("base", "proximity", "_safe", "_rn", "_held")
    out = few.unionByName(many)
    return out.withColumn("dropped", F.count_if(~F.col("kept")).over(page))
