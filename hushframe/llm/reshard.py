"""Resharding by minimum-cost flow: move as few bytes as possible from old shards to new ones of given capacity.

The flow is solved over shard totals only. Documents are then dealt to each (old shard, new shard) stream by running
byte sums kept per block, so no shard is ever sorted or summed by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import clean_text, cut, fresh

#: A document of at least 1 / LARGE of a new shard's capacity is placed on its own; there can be LARGE of them a shard at most.
LARGE = 1000
#: Blocks of an old shard, the units of the running sums: this many, and one more for each BLOCK_BYTES or BLOCK_ROWS of the largest shard.
BLOCKS, BLOCK_BYTES, BLOCK_ROWS = 256, 64 << 20, 200_000
#: Rows of one bucket, the unit of slot numbers.
BUCKET_ROWS = 20_000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j that ships all supply at least cost.

    Successive shortest paths with potentials; costs are non-negative integers. Ties go to the lowest shard numbers.
    Raises ValueError if the capacities are too small together.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        distance: list[float] = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                distance[i] = -potential[i]
                heap.append((distance[i], i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            if u < n:
                arcs = [(n + j, cost[u][j]) for j in range(m)]
            else:
                arcs = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in arcs:
                new = d + c + potential[u] - potential[v]
                if new < distance[v]:
                    distance[v], back[v] = new, u
                    heapq.heappush(heap, (new, v))
        reach = max(d for d in distance if d != float("inf"))
        potential = [p + min(d, reach) for p, d in zip(potential, distance, strict=True)]
        end = min((n + j for j in range(m) if room[j]), key=lambda v: (potential[v], v))
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[end - n]] + [flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and hold total exactly."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_large(flow: list[list[int]], homes: list[int], large: list[tuple[int, int, int]]) -> dict[int, int]:
    """New shard by document key for (old shard, size, key) triples, largest first; flow is left with what small documents fill.

    homes: the new shard of the same number as each old one, or -1.
    """
    placed = {}
    for i, size, key in sorted(large, key=lambda x: (x[0], -x[1], x[2])):
        row = flow[i]
        j = max(range(len(row)), key=lambda k: (row[k] >= size and k == homes[i], row[k], -k))
        placed[key] = j
        row[j] -= size
    for row in flow:  # an overdrawn stream is repaid by the fullest ones
        while (low := min(row)) < 0 and (high := max(row)) > 0:
            pay = min(-low, high)
            row[row.index(low)] += pay
            row[row.index(high)] -= pay
    return placed


def reshard(docs: DataFrame, old_shard: Column, capacities: Sequence[int] | None = None, shards: int = 16, cost: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot, moved.

    size is the text's UTF-8 bytes plus 1 (null text: 1; its crc is that of no bytes). capacities: bytes of each new shard;
    equal ones if None. A null old shard is its own shard, numbered after the others. Repeated rows are rows of their own.
    An empty table gives no rows. Extra columns are ignored. Shards exceed their capacities by a small document per stream at most.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(
        F.col("doc_id"), (F.octet_length(clean_text()) + 1).cast("long").alias("size"), F.crc32(clean_text()).alias("text_crc32"), old_shard.cast("int").alias("old_shard"),
    ).withColumn("key", F.xxhash64("doc_id", "text_crc32", "size")))
    counted = rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row per old shard
    totals = {r.old_shard: r.bytes for r in counted}
    named = sorted(x for x in totals if x is not None)
    place = {x: k for k, x in enumerate(named)} | {None: len(named)}
    supply = [totals[x] for x in named] + [totals.get(None, 0)]
    capacities = list(capacities or even_capacities(sum(supply), shards))
    if cost is None:
        cost = [[int(x != j) for j in range(len(capacities))] for x in [*named, None]]
    flow = min_cost_flow(supply, capacities, cost)
    rows = rows.withColumn("i", F.coalesce(_lookup(named)[F.col("old_shard")], F.lit(len(named)))) if named else rows.withColumn("i", F.lit(0))

    floor = max(min([c for c in capacities if c] or [1]) // LARGE, 1)
    large = [(r.i, r.bytes, r.key) for r in rows.where(F.col("size") > floor).groupBy("i", "key").agg(F.sum("size").alias("bytes")).collect()]  # sum(supply) / floor rows at most
    homes = [*named, -1]
    placed = place_large(flow, homes, large)
    big = spark.createDataFrame(list(placed.items()) or [(0, 0)], "key long, shard int").limit(len(placed))
    small = rows.where(F.col("size") <= floor)

    streams, begin = [], 0
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda k: (k != homes[i], k)):
            if row[j] > 0:
                streams.append((i, at, j))
                at += row[j]
    starts = {i: [(a, j) for k, a, j in streams if k == i] for i in range(len(flow))}
    dealt = _deal(small, starts, BLOCKS + max(supply) // BLOCK_BYTES + max([r.n for r in counted], default=0) // BLOCK_ROWS)
    out = dealt.select("doc_id", "size", "text_crc32", "old_shard", "key", "shard").unionByName(
        rows.where(F.col("size") > floor).join(F.broadcast(big), "key").select("doc_id", "size", "text_crc32", "old_shard", "key", "shard")
    )
    out = cut(out)
    n = max(1, -(-out.count() // BUCKET_ROWS))
    return number_slots(out, n).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", "slot", (~F.col("old_shard").eqNullSafe(F.col("shard"))).alias("moved")
    )


def _lookup(named: list[int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in enumerate(named)) for x in pair])


def _deal(small: DataFrame, starts: dict[int, list[tuple[int, int]]], blocks: int) -> DataFrame:
    """small with the new shard of each row: its running byte sum within the old shard falls into one stream."""
    small = small.withColumn("block", F.pmod(F.col("key"), F.lit(blocks)))
    sums = small.groupBy("i", "block").agg(F.sum("size").alias("bytes"))
    ahead = Window.partitionBy("i").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bytes").over(ahead), F.lit(0))).drop("bytes")
    inside = Window.partitionBy("i", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["i", "block"])
    middle = F.col("ahead") + F.col("inside") + F.expr("size div 2")
    shard = F.lit(None).cast("int")
    for i, cuts in starts.items():
        choice = F.lit(cuts[0][1] if cuts else 0)
        for at, j in cuts[1:]:
            choice = F.when(middle >= at, F.lit(j)).otherwise(choice)
        shard = F.when(F.col("i") == i, choice).otherwise(shard)
    return small.withColumn("shard", shard)


def number_slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each shard; counts per (shard, bucket) are summed, rows are numbered inside a bucket."""
    rows = rows.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")))
    return rows.join(counts, ["shard", "bucket"]).withColumn("slot", F.col("ahead") + F.col("rank") - 1)


def rewrite(source: str, target: str, plan: DataFrame, key: str = "doc_id") -> list[int]:
    """Write to target the shard folders that lose or gain rows under plan (key, old_shard, shard); the others stay as they are.

    source has folders old_shard=K of Parquet files. Each row is written once: nulls match nulls, repeated rows are counted
    off against the plan's. A second run replaces the folders of the first, also those that it leaves without rows: target holds the
    rewritten shards of the last run and nothing else. Returns the new shards that gained or lost rows; one without rows has no folder.
    """
    spark = plan.sparkSession
    touched = plan.where(~F.col("old_shard").eqNullSafe(F.col("shard"))).select(F.explode(F.array("old_shard", "shard")).alias("k")).distinct()
    shards = sorted(r.k for r in touched.collect() if r.k is not None)  # shard numbers
    docs = spark.read.parquet(source)
    names = fresh(docs, "shard", "n", "size", "crc", "row_hash")
    name = names["shard"]
    same, known = [key, "old_shard"], [F.col(key), F.col("old_shard")]
    if "text" in docs.columns and {"size", "text_crc32"} <= set(plan.columns):  # tells rows of one key with different texts apart
        docs = docs.withColumns({names["size"]: (F.octet_length(clean_text()) + 1).cast("long"), names["crc"]: F.crc32(clean_text())})
        same, known = [*same, names["size"], names["crc"]], [*known, F.col("size"), F.col("text_crc32")]
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    docs = docs.withColumn(names["row_hash"], F.xxhash64(*plain))
    docs = docs.withColumn(names["n"], F.row_number().over(Window.partitionBy(*same).orderBy(names["row_hash"])))
    moves = plan.select(*[c.alias(f"plan_{k}") for k, c in enumerate(known)], F.col("shard").alias(name))
    ids = [f"plan_{k}" for k in range(len(known))]
    moves = moves.withColumn("plan_n", F.row_number().over(Window.partitionBy(*ids).orderBy(name))).where(F.col(name).isin(shards))
    match = docs[names["n"]] == moves["plan_n"]
    for c, i in zip(same, ids, strict=True):
        match = match & docs[c].eqNullSafe(moves[i])
    out = docs.join(moves, match).drop("old_shard", "plan_n", *ids, *[v for k, v in names.items() if k != "shard"])
    out.repartition(name, F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy(name).option("partitionOverwriteMode", "static").mode("overwrite").parquet(target)
    return shards


def op1_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(16))
    return reshard(docs.select("doc_id", "text", "source"), old, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved"
    )
