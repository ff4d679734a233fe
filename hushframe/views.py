"""Tables of the operators' kinds, derived from the driver's tables by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_X, _Y, _W, _H = ("CAST(p_partkey * 37 % 1600 AS DOUBLE)", "CAST(p_partkey * 53 % 1200 AS DOUBLE)", "CAST(p_partkey % 7 * 40 AS DOUBLE)", "CAST(p_size % 5 * 12 AS DOUBLE)")
_BOX = {c: f"CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {e} END" for c, e in zip("xywh", (_X, _Y, _W, _H), strict=True)}

#: name: (table, condition, {column: expression})
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "nodes": ("part", "true", {
        "page_id": "CAST(substr(p_brand, 7) AS BIGINT)", "request_id": "CAST(substr(p_brand, 7) AS BIGINT)", "node_idx": "CAST(p_partkey AS INT)", "agent_id": "concat('agent-', CAST(p_partkey AS STRING))",
        "tag": "CASE p_size % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'button' WHEN 2 THEN 'a' WHEN 3 THEN 'select' ELSE 'div' END",
        "role": "CASE p_size % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN NULL ELSE 'textbox' END",
        "type": "CASE WHEN p_size % 5 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'tel' WHEN 2 THEN 'text' ELSE 'password' END END",
        "text": "CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN '  ' ELSE p_name END", **_BOX, "sensitive": "p_partkey % 13 = 0",
    }),
    "regions": ("part", "true", {
        "request_id": "CAST(substr(p_brand, 7) AS BIGINT)", "region_idx": "CAST(p_partkey AS INT)", "type": "CASE WHEN p_partkey % 2 = 0 THEN 'email' ELSE 'weird' END",
        "x": f"{_X} + 5", "y": f"{_Y} + 2", "w": f"{_W} + 10", "h": f"{_H} + 10",
        "agent_id": "CASE WHEN p_partkey % 12 = 0 THEN concat('agent-', CAST(p_partkey AS STRING)) END", "given": "CASE p_partkey % 9 WHEN 0 THEN 'vision' WHEN 3 THEN 'dom' END",
    }),
    "boxes": ("orders", "true", {
        "image_id": "o_custkey", "box_idx": "o_orderkey", "label": "CASE o_orderstatus WHEN 'O' THEN 'person' WHEN 'F' THEN 'Book' ELSE 'laptop' END", "score": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
        "xmin": "CAST(o_orderkey * 17 % 300 AS DOUBLE)", "ymin": "CAST(o_orderkey * 29 % 200 AS DOUBLE)",
        "xmax": "CAST(o_orderkey * 17 % 300 + 20 + o_orderkey % 150 AS DOUBLE)", "ymax": "CAST(o_orderkey * 29 % 200 + 10 + o_orderkey % 110 AS DOUBLE)",
    }),
    "images": ("customer", "true", {"image_id": "c_custkey", "width": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(400 AS DOUBLE) END", "height": "CAST(300 AS DOUBLE)"}),
    "actions": ("events", "true", {
        "run_id": "user_id", "user_id": "user_id", "step": "event_id",
        "action": "CASE event_type WHEN 'view' THEN 'scroll' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'fill_profile' ELSE CASE WHEN event_id % 50 < 25 THEN 'done' ELSE 'hover' END END",
        "target_id": "CASE WHEN event_type IN ('view', 'error') THEN 'page' WHEN event_id % 41 = 0 THEN '' ELSE concat('agent-', CAST(event_id % 3 AS STRING)) END",
        "value": "CASE WHEN event_type = 'purchase' THEN concat('v', CAST(event_id % 2 AS STRING)) WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'x' END",
        "profile_field": "CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'full_name' END WHEN event_type = 'click' AND event_id % 97 = 0 THEN 'email' END",
    }),
    "run_nodes": ("events", "true", {
        "run_id": "user_id", "agent_id": "concat('agent-', CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING))",
    }),
    "marks": ("events", "true", {
        "run_id": "user_id", "seq": "event_id", "step": "CAST(event_id % 25 AS INT)", "stage": "event_type", "ts_ms": "CAST(event_id * 137 + event_id % 7 AS DOUBLE)",
        "heap_mb": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE value END",
    }),
    "sends": ("events", "true", {
        "run_id": "user_id", "step": "CAST(floor(event_id / 600.0) AS BIGINT)", "attempt_at": "event_id", "ts_ms": "CAST(event_id * 137 AS DOUBLE)",
        "error_class": "CASE event_type WHEN 'error' THEN 'http_500' WHEN 'view' THEN 'http_422' END", "retryable": "event_type = 'error'",
    }),
    "profiles": ("customer", "true", {
        "user_id": "c_custkey", "full_name": "CASE WHEN c_custkey % 6 = 0 THEN '   ' ELSE concat(' ', c_name, ' ') END", "email": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@example.org') END",
        "phone": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('+91 98765', CAST(10000 + c_custkey % 90000 AS STRING)) END",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, condition, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df dealt to all cores, and to tasks of so many rows, where its files give fewer; else df itself. The count is that of the files' footers."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def with_views(*names: str) -> str:
    """The WITH clause that gives DuckDB the named views."""
    parts = []
    for name in names:
        table, condition, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {condition})")
    return "WITH " + ", ".join(parts)
