"""Readers of JSON requests and event logs, and the writers of accepted and quarantined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "run_id long, seq long, step int, stage string, ts_ms double, heap_mb double"
ACTIONS = "run_id long, step long, action string, target_id string, value string, profile_field string"
PATCHES = "run_id long, seq long, ts_ms double, patch string"
#: What a quarantine holds: codes and places, no text.
QUARANTINE = ["request_id", "error_code", "errors"]


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(request_id, body) of files with one JSON request a line; the id is the line's hash."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.xxhash64("value").alias("request_id"), F.col("value").alias("body"))


def read_log(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """A Parquet log with a fixed schema."""
    return (spark.readStream if stream else spark.read).schema(schema).parquet(path)


def write_split(decided: DataFrame, accepted: str, quarantine: str, mode: str = "append") -> None:
    """Accepted requests (request_id, body) whole, rejected ones as QUARANTINE columns only; decided once for both."""
    decided = decided.persist()
    decided.where("status = 200").select("request_id", "body").write.mode(mode).parquet(accepted)
    decided.where("status <> 200").select(*QUARANTINE).write.mode(mode).parquet(quarantine)
    decided.unpersist()
