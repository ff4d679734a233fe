"""Streaming forms without keyed state of their own: frame reports, admission and page scans. Late or unmatched data fail closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushframe.functions import text as X
from hushframe.operators import page_rows as W
from hushframe.operators import rank as R
from hushframe.operators import requests as Q
from hushframe.sources import html as H
from hushframe.sources import logs

def stream_frame_tokens(announcements: DataFrame, reports: DataFrame, delay: str = "6 seconds") -> DataFrame:
    """Announced frames (page_id, token, ts) with their report if it came within delay; none means that the frame is redacted whole."""
    a = announcements.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "token"])
    r = reports.withWatermark("report_ts", delay).select(F.col("page_id").alias("r_page"), F.col("token").alias("r_token"), "frame_id", "report_ts")
    match = (F.col("page_id") == F.col("r_page")) & (F.col("token") == F.col("r_token")) & F.expr(f"report_ts BETWEEN ts AND ts + INTERVAL {delay}")
    joined = a.join(r, match, "left_outer")
    return joined.select("page_id", "token", "ts", "frame_id", F.col("frame_id").isNull().alias("redact_whole"))


def stream_admission(requests: DataFrame) -> DataFrame:
    """The decision on each request, in its row: no shuffle and no state."""
    return Q.admit(requests)


def run_admission(requests: DataFrame, accepted: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Started stream of requests (request_id, body) into two sinks: accepted ones whole, rejected ones as codes and places."""
    def split(batch: DataFrame, number: int) -> None:
        logs.write_split(Q.admit(batch, keep_body=True), f"{accepted}/batch={number}", f"{quarantine}/batch={number}", "overwrite")

    return requests.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pii(texts: DataFrame) -> DataFrame:
    """texts with pii_types, and text null where any was found."""
    df = texts.withColumn("pii_types", X.text_pii_types(F.col("text")))
    return df.withColumn("text", F.when(F.size("pii_types") == 0, F.col("text")))


def stream_pages(pages: DataFrame, goal: str, max_elements: int = R.MAX_ELEMENTS) -> DataFrame:
    """Node rows of arriving pages (page_id, html), scanned, flagged, ranked and sanitised, each page in its row: no state, no shuffle, append mode."""
    return W.sent_nodes(W.with_sent(W.ranked_rows(W.page_rows(H.parse_pages(pages)), goal, max_elements, frames=False)))


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """All that is there now, through a stream in append mode into files, each row once even if a batch is run again."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All that is there now, through the stream, as a table in folder; each is applied to every batch."""
    def save(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if query.lastProgress is None:  # a stream without rows gives an empty table
        save(spark.createDataFrame([], stream.schema), 0)
    return spark.read.parquet(f"{folder}/out").drop("batch")
