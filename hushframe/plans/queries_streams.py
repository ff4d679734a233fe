"""Queries that send a whole table through a stream. Results are those of the batch operators, so SQL can express most."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import requests as Q
from hushframe.plans import queries_admission, queries_logs
from hushframe.plans.queries_text import RULES, has
from hushframe.sources import logs
from hushframe.streaming import jobs, state
from hushframe.views import VIEWS

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, or in a temporary one where none is named and Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base}/stream-{uuid.uuid4()}"


def stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table as a stream of its files."""
    path = f"{sf}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def read_again(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of files that another session has written."""
    return spark.read.schema(df.schema).parquet(*df.inputFiles()) if df.inputFiles() else spark.createDataFrame([], df.schema)


def _stalls(spark: SparkSession, sf: str) -> DataFrame:
    columns = VIEWS["actions"][2]
    actions = stream(state.stateful_session(spark), sf, "events").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()], "CAST(ts AS TIMESTAMP) AS ts")
    return read_again(spark, jobs.run_to_files(state.stream_stalls(actions), folder(spark)))


_PATCHES = "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'finish' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'stop' ELSE 'progress' END"


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """Final states of runs, and refused patches, from both sinks; some patches are broken or missing."""
    patch = F.expr(f"CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '[1' ELSE concat('{{\"kind\":\"', {_PATCHES}, '\",\"stage\":\"', event_type, '\"}}') END")
    patches = stream(state.stateful_session(spark), sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), patch.alias("patch"))
    base = folder(spark)
    state.run_split_state(state.stream_run_state(patches), f"{base}/states", f"{base}/refused", f"{base}/state").awaitTermination()
    states = spark.read.schema("run_id long, seq long, state string, batch long").parquet(f"{base}/states").groupBy("run_id").agg(F.max_by(F.struct("seq", "state"), "batch").alias("s"))
    fields = [F.get_json_object("s.state", f"$.{c}").alias(n) for c, n in (("active", "active"), ("stopRequested", "stop_requested"), ("stage", "stage"))]
    refused = spark.read.schema("run_id long, seq long, patch string").parquet(f"{base}/refused")
    return states.select("run_id", F.lit("state").alias("kind"), "s.seq", *fields).unionByName(refused.select("run_id", F.lit("refused").alias("kind"), "seq", *[F.lit(None).cast("string").alias(n) for n in ("active", "stop_requested", "stage")]))


_STATES = f"""WITH p AS (SELECT user_id AS run_id, event_id AS seq, event_type AS stage, CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'broken' ELSE {_PATCHES} END AS kind FROM events),
b AS (SELECT *, max(CASE WHEN kind = 'start' THEN seq END) OVER before AS started, max(CASE WHEN kind = 'finish' THEN seq END) OVER before AS finished FROM p WINDOW before AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, kind <> 'broken' AND (kind = 'start' OR coalesce(started > coalesce(finished, -1), false)) AS taken FROM b),
l AS (SELECT run_id, max(seq) AS last, max(CASE WHEN kind = 'start' THEN seq END) AS started FROM t GROUP BY run_id),
f AS (SELECT l.run_id, l.last, arg_max(CASE WHEN t.kind <> 'stop' THEN t.stage END, t.seq) AS stage, count(*) FILTER (WHERE t.kind = 'finish') = 0 AS active, count(*) FILTER (WHERE t.kind = 'stop') > 0 AS stopped FROM l JOIN t ON l.run_id = t.run_id AND t.taken AND t.seq >= l.started GROUP BY l.run_id, l.last)
SELECT run_id, 'state' AS kind, last AS seq, CASE WHEN active THEN 'true' ELSE 'false' END AS active, CASE WHEN stopped THEN 'true' ELSE 'false' END AS stop_requested, stage FROM f
UNION ALL SELECT run_id, 'refused', seq, NULL, NULL, NULL FROM t WHERE NOT taken"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    told = events.where("event_type = 'view'").select(F.col("user_id").alias("page_id"), F.col("event_id").cast("string").alias("token"), "ts")
    token = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))  # some reports come without a token
    reports = events.where("event_type = 'view'").select(F.col("user_id").alias("page_id"), token.alias("token"), F.col("event_id").alias("frame_id"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 9)")).alias("report_ts"))
    return jobs.run_to_table(jobs.stream_frame_tokens(told, reports), folder(spark))


_AFTER = "event_id % 9 * 500 + 300"  # when a frame reports, in ms after its first announcement


def _life(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that announce themselves again, are acknowledged or not, report in time, late or never, and are detached."""
    def at(ms: str) -> str:
        return f"CAST(ts AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, 0, CAST(({ms}) / 1000.0 AS DECIMAL(18, 6)))"

    def told(kind: str, ms: str, when: str) -> str:
        return f"CASE WHEN {when} THEN named_struct('kind', '{kind}', 'at', {at(ms)}) END"

    each = [*[told("announce", str(200 * k), f"event_id % 4 >= {k}") for k in range(4)], told("ack", "300", "event_id % 5 <> 0"), told("report", _AFTER, "event_id % 3 <> 0"), told("detach", "1000", "event_id % 7 = 0")]
    events = stream(state.stateful_session(spark), sf, "events").where("event_type = 'view'").select("user_id", "event_id", F.explode(F.array_compact(F.array(*[F.expr(e) for e in each]))).alias("e"))
    events = events.select(F.col("user_id").alias("page_id"), F.col("event_id").cast("string").alias("token"), F.col("e.at").alias("ts"), F.col("e.kind").alias("kind"), F.col("event_id").alias("frame_id"))
    return read_again(spark, jobs.run_to_files(state.stream_token_life(events), folder(spark)))


#: What is decided by its own events comes out at once; what only waits comes out when the watermark, 6 s behind the newest event, reaches its deadline.
_LIFE = f"""WITH v AS (SELECT user_id AS page_id, event_id, CAST(ts AS TIMESTAMP) AS ts, {_AFTER} AS after, event_id % 5 <> 0 AS acked, event_id % 3 <> 0 AS reports, event_id % 7 = 0 AS detached FROM events WHERE event_type = 'view'),
w AS (SELECT max(ts + to_milliseconds(greatest(event_id % 4 * 200, CASE WHEN acked THEN 300 ELSE 0 END, CASE WHEN reports THEN after ELSE 0 END, CASE WHEN detached THEN 1000 ELSE 0 END))) - to_seconds(6) AS mark FROM v),
d AS (SELECT *, acked AND reports AND after <= CASE WHEN detached THEN 999 ELSE 3300 END AS merged FROM v),
r AS (SELECT *, CASE WHEN merged THEN NULL WHEN detached THEN 'detached' WHEN acked THEN 'report_timeout' ELSE 'never_acknowledged' END AS reason FROM d)
SELECT page_id, CAST(event_id AS VARCHAR) AS token, CAST(CASE WHEN acked THEN least(event_id % 4 + 1, 2) ELSE event_id % 4 + 1 END AS INT) AS announced, CASE WHEN merged THEN event_id END AS frame_id, NOT merged AS redact_whole, reason
FROM r, w WHERE merged OR detached OR (acked AND reports) OR ts + to_milliseconds(CASE WHEN acked THEN 3300 ELSE 6000 END) <= mark"""


def _pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = jobs.stream_pii(stream(spark, sf, "documents").select("doc_id", "text"))
    return jobs.run_to_table(docs.select("doc_id", F.array_join("pii_types", ",").alias("types"), F.length("text").alias("kept_chars")), folder(spark))


def _written(spark: SparkSession, base: str) -> DataFrame:
    """What both sinks of admission hold: request_id, and the code of rejected ones."""
    accepted = spark.read.schema("request_id long, body string").parquet(f"{base}/accepted")
    quarantine = spark.read.schema("request_id long, error_code string").parquet(f"{base}/quarantine")
    return accepted.where("body is not null").select("request_id", F.lit(None).cast("string").alias("error_code")).unionByName(quarantine.select("request_id", "error_code"))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    base = folder(spark)
    logs.write_split(Q.admit(queries_admission.requests(spark, sf), keep_body=True), f"{base}/accepted", f"{base}/quarantine")
    return _written(spark, base)


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    base = folder(spark)
    orders = stream(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr(queries_admission.BODY).alias("body"))
    jobs.run_admission(orders, f"{base}/accepted", f"{base}/quarantine", f"{base}/state").awaitTermination()
    return _written(spark, base)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as lines of JSON and read again."""
    base = folder(spark)
    queries_admission.requests(spark, sf).select("body").write.text(f"{base}/lines")
    return Q.admit(logs.read_requests(spark, f"{base}/lines")).groupBy("status", "error_code").count().select("status", "error_code", F.col("count").alias("n"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.read_log(spark, f"{sf}/events.parquet", "user_id long, event_id long, event_type string")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving pages scanned, flagged, ranked and sanitised, each in its row."""
    return jobs.run_to_files(jobs.stream_pages(stream(spark, sf, "pages").select("page_id", "html"), "open the article about the and of"), folder(spark))


_TYPES = f"list_filter([{', '.join(f'CASE WHEN {has(k)} THEN {k!r} END' for k in RULES)}], lambda x: x IS NOT NULL)"
QUERIES["t1_stream_stalls"] = (_stalls, queries_logs.QUERIES["r8_detect_stalls"][1])
QUERIES["t2_stream_run_state"] = (_state, _STATES)
QUERIES["t3_stream_frame_tokens"] = (_tokens, None)
QUERIES["t3_token_life"] = (_life, _LIFE)
QUERIES["t5_stream_pii"] = (_pii, f"SELECT doc_id, array_to_string({_TYPES}, ',') AS types, CASE WHEN len({_TYPES}) = 0 THEN CAST(length(text) AS INT) END AS kept_chars FROM documents")
QUERIES["t4_admission_in_row"] = (_admitted, f"{queries_admission.SQL_REQUESTS} SELECT request_id, error_code FROM decided")
QUERIES["s5_write_split"] = (_split, f"{queries_admission.SQL_REQUESTS} SELECT request_id, error_code FROM decided")
QUERIES["s4_read_requests"] = (_lines, f"{queries_admission.SQL_REQUESTS} SELECT status, error_code, count(*) AS n FROM decided GROUP BY status, error_code")
QUERIES["s6_read_log"] = (_log, "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id, event_type")
QUERIES["t5_stream_pages"] = (_pages, None)
