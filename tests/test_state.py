"""Streams with keyed state over several batches: the same rows come out as from one batch, and odd patches stop nothing."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe.streaming import jobs, state


def run(spark, tmp_path, kind, batches, build):
    """Rows of a stream that gets one file a batch, in order."""
    session = state.stateful_session(spark)
    names = [c.split()[0] for c in kind.split(", ")]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.json(f"{tmp_path}/in/{k}", ignoreNullFields=False)
    source = session.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    return [tuple(r) for r in jobs.run_to_files(build(source.select(*names)), f"{tmp_path}/out").collect()]


def tokens(spark, tmp_path, batches):
    kind = "page_id long, token string, ms long, kind string, frame_id long"
    return sorted(run(spark, tmp_path, kind, batches, lambda s: state.stream_token_life(s.withColumn("ts", F.timestamp_millis(F.col("ms") + 10**9)))), key=str)


END = [(9, "end", 100_000, "ack", None)]
LIVES = [
    ([(1, "a", 0, "announce", None), (1, "a", 200, "announce", None), (1, "a", 250, "ack", None), (1, "a", 400, "announce", None), (1, "a", 900, "report", 7)], [(1, "a", 2, 7, False, None)]),
    ([(1, "a", k * 200, "announce", None) for k in range(30)], [(1, "a", 30, None, True, "never_acknowledged")]),
    ([(1, "a", 0, "announce", None), (1, "a", 10, "report", 7)], [(1, "a", 1, None, True, "never_acknowledged")]),
    ([(1, "a", 0, "announce", None), (1, "a", 10, "ack", None), (1, "a", 3011, "report", 7)], [(1, "a", 1, None, True, "report_timeout")]),
    ([(1, "a", 0, "announce", None), (1, "a", 10, "ack", None), (1, "a", 3010, "report", 7)], [(1, "a", 1, 7, False, None)]),
    ([(1, "a", 0, "announce", None), (1, "a", 10, "ack", None), (1, "a", 20, "detach", None), (1, "a", 30, "report", 7)], [(1, "a", 1, None, True, "detached")]),
    ([(1, "a", 0, "announce", None), (1, "a", 7000, "announce", None), (1, "a", 7100, "ack", None), (1, "a", 7200, "report", 8)], [(1, "a", 1, 8, False, None), (1, "a", 1, None, True, "never_acknowledged")]),
    ([(None, "a", 0, "announce", None), (1, None, 0, "announce", None), (1, "a", 0, "odd", None), (1, "a", 0, None, None), (1, "a", 5, "report", 1), (1, "a", 5, "ack", None)], []),
]


@pytest.mark.parametrize("whole", [True, False])
def test_token_lives(spark, tmp_path, whole):
    """Every life at once, each on a page of its own; in one batch or event by event."""
    events = sorted(((p and p + 10 * n, t, ms, k, f) for n, (rows, _) in enumerate(LIVES) for p, t, ms, k, f in rows), key=lambda r: r[2])
    wanted = sorted(((r[0] + 10 * n, *r[1:]) for n, (_, rows) in enumerate(LIVES) for r in rows), key=str)
    size = max(1, len(events) // 7)
    batches = [events] if whole else [events[k : k + size] for k in range(0, len(events), size)]
    assert tokens(spark, tmp_path, [*batches, END, END]) == wanted


def test_stalls_over_batches(spark, tmp_path):
    kind = "run_id long, step long, ms long, action string, target_id string, value string"
    runs = {1: "AA", 2: "AAA", 3: "ABA", 4: "ABAB", 5: "ABCABC", 6: "AAAAAA"}
    rows = [(k, i, i * 1000, "click", c, None) for k, s in runs.items() for i, c in enumerate(s)]
    batches = [[r for r in rows if r[1] in steps] for steps in ((0, 1), (2, 3), (4, 5))]
    out = run(spark, tmp_path, kind, batches, lambda s: state.stream_stalls(s.withColumn("ts", F.timestamp_millis(F.col("ms") + 10**9))))
    assert sorted(out) == [(2, 2, 1), (4, 3, 2), (5, 5, 3), (6, 2, 1)]


def test_a_run_that_was_given_up_begins_anew(spark, tmp_path):
    kind = "run_id long, step long, ms long, action string, target_id string, value string"
    day = state.IDLE_MS
    batches = [[(1, 0, 0, "click", "A", None), (1, 1, 1, "click", "A", None)], [(2, 0, 3 * day, "click", "B", None)], [(2, 1, 3 * day + 1, "click", "B", None)], [(1, 2, 3 * day + 2, "click", "A", None)]]
    assert run(spark, tmp_path, kind, batches, lambda s: state.stream_stalls(s.withColumn("ts", F.timestamp_millis(F.col("ms") + 10**9)))) == []


def test_run_state_and_refused_patches(spark, tmp_path):
    kind = "run_id long, seq long, ms long, patch string"
    patches = ['{"stage":"a"}', '{"kind":"start","goal":"g"}', "[1", None, "3", '{"kind":"stop"}', '{"stage":"b","lastError":null}', '{"kind":"finish"}', '{"kind":"stop"}']
    rows = [(1, k, k * 1000, p) for k, p in enumerate(patches)]
    batches = [rows[:2], rows[2:6], rows[6:]]
    session = state.stateful_session(spark)
    for k, part in enumerate(batches):
        spark.createDataFrame(part, kind).coalesce(1).write.json(f"{tmp_path}/in/{k}", ignoreNullFields=False)
    source = session.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_millis(F.col("ms") + 10**9))
    state.run_split_state(state.stream_run_state(source), f"{tmp_path}/states", f"{tmp_path}/refused", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/refused").collect()) == [0, 2, 3, 4, 8]
    last = spark.read.parquet(f"{tmp_path}/states").orderBy(F.desc("seq")).first()
    assert json.loads(last.state) == {"goal": "g", "stage": "b", "lastError": None, "active": False, "stopRequested": True, "outcome": None}
