"""Keyed state of streams: stalls of runs, run records and the life of frame tokens.

Each processor keeps typed state by key and an event-time timer; events of a key are taken in their own order, and deadlines that
a later event has passed count before it, so that what comes out does not depend on where a batch ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hushframe.operators.runs import STALL_REPEATS

KEPT = max(p * r for p, r in STALL_REPEATS.items())
#: How late events may come, and how long after its last event the state of a run is held.
LATE, IDLE_MS = "1 hour", 24 * 3600 * 1000
#: A frame announces its token for so long, and a report is waited for so long after the token is acknowledged.
ANNOUNCED_MS, REPORT_MS = 6000, 3000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, as typed state needs; spark's own settings stay."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    return session


class Keyed(StatefulProcessor):
    """Rows of a key, and one timer for each key with state. A call to the state store costs more than the work on a row, so that
    state is read once and what has changed is written once for a key's rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def close(self) -> None:
        pass

    def _due(self, at: int, had_state: bool) -> None:
        """The key's only timer is at that time; a key without state has none yet."""
        old = list(self.handle.listTimers()) if had_state else []
        for t in old:
            if t != at:
                self.handle.deleteTimer(t)
        if at not in old:
            self.handle.registerTimer(at)

    def _idle(self, rows: list[Row], timerValues, had_state: bool) -> None:
        self._due(max(max(r.us for r in rows) // 1000, timerValues.getCurrentWatermarkInMs()) + IDLE_MS, had_state)


def timed(rows: DataFrame, late: str) -> DataFrame:
    """rows with the watermark on ts, and us, the microseconds of ts. Rows without a time are taken as the oldest."""
    return rows.withWatermark("ts", late).withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(0)))


def repeated_period(recent: list[str]) -> int | None:
    """The shortest period with which the last signatures repeat often enough."""
    for p, r in sorted(STALL_REPEATS.items()):
        if len(recent) >= p * r and all(recent[-k] == recent[-k - p] for k in range(1, p * (r - 1) + 1)):
            return p
    return None


class Stalls(Keyed):
    """recent: a list of the last signatures; run: the last step, and whether the run has stalled already."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent, self.run = handle.getListState("recent", "sig string"), handle.getValueState("run", "last long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, out, batch = self.run.get(), [], sorted(rows, key=lambda r: r.step)
        last, stopped = held or (-1, False)
        known = recent = [s for (s,) in self.recent.get()] if held else []
        for r in batch:
            if stopped or r.step <= last:
                continue
            last, recent = r.step, [*recent, r.sig][-KEPT:]
            if p := repeated_period(recent):
                stopped = True
                out.append(Row(run_id=key[0], step=last, period=p))
        if held != (last, stopped):
            self.run.update((last, stopped))
        if recent != known:
            self.recent.put([(s,) for s in recent])
        self._idle(batch, timerValues, held is not None)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        self.recent.clear()
        yield from ()


def stream_stalls(actions: DataFrame) -> DataFrame:
    """(run_id, step, period) once per run, when it first stalls; a run's later actions and ones below its last step are ignored.

    actions: run_id, step, action, target_id, value and ts, the event's time, of a stateful_session. The state of a run is given up once
    the watermark, LATE behind the newest event, is IDLE_MS past its last one.
    """
    sig = F.concat_ws(":", F.coalesce("action", F.lit("")), F.coalesce("target_id", F.lit("")), F.coalesce("value", F.lit("")))
    rows = actions.where("action <> 'done'").select("run_id", "step", "ts", sig.alias("sig"))
    return timed(rows, LATE).groupBy("run_id").transformWithState(Stalls(), "run_id long, step long, period int", "Append", "EventTime")


class Runs(Keyed):
    """fields: a run's fields by name, as JSON; a field that was cleared holds null."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "name string", "value string")

    @staticmethod
    def _applied(state: dict, text: str | None) -> dict | None:
        """The fields after the patch; null if it is refused: it is no object, or no run is active and it starts none."""
        try:
            patch = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(patch, dict):
            return None
        kind = patch.pop("kind", "progress")
        if kind == "start":
            return {**patch, "active": True, "stopRequested": False}
        if not state.get("active"):
            return None
        if kind == "stop":
            return {**state, "stopRequested": True}
        if kind == "finish":
            return {**state, **patch, "outcome": patch.get("outcome", state.get("outcome")), "active": False}
        return {**state, **patch}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch, out = sorted(rows, key=lambda r: r.seq), []
        held = {k: v for (k,), (v,) in self.fields.iterator()} if self.fields.exists() else {}
        state = {k: json.loads(v) for k, v in held.items()}
        for r in batch:
            after = self._applied(state, r.patch)
            if after is None:
                out.append(Row(run_id=key[0], kind="refused", seq=r.seq, state=r.patch))
            else:
                state = after
        if state:
            kept = {k: json.dumps(v) for k, v in state.items()}
            for name in held.keys() - kept.keys():
                self.fields.removeKey((name,))
            for name, value in kept.items():
                if held.get(name) != value:
                    self.fields.updateValue((name,), (value,))
            out.append(Row(run_id=key[0], kind="state", seq=batch[-1].seq, state=json.dumps(state, sort_keys=True)))
            self._idle(batch, timerValues, bool(held))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.fields.clear()
        yield from ()


def stream_run_state(patches: DataFrame) -> DataFrame:
    """(run_id, kind, seq, state) of patches (run_id, seq, ts, patch), of a stateful_session: after each batch a run's state, and each refused patch as it came.

    start opens a run, stop marks an active one, finish ends it and keeps an outcome set before, others change it; an absent key keeps a
    field, a null clears it. A patch without an active run, one that is no JSON object and a null one are refused; no patch stops the
    stream. A run that was never started has no state.
    """
    rows = timed(patches.select("run_id", "seq", "ts", "patch"), LATE)
    return rows.groupBy("run_id").transformWithState(Runs(), "run_id long, kind string, seq long, state string", "Append", "EventTime")


class Tokens(Keyed):
    """life: when a token was first announced and acknowledged, how often it was announced until then, and whether its frame was merged."""

    NAMES = ("page_id", "token", "announced", "frame_id", "redact_whole", "reason")
    RANK = {"announce": 0, "ack": 1, "report": 2, "detach": 3}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getValueState("life", "first long, acked long, announced int, merged boolean")

    @staticmethod
    def _deadline(first: int, acked: int | None, merged: bool) -> int:
        return first + ANNOUNCED_MS if merged or acked is None else acked + REPORT_MS

    @classmethod
    def _told(cls, *values) -> Row:
        return Row(**dict(zip(cls.NAMES, values, strict=True)))

    @classmethod
    def _expired(cls, key: tuple, acked: int | None, announced: int) -> Row:
        return cls._told(*key, announced, None, True, "never_acknowledged" if acked is None else "report_timeout")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = life = self.life.get()
        out = []
        for r in sorted(rows, key=lambda r: (r.us, self.RANK[r.kind])):
            now, kind = r.us // 1000, r.kind
            if life is not None and now > self._deadline(life[0], life[1], life[3]):
                if not life[3]:
                    out.append(self._expired(key, life[1], life[2]))
                life = None
            if kind == "announce":
                life = (now, None, 1, False) if life is None else (life[0], life[1], life[2] + 1, life[3]) if life[1] is None else life
            elif life is None or life[3]:
                continue
            elif kind == "ack":
                life = (life[0], now, life[2], False) if life[1] is None else life
            elif kind == "detach":
                out.append(self._told(*key, life[2], None, True, "detached"))
                life = None
            elif kind == "report" and life[1] is not None:  # without an acknowledged token a report counts for nothing
                out.append(self._told(*key, life[2], r.frame_id, False, None))
                life = (*life[:3], True)
        old, new = (None if x is None else self._deadline(x[0], x[1], x[3]) for x in (held, life))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if life is None and held is not None:
            self.life.clear()
        elif life is not None and life != held:
            self.life.update(life)
        if new is not None and new != old:
            self.handle.registerTimer(new)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        life = self.life.get()
        self.life.clear()
        if life is not None and not life[3]:
            yield self._expired(key, life[1], life[2])


def stream_token_life(events: DataFrame, late: str = "6 seconds") -> DataFrame:
    """(page_id, token, announced, frame_id, redact_whole, reason) of events (page_id, token, ts, kind, frame_id), of a stateful_session.

    kind: announce, repeated by a frame until its token is acknowledged (ack); report, by which the frame is merged if it comes within
    REPORT_MS of that; detach, which purges the token. A frame that is not merged is redacted whole: its token was never acknowledged within
    ANNOUNCED_MS, its report came late or not at all, or its element was detached. A token that is announced again after that begins anew.
    Rows without page, token or a known kind are left out.
    """
    known = events.where("page_id is not null and token is not null").where(F.col("kind").isin(*Tokens.RANK))
    rows = known.select("page_id", "token", "ts", "kind", F.col("frame_id").cast("long").alias("frame_id"))
    return timed(rows, late).groupBy("page_id", "token").transformWithState(Tokens(), "page_id long, token string, announced int, frame_id long, redact_whole boolean, reason string", "Append", "EventTime")


def run_split_state(states: DataFrame, state_folder: str, refused_folder: str, checkpoint: str):
    """Started stream of stream_run_state into two sinks, a folder for each batch's number, so that a batch that is run again replaces itself."""
    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("kind = 'state'").drop("kind").write.mode("overwrite").parquet(f"{state_folder}/batch={number}")
        batch.where("kind = 'refused'").select("run_id", "seq", F.col("state").alias("patch")).write.mode("overwrite").parquet(f"{refused_folder}/batch={number}")
        batch.unpersist()

    return states.writeStream.foreachBatch(split).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
