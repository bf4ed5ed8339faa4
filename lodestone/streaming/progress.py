"""Progress of tasks: batch definitions, and the same kept as state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TERMINAL

#: Stages and the default description of each.
STAGES = ("upload", "register", "download", "hash", "duplicate", "parse", "cleanse", "anonymize", "chunk", "summarize", "filter", "embed", "insert", "index", "complete")
STATE_TTL_S, HEARTBEAT_TTL_S = 14_400, 30


def latest(events: DataFrame, by: list[str], order: str = "event_id") -> DataFrame:
    """The last event of each key (max_by: combined before the shuffle)."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("ts", order)).alias("s")).select(*by, "s.*")


def _running(events: DataFrame, by: list[str], now: int | None, ttl: int) -> DataFrame:
    """The last events of tasks whose state is not terminal; at `now`, those of groups heard of within the ttl.

    Any event of a group, a terminal one too, keeps all its running tasks for another ttl.
    """
    last = latest(events, [*by, "task_id"]).where(~F.col("status").isin(*TERMINAL))
    if now is None:
        return last
    alive = events.groupBy(*by).agg(F.max("ts").alias("_seen")).where(F.col("_seen") >= now - ttl)
    return last.join(alive, by, "left_semi")


def running_by_user(events: DataFrame, now: int | None = None, ttl: int = STATE_TTL_S) -> DataFrame:
    """(user_id, tasks): tasks of each user whose last state is not terminal; at `now`, of users heard of within the ttl."""
    last = _running(events, ["user_id"], now, ttl)
    return last.groupBy("user_id").agg(F.array_sort(F.collect_set("task_id")).alias("tasks"))


def running_by_category(events: DataFrame, now: int | None = None, ttl: int = STATE_TTL_S) -> DataFrame:
    """(user_id, category, tasks); events with an empty category do not count. At `now`, of pairs heard of within the ttl."""
    some = events.where("category is not null and category != ''")
    last = _running(some, ["user_id", "category"], now, ttl)
    return last.groupBy("user_id", "category").agg(F.array_sort(F.collect_set("task_id")).alias("tasks"))


def liveness(events: DataFrame, now: int, ttl: int = HEARTBEAT_TTL_S) -> DataFrame:
    """(task_id, active): heard of within the ttl, or the last state not terminal."""
    last = latest(events, ["task_id"])
    return last.select("task_id", ((F.lit(now) - F.col("ts") <= ttl) | ~F.col("status").isin(*TERMINAL)).alias("active"))


def described(events: DataFrame, names: DataFrame) -> DataFrame:
    """events with the description of their stage and status; names (stage, status, description) has a row for each pair."""
    from ..operators.joins import small

    out = events.join(small(names), ["stage", "status"], "left")
    return out.withColumn("description", F.coalesce("description", F.concat_ws(" ", "stage", "status")))


def latest_stream(events: DataFrame, by: str = "task_id", ttl_s: int = STATE_TTL_S) -> DataFrame:
    """A stream of the latest state of each key, kept in RocksDB state that expires after ttl_s seconds without an event.

    events: a stream with by, status, ts (epoch seconds), event_id. Emits a key's state whenever it changes.
    Needs the RocksDB state store provider, in processing time.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Latest(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("latest", "status string, ts long, event_id long", ttl_s * 1000)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            old = self.state.get() if self.state.exists() else None
            best = tuple(old) if old is not None else None
            for pdf in rows:
                top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
                got = (top.status, int(top.ts), int(top.event_id))
                if best is None or got[1:] > tuple(best[1:]):
                    best = got
            if best is not None and (old is None or tuple(old) != best):
                self.state.update(best)
                yield pd.DataFrame({by: [key[0]], "status": [best[0]], "ts": [best[1]], "event_id": [best[2]]})

        def close(self) -> None:
            pass

    return events.groupBy(by).transformWithStateInPandas(Latest(), f"{by} string, status string, ts long, event_id long", "Update", "ProcessingTime")


def running_stream(events: DataFrame, by: list[str], ttl_s: int = STATE_TTL_S) -> DataFrame:
    """A stream of the running tasks of each group (by: user_id, or user_id and category), as (by..., tasks array<string>).

    A task enters with an event and leaves with a terminal one; events older than the last of their task are passed over.
    Each event keeps a group's tasks for another ttl_s seconds of processing time. With category in by, events without one
    do not count. Emits a group's set whenever it changes. Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    class Running(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getMapState("tasks", "task_id string", "status string, ts long, event_id long", ttl_s * 1000)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            tasks = {k[0]: tuple(v) for k, v in self.state.iterator()}
            was = sorted(t for t, v in tasks.items() if v[0] not in TERMINAL)
            for pdf in rows:
                for task, status, ts, event in zip(pdf.task_id, pdf.status, pdf.ts, pdf.event_id, strict=True):
                    if task not in tasks or (int(ts), int(event)) > tasks[task][1:]:
                        tasks[task] = (status, int(ts), int(event))
            for task, value in tasks.items():  # every event renews the whole group
                self.state.updateValue((task,), value)
            now = sorted(t for t, v in tasks.items() if v[0] not in TERMINAL)
            if now != was:
                yield pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "tasks": [now]})

        def close(self) -> None:
            pass

    some = events.where("category is not null and category != ''") if "category" in by else events
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", tasks array<string>"
    return some.groupBy(*by).transformWithStateInPandas(Running(), schema, "Update", "ProcessingTime")


def listener_stream(events: DataFrame, snapshot: DataFrame, by: str = "user_id") -> DataFrame:
    """What the listener of each group is sent: (by, kind, task_id, stage, status), kind being snapshot, delta or end.

    snapshot (by, task_id, stage, status, ts, event_id): the latest state of every task when the listeners connect. Its
    running tasks come first; then each newer state of a task, the last of a micro-batch; `end` when none of the group's
    tasks runs any more, after which nothing more is sent. A group that has no running task at first ends at once.
    Needs the RocksDB state store provider, in processing time.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kind = events.schema[by].dataType.simpleString()

    class Listener(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.tasks = handle.getMapState("tasks", "task_id string", "stage string, status string, ts long, event_id long")
            self.sent = handle.getValueState("sent", "said string")  # what was last said besides deltas: nothing, snapshot or end

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for r in initialState.itertuples():
                self.tasks.updateValue((r.task_id,), (r.stage, r.status, int(r.ts), int(r.event_id)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)  # a group without events is told its snapshot, too

        def _rows(self, key, rows):
            import pandas as pd

            return pd.DataFrame([(key[0], *r) for r in rows], columns=[by, "kind", "task_id", "stage", "status"])

        def _said(self) -> str:
            return self.sent.get()[0] if self.sent.exists() else ""

        def _snapshot(self) -> list:
            self.sent.update(("snapshot",))
            return [("snapshot", t[0], v[0], v[1]) for t, v in sorted(self.tasks.iterator()) if v[1] not in TERMINAL]

        def _end(self) -> list:
            if any(v[1] not in TERMINAL for _, v in self.tasks.iterator()):
                return []
            self.sent.update(("end",))
            return [("end", None, None, None)]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self._said():
                yield self._rows(key, self._snapshot() + self._end())

        def handleInputRows(self, key, rows, timerValues):
            out = [] if self._said() else self._snapshot()
            newest = {}
            for pdf in rows:
                for r in pdf.itertuples():
                    got = (r.stage, r.status, int(r.ts), int(r.event_id))
                    old = newest.get(r.task_id) or (tuple(self.tasks.getValue((r.task_id,))) if self.tasks.containsKey((r.task_id,)) else None)
                    if old is None or got[2:] > old[2:]:
                        newest[r.task_id] = got
            for task, value in sorted(newest.items()):
                self.tasks.updateValue((task,), value)
                if self._said() != "end":
                    out.append(("delta", task, value[0], value[1]))
            if self._said() != "end":
                out += self._end()
            if out:
                yield self._rows(key, out)

        def close(self) -> None:
            pass

    some = events.select(by, "task_id", "stage", "status", "ts", "event_id")
    first = snapshot.select(by, "task_id", "stage", "status", "ts", "event_id").groupBy(by)
    schema = f"{by} {kind}, kind string, task_id string, stage string, status string"
    return some.groupBy(by).transformWithStateInPandas(Listener(), schema, "Append", "ProcessingTime", initialState=first)


def liveness_stream(events: DataFrame, ttl_s: int = HEARTBEAT_TTL_S) -> DataFrame:
    """(task_id, active) whenever it changes: a task is active while its last state is not terminal or it was heard of within
    ttl_s seconds of processing time; a timer says so when that time is over, without any event. Needs the RocksDB state store provider."""
    from pyspark.sql.streaming import StatefulProcessor

    class Alive(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("last", "status string, ts long, event_id long, active boolean, until long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            old = tuple(self.state.get()) if self.state.exists() else None
            best = old[:3] if old else None
            for pdf in rows:
                for r in pdf.itertuples():
                    got = (r.status, int(r.ts), int(r.event_id))
                    best = got if best is None or got[1:] > best[1:] else best
            until = timerValues.getCurrentProcessingTimeInMs() + ttl_s * 1000
            if old and old[4]:
                self.handle.deleteTimer(old[4])
            self.handle.registerTimer(until)
            self.state.update((*best, True, until))
            if not old or not old[3]:
                yield pd.DataFrame({"task_id": [key[0]], "active": [True]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            status, ts, event, active, _ = self.state.get()
            if status in TERMINAL and active:
                self.state.update((status, ts, event, False, 0))
                yield pd.DataFrame({"task_id": [key[0]], "active": [False]})

        def close(self) -> None:
            pass

    return events.select("task_id", "status", "ts", "event_id").groupBy("task_id").transformWithStateInPandas(Alive(), "task_id string, active boolean", "Update", "ProcessingTime")


def reaper_stream(jobs: DataFrame, pending_s: int, running_s: int) -> DataFrame:
    """(id, status, error_message, completed_at): jobs that a timer fails, as the batch definition `reap` would.

    jobs: a stream of the states of jobs (id, status, event_id). One that is pending for pending_s seconds of processing time
    after its first pending state, or running for running_s after its first running one, without coming further, is failed.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kind = jobs.schema["id"].dataType.simpleString()
    limits = {"pending": (pending_s, "not started in time"), "running": (running_s, "not completed in time")}

    class Reaper(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("job", "status string, event_id long, until long")

        def handleInputRows(self, key, rows, timerValues):
            old = tuple(self.state.get()) if self.state.exists() else None
            best = old[:2] if old else None
            for pdf in rows:
                for r in pdf.itertuples():
                    best = (r.status, int(r.event_id)) if best is None or int(r.event_id) > best[1] else best
            if old is None or best[0] != old[0]:
                if old and old[2]:
                    self.handle.deleteTimer(old[2])
                until = timerValues.getCurrentProcessingTimeInMs() + limits[best[0]][0] * 1000 if best[0] in limits else 0
                if until:
                    self.handle.registerTimer(until)
                self.state.update((*best, until))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            status, event, _ = self.state.get()
            if status in limits:
                self.state.update(("failed", event, 0))
                yield pd.DataFrame({"id": [key[0]], "status": ["failed"], "error_message": [limits[status][1]], "completed_at": [timerValues.getCurrentProcessingTimeInMs() // 1000]})

        def close(self) -> None:
            pass

    schema = f"id {kind}, status string, error_message string, completed_at long"
    return jobs.select("id", "status", "event_id").groupBy("id").transformWithStateInPandas(Reaper(), schema, "Update", "ProcessingTime")


def write_latest(events: DataFrame, path: str, checkpoint: str, by: list[str]):
    """Starts a stream that appends the latest state of each key of a micro-batch under its batch id, written at most once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        latest(batch, by).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
